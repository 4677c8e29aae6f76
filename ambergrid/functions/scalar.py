"""Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """0/1 flag; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least/greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def weekday(ts: Column) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return flag(F.weekday(ts) >= 5)


def is_night(ts: Column) -> Column:
    hour = F.hour(ts)
    return flag((hour >= 22) | (hour <= 6))


def is_risky_hour(ts: Column) -> Column:
    return flag(F.hour(ts).between(0, 5))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start_us: Column, end_us: Column) -> Column:
    """Seconds with fractions between two microsecond counts."""
    return (end_us - start_us) / F.lit(1e6)


def lookup(key: Column, table: Mapping[str, int]) -> Column:
    """Value of a small fixed table; keys that are not in it give NULL."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def route(value: Column, limits: Sequence[tuple[float, str]], default: str) -> Column:
    """First route whose limit the value exceeds; limits are tried in the given order."""
    chain = None
    for limit, name in limits:
        chain = F.when(value > limit, name) if chain is None else chain.when(value > limit, name)
    return F.lit(default) if chain is None else chain.otherwise(default)


#: Duration units and their length in milliseconds.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: Column) -> Column:
    """Milliseconds of a literal such as '500ms', '10s', '30m' or '2h'; else NULL."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)\s*$"
    amount = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return amount.cast("double") * lookup(F.regexp_extract(text, pattern, 2), UNIT_MS)


def hash_order(key: Column, seed: int) -> Column:
    """60-bit number from md5(key, seed): a repeatable random order of the keys."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(str(seed))))
    # Never NULL, so that no filter evaluates it a second time.
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def uniform(key: str, seed: int, tag: str) -> Column:
    """A number in [0, 1) that depends only on the key, the seed and the tag."""
    mixed = F.xxhash64(F.col(key), F.lit(seed), F.lit(tag))
    return F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))


def money(value: Column) -> Column:
    return F.format_string("%.2f", value)


def money_grouped(value: Column) -> Column:
    """Two decimals with thousands separators, as in '1,234.50'."""
    return F.format_number(value, 2)
