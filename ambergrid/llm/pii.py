"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a small local parser expands to both sides and
validates what it finds. Every parser reads each character a bounded number of times,
so texts of any length take linear time.

The base kinds follow these patterns, leftmost and non-overlapping per kind:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts up to 255; card
``[0-9]([\\x20-]?[0-9])+`` with 12 to 19 digits and a Luhn checksum; phone
``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits.

Defined results: NULL and empty texts have no spans; offsets are code points, end exclusive.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["login", "account", "identity", "secret"]
KINDS = BASE_KINDS + ADDED_KINDS
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
DOMAIN = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SECRET = ALNUM | frozenset("_-./+=")

#: Words that announce an identifier, and the parser for what follows.
CUES = {
    "account": ["iban", "account", "acct"],
    "identity": ["ssn", "social security", "passport"],
    "secret": ["token", "secret", "password", "passwd", "api_key", "api key", "apikey"],
}


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("login", 3))
    for digit in DIGITS:
        found.add_word(digit, ("number", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_end(text: str, start: int, allowed: frozenset) -> int:
    end, size = start, len(text)
    while end < size and text[end] in allowed:
        end += 1
    return end


def domain_end(text: str, start: int) -> int:
    """End of labels joined by dots, or ``start`` if there are fewer than two."""
    end = run_end(text, start, DOMAIN)
    if end == start:
        return start
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DOMAIN:
        end = run_end(text, end + 1, DOMAIN)
        labels += 1
    return end if labels > 1 else start


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def digit_chain(text: str, start: int, joints: str) -> list[tuple[int, int]]:
    """Runs of digits from ``start`` on, each one joint character apart."""
    runs, size = [], len(text)
    while True:
        end = run_end(text, start, DIGITS)
        runs.append((start, end))
        if end + 1 < size and text[end] in joints and text[end + 1] in DIGITS:
            start = end + 1
        else:
            return runs


def octets(text: str, runs: list[tuple[int, int]]) -> bool:
    for start, end in runs:
        part = text[start:end].lstrip("0")
        if len(part) > 3 or int(part or "0") > 255:
            return False
    return True


def iban(text: str, start: int) -> int:
    """End of an IBAN that begins at ``start``, or ``start``."""
    compact, end, size = "", start, len(text)
    best = start
    while end < size and len(compact) < 34:
        char = text[end]
        if char in DIGITS or char in UPPER:
            compact += char
            end += 1
            if len(compact) >= 15 and not (end < size and text[end] in ALNUM):
                turned = compact[4:] + compact[:4]
                if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                    best = end
        elif char == " " and compact and text[end - 1] != " ":
            end += 1
        else:
            break
    head = text[start : start + 4]
    return best if len(head) == 4 and head[:2].isalpha() and head[2:].isdigit() else start


def after_cue(text: str, end: int) -> int:
    """First character behind a cue's separators, or -1 when letters follow directly."""
    size, start = len(text), end
    while end < size and end - start < 16 and text[end] in " \t:=#\"'.":
        end += 1
    return end if end > start and end < size else -1


def cued(text: str, kind: str, start: int) -> int:
    """End of the value of ``kind`` at ``start``, or ``start`` if it is not valid."""
    if kind == "account":
        end = iban(text, start)
        if end > start:
            return end
        end = run_end(text, start, DIGITS)
        return end if 8 <= end - start <= 17 and not (end < len(text) and text[end] in ALNUM) else start
    if kind == "identity":
        runs = digit_chain(text, start, "-") if text[start] in DIGITS else []
        if [e - s for s, e in runs] == [3, 2, 4] and text[start : start + 3] not in ("000", "666"):
            return runs[-1][1]
        end = run_end(text, start, DIGITS | UPPER)
        digits = sum(c in DIGITS for c in text[start:end])
        return end if 8 <= end - start <= 9 and digits >= 6 else start
    end = run_end(text, start, SECRET)
    value = text[start:end]
    mixed = any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
    return end if end - start >= 16 and mixed else start


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base), by start, then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int, bool]] = []
    size = len(text)
    mail_end = dotted_end = card_end = 0
    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if kind == "number":
            if at >= dotted_end:
                runs = digit_chain(text, at, ".")
                dotted_end = runs[-1][1]
                for first in range(0, len(runs) - 3, 4):
                    four = runs[first : first + 4]
                    if octets(text, four):
                        found.append(("ip", four[0][0], four[3][1], True))
            if at >= card_end:
                runs = digit_chain(text, at, " -")
                card_end = runs[-1][1]
                length = sum(e - s for s, e in runs)
                if 12 <= length <= 19 and luhn("".join(text[s:e] for s, e in runs)):
                    found.append(("card", at, card_end, True))
        elif kind == "email":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            end = domain_end(text, at + 1)
            if start < at and end > at + 1:
                mail_end = end
                found.append(("email", start, end, True))
        elif kind == "phone":
            if at + 1 < size and text[at + 1] in DIGITS:
                end = run_end(text, at + 2, PHONE)
                while end > at + 3 and text[end - 1] not in DIGITS:
                    end -= 1
                if end > at + 3 and 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    found.append(("phone", at, end, True))
        elif kind == "login":
            start = at
            while start > 0 and at - start < 16 and text[start - 1] in ALNUM:
                start -= 1
            user = run_end(text, last + 1, LOCAL | frozenset(":"))
            if start < at and last + 1 < user < size and text[user] == "@":
                end = domain_end(text, user + 1)
                if end > user + 1:
                    found.append(("login", start, end, False))
        elif at == 0 or text[at - 1] not in ALNUM:
            start = after_cue(text, last + 1)
            end = cued(text, kind, start) if start >= 0 else start
            if end > start:
                found.append((kind, start, end, False))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: [dict(zip(("kind", "start", "end", "base"), s)) for s in scan(t)]
    )


def pii_spans(text: Column) -> Column:
    """Array of spans (kind, start, end, base) of a text column."""
    return F.pandas_udf(_spans, SPANS)(text)


def cover(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlaps merge into one."""
    spans = scan(text)
    if not spans:
        return text
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:start], f"[{kind.upper()}]"]
        done, k = end, k + 1
    return "".join([*out, text[done:]])


def _cover(texts: pd.Series) -> pd.Series:
    return texts.map(cover, na_action="ignore")


def redacted(text: Column) -> Column:
    """Texts without their personal data; NULL stays NULL."""
    return F.pandas_udf(_cover, "string")(text)


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))),
        ",",
    )
