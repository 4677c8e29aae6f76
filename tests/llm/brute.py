"""Plain versions of the operators, for small inputs."""

import collections
import fractions
import hashlib
import html
import math
import re
import zlib

import numpy as np

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def groups(ids, links):
    """Smallest id reachable from each id."""
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def shingle_set(text, width):
    found = SPACED.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    if len(found) < width:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def jaccard(docs, width, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    best = groups(ids, links)
    return {i: (len(sets[i]), best[i]) for i in ids}


def repeats(texts, span):
    """(n_bytes, n_removed, n_spans, kept digest) per text."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i : i + span] for raw in raws for i in range(len(raw) - span + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if seen[raw[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def personal(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def phrases(text, known):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in known.items():
        part = phrase.split()
        places += [(i, label) for i in range(len(found) - len(part) + 1) if found[i : i + len(part)] == part]
    return len(found), sorted(places)


def statistics(text):
    text = text or ""
    found = SPACED.findall(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def targets(sizes, weights=(5, 2, 1)):
    """Target per source by repeated sharing; ``sizes`` in the order of the sources."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 3 * sizes[k] + 1e-9]
        if not over:
            for k in free:
                target[k] = weight[k] * level
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            free.discard(k)
    return target


def article(page):
    """Text of a page whose only content is an article of headings and paragraphs."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|article)>", inner)
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return " ".join(t for t in texts if t)


def periodic_runs(words, least=24, times=3):
    """All runs (start, length, period) by comparing words q apart, for every q."""
    found = []
    for q in range(1, len(words) // times + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            part = words[start : start + q]
            if length >= max(least, times * q) and all(part != part[d:] + part[:d] for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(key, words):
    """The words after the contract's rule, which repeats a part in one text of ten."""
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_row(key, text):
    """The row of op13 for one document, without its id."""
    words = planted(key, SPACED.findall(text or ""))
    runs = periodic_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def one_error(a, b):
    """Whether the strings differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def spelling(docs, every=199, least=6, times=5, ratio=5):
    """word -> (form, root, n, n_near, form_n) over all pairs of words."""
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    near = {w: [v for v in counts if one_error(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, counts[w], len(near[w]), counts[forms[w]] if forms[w] else None)
    return out


def benchmark_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contaminated(docs, items, window=10):
    """Per document: (n_words, n_hit, sorted names of items with occurring windows)."""
    windows = collections.defaultdict(set)
    for name, text in items:
        words = benchmark_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        words, hit, names = benchmark_words(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        out.append((len(words), len(hit), sorted(names)))
    return out


class KneserNey:
    """Interpolated Kneser-Ney over strings of symbols, from the definition."""

    def __init__(self, lines, order, uniform):
        self.order, self.uniform = order, uniform
        grams = collections.Counter(x[i : i + order] for x in lines for i in range(len(x) - order + 1))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):  # a lower order counts the different symbols before
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])

    def discount(self, k):
        found = collections.Counter(self.counts[k].values())
        return min(max(found[1] / max(found[1] + 2 * found[2], 1), 0.1), 0.9)

    def probability(self, context, symbol, k=None):
        k = self.order if k is None else k
        if k == 0:
            return self.uniform
        context = context[len(context) - k + 1 :]
        after = {g: n for g, n in self.counts[k].items() if g[:-1] == context}
        lower = self.probability(context, symbol, k - 1)
        if not after:
            return lower
        total, discount = sum(after.values()), self.discount(k)
        own = max(after.get(context + symbol, 0) - discount, 0) / total
        return own + discount * len(after) / total * lower

    def entropy(self, line):
        places = range(self.order - 1, len(line))
        return -sum(math.log2(self.probability(line[i - self.order + 1 : i], line[i])) for i in places) / len(places)


def robust_distances(texts, groups, core, cut, steps, least, consistency):
    """Squared robust distance per text (None if the base rules reject it), by plain matrices.

    ``groups`` are (language, source); small ones are pooled by language, then altogether.
    """
    rows = []
    for text in texts:
        n, chars, symbols, repeated, often = statistics(text)
        lines = len([x for x in (text or "").split("\n") if SPACED.search(x)])
        x = [math.log(max(chars, 1) / max(n, 1)), *(math.sqrt(a / max(b, 1)) for a, b in ((symbols, chars), (repeated, lines), (often, n)))]
        rows.append((n < 50 or 100 * often > 50 * n, np.floor(np.array(x) * 1000 + 0.5), np.array([chars, chars, lines, n], float)))
    good = [k for k, r in enumerate(rows) if not r[0]]
    sizes = collections.Counter(groups[k] for k in good)
    left = collections.Counter()
    for (lang, source), n in sizes.items():
        left[lang] += n if n < least else 0
    name = {g: ("own", g) if n >= least else ("lang", g[0]) if left[g[0]] >= least else ("rest",) for g, n in sizes.items()}
    pools = collections.defaultdict(list)
    for k in good:
        pools[name[groups[k]]].append(k)
    if 0 < len(pools.get(("rest",), [])) < least:
        judged = pools[("rest",)]
        pools[("rest",)] = good
    else:
        judged = pools.get(("rest",), [])
    out = [None] * len(texts)
    at_once = np.array([4, 1, 1, 6]) / 4

    def noise(n):
        value = at_once / np.maximum(n, 1.0)
        value[1:] = np.minimum(value[1:], 0.5 / cut)
        return np.maximum(value * 1e6, 1 / 12)

    for pool, members in pools.items():
        x = np.array([rows[k][1] for k in members])
        counted = np.array([rows[k][2] for k in members])
        mean = counted.mean(axis=0)
        floor = noise(mean)
        ordered = np.sort(x, axis=0)
        low, centre, high = (ordered[math.ceil(len(x) * q) - 1] for q in (0.25, 0.5, 0.75))
        scatter = np.diag(np.maximum(((high - low) / 1.349) ** 2, floor))

        def distances():
            row = np.array([noise(np.minimum(c, mean)) for c in counted])
            away = (x - centre) * np.sqrt(np.minimum(1.0, np.diag(scatter) / row))
            return np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter), away)

        for _ in range(steps):
            bucket = np.maximum(np.floor(np.log2(np.maximum(distances(), 2.0**-8)) * 8), -64)
            before = np.array([(bucket < b).sum() for b in bucket])
            near = x[before < core * len(x)]
            centre = near.mean(axis=0)
            scatter = (near.T @ near / len(near) - np.outer(centre, centre)) * consistency
            np.fill_diagonal(scatter, np.maximum(np.diag(scatter), floor))
        for k, d in zip(members, distances()):
            if pool != ("rest",) or k in set(judged):
                out[k] = d
    return out
