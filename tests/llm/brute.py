"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def secret_spans(text: str | None):
    patterns = {
        "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    out = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if least[kind](m)]
    return out


def luhn(digits: str) -> bool:
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def personal_spans(text: str | None):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    out = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return out


def tokens(encode, rows, end=2):
    """[(doc_id, start, n_tokens, crc)] in ascending order, null ids first and equal ids by text."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*encode(text or ""), end]
        out.append((doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def contaminated(text: str | None, benchmark):
    """(n_words, n_hit, item ids): every window looked for at every place."""
    windows = defaultdict(set)
    for item, item_text in benchmark:
        words = ALNUM.findall(low(item_text))
        for k in range(max(1, len(words) - 9)) if words else ():
            windows[tuple(words[k:k + 10])].add("" if item is None else str(item))
    words, hit, items = ALNUM.findall(low(text)), set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if found := windows.get(tuple(words[k:k + n])):
                hit |= set(range(k, k + n))
                items |= found
    return len(words), len(hit), sorted(items)


def shingles(text: str | None) -> frozenset:
    words = NOT_SPACE.findall(low(text))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 3]) for k in range(len(words) - 2))


def near_components(rows):
    """doc_id -> (size of its set, smallest doc_id reachable), all pairs compared; distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def quality(text: str | None):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = NOT_SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if NOT_SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), n < 50 or 100 * len(again) > 50 * n


def deleted_lines(rows, least=2):
    """[(doc_id, n_lines, n_deleted)] of rows in their order: lines in a window that stands, without overlap, earlier."""
    texts = [(t or "").split("\n") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    first, out = {}, {}
    for at, k in enumerate(order):
        lines, gone = texts[k], set()
        for p in range(len(lines) - least + 1):
            window = tuple(lines[p:p + least])
            if window not in first:
                first[window] = (at, p)
            elif first[window][0] < at or first[window][1] + least <= p:
                gone |= set(range(p, p + least))
        out[k] = (rows[k][0], len(lines), len(gone))
    return [out[k] for k in range(len(rows))]


def line_copies(texts):
    """{(text, pos): (length, of_text, of_pos)}: the longest run of lines shared with an earlier place, and the first such place."""
    lines = [t.split("\n") for t in texts]
    places = [(k, p) for k, x in enumerate(lines) for p in range(len(x))]
    out = {}
    for n, (k, p) in enumerate(places):
        best = (0, 0, 0)
        for j, q in places[:n]:
            length = 0
            while p + length < len(lines[k]) and q + length < len(lines[j]) and lines[k][p + length] == lines[j][q + length]:
                length += 1
            if length > best[0]:
                best = (length, j, q)
        if best[0]:
            out[k, p] = best
    return out


def removed(texts, width=35):
    """[(n_words, n_removed, digest of the kept words)]: every window of every text counted."""
    words = [NOT_SPACE.findall(t or "") for t in texts]
    often = Counter(tuple(w[k:k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if often[tuple(w[k:k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def runs(x, times=4, least=6):
    """[(start, length, period)]: every lag tried at every place."""
    out = set()
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            part = x[i:j + q]
            if len(part) >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.add((i, len(part), q))
            i = max(j, i) + 1
    return sorted(out)


def periodic(doc_id, text):
    """The row of one document: n_runs, the strongest run, its exponent, both digests."""
    x = NOT_SPACE.findall(text or "")
    n = len(x)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    found = runs(x)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(x) if i not in gone)))


def lloyd(vectors, clusters=8, rounds=10, components=64):
    """[(vec_id, cluster, distance)] of the usable vectors in their order, and the centroids, in Python integers."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in vectors if v is not None and len(v) == components and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted((sha(f"3:{'' if i is None else i}"), v) for i, v in kept)[:clusters]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            if own := [v for (_, v), label in zip(kept, labels) if label == k]:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids
