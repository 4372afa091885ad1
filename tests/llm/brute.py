"""Brute-force versions, as plain as can be."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, size=50):
    first = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = set()
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - size + 1):
            if first[tuple(own[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.add((d, len(own), len(gone), sha(kept)))
    return out


def simhash_value(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    value = 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    for bit in range(64):
        if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes):
            value |= 1 << bit
    return value


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def simhash(rows):
    values = {d: simhash_value(t) for d, t in rows}
    part = components(values, lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)
    return {(d, f"{v:016x}", part[d]) for d, v in values.items()}


def token_files(rows, tokenizer, end_id=1):
    import struct
    import zlib

    out, start = set(), 0
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.add((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def bpe(rows, tokenizer):
    out = set()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out.add((d, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def shingles(text, size=5):
    words = WORD.findall(text or "")
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """doc_id -> (text, edited text, next text)"""
    ordered = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 4
        out[d] = t, t[: len(t) - n] + following[:n], following
    return out


def article(html):
    """Main text of the pages of the given tables, whose article stands in one element."""
    from html import unescape

    found = re.search(r"<article>(.*?)</article>", html, re.S)
    blocks = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", found[1])
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    """Counts by kind and the list of base spans."""
    spans, counts = [], []
    for kind, pattern in PII.items():
        own = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                own.append(f"{kind}:{m.start()}:{m.end()}")
        spans += own
        counts.append(len(own))
    return (*counts, ",".join(spans))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines(rows, edits=2, least=16):
    """doc_id -> (n_lines, n_removed, n_links, kept sha)"""
    places = {}
    split = {d: (t or "").split("\n") for d, t in rows}
    for d in sorted(split):
        for i, line in enumerate(split[d]):
            if WORD.search(line):
                places.setdefault(line, (d, i))
    long = {x: None for x in places if len(x) >= least}
    by_length = {}
    for x in long:
        by_length.setdefault(len(x), []).append(x)
    links = {x: 0 for x in places}
    pairs = set()
    for n, own in by_length.items():
        for a in own:
            for m in range(n, n + edits + 1):
                for b in by_length.get(m, ()):
                    if (m > n or a < b) and near(a, b, edits):
                        pairs.add((a, b))
                        links[a] += 1
                        links[b] += 1
    parent = {x: x for x in places}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    first = {}
    for x, place in places.items():
        first[root(x)] = min(first.get(root(x), place), place)
    out = {}
    for d, own in split.items():
        solid = [i for i, x in enumerate(own) if WORD.search(x)]
        gone = {i for i in solid if first[root(own[i])] != (d, i)}
        kept = "\n".join(x for i, x in enumerate(own) if i not in gone)
        out[d] = len(solid), len(gone), sum(links[own[i]] for i in solid), sha(kept)
    return out


def near(a, b, edits):
    """Counters of letters first: they differ by at most two for each edit."""
    from collections import Counter

    x, y = Counter(a), Counter(b)
    if sum((x - y).values()) + sum((y - x).values()) > 2 * edits:
        return False
    return distance(a, b) <= edits


def plain(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))


def alignment(a, b):
    """Smith-Waterman score of two word lists."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best = max(best, max(new))
        row = new
    return best


def leaks(rows, items):
    out = set()
    known = [(i, plain(t)) for i, t in items]
    for d, t in rows:
        words = plain(t)
        have = set(words)
        for i, own in known:
            if own and 2 * sum(w in have for w in own) >= len(own):
                score = alignment(own, words) / (2 * len(own))
                if score >= max(0.5, 1 - 0.075 * (len(own) - 1)) - 1e-9:
                    out.add((d, i))
    return out


def near_copies(rows, least=0.8):
    """(doc_id, least doc_id reachable over pairs of texts with a five-word similarity of *least* or more)."""
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return components(sets, lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
