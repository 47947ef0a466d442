"""Brute-force versions that the operators are held against, and small awkward tables."""

import re

import numpy as np
import xxhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
#: columns that a careless operator would mix up with its own
CLASH = ("score", "predicted", "h", "n", "_h", "_id", "label", "key", "anchor", "node", "root", "shard", "slot", "ids",
         "_n", "_ch", "_cn", "_slot", "_shard", "_at", "cut", "row", "cut_h", "owned", "rep", "vector", "sig", "fp", "component_id")

AWKWARD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t", None, "a", 5), (4, "ab", "en", None, 2),
    (5, "the same words again and again " * 30, "en", "a", 930), (6, "the same words again and again " * 30, "en", "b", 930),
    (6, "the same words again and again " * 30, "en", "b", 930), (7, "x" * 50_000, "de", "a", 50_000),
    (8, "wort für wort ganz äöü ß " * 2000, "de", "a", 50_000), (9, "?! 123 --", "fr", "a", 9), (None, "no id here", "en", "a", 10),
    (10, "日本語 текст mixed é́ \U0001f642", "de", "a", 20), (11, "THE SAME WORDS AGAIN AND AGAIN " * 30, "en", "a", 930),
]


def clashing(df):
    from pyspark.sql import functions as F

    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df


def spread(n, pairs):
    """Component of each of n nodes: its smallest member."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def simhash(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[k:k + words]) for k in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def cut(texts, length):
    """(bytes left, spans) of each text without the bytes of strings that also start elsewhere."""
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k:k + length]] = seen.get(t[k:k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((np.frombuffer(t, np.uint8)[~gone].tobytes(),
                    list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))))
    return out


def part_distance(pattern, text):
    """Fewest edits that turn pattern into a part of text."""
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def periodic(words, min_length=12):
    """(start, length, period) of every maximal run, by start and period."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        low = 0
        while low < n - p:
            high = low
            while high < n - p and words[high] == words[high + p]:
                high += 1
            if high - low + p >= max(min_length, 2 * p):
                out.setdefault((low, high - low + p), p)
            low = high + 1
    return sorted(((a, size, p) for (a, size), p in out.items()), key=lambda r: (r[0], r[2]))
