"""Small tables with awkward rows, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(n, seed=0):
    """``n`` words, rarely two the same."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join("bdfgklmnprstvz"[(x >> (8 + 6 * k)) % 14] + "aeiou"[(x >> (40 + 4 * k)) % 5] for k in range(3)))
    return " ".join(out)


def awkward():
    """Texts: null, empty, blank, one word, ties, repeats, other alphabets, very long."""
    base = prose(60, 1)
    return [None, "", " \n\t", "word", base, base, base.replace(" ", "  ", 3), "ça va très bien à l'été\nça va très bien à l'été", prose(30, 2) + "\n" + prose(30, 2), prose(20_000, 3), "\n".join([prose(12, 4)] * 5), "a b c d e", "x" * 50_000]


def strip_repeats(rows, window=20):
    """doc_id -> (words, removed, kept) by the definition, over rows sorted by id."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_classes(rows, least=0.8):
    """doc_id -> smallest id of its class, by comparing all pairs; texts without words are one class."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) / len(x | y) >= least):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def repeat_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(rows, least=20):
    """doc_id -> numbers of the lines that stay, by comparing all lines."""
    first = {}
    lines = [(i, n, line) for i, text in sorted(rows, key=lambda r: r[0]) for n, line in enumerate((text or "").split("\n"))]
    for i, n, line in lines:
        if line.strip():
            first.setdefault(line, (i, n))
    order = sorted(first.items(), key=lambda kv: kv[1])
    near = set()
    for k, (line, _) in enumerate(order):
        if len(line) >= least and any(abs(len(line) - len(o)) <= 1 and len(o) >= least and edit_distance(line, o) <= 1 for o, _ in order[:k]):
            near.add(line)
    out = {i: [] for i, _ in rows}
    for i, n, line in lines:
        if not line.strip() or (first[line] == (i, n) and line not in near):
            out[i].append(n)
    return out
