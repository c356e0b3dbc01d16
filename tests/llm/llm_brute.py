"""Plain versions of the operators, and rows to try them on."""

from __future__ import annotations

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = 1 << 62  # a null id comes after all others


def frame(spark, rows):
    """documents of (doc_id, text), with the usual columns and some of clashing names."""
    own = [(i, t, ("en", "de", None)[k % 3], (None, "s1", "s1", "s2")[k % 4], k,
            "x", b"y", 7, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        own, "doc_id bigint, text string, lang string, source string, n_chars bigint, run string, "
             "kept binary, n_words int, component_id string").repartition(3)


def some_rows(seed: int = 0, docs: int = 40) -> list[tuple]:
    """Texts that share passages, exact and near copies, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(4)]
    rows: list[tuple] = []
    for i in range(docs):
        words = [rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.3:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = "NEW"
        rows.append((i * 3, rng.choice([" ", " ", "\n", "\t "]).join(words)))
    long = " ".join(rng.choice(vocabulary) for _ in range(3000))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "a"), (504, "a"), (505, "A b"),
             (506, "a" * 400), (507, "a" * 300 + "b"), (508, "x y " * 200), (509, "x y " * 30),
             (510, long), (511, long[:9000]), (512, long), rows[0], rows[1], (rows[2][0], "other é"),
             (None, rows[3][1]), (None, None), (None, long[500:2000])]
    return rows


def removed_bytes(rows, window=50):
    first: dict[bytes, int] = {}
    own = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in own:
        for k in range(len(b) - window + 1):
            s = b[k:k + window]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in own:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k:k + window]] < i:
                gone[k:k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if i == LAST else i, len(b), sum(gone), spans,
                    hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows, window=35):
    seen: collections.Counter = collections.Counter()
    own = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    for _, w in own:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k:k + window])] += 1
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").encode().lower())
    size = min(size, len(w))
    return {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if size else set()


def linked(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)]


def contained(rows, items, size=5, share=0.8):
    import math

    out = []
    for i, t in rows:
        for j, x in items:
            own = shingles(x, size)
            if not own:
                continue
            words = len(next(iter(own)))
            both = len(own & shingles(t, words)) if len(WORD.findall((t or "").encode())) >= words else 0
            if both >= math.ceil(share * len(own) - 1e-9):
                out.append((i, j, both, len(own)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def empty(df):
    return df.where(F.lit(False))
