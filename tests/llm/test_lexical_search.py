"""Operator 12: against brute force in plain integers, with pruning at work, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np

from agrarium.llm import op12_lexical_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(SMALL))
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 25 + (25 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(4_000)] + ["Éclair", "éclair", "x9", "naïve"]
    docs = [(i, rng.choice(". ,\n") .join(rng.choices(words, k=rng.choice([0, 3, 20, 200])))) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 3)] + [(None, "w1 w2 W3"), (None, "w1 w2 W3"), (5, "w1 w2 W3"), (-1, None), (-2, "  ,.")]
    return docs, [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40])))) for i in range(30)] + [(3, "w1 w1 w2"), (None, "w2 ÉCLAIR"), (99, None), (98, "!?"), (97, "unheard-of")]


def test_equals_brute_force(spark):
    docs, items = corpus(1, 600)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"bucket": 16, "head": 40, "block_items": 4, "width": 8}, {"pass_chars": 300, "head": 10}):
        got = sorted((tuple(r) for r in op.ranked(d, i, k=7, **options).collect()), key=str)
        assert got == brute(docs, items, 7)


def test_bounds_prune(spark):
    """Few of all pairs are scored, and the answers are those of all pairs."""
    rng = np.random.default_rng(2)
    weighted = {i: {int(t): int(w) for t, w in zip(rng.choice(400, 12, replace=False), rng.integers(1, 9_000, 12))} for i in range(20)}
    (block,) = op.blocks_of(weighted, 4_096, 128)
    n, per = 4_000, 25
    row, term = np.repeat(np.arange(n), per), np.concatenate([rng.choice(400, per, replace=False) for _ in range(n)])
    impact = rng.integers(1, 10**6, n * per) // (1 + row // 400)  # in order of length
    best, scored = op.Best(5, {}), 0
    for lo in range(0, n, 200):
        own = (row >= lo) & (row < lo + 200)
        scored += op.search(op.Bucket(np.arange(lo, lo + 200), np.zeros(200, bool), row[own] - lo, term[own], impact[own]), block, best)
    dense = np.zeros((n, 400), np.int64)
    dense[row, term] = impact
    for i, own in weighted.items():
        scores = sum(dense[:, t] * w for t, w in own.items())
        assert best.rows[i][0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert scored < 0.1 * n * 20


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 60_000, 9, "z"), (2, "a", 8, "y"), (2, "a", 8, "y")], "doc_id long, text string, rank int, item string")
    items = spark.createDataFrame([(1, "A a", 2)], "item_id long, text string, score int")
    assert [tuple(r) for r in op.ranked(docs, items).orderBy("rank").collect()] == brute([(1, "a b " * 60_000), (2, "a"), (2, "a")], [(1, "A a")], 20)
    assert op.ranked(docs.limit(0), items).count() == 0 and op.ranked(docs, items.limit(0)).count() == 0
    assert op.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
