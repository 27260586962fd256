"""Links by any number of leading blocks have the same components, and leads grow with the fingerprints."""

import numpy as np
import pytest

from agrarium.llm import op4_simhash_dedup
from agrarium.llm.components import components


def fingerprints():
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False))) for s in seeds for _ in range(40)]
    return np.unique(np.array(near + [np.uint64(0), np.uint64(2**64 - 1)]))


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_components(spark, blocks):
    fps = fingerprints()
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    signed = fps.view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    rooted = {r.node: r.root for r in components(op4_simhash_dedup.links(df, 4, 50, blocks)).collect()}
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(find(i), set()).add(v)
    for members in groups.values():
        assert len({rooted.get(v, v) for v in members}) == 1
    assert len({rooted.get(v, v) for v in signed}) == len(groups)


def test_leads_grow():
    sizes = [op4_simhash_dedup.deals(n, 4, 20_000) for n in (10**6, 10**9, 10**11)]
    assert [(len(o), min(leads)) for o, leads in sizes] == [(5, 12), (15, 20), (35, 27)]
    for orders, _ in sizes:
        for order in orders:
            assert sorted(order)[0][0] == 0 and sum(w for _, w in order) == 64
