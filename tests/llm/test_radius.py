"""The radius before the exact check leaves room for windows at the least similarity."""

import inspect

import corpus_pipeline
import numpy as np

from agrarium.llm import op1_decontaminate, queries


def test_radius():
    assert inspect.signature(op1_decontaminate.leaks).parameters["radius"].default == 23
    assert all("radius=23" in inspect.getsource(f) for f in (queries.op1_leaks, corpus_pipeline.decontaminate))
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    index = op1_decontaminate.HammingIndex(fps, 23)
    far = [fp ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 23, replace=False))) for fp in fps]
    assert all(i in index.near(fp) for i, fp in enumerate(far))
