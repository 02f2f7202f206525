"""The driver's memory while it fits an index."""

import tracemalloc

import numpy as np

from quillon.llm import ann


def test_fit_holds_little_beside_its_sample():
    x = np.random.default_rng(0).normal(size=(20_000, 32))
    tracemalloc.start()
    ann.fit_index(x, 40_000, float(np.sqrt((x * x).sum(1).max())), 1_250, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * x.nbytes
    assert ann.MAX_LISTS * ann.PER_CENTROID <= 1 << 16
