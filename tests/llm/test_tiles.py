"""SimHash tiles of which some are empty."""

import numpy as np

from tickloom.llm import shared, simhash


def test_empty_tiles_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(6)])).view(np.int64)
    linked = simhash.links(spark.createDataFrame([(int(x),) for x in values], "fp long"), 2, 1)
    roots = {r.node: r.root for r in shared.components(linked).collect()}
    v = values.view(np.uint64)
    near = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2)
    assert all(roots.get(int(values[a]), int(values[a])) == roots.get(int(values[b]), int(values[b])) for a, b in near)
