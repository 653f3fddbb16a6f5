import os

import numpy as np
import pytest

import lamella.llm.components as module
from lamella.llm.common import shared_folder


def plain_components(edges):
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
    return {x: root(x) for x in of}


def components(spark, edges):
    rows = module.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("few", [module.FEW_EDGES, 0])
def test_in_one_task_and_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW_EDGES", few)
    rng = np.random.default_rng(8)
    edges = [tuple(x) for x in rng.integers(-300, 300, (260, 2)).tolist()]
    edges += [(10_000 + i, 10_001 + i) for i in range(60)] + [(20_000, 20_000 + i) for i in range(1, 60)] + [(1 << 62, -(1 << 62)), (5, 5), (900, 900), (None, 7), (8, None)]
    edges += [(b, a) for a, b in edges[:50]]
    want = plain_components(edges)
    assert components(spark, edges) == want and 900 not in want and want[10_060] == 10_000


def test_no_edges(spark):
    assert components(spark, []) == {} and components(spark, [(1, 1), (None, 2)]) == {}


def test_few_edges_take_few_files(spark):
    """Rounds leave a file for each task of each step, so with many partitions small lists filled the disk."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    folder = shared_folder(spark).removeprefix("file://")
    files = lambda: sum(len(names) for _, _, names in os.walk(folder))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        held = files()
        assert components(spark, [(i, i + 1) for i in range(200)]) == {i: 0 for i in range(201)}
        assert files() - held <= 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
