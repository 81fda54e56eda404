"""What the driver has to do for near duplicates: Spark jobs and broadcasts cost it memory, whatever the table's size."""

import random

import numpy as np
import pytest

from fathom.llm import minhash
from fathom.llm.components import components
from fathom.operators import graph
from tests.llm.test_minhash import brute


def plain(pairs):
    low = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_few_jobs_without_hubs(spark, docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        copied = i % 3 == 0 and i
        t = list(rows[i - 1][1].split()) if copied else rng.choices(words, k=60)
        if copied and i % 2:
            t[0] = "other"
        rows.append((i, " ".join(t)))
    table = docs(rows)
    spark.sparkContext.setJobGroup("near-duplicates", "count its jobs")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table, 5, (80, 100)).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-duplicates"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: v[1] for k, v in brute(rows, 5, 80, 100).items()}
    assert jobs <= 75


@pytest.mark.parametrize("limit", [0, 40, 1 << 16])
def test_components_by_rounds_and_in_a_task(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "TASK_EDGES", limit)
    rng = random.Random(limit)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)] + [(names[0], x) for x in names[:320]]  # a hub
    pairs += list(zip(names[400:], names[401:], strict=False))
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain([p for p in pairs if p[0] != p[1]])


def test_smallest_reachable_of_paths():
    for order in (np.arange(5000), np.arange(5000)[::-1].copy(), np.random.default_rng(1).permutation(5000)):
        names, low = graph.smallest_reachable(order[:-1], order[1:])
        assert (names == np.arange(5000)).all() and (low == 0).all()
