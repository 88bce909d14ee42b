"""Ancestry against a plain walk on random graphs with merges, repeated and unknown parents, and cycles."""

import random
from collections import deque

import pytest

from heddle.model import Archive
from heddle.operators import dag


def archive_of(spark, parents):
    revisions = spark.createDataFrame([(r, None, None, i) for i, r in enumerate(parents)], "revision_id string, run_id string, plan_id string, ordinal bigint")
    edges = [(r, p, k) for r, ps in parents.items() for k, p in enumerate(ps)]
    return Archive({"revisions": revisions, "edges": spark.createDataFrame(edges, "child string, parent string, pos bigint")})


def order(parents, root):
    out, seen, queue = [], set(), deque([root])
    while queue:
        r = queue.popleft()
        if r in seen:
            continue
        seen.add(r)
        if r not in parents:
            continue
        out.append(r)
        queue.extend(p for p in parents[r] if p not in seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_visible_order_is_breadth_first(spark, seed):
    rnd = random.Random(seed)
    ids = [f"r{i}" for i in range(60)]
    parents = {r: [ids[rnd.randrange(i)] for _ in range(rnd.choice([0, 1, 1, 2, 3]))] if i else [] for i, r in enumerate(ids)}
    parents["r9"].append("nobody")
    parents["r3"] = parents["r3"] + ["r40"]  # a cycle, if r40 leads back
    a = archive_of(spark, parents)
    got = {}
    for r in dag.visible(a, a.revisions).collect():
        got.setdefault(r["root"], {})[r["rank"]] = r["revision_id"]
    for root in ids:
        assert [got[root][k] for k in sorted(got[root])] == order(parents, root), root
    ancestors = {(r["revision_id"], r["ancestor"]) for r in dag.ancestors(a).collect()}
    assert ancestors == {(root, x) for root in ids for x in order(parents, root) if x != root}


def test_cycle_and_unknown_parent(spark):
    a = archive_of(spark, {"a": ["b"], "b": ["a"], "c": ["b"], "d": ["x"], "e": []})
    assert [r["subject"] for r in dag.cycle_check(a).collect()] == ["a"]
    assert [(r["subject"], r["related"]) for r in dag.dangling_parents(a).collect()] == [("d", "x")]
    assert {r["revision_id"] for r in dag.on_cycle(a).collect()} == {"a", "b"}
    assert dag.cycle_check(archive_of(spark, {"a": [], "b": ["a"]})).count() == 0
    assert {(r["revision_id"], r["child"]) for r in dag.children(a).collect()} >= {("x", "d")}


def test_sets_above_equal_the_closure(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n3", "n15"), ("x", "y"), ("y", "x"), ("m", "n18")]
    edges = spark.createDataFrame([(s, t, 0) for s, t in pairs], "source string, target string, pos bigint")
    start = spark.createDataFrame([("n2",), ("x",)], "revision_id string")
    got = [r[0] for r in dag.above(edges, start).collect()]
    assert sorted(got) == sorted([f"n{i}" for i in range(2, 21)] + ["x", "y"])
    more = dag.above(edges, spark.createDataFrame([("n0",), ("m",), ("n5",)], "revision_id string"), dag.above(edges, start))
    assert sorted(r[0] for r in more.collect()) == ["m", "n0", "n1"]
    assert {r["target"] for r in dag.closure_above(edges, start).where("source = 'n2'").collect()} == {f"n{i}" for i in range(3, 21)}


def test_a_search_over_dealt_edges_finds_the_same_set(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("z", "n0")]
    edges = spark.createDataFrame(pairs, "source string, target string").repartition(3, "source").sortWithinPartitions("source").persist()
    start = spark.createDataFrame([("n2",), ("x",)], "revision_id string")
    got = sorted(r[0] for r in dag.above(edges, start, dealt=3).collect())
    edges.unpersist()
    assert got == sorted(r[0] for r in dag.above(edges, start).collect()) == sorted([f"n{i}" for i in range(2, 10)] + ["x", "y"])


def test_a_search_over_dealt_edges_takes_many_levels_a_round(spark, monkeypatch):
    """50 levels with merges, a cycle and known nodes: a step for each eight levels, and no node twice."""
    from heddle import staging

    steps = []
    monkeypatch.setattr(dag, "stage", lambda df, name, **options: steps.append(name) or staging.stage(df, name, **options))
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(50)] + [("n3", "n15"), ("n20", "n4"), ("x", "y"), ("y", "x"), ("x", "k"), ("k", "m")]
    edges = spark.createDataFrame(pairs, "source string, target string").repartition(3, "source").sortWithinPartitions("source").persist()
    start = spark.createDataFrame([("n0",), ("x",), ("n0",)], "revision_id string")
    got = [r[0] for r in dag.above(edges, start, spark.createDataFrame([("k",), ("m",)], "revision_id string"), dealt=3).collect()]
    edges.unpersist()
    assert sorted(got) == sorted([f"n{i}" for i in range(51)] + ["x", "y"])
    assert len(steps) <= 8
