"""Graph operators on small graphs: chain, diamond, cycle, unknown node, several producers."""

import random

import pytest
from pyspark.sql import functions as F

from weirgate.operators import graph as G
from weirgate.operators import lineage as L

CHAIN = ["raw-events", "extract", "processed-events", "transform-etl", "final-report", "load-report", "published-report"]
TRANSFORMS = {"extract", "transform-etl", "load-report"}


def tables(spark, pairs, transforms):
    ids = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([(i, "transform" if i in transforms else "dataset") for i in ids], "id string, type string")
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, position int")
    return nodes, edges


@pytest.fixture(scope="module")
def chain(spark):
    return tables(spark, list(zip(CHAIN, CHAIN[1:])), TRANSFORMS)


def test_destination_keeps_only_what_leads_to_it(chain, rows):
    nodes, edges = chain
    kept = G.upstream_nodes(edges, nodes, "final-report")
    assert {r[0] for r in rows(kept)} == set(CHAIN[:5])
    assert rows(G.edges_within(edges, kept)) == sorted(zip(CHAIN[:4], CHAIN[1:5]))


def test_unknown_destination_is_itself(chain, rows):
    nodes, edges = chain
    assert rows(G.upstream_nodes(edges, nodes, "nowhere")) == [("nowhere", "dataset", 0)]


def test_levels_and_roots(chain, rows):
    nodes, edges = chain
    assert rows(G.dependency_levels(nodes, edges)) == [("extract", 0), ("load-report", 2), ("transform-etl", 1)]
    assert [r[0] for r in rows(G.roots(nodes, edges))] == ["raw-events"]
    assert rows(G.transform_ports(nodes, edges)) == [(t, 1, 1) for t in sorted(TRANSFORMS)]


def test_diamond_level_is_the_longest_path(spark, rows):
    pairs = [("a", "t1"), ("t1", "b"), ("b", "t2"), ("t2", "c"), ("b", "t3"), ("c", "t3"), ("t3", "d")]
    nodes, edges = tables(spark, pairs, {"t1", "t2", "t3"})
    assert rows(G.dependency_levels(nodes, edges)) == [("t1", 0), ("t2", 1), ("t3", 2)]


def test_cycles_and_what_is_behind_them_have_no_level(spark, rows):
    pairs = [("x", "t1"), ("t1", "y"), ("y", "t2"), ("t2", "x"), ("y", "t3"), ("t3", "z"), ("q", "t4"), ("t4", "r")]
    nodes, edges = tables(spark, pairs, {"t1", "t2", "t3", "t4"})
    assert rows(G.dependency_levels(nodes, edges)) == [("t4", 0)]
    reached = G.reach(edges, spark.createDataFrame([("x",)], "node string"), "down")
    assert {r[0] for r in rows(reached)} == {"x", "t1", "y", "t2", "t3", "z"}


def test_last_producer_counts(spark, rows):
    pairs = [("t1", "d"), ("t2", "d"), ("d", "t3"), ("d", "t2"), ("t9", "e")]
    nodes, edges = tables(spark, pairs, {"t1", "t2", "t3", "t9"})
    assert rows(G.producers(nodes, edges)) == [("d", "t2", 2), ("e", "t9", 1)]
    assert rows(G.transform_dependencies(nodes, edges)) == [("t3", "t2")]


def test_self_dependency_is_ignored(spark, rows):
    nodes, edges = tables(spark, [("t1", "d"), ("d", "t1")], {"t1"})
    assert rows(G.transform_dependencies(nodes, edges)) == []
    assert rows(G.dependency_levels(nodes, edges)) == [("t1", 0)]


def brute_depths(pairs, seed, forward, limit=None):
    depth, frontier, found = 0, {seed}, {seed: 0}
    while frontier and (limit is None or depth < limit):
        depth += 1
        near = {(b if forward else a) for a, b in pairs if (a if forward else b) in frontier}
        frontier = {n for n in near if n not in found}
        found |= {n: depth for n in frontier}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_matches_breadth_first_search_with_a_hub(spark, rows, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(80)]
    pairs += [("hub", f"n{i}") for i in range(0, 40, 3)] + [("n5", "hub")]
    _, edges = tables(spark, pairs, set())
    start = spark.createDataFrame([("n5",)], "node string")
    for direction, forward in (("down", True), ("up", False)):
        expected = brute_depths(pairs, "n5", forward)
        assert rows(G.reach(edges, start, direction)) == sorted(expected.items(), key=repr)
        limited = brute_depths(pairs, "n5", forward, 2)
        assert rows(G.reach(edges, start, direction, 2)) == sorted(limited.items(), key=repr)


def test_lineage_around_and_impact(chain, rows):
    _, edges = chain
    around = {(n, d): k for n, d, k in rows(G.lineage_around(edges, "processed-events", depth=1))}
    assert around == {("processed-events", 0): "root", ("extract", 1): "upstream", ("transform-etl", 1): "downstream"}
    assert dict(rows(G.impact_counts(G.impact(edges, "processed-events")))) == {"direct": 1, "indirect": 3}


def test_pii_flow(spark, rows):
    fields = spark.createDataFrame(
        [
            ("raw", 0, "email", "string", True, None),
            ("clean", 0, "email", "string", True, "raw.email"),
            ("mart", 0, "contact", "string", False, "clean.email"),
            ("mart", 1, "total", "float", False, "raw.amount"),
        ],
        "dataset string, position int, name string, type string, pii boolean, from_ref string",
    )
    assert rows(L.pii_flow(fields)) == [("clean.email", "clean", True), ("mart.contact", "mart", False)]
    assert rows(L.column_origins(fields, "mart.contact")) == [("raw.email", 2)]
    assert rows(L.pii_flow_counts(L.pii_flow(fields))) == [(2, 2, 1)]


def test_column_reference_splits_at_the_last_dot(spark, rows):
    fields = spark.createDataFrame([("d", "c", "a.b.col")], "dataset string, name string, from_ref string")
    assert rows(L.column_edges(fields)) == [("a.b", "col", "d", "c")]


def test_direction_is_checked(chain):
    with pytest.raises(ValueError):
        G.reach(chain[1], chain[0].select(F.col("id").alias("node")), "sideways")


def test_search_does_not_broadcast_the_edges(spark, rows, monkeypatch):
    """Only the first step of a job knows how small its frontier is; the steps after it must not fetch the edges."""
    plans, add = [], G._Rounds.add

    def spy(self, df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df, *rest)

    monkeypatch.setattr(G._Rounds, "add", spy)
    _, edges = tables(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)], set())
    start = spark.createDataFrame([("n0",)], "node string")
    assert rows(G.reach(edges, start, "down")) == [(f"n{i}", i) for i in range(7)]
    assert plans[1].count("SortMergeJoin [node") == 3  # two in the third step, one in the second
