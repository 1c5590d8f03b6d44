"""Lineage graphs as two tables: nodes (id, type) and edges (src, dst).

Reachability and levels are breadth-first rounds of joins. Each round writes its small result to the
scratch folder, so plans stay short, lost executors only repeat one round, and Spark knows the size of
the frontier: a small one is broadcast against the edges, which are then scanned without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirgate.session import scratch_path, verify_rows, written


#: Steps of one job of a search.
HOPS = 3


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in ("up", "down"):
        raise ValueError("direction is 'up' or 'down'")
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    return edges.select(F.col(here).alias("node"), F.col(there).alias("next"))


class _Rounds:
    """Results of the rounds of an iterative job: one folder per round below one scratch folder."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self._spark, self._path, self._schema = spark, scratch_path(spark, label), schema

    def add(self, df: DataFrame, number: int, *measures: Column) -> int | tuple:
        """Write and verify the rows of a round; their number, and the measures of them that are asked for."""
        seen, path = Observation(), f"{self._path}/round={number}"
        named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *named).write.parquet(path)
        found = seen.get
        verify_rows(self.get(number), found["rows"], path)
        return (found["rows"], *(found[f"m{i}"] for i in range(len(measures)))) if measures else found["rows"]

    def get(self, number: int) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/round={number}")

    def all(self) -> DataFrame:
        """Every round so far, as one scan with the number in ``round``."""
        return self._spark.read.schema(f"{self._schema}, round int").parquet(self._path)


def reach(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from any seed with their smallest distance in ``depth``; seeds have depth 0.

    Cycles end by themselves: a node is followed only from the round that first finds it. ``seeds`` has one
    column, ``node``. A round is one job that goes ``HOPS`` steps ahead, so the nodes known already are read
    once for as many steps. A step's join is on the node, so a hub's edges are split by AQE, and the smallest
    depth of a node combines before its shuffle. After the first step the frontier's size is not known to the planner,
    which would take the edges for the smaller side and send them all through the driver: these joins are sorted.
    """
    hops = written(_oriented(edges, direction), "hops")
    rounds, number, depth = _Rounds(edges.sparkSession, "reach", "node string, depth int"), 0, 0
    found = rounds.add(seeds.select("node", F.lit(0).alias("depth")).distinct(), number)
    while found and (max_depth is None or depth < max_depth):
        ahead = rounds.get(number).filter(F.col("depth") == depth).select("node")
        steps = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        reached = None
        for step in range(1, steps + 1):
            ahead = hops.join(ahead if step == 1 else ahead.hint("merge"), "node").select(F.col("next").alias("node")).distinct()
            there = ahead.withColumn("depth", F.lit(depth + step))
            reached = there if reached is None else reached.unionByName(there)
        nearest = reached.groupBy("node").agg(F.min("depth").alias("depth"))
        depth, number = depth + steps, number + 1
        new = nearest.join(rounds.all().select("node"), "node", "left_anti")
        _, found = rounds.add(new, number, F.count_if(F.col("depth") == depth))
    return rounds.all().select("node", "depth")


def upstream_nodes(edges: DataFrame, nodes: DataFrame, destination: str) -> DataFrame:
    """The destination and every node on a path to it; ids without a node row count as datasets."""
    seeds = edges.sparkSession.createDataFrame([(destination,)], "node string")
    kept = reach(edges, seeds, "up")
    types = nodes.select(F.col("id").alias("node"), "type")
    return kept.join(types, "node", "left").select(
        F.col("node").alias("id"), F.coalesce("type", F.lit("dataset")).alias("type"), "depth"
    )


def edges_within(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    src, dst = kept.select(F.col("id").alias("src")), kept.select(F.col("id").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst")


def lineage_around(edges: DataFrame, name: str, depth: int = 3, direction: str = "both") -> DataFrame:
    """Nodes within ``depth`` hops of a record, up, down or both ways; the record itself is the root."""
    seeds = edges.sparkSession.createDataFrame([(name,)], "node string")
    sides = {"both": ("up", "down")}.get(direction, (direction,))
    result = None
    for side in sides:
        label = "upstream" if side == "up" else "downstream"
        found = reach(edges, seeds, side, depth).withColumn(
            "direction", F.when(F.col("depth") == 0, "root").otherwise(label)
        )
        result = found if result is None else result.unionByName(found.filter(F.col("depth") > 0))
    return result


def impact(edges: DataFrame, name: str) -> DataFrame:
    """Every downstream consumer, direct (one hop) or indirect."""
    seeds = edges.sparkSession.createDataFrame([(name,)], "node string")
    found = reach(edges, seeds, "down").filter(F.col("depth") > 0)
    return found.withColumn("consumer", F.when(F.col("depth") == 1, "direct").otherwise("indirect"))


def impact_counts(consumers: DataFrame) -> DataFrame:
    return consumers.groupBy("consumer").agg(F.count(F.lit(1)).alias("consumers"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Datasets nothing writes."""
    incoming = edges.select(F.col("dst").alias("id")).distinct()
    return nodes.filter(F.col("type") == "dataset").join(incoming, "id", "left_anti")


def producers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The transform that writes each dataset. Of several the last declared one counts (``position``)."""
    transforms = nodes.filter(F.col("type") == "transform").select(F.col("id").alias("src"))
    writes = edges.join(transforms, "src", "left_semi")
    return writes.groupBy(F.col("dst").alias("dataset")).agg(
        F.max_by("src", F.struct("position", "src")).alias("producer"), F.count(F.lit(1)).alias("writers")
    )


def transform_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (transform, depends_on): the transform reads a dataset the other one produces.

    Each dataset has one producer, so an edge gives at most one pair however many read the dataset. The
    producers are written first: joined as a plain table, a dataset with very many readers is split.
    A transform does not depend on itself.
    """
    transforms = nodes.filter(F.col("type") == "transform").select(F.col("id").alias("dst"))
    reads = edges.join(transforms, "dst", "left_semi").select(
        F.col("src").alias("dataset"), F.col("dst").alias("transform")
    )
    produced = written(producers(nodes, edges).select("dataset", F.col("producer").alias("depends_on")), "producers")
    return (
        reads.join(produced, "dataset")
        .filter(F.col("transform") != F.col("depends_on"))
        .select("transform", "depends_on")
        .distinct()
    )


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each transform: 0 without dependencies, otherwise one above its highest dependency.

    A table holds the transforms that wait, each with the number of its dependencies that no earlier level has met.
    A level is one job: the transforms freed last count down those that need them, and those that reach zero are
    freed next. The dependencies that are met are dropped from the other table whenever they are half of it, so
    both tables shrink and all levels together read each dependency a few times. Transforms on or behind a cycle
    never reach zero and are left out.
    """
    spark = nodes.sparkSession
    transforms = nodes.filter(F.col("type") == "transform").select(F.col("id").alias("transform")).distinct()
    needs = written(transform_dependencies(nodes, edges), "needs")
    wanted = needs.groupBy("transform").agg(F.count(F.lit(1)).alias("missing"))
    rounds, level = _Rounds(spark, "levels", "transform string, missing bigint"), 0
    waiting = transforms.join(wanted, "transform", "left").select("transform", F.coalesce("missing", F.lit(0)).alias("missing"))
    rows, freed, unmet = rounds.add(waiting, level, F.count_if(F.col("missing") == 0), F.sum("missing"))
    held, since = unmet, 0  # dependencies in ``needs``, and the level since which those met are still in it
    while freed and freed < rows:
        if 2 * unmet <= held:
            met = rounds.all().filter((F.col("missing") == 0) & (F.col("round") >= since) & (F.col("round") < level))
            needs = written(needs.join(met.select(F.col("transform").alias("depends_on")), "depends_on", "left_anti"), "needs")
            held, since = unmet, level
        state = rounds.get(level)
        done = state.filter("missing = 0").select(F.col("transform").alias("depends_on"))
        met = needs.join(done, "depends_on").groupBy("transform").agg(F.count(F.lit(1)).alias("met"))
        left = state.filter("missing > 0").join(met, "transform", "left")
        level += 1
        rows, freed, unmet = rounds.add(left.select("transform", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")), level, F.count_if(F.col("missing") == 0), F.sum("missing"))
        unmet = unmet or 0
    return rounds.all().filter("missing = 0").select("transform", F.col("round").alias("level"))


def transform_ports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of inputs and outputs of each transform."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        )
    )
    counts = ends.groupBy("id").agg(F.sum("i").alias("inputs"), F.sum("o").alias("outputs"))
    transforms = nodes.filter(F.col("type") == "transform").select("id")
    return transforms.join(counts, "id", "left").select(
        "id", F.coalesce("inputs", F.lit(0)).alias("inputs"), F.coalesce("outputs", F.lit(0)).alias("outputs")
    )


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("type", "id")
