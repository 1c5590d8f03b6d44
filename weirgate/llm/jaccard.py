"""Jaccard join over word shingles as a grouped prefix join.

A document's set holds the hashes of its distinct shingles. Two sets link when
``100 * intersection >= percent * union``.

1. Shingles are ordered by how many documents have them, read from a table of 2^18 counters that all
   documents fill (2 MB at any input size; two shingles in one counter only make the order less sharp), then
   by hash. Sets that link share one of the first ``n - ceil(percent / 100 * n) + 1`` shingles in that order.
2. Equal sets become one set. Sets with the same prefix and size become one group, and only groups are
   joined on prefix shingles; a shingle of one group alone is dropped first.
3. Star round: in each list of groups with one shingle and similar size, the center is the group that has the
   shingle earliest in its order, so with the fewest shingles of its own: the text that the others are edits of,
   where it is there. A group is compared with two centers at most. Verified links are made into classes.
4. Cross round: only shingles that groups of different classes have in their prefixes can be common to two classes.
   So from the first shingle that two groups share, what a group can still have in common with the other one is the
   shingles after its prefix and those of its prefix from there on that several classes have. That bounds the size
   of its partner, its reach. Groups meet in bands of sizes within their reach: an edited copy with too many
   shingles of its own meets nobody of its size, however many copies share the rest of its prefix. Groups that meet
   are expanded to members and verified. Pairs inside one class can't change the classes, so nothing is lost,
   and a large group of near copies is never expanded into all pairs.

Verification drops pairs that their sketches rule out, computes the sets of the documents left from their texts and
compares exact intersections in cells: one set and a bounded number of its partners. A sketch has 1,024 bits or as many
as the set has shingles, a power of two, each the parity of the number of shingles that fall on it; two sketches
differ in no more bits than their sets in shingles. The longer of two is folded by exclusive or.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.common import components, passing_tables, stored
from weirgate.llm.words import Words, chosen_runs, mixed, run_hashes, signed, word_slices

SHINGLE = 5
PERCENT = 75
COUNTERS = 1 << 18
CELL_SETS = 48
CELL_SHINGLES = 1 << 17
MOST_SHINGLES = 1 << 20
SKETCH_LONGS = 16
BAND = 1.15
MARKS = 1 << 24


def _sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; all words as one shingle where there are fewer than ``size``."""
    runs, _, text = chosen_runs(words, size)
    at = np.searchsorted(text, np.arange(len(words.bounds)))
    out = []
    for i in range(len(words.bounds) - 1):
        own = words.of(i)
        if 0 < own.stop - own.start < size:
            out.append(run_hashes(words.hashes[own], np.zeros(1, np.int64), np.array([own.stop - own.start])))
        else:
            out.append(np.unique(runs[at[i] : at[i + 1]]))
    return out


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for words in word_slices(batch.column(0), lower=True):
                counts += np.bincount(_counter(np.concatenate(_sets(words, size))), minlength=COUNTERS)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(counts[filled], pa.int64())], names=["counter", "n"])

    return run


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bits of a set, as longs."""
    width = max(64 * SKETCH_LONGS, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64 * SKETCH_LONGS
    odd = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _profile(size: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            for words in word_slices(batch.column(1), lower=True):
                sets = _sets(words, size)
                prefixes = []
                for s in sets:
                    first = prefix_length(len(s), percent) if len(s) else 0
                    if first < len(s):
                        rank = order[_counter(s)]
                        s = s[np.lexsort((s, rank))[:first]]
                    prefixes.append(s)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in prefixes])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(np.array([_same(s) for s in sets], np.uint64)), pa.int64()),
                        pa.array(signed(np.array([xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(s)) for p, s in zip(prefixes, sets)], np.uint64)), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(np.concatenate(prefixes)), pa.int64())),
                        pa.array([_sketch(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "s", "g", "prefix", "sketch"],
                )

    return run


def _same(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=1)


def _celled(size: int):
    """The set of each text, once for each cell that it takes part in."""
    names = ["center", "block", "member", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for words in word_slices(batch.column(2), lower=True):
                rows, lists, total = [], [], 0
                for i, s in enumerate(_sets(words, size)):
                    if int(np.uint64(_same(s)).astype(np.int64)) != wanted[words.first + i]:
                        continue
                    for cell in cells[words.first + i]:
                        rows.append((cell["center"], cell["block"], cell["member"]))
                        lists.append(signed(s))
                        total += len(s)
                        if total >= MOST_SHINGLES:
                            yield _batch(rows, lists, names)
                            rows, lists, total = [], [], 0
                if rows:
                    yield _batch(rows, lists, names)

    return run


def _batch(rows: list[tuple], lists: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists), pa.int64()))], names=names)


def _verified(percent: int):
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        flat = cell.column("shingles").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        values, at = flat.values.to_numpy(), flat.offsets.to_numpy()
        members, ids = cell.column("member").to_pylist(), cell.column("center").to_pylist()
        center = next((i for i, m in enumerate(members) if m is None), None)
        linked = []
        if center is not None:
            c = np.sort(values[at[center] : at[center + 1]])
            for i, m in enumerate(members):
                if m is None or not len(c):
                    continue
                own = values[at[i] : at[i + 1]]
                common = int((c[np.minimum(np.searchsorted(c, own), len(c) - 1)] == own).sum())
                if 100 * common >= percent * (len(c) + len(own) - common):
                    linked.append(m)
        return pa.table({"a": pa.array([ids[0]] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sets of these sizes with a common prefix shingle at these places can link: by size, and by how many
    shingles can still be common before and after the places."""
    needed = F.ceil((na + nb) * F.lit(percent) / F.lit(100 + percent))
    most = F.least(pa_, pb) + F.least(na - pa_, nb - pb)
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (most >= needed)


def _sketches_allow(percent: int) -> Column:
    """Whether sets ``a`` and ``b`` with these sketches can link; true where the one is over twice as long as the other."""
    longs = F.least(F.size("sketcha"), F.size("sketchb"))

    def folded(sketch: str) -> Column:
        halves = F.zip_with(F.slice(sketch, 1, longs), F.slice(sketch, longs + 1, longs), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(sketch) == longs, F.col(sketch)).when(F.size(sketch) == 2 * longs, halves)

    apart = F.zip_with(folded("sketcha"), folded("sketchb"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    size = F.col("na") + F.col("nb")
    most = size - 2 * F.ceil(size * F.lit(percent) / F.lit(100 + percent))
    return F.coalesce(F.aggregate(apart, F.lit(0), lambda total, bits: total + bits) <= most, F.lit(True))


def _marked(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``placed``, so that their texts are not shuffled: each id sets
    one of ``MARKS`` bits, of which at most 2^18 longs are broadcast at any input size."""

    def marked(df: DataFrame) -> DataFrame:
        mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
        return df.select(*df.columns, F.floor(mark / 64).cast("int").alias("word"), (mark % 64).cast("int").alias("bit"))

    words = stored(marked(placed.select("id")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "marks")
    return marked(rows).join(F.broadcast(words), "word").where("getbit(bits, bit) = 1").drop("word", "bit", "bits")


def _links(rows: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (center, member: sets) that link, as ``(a, b)``. Sets are only shipped for pairs that their
    sketches allow."""
    centers, partners = (
        sets.select("s", "n", "sketch").toDF(name, f"n{end}", f"sketch{end}")
        for name, end in (("center", "a"), ("member", "b"))
    )
    met = stored(pairs.where("center <> member").distinct(), "met").join(centers, "center").join(partners, "member")
    pairs = stored(met.where(_sketches_allow(percent)).select("center", "member", F.col("nb").alias("n")), "pairs")
    load = pairs.groupBy("center").agg(F.count("member").alias("m"), F.sum("n").alias("n"))
    blocks = stored(
        load.select("center", F.greatest(F.ceil(F.col("m") / CELL_SETS), F.ceil(F.col("n") / CELL_SHINGLES)).alias("blocks")), "blocks"
    )
    members = pairs.join(blocks, "center").select(
        F.col("member").alias("s"), "center", F.expr("pmod(hash(member), blocks)").alias("block"), "member"
    )
    heads = blocks.select(
        F.col("center").alias("s"), "center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("member")
    )
    cells = members.unionByName(heads).groupBy("s").agg(F.collect_list(F.struct("center", "block", "member")).alias("cells"))
    placed = stored(stored(cells, "cells").join(sets.select("s", "id"), "s").select("id", "s", "cells"), "placed")
    whole = _marked(rows, placed).join(placed, "id").select("s", "cells", "text")
    celled = whole.mapInArrow(_celled(size), "center long, block long, member long, shingles array<long>")
    return stored(celled.groupBy("center", "block").applyInArrow(_verified(percent), "a long, b long"), "links")


def _met(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups and classes ``(ga, ca, gb, cb)`` of ``shared`` that may link: ``(token, g, c, n, pos)`` of each
    prefix shingle that several classes have."""
    later = Window.partitionBy("g", "c").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) - 1  # shingles after the prefix
    left = after + F.count("token").over(later)
    reach = F.floor(left * F.lit(100 + percent) / F.lit(percent)).cast("long") - F.col("n")
    reached = shared.select("token", "g", "c", "n", reach.alias("reach"))

    def band(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(BAND))).cast("int")

    least = F.ceil(F.col("n") * F.lit(percent) / F.lit(100))
    small = reached.where("reach >= n").select("token", band(F.col("n")).alias("band"), *(F.col(k).alias(f"{k}a") for k in ("g", "c", "n", "reach")))
    large = reached.where(F.col("reach") >= least).select(
        "token",
        F.explode(F.sequence(band(least), band(F.least("reach", "n")))).alias("band"),
        *(F.col(k).alias(f"{k}b") for k in ("g", "c", "n", "reach")),
    )
    apart = F.when(F.col("na") == F.col("nb"), F.col("ca") < F.col("cb")).otherwise((F.col("na") < F.col("nb")) & (F.col("ca") != F.col("cb")))
    fits = (F.lit(100) * F.col("na") >= F.lit(percent) * F.col("nb")) & (F.col("nb") <= F.col("reacha")) & (F.col("na") <= F.col("reachb"))
    return small.join(large, ["token", "band"]).where(apart & fits).select("ga", "ca", "gb", "cb").distinct()


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Words are runs of bytes other than space and 0x09-0x0D with A-Z in lower case. A null text or one without
    words has no shingles and links with nothing. The key is an integer; repeated rows of a key are compared
    each with its own text; a row without a key takes part and gets the smallest key of its class (null if
    there is none). Other columns of ``docs`` are ignored. Sets are compared by 64-bit shingle hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    with passing_tables(docs.sparkSession) as keep:
        profiles, final = _classes(docs, key, text, size, percent)
        ids = keep(profiles.select("id", "n", F.when(F.col("n") > 0, F.col("s")).alias("s")), "ids")
        final = keep(final, "final")
    return ids.join(final, "s", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col("id")).alias("component_id")
    )


def _classes(docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, with their set ``s``, and the component (s, component_id) of each set."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.where("text is not null").select("text").mapInArrow(_count(size), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, dtype=np.int64)
    found = counted.toPandas()  # COUNTERS rows at most
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    order = spark.sparkContext.broadcast(counts)
    profiles = stored(rows.mapInArrow(_profile(size, percent, order), "id long, n long, s long, g long, prefix array<long>, sketch array<long>"), "profiles")
    sets = stored(profiles.where("n > 0").groupBy("s").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("sketch").alias("sketch")), "sets")
    groups = stored(sets.where("id is not null").groupBy("g").agg(F.min("s").alias("rep")), "groups")
    reps = sets.join(groups.select(F.col("rep").alias("s")), "s").select("s", F.col("id").alias("least"))
    postings = (
        profiles.join(stored(reps, "reps"), "s")
        .where("id = least")
        .select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    )
    shared = stored(postings.groupBy("token").agg(F.count("g").alias("lists")).where("lists > 1").select("token"), "tokens")
    lists = stored(postings.join(shared, "token").select("token", "g", "n", "pos"), "lists")

    stars = None
    for shift in (0.0, 0.5):
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + shift) if percent < 100 else F.col("n")
        banded = lists.select("token", "g", "n", "pos", band.alias("band"))
        first = stored(banded.groupBy("token", "band").agg(F.min(F.struct("pos", "g", "n")).alias("f")), "firsts")
        starred = banded.join(first, ["token", "band"]).where("g <> f.g")
        starred = starred.where(_may_link(F.col("n"), F.col("pos"), F.col("f.n"), F.col("f.pos"), percent))
        found = stored(starred.groupBy("g").agg(F.min(F.struct("f.pos", "f.g")).alias("f")).select("g", F.col("f.g").alias("first")), "stars")
        stars = found if stars is None else stars.union(found)
    rep_of = groups.select(F.col("g").alias("first"), F.col("rep").alias("center"))
    members = sets.where("id is not null").select("g", F.col("s").alias("member"))
    centers = stored(stored(stars.distinct(), "star").join(rep_of, "first").select("g", "center"), "centers")
    inside = members.join(groups.select("g", F.col("rep").alias("center")), "g").select("center", "member")
    links = _links(rows, sets, members.join(centers, "g").select("center", "member").union(inside), size, percent)
    ids = sets.select(F.col("s").alias("id"))
    classes = stored(components(ids, links), "classes")

    units = stored(
        members.join(classes.select(F.col("id").alias("member"), F.col("component").alias("c")), "member").select("g", "c", "member"), "units"
    )
    open_lists = stored(lists.join(units.select("g", "c").distinct(), "g"), "open")
    mixed_tokens = stored(open_lists.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("token"), "mixed")
    crossing = stored(open_lists.join(mixed_tokens, "token"), "mixed_lists")
    pairs = stored(_met(crossing, percent), "crosses")
    wide = (
        pairs.join(units.toDF("ga", "ca", "center"), ["ga", "ca"])
        .join(units.toDF("gb", "cb", "member"), ["gb", "cb"])
        .select("center", "member")
    )
    more = _links(rows, sets, wide, size, percent)
    at = classes.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    bt = classes.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = more.join(at, "a").join(bt, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = stored(components(classes.select(F.col("component").alias("id")).distinct(), joined), "roots")
    last = stored(
        classes.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component").select(F.col("id").alias("s"), "root"), "last"
    )
    named = last.join(sets, "s")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return profiles, last.join(stored(least, "least"), "root").select("s", "component_id")
