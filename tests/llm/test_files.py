"""URL filters, archives, the registered queries and the pipeline."""

import ctypes
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, duck, rows_of
from tests.llm.helpers import docs, prose
from weirgate.llm import common, warc
from weirgate.llm.queries import ORACLE, QUERIES
from weirgate.llm.urls import filter_urls, lookup_patterns

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(ORACLE[name])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), theirs) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op13_packing"}))  # that has a row a piece
def test_one_row_for_each_input_row(spark, name):
    source = "embeddings" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_lookup_patterns(spark):
    url = "https://u@Blog.Example.com:80/a//b.html?x=1#y"
    row = spark.createDataFrame([(url,), ("mailto:x",), (None,)], "u string").select(lookup_patterns(F.col("u")).alias("p")).collect()
    assert row[0]["p"] == ["blog.example.com", "example.com", "com", "blog.example.com/a", "blog.example.com/a/b.html"]
    assert row[1]["p"] is None and row[2]["p"] is None


def test_entries_hold_from_add_to_remove(spark):
    changes = [
        ("block", "b.com", True, 100), ("block", "b.com", True, 150), ("block", "b.com", False, 200), ("block", "b.com", True, 10**7),
        ("allow", "x.b.com", True, 120), ("block", "x.b.com", True, 120), ("block", "c.com", False, 50), ("block", "c.com", True, 50), ("block", None, True, 1), ("other", "d.com", True, 1),
    ]
    captures = [(i, u, t) for i, (u, t) in enumerate([("http://b.com/", 99), ("http://b.com/", 100), ("http://b.com/", 199), ("http://b.com/", 200), ("http://a.b.com/q", 10**7 + 5), ("http://x.b.com", 130), ("http://c.com", 60), ("http://d.com", 60), (None, 60), ("http://b.com", None)])]
    table = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("pattern", F.lit(1))
    got = filter_urls(table, spark.createDataFrame(changes, "list string, pattern string, added boolean, at long")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["clear", "blocked", "blocked", "clear", "blocked", "allowed", "blocked", "clear", "clear", "clear"]
    none = table.where("false")
    assert filter_urls(none, spark.createDataFrame(changes, "list string, pattern string, added boolean, at long")).collect() == []


def pages(spark):
    rows = [(1, "u1", "same"), (9, "u9", "same"), (9, "u9", "same"), (4, "u\r\nX: 4", None), (5, None, ""), (6, "u6", "é\r\n\r\nWARC/1.1" * 9), (None, "n", "same"), (7, "u7", "x" * 200_000), (8, "u8", "s"), (2, "u2", "s")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))


def test_archives_round_trip_and_are_the_same_again(spark, tmp_path):
    found = []
    for run in ("a", "b"):
        target = f"file://{tmp_path}/{run}"
        manifest = warc.write_archives(pages(spark), target, least_bytes=1, shard_bytes=60_000, file_bytes=400)
        files = sorted(tuple(r) for r in manifest.collect())
        assert sorted(f[0] for f in files) == sorted(p.name for p in (tmp_path / run).iterdir())
        for name, _, size, sha in files:
            raw = (tmp_path / run / name).read_bytes()
            assert len(raw) == size and hashlib.sha256(raw).hexdigest() == sha
        found.append(files)
    assert found[0] == found[1] and len(found[0]) > 2
    got = sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(manifest, target).collect()), key=repr)
    n = len(("é\r\n\r\nWARC/1.1" * 9).encode())
    want = [(1, "revisit", 9, 4), (9, "response", None, 4), (9, "response", None, 4), (4, "response", None, 0), (5, "response", None, 0), (6, "response", None, n), (None, "revisit", 9, 4), (7, "response", None, 200_000), (8, "response", None, 1), (2, "revisit", 8, 1)]
    assert got == sorted(want, key=repr)


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    manifest = warc.write_archives(pages(spark), f"file://{tmp_path}")
    name = manifest.first()["file"]
    raw = bytearray((tmp_path / name).read_bytes())
    (tmp_path / name).write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="ends inside|records of|damaged"):
        warc.read_archives(manifest, f"file://{tmp_path}").collect()


def test_no_pages(spark, tmp_path):
    manifest = warc.write_archives(pages(spark).where("false"), f"file://{tmp_path}/x")
    assert manifest.collect() == [] and warc.read_archives(manifest, f"file://{tmp_path}/x").collect() == []


def test_stages_take_effect(spark):
    passage = prose(5, 60)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = [prose(1, 100), prose(1, 100), f"{prose(2, 80)} {passage}", f"{passage} {prose(3, 80)}", "?? 12", None, f"{prose(4, 40)} {item} end", prose(6, 90)]
    df = docs(spark, texts)
    kept = corpus_pipeline.keep_languages(spark, df, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 6, 7]
    kept = corpus_pipeline.keep_first_of_class(spark, kept, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 6, 7]
    cut = corpus_pipeline.cut_repeats(spark, kept, FOLDER)
    assert cut.columns == list(corpus_pipeline.COLUMNS)
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[3]["text"] == prose(3, 80) and by_id[3]["n_chars"] == len(prose(3, 80)) and by_id[2]["text"] == texts[2]
    left = corpus_pipeline.drop_leaks(spark, cut, FOLDER)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3, 7]
    coded = corpus_pipeline.encode_pieces(spark, left, FOLDER).collect()
    assert all(r["same_text"] and r["n_tokens"] == len(r["ids"]) for r in coded) and len(coded) == 4


def test_stages_on_edges(spark):
    long = prose(8, 140_000, words=90_000)
    assert len(long) > 600_000
    rows = docs(spark, [(1, prose(1, 100)), (None, prose(2, 90)), (3, prose(3, 80)), (3, prose(4, 85)), (5, long), (6, ""), (7, None)])
    odd = rows.selectExpr("*", "'r' AS row", "1 AS matches", "2 AS kept", "3 AS same", "4 AS removed", "5 AS copies", "6 AS id", "7 AS component", "8 AS digest", "9 AS decoded")
    kept = {name: [None, 1, 3, 3, 5] for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, FOLDER)
        found = odd.select("doc_id", "text" if "text" in odd.columns else "n_tokens").collect()
        left = sorted((r[0] for r in found if r[1]), key=lambda i: (i is not None, i))
        assert left == kept[name], name
        if name != "sentencepiece":
            assert odd.columns == list(corpus_pipeline.COLUMNS)
            assert {r[1] for r in found if r[0] == 5} == {long}
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_languages_without_a_labelled_row(spark):
    rows = docs(spark, ["some text", "12 ?", None, "текст"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_languages(spark, rows, FOLDER).collect()) == [0, 3]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc gives memory back on demand")
def test_a_worker_gives_back_what_the_operator_before_held():
    def own_mb():
        with open("/proc/self/status") as lines:
            return next(int(line.split()[1]) // 1024 for line in lines if line.startswith("RssAnon"))

    common.held(("first",), lambda: [bytes(1000) for _ in range(200_000)])
    above = [bytes(1000) for _ in range(1_000)]  # on top of the heap, which so can't shrink by itself
    full = own_mb()
    common.held(("second",), lambda: None)
    assert own_mb() < full - 150 and above


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
