"""The registered queries: each operator over its whole table, and the SQL twin where there is one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.common import label_split, ship_code, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_code(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


@query(
    r"""
    WITH words AS (
      SELECT doc_id, i - 1 AS p, w[i] AS word
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
           LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
    windows AS (
      SELECT doc_id, p, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h,
             count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n
      FROM words),
    hits AS (
      SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM windows WHERE n = 50) WHERE doc_id > least),
    marked AS (
      SELECT w.doc_id, w.p, w.word,
             max(h.p) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM words w LEFT JOIN hits h USING (doc_id, p))
    SELECT d.doc_id, count(m.p) AS n_words, count(*) FILTER (m.gone) AS n_removed,
           sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (NOT m.gone), '')) AS kept_sha256
    FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
    """
)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.substring import remove_repeats

    kept = F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256)
    return remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query()
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, folder, "documents"))


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.langid import identify, train

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", label_split(F.col("doc_id")).alias("part"))
    model = train(docs.where("part <> 1"))
    return identify(docs.withColumn("held_out", F.col("part") == 1), model, carry=("doc_id", "held_out"))


@query()
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))


@query()
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from weirgate.llm.pieces import round_trip

    both = round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from weirgate.llm.tokencount import count_tokens

    counted = count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.toxicity import score, train

    docs = table(spark, folder, "documents").select("doc_id", "text", (label_split(F.col("doc_id")) == 1).alias("held_out"))
    model = train(docs.where("not held_out"), table(spark, folder, "labels"))
    return score(docs, model, carry=("doc_id", "held_out"))


@query(
    """
    WITH raw AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS p FROM pages),
    marked AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS last FROM raw),
    bits AS (
      SELECT page_id, payload_bytes, last,
             (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(h, 1 + 10 * ((k - 1) // 8), 10)) AS BIGINT) // (1::BIGINT << (35 - 5 * ((k - 1) % 8))) % 32, 1), '' ORDER BY k)
              FROM generate_series(1, 32) t(k)) AS payload_digest
      FROM marked)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM bits
    """
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.warc import archive_folder, read_archives, write_archives

    target = archive_folder(spark)
    manifest = write_archives(table(spark, folder, "pages"), target)
    return read_archives(manifest, target).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.decontaminate import find_items

    found = find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_items"), F.col("matches.item").alias("item_ids"), (F.size("matches") > 0).alias("contaminated")
    )


@query()
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from weirgate.llm.alignment import align_documents, count_links

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_documents(table(spark, folder, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    n_links = F.aggregate("pair_links", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_links")
    kept = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return count_links(aligned.select(*kept[:4], n_links, digest, "pairs", "pair_links"), kept)


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of :func:`op12_vector_codes` one after the other."""
    distance = "list_sum(list_transform(list_zip(s.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
              SELECT s.vec_id, s.p, any_value(s.x) AS x, min((CAST({distance} AS BIGINT), c.e)) AS best
              FROM cut s JOIN c{i} c ON s.p = c.p GROUP BY s.vec_id, s.p)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
                  SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
                    SELECT p, e, list(v ORDER BY j) AS c FROM (
                      SELECT p, best[2] AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS v
                      FROM a{i}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM cut))) AS j) GROUP BY ALL) GROUP BY p, e) m
                  ON m.p = c.p AND m.e = c.e)"""
            )
    return f"""
    WITH kept AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    cut AS MATERIALIZED (
      SELECT vec_id, p, v[1 + p * (len(v) // {parts}) : (p + 1) * (len(v) // {parts})] AS x
      FROM kept, (SELECT unnest(range({parts})) AS p)),
    c0 AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut
      WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
    {", ".join(steps)},
    coded AS (
      SELECT vec_id, string_agg(lower(printf('%02x', best[2])), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest
    """


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.vectorcodes import codebooks_digest, compress, with_label_error

    coded, books = compress(table(spark, folder, "embeddings"), carry=("label",))
    digest = F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


@query()
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from weirgate.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


#: Seconds of 2024-01-01, the first day of the captures and list changes that are derived from the pages.
YEAR_START = 1_704_067_200


@query(
    rf"""
    WITH p AS (
      SELECT page_id, url, {YEAR_START} + (page_id * 7919) % 31622400 AS fetched_at,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)) AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    parts AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, string_split(host, '.') AS labels FROM p),
    changes AS (
      SELECT CASE WHEN page_id % 10 = 5 THEN 'allow' ELSE 'block' END AS list,
             CASE page_id % 3 WHEN 0 THEN array_to_string(labels[-3:], '.') WHEN 1 THEN host ELSE concat_ws('/', host, segs[1]) END AS pattern,
             (page_id // 5) % 3 <> 0 AS added, {YEAR_START} + (page_id * 104729) % 31622400 AS moment FROM parts),
    once AS (SELECT list, pattern, moment, bool_or(added) AS added FROM changes GROUP BY ALL),
    flips AS (SELECT * FROM (SELECT *, lag(added, 1, FALSE) OVER (PARTITION BY list, pattern ORDER BY moment) AS before FROM once) WHERE added <> before),
    ends AS (SELECT *, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment) AS until FROM flips),
    spans AS (SELECT list, pattern, moment AS since, until FROM ends WHERE added),
    asked AS (
      SELECT page_id, url, fetched_at, unnest(list_concat(
        list_transform(generate_series(1, len(labels)), lambda i: array_to_string(labels[i:], '.')),
        list_transform(generate_series(1, len(segs)), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) AS pattern FROM parts),
    hits AS (
      SELECT a.page_id, a.pattern, s.list FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.since <= a.fetched_at
        AND (s.until IS NULL OR a.fetched_at < s.until)),
    judged AS (
      SELECT page_id, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow FROM hits GROUP BY page_id),
    best AS (
      SELECT page_id, pattern, list FROM hits
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, list = 'allow' DESC, pattern DESC) = 1)
    SELECT p.page_id, p.url, p.fetched_at, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, b.pattern,
           CASE WHEN b.list IS NULL THEN 'clear' WHEN b.list = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict
    FROM p LEFT JOIN judged j USING (page_id) LEFT JOIN best b USING (page_id)
    """
)
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from weirgate.llm.urls import filter_urls, host_of, path_of

    pages = table(spark, folder, "pages").select("page_id", "url")
    second = lambda factor: F.lit(YEAR_START) + F.pmod(F.col("page_id") * F.lit(factor), F.lit(31_622_400))
    captures = pages.withColumn("fetched_at", second(7919))
    labels = F.split(host_of(F.col("url")), r"\.")
    segment = F.element_at(F.filter(F.split(path_of(F.col("url")), "/"), lambda p: p != ""), 1)
    kind = F.col("page_id") % 3
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    pattern = F.when(kind == 0, domain).when(kind == 1, host_of(F.col("url"))).otherwise(F.concat_ws("/", host_of(F.col("url")), segment))
    changes = pages.select(
        F.when(F.col("page_id") % 10 == 5, "allow").otherwise("block").alias("list"),
        pattern.alias("pattern"),
        (F.floor(F.col("page_id") / 5) % 3 != 0).alias("added"),
        second(104_729).alias("at"),
    )
    return filter_urls(captures, changes)
