"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet below the shared folder and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.common import label_split, ship_code, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drops texts of no determined language (null, or without a letter).

    The model is fitted on the labelled documents of this stage's input, without the held-out part. Where there are
    none, only texts without a letter go.
    """
    from weirgate.llm.langid import UNDETERMINED, identify, train

    ship_code(spark)
    model = train(docs.where(label_split(F.col("doc_id")) != 1))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = identify(docs, model, carry=COLUMNS).where(F.col("lang_pred") != UNDETERMINED)
    return known.select(*COLUMNS)


def keep_first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies the document with the smallest id stays.

    A row without an id stays. Rows that repeat a kept id all stay, as they can't be told apart by id.
    """
    from weirgate.llm.jaccard import jaccard_classes

    ship_code(spark)
    classes = jaccard_classes(docs)
    copies = classes.where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(stored(copies, "copies"), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages of 50 words and more that a document with a smaller id holds are cut out.

    A text that loses nothing stays as it was; one that loses words becomes its other words joined by spaces,
    and goes when none is left.
    """
    from weirgate.llm.substring import remove_repeats

    ship_code(spark)
    cut = remove_repeats(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    from weirgate.llm.decontaminate import find_items

    ship_code(spark)
    found = find_items(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding with begin and end, decoded again as a check: the round trip gives the text back.

    Returns ``doc_id``, ``lang``, ``source``, ``ids``, ``n_tokens`` and ``same_text``.
    """
    import public_tokenizers

    from weirgate.llm.pieces import round_trip

    ship_code(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    named = docs.select("doc_id", "lang", "source", "text", digest)
    both = round_trip(named, path, carry=("doc_id", "lang", "source", "digest"))
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("digest")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("same_text"))


STAGES = [
    ("language_id", keep_languages),
    ("ngram_jaccard", keep_first_of_class),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the language model nor the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
