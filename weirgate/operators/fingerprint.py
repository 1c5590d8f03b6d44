"""Content fingerprints that do not depend on row order or partitioning.

A row's SHA-256 is cut into twelve 20-bit numbers. Rows are grouped into at most 256 parts by the first
two hex digits, the numbers and the rows of a part are added up (so copies count; a sum holds for 8
million million rows), and each part is digested. The fingerprint is the digest of the sorted part digests. Sums combine before the shuffle,
and only the at most 256 part rows of a table are ever brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.identifiers import sha256_digest
from weirgate.functions.times import micros

WORDS = 4
WORD_DIGITS = 15
PIECES = 3
PIECE_BITS = 20


def _exact(value: Column) -> Column:
    """Exact text of a double. Each step is a function over a list of one, which keeps its text out of the generated code:
    written out, a few such columns make a method so long that Java never compiles it and interprets it for every row."""
    two = F.lit(2.0)

    def power(x: Column) -> Column:
        size = F.abs(x)
        usual = F.when(F.isnan(x) | (size == float("inf")) | (x == 0), 1.0).otherwise(size)
        return F.struct(x.alias("x"), usual.alias("size"), F.floor(F.log2(usual)).cast("int").alias("power"))

    def scaled(s: Column) -> Column:
        # in two steps, as the factor may be beyond the largest number
        half = F.floor((F.lit(52) - s["power"]) / 2).cast("int")
        whole = s["size"] * F.pow(two, half) * F.pow(two, F.lit(52) - s["power"] - half)
        return F.struct(s["x"].alias("x"), s["power"].alias("power"), whole.alias("scaled"))

    def stepped(s: Column) -> Column:
        step = F.when(s["scaled"] >= float(1 << 53), 1).when(s["scaled"] < float(1 << 52), -1).otherwise(0)
        return F.struct(s["x"].alias("x"), s["power"].alias("power"), s["scaled"].alias("scaled"), step.alias("step"))

    def text(s: Column) -> Column:
        x, sign = s["x"], F.when(s["x"] < 0, "-").otherwise("")
        whole = (s["scaled"] / F.pow(two, s["step"])).cast("bigint").cast("string")
        exact = F.concat(sign, whole, F.lit("p"), (s["power"] + s["step"] - 52).cast("string"))
        special = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, "0")
        return F.when(x.isNotNull(), special.otherwise(exact))

    found = F.array(value)
    for step in (power, scaled, stepped, text):
        found = F.transform(found, step)
    return found[0]


def canonical(c: Column, kind: T.DataType) -> Column:
    """Text of a value that any engine can make, NULL for NULL.

    Numbers with a fraction are their exact sign, whole significand of 53 bits and power of two, as ``-123p-45``
    (``0``, ``nan``, ``inf`` and ``-inf`` by name; both zeros are equal). Timestamps are microseconds and dates days
    since 1970, binary values hex. Lists and structs have each value with its length, maps their entries in order
    of the key's text.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _exact(c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(c).cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: sized(canonical(x, kind.elementType))), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(sized(canonical(e["key"], kind.keyType)), F.lit("="), sized(canonical(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(F.sort_array(F.transform(F.map_entries(c), pair)), ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        values = [sized(canonical(c.getField(f.name), f.dataType)) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")")))
    return c.cast("string")


def sized(text: Column) -> Column:
    """A text after its length, ``-`` for NULL."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Unambiguous text of a row: sorted names, each with the length and canonical text of its value, ``-`` for NULL."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}="), sized(canonical(F.col(f"`{n}`"), kinds[n]))) for n in sorted(columns)])


def part_digests(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """At most 256 part digests per key."""
    names = [c for c in (columns or df.columns) if c not in keys]
    hashed = df.select(*keys, F.sha2(row_text(df, names), 256).alias("h"))
    words = [
        F.conv(F.substring("h", 1 + i * WORD_DIGITS, WORD_DIGITS), 16, 10).cast("bigint").alias(f"w{i}") for i in range(WORDS)
    ]
    rows = hashed.select(*keys, F.substring("h", 1, 2).alias("part"), *words)
    pieces = [
        F.sum(F.shiftright(f"w{i}", j * PIECE_BITS).bitwiseAND(F.lit((1 << PIECE_BITS) - 1))).alias(f"s{i}_{j}")
        for i in range(WORDS)
        for j in range(PIECES)
    ]
    sums = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), *pieces)
    numbers = [F.col(c).cast("string") for c in sums.columns if c not in (*keys, "part")]
    return sums.select(*keys, "n", F.sha2(F.concat_ws(",", "part", *numbers), 256).alias("part_digest"))


def fingerprints(
    df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None, salt: str = ""
) -> DataFrame:
    """Row count and fingerprint per key, or of the whole table without keys."""
    combined = part_digests(df, keys, columns).groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.array_join(F.sort_array(F.collect_list("part_digest")), "").alias("__parts"),
    )
    return combined.select(*keys, "row_count", sha256_digest(F.concat(F.lit(salt), "__parts")).alias("fingerprint"))


def table_fingerprint(df: DataFrame, table: str, profile: str = "default") -> DataFrame:
    """Fingerprint salted with the table and profile it belongs to."""
    return fingerprints(df, salt=f"table={table}\nprofile={profile}\n")


def verify(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with both fingerprints and whether they agree; a missing side does not."""
    left = actual.select(*keys, F.col("fingerprint").alias("actual"))
    right = expected.select(*keys, F.col("fingerprint").alias("expected"))
    return left.join(right, list(keys), "full").withColumn(
        "matches", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    )
