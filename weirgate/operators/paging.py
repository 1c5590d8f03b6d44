"""Pages of an ordered table by rank selection, without ordering the rows before the page.

The order is taken apart into whole numbers, most significant first: whether the time is missing, the time, and the
tiebreak in pieces. Over one number at a time the rows are counted in at most 256 buckets of equal width; the page's
ranks tell in which buckets it begins and ends, and only these are counted again in finer ones. Once the rows left
are few, or as few as the page is long, they are ordered. Where a single value holds many, such as an instant that a million rows
share or a missing time, the next number splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.times import micros

BUCKETS = 256
#: Rows that one task may order at once.
FEW = 50_000
#: Bytes of a text in one whole number, and how many bytes of it are used to tell rows apart.
PIECE_BYTES, TEXT_BYTES = 7, 70


def order_numbers(column: str, kind: T.DataType, descending: bool = False) -> list[Column]:
    """Whole numbers that order rows as the column does, most significant first; nulls as Spark has them.

    For texts by their first ``TEXT_BYTES`` bytes; for a kind that has no such numbers none at all.
    """
    c = F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        values = [micros(c)]
    elif isinstance(kind, T.TimestampType):
        values = [F.unix_micros(c)]
    elif isinstance(kind, T.DateType):
        values = [F.unix_date(c).cast("long")]
    elif isinstance(kind, T.IntegralType):
        wide = c.cast("long")
        values = [F.shiftright(wide, 32), wide.bitwiseAND(F.lit((1 << 32) - 1))]
    elif isinstance(kind, T.StringType):
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        size = 2 * PIECE_BYTES
        values = [F.conv(F.substring(digits, 1 + i * size, size), 16, 10).cast("long") for i in range(TEXT_BYTES // PIECE_BYTES)]
    else:
        return []
    if descending:
        return [c.isNull().cast("long"), *(F.negate(v) for v in values)]
    return [c.isNotNull().cast("long"), *values]


def located(
    df: DataFrame, numbers: list[Column], offset: int, limit: int, rows: int, within: tuple[int, int] | None = None
) -> list[tuple[DataFrame, int, int]]:
    """Parts of ``df``, each with the offset and length in it, that make up rows ``offset`` to ``offset + limit - 1``.

    ``rows`` is the number of rows of ``df``, ``within`` the bounds of the first number where they are known. Buckets
    inside the page are parts as they are. The first and the last one, which may hold more, are counted again. A part
    of which not all is needed has at most ``FEW`` rows, or twice the page's, unless rows are equal in all numbers.
    """
    if limit <= 0 or rows <= offset:
        return []
    if rows <= max(FEW, 2 * limit) or not numbers:
        return [(df, offset, limit)]
    x = numbers[0]
    low, high = within or df.agg(F.min(x), F.max(x)).first()
    if low == high:  # also where all are missing: one value, which the next number splits
        return located(df, numbers[1:], offset, limit, rows)
    width = (high - low) // BUCKETS + 1
    bucket = F.call_function("div", x - F.lit(low), F.lit(width))
    counts = sorted((r["b"], r["n"]) for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    parts, whole, before = [], [], 0
    for number, n in counts:
        begin, end = max(offset - before, 0), min(offset + limit - before, n)
        before += n
        bounds = low + number * width, min(high, low + (number + 1) * width - 1)
        if begin == 0 and end == n:
            whole.append((*bounds, n))
        elif begin < end:
            parts += located(df.filter(x.between(*bounds)), numbers, begin, end - begin, n, bounds)
    if whole:
        parts.append((df.filter(x.between(whole[0][0], whole[-1][1])), 0, sum(n for *_, n in whole)))
    return parts


def page(df: DataFrame, limit: int, offset: int = 0, at: str = "start_time", tiebreak: str = "id") -> DataFrame:
    """One page, newest first, every row carrying the number of rows before paging in ``total``.

    Rows without a time come last, those of one time by ``tiebreak``. Past the end the page is empty.
    """
    total = df.count()
    numbers = [*order_numbers(at, df.schema[at].dataType, descending=True), *order_numbers(tiebreak, df.schema[tiebreak].dataType)]
    order = [F.col(at).desc(), F.col(tiebreak)]
    found = df.limit(0)
    for part, begin, length in located(df, numbers, offset, limit, total):
        found = found.unionByName(part.orderBy(*order).offset(begin).limit(length))
    return found.orderBy(*order).withColumn("total", F.lit(total).cast("long"))
