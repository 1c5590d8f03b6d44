"""Fingerprints in DuckDB terms, for the SQL twins: the canonical text of rows and its digest."""

from __future__ import annotations

from collections.abc import Mapping


def text_sql(name: str, kind: str) -> str:
    """Canonical text of a column of ``kind``: ``plain`` (whole numbers and text), ``double`` or ``timestamp``."""
    if kind == "timestamp":
        return f"CAST(epoch_us({name}) AS VARCHAR)"
    if kind == "double":
        size, power = f"abs({name})", f"CAST(floor(log2(abs({name}))) AS INTEGER)"
        scaled = f"({size} * pow(2.0, 52 - {power}))"
        step = f"(CASE WHEN {scaled} >= 9007199254740992 THEN 1 WHEN {scaled} < 4503599627370496 THEN -1 ELSE 0 END)"
        whole = f"CAST({scaled} / pow(2.0, {step}) AS BIGINT)"
        return f"CASE WHEN {name} = 0 THEN '0' ELSE concat(CASE WHEN {name} < 0 THEN '-' ELSE '' END, {whole}, 'p', {power} + {step} - 52) END"
    return f"CAST({name} AS VARCHAR)"


def row_sql(columns: Mapping[str, str]) -> str:
    """Text of a row: names in order, each with the length and canonical text of its value, ``-`` for NULL."""
    parts = []
    for name in sorted(columns):
        text = text_sql(name, columns[name])
        value = f"CASE WHEN {name} IS NULL THEN '-' ELSE concat(CAST(length({text}) AS VARCHAR), ':', {text}) END"
        parts.append(f"concat('{name}=', {value})")
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def digest_sql(rows: str, keys: str = "", salt: str = "''") -> str:
    """Common table expressions up to ``prints`` (keys, row_count, fingerprint) over a query giving ``txt`` and the keys."""
    prefix = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    limbs = ", ".join(
        f"CAST(sum((CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT) >> {20 * j}) & 1048575) AS VARCHAR)"
        for i in range(4)
        for j in range(3)
    )
    return f"""hashed AS (SELECT {prefix}sha256(txt) AS h FROM ({rows})),
      parts AS (SELECT {prefix}substr(h, 1, 2) AS part, count(*) AS n, sha256(concat_ws(',', substr(h, 1, 2), CAST(count(*) AS VARCHAR), {limbs})) AS d
                FROM hashed GROUP BY {prefix}substr(h, 1, 2)),
      prints AS (SELECT {prefix}CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
                        concat('sha256:', sha256(concat({salt}, coalesce(string_agg(d, '' ORDER BY d), '')))) AS fingerprint FROM parts {group})"""


PLAIN, DOUBLE, TIME = "plain", "double", "timestamp"

#: Kinds of all columns of the given tables that are fingerprinted.
CUSTOMER = {"c_custkey": PLAIN, "c_name": PLAIN, "c_nationkey": PLAIN, "c_acctbal": DOUBLE, "c_mktsegment": PLAIN}
ORDERS = {
    "o_orderkey": PLAIN, "o_custkey": PLAIN, "o_orderstatus": PLAIN, "o_totalprice": DOUBLE, "o_orderdate": TIME, "o_orderpriority": PLAIN,
}
LINEITEM = {
    "l_orderkey": PLAIN, "l_partkey": PLAIN, "l_suppkey": PLAIN, "l_linenumber": PLAIN, "l_quantity": DOUBLE, "l_extendedprice": DOUBLE,
    "l_discount": DOUBLE, "l_tax": DOUBLE, "l_returnflag": PLAIN, "l_linestatus": PLAIN, "l_shipdate": TIME,
}


def tables_sql(tables: Mapping[str, Mapping[str, str]]) -> str:
    """(table_name, row_count, fingerprint) of whole tables."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS table_name, {row_sql(columns)} AS txt FROM {name}" for name, columns in tables.items())
    return f"SELECT table_name, row_count, fingerprint FROM (WITH {digest_sql(rows, keys='table_name')} SELECT * FROM prints)"
