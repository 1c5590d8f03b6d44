"""Names, schema references and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of names and schema references.
IDENTIFIER = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\z"
SCHEMA_REF = r"(?s)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(@.+)?\z"
CONSTRAINT_PREFIX = r"^[\^~>=< ]+"
DIGEST_PREFIX = "sha256:"


def record_id(namespace: Column, name: Column) -> Column:
    """Catalog id: ``namespace/name``."""
    return F.concat_ws("/", namespace, name)


def is_identifier(name: Column) -> Column:
    """True for 1-63 lowercase letters, digits and inner hyphens."""
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def is_schema_ref(ref: Column) -> Column:
    """True for ``module`` or ``module@constraint`` with a well-formed module and a non-empty constraint."""
    return F.coalesce(ref.rlike(SCHEMA_REF), F.lit(False))


def schema_ref_module(ref: Column) -> Column:
    """The part before the first ``@``."""
    return F.substring_index(ref, "@", 1)


def schema_ref_constraint(ref: Column) -> Column:
    """The part after the first ``@``; empty when there is none."""
    return F.when(F.instr(ref, "@") > 0, F.substr(ref, F.instr(ref, "@") + F.lit(1))).when(
        ref.isNotNull(), F.lit("")
    )


def format_schema_ref(module: Column, constraint: Column) -> Column:
    """Inverse of the two functions above."""
    return F.when(F.coalesce(constraint, F.lit("")) == "", module).otherwise(F.concat_ws("@", module, constraint))


def strip_constraint(constraint: Column) -> Column:
    """Drop leading comparison signs and spaces, leaving the bare version."""
    return F.regexp_replace(constraint, CONSTRAINT_PREFIX, "")


def sha256_digest(content: Column) -> Column:
    """``sha256:`` plus the hex digest."""
    return F.concat(F.lit(DIGEST_PREFIX), F.sha2(content, 256))
