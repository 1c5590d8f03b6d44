"""Data contracts: declared columns, their checks and their evolution."""

from weirgate.contracts.conformance import conform, conformance_report, duplicate_fields
from weirgate.contracts.evolution import breaking_changes, read_together, schema_diff
from weirgate.contracts.types import Contract, Field, contract_type, foreign_type, spark_type

__all__ = [
    "Contract",
    "Field",
    "breaking_changes",
    "conform",
    "conformance_report",
    "contract_type",
    "duplicate_fields",
    "foreign_type",
    "read_together",
    "schema_diff",
    "spark_type",
]
