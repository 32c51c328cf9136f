"""Queries of the schema drift operator (problem 3)."""

from __future__ import annotations

from ..operators import drift
from .registry import query, table


@query("p3_found")
def p3_found(spark, d):
    changes = drift.schema_changes(table(spark, d, "import_files"), table(spark, d, "raw_rows"))
    return changes.select("file_id", "change_kind", "old_name", "new_name")


@query("p3_unified")
def p3_unified(spark, d):
    return drift.unified(table(spark, d, "import_files"), table(spark, d, "raw_rows"))


@query("p3_table")
def p3_table(spark, d):
    """The unified table with typed columns."""
    return drift.typed_table(drift.unified(table(spark, d, "import_files"), table(spark, d, "raw_rows")))
