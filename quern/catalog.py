"""All registered queries of the engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import audits, chats, cleaning, curation, duplicates, profiles, records, scores, selections

FAMILIES = (chats, cleaning, duplicates, selections, profiles, scores, audits, records, curation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, (f, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
