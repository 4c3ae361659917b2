"""All registered queries of the library proper and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.plans import documents_sql, expressions, oracles, queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own.QUERIES | expressions.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | expressions.ORACLES | documents_sql.ORACLES
