"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, cases, evaluation, ledgers, logic, protocols, stars, streams, texts

MODULES = [cases, audits, texts, evaluation, ledgers, logic, protocols, stars, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in MODULES:
        out |= module.SQL
    return out
