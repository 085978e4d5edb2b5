"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: Run
    sql: str | None


REGISTERED: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def put(run: Run) -> Run:
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = Registered(name, run, sql)
        return run

    return put
