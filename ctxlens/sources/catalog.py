"""Which collections and search indexes a store has: made if missing, surveyed, dropped if undeclared, and held to an allowance."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .log_table import LogTable
from .sinks import ensure_tables

log = logging.getLogger(__name__)
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("collection", "name", "folder", "status")] + [T.StructField(n, T.LongType()) for n in ("seq", "created")])


@dataclass(frozen=True)
class SearchIndex:
    """A declared index; ``build(spark, folder)`` makes it under a folder of its own (a VectorIndex or TextIndex, say)."""

    collection: str
    name: str
    build: Callable[[SparkSession, str], object]

    @property
    def label(self) -> str:
        return f"{self.collection}.{self.name}"


class OverAllowance(RuntimeError):
    """More search indexes than the store may hold."""


def _registry(spark: SparkSession, base: str) -> LogTable:
    return LogTable(spark, f"{base}/_indexes", SCHEMA, ["collection", "name"], "seq", "created", buckets=1)


def survey(spark: SparkSession, base: str) -> DataFrame:
    """collection, name, folder of the search indexes that the store holds."""
    return _registry(spark, base).read().where("status = 'ready'").select("collection", "name", "folder").orderBy("collection", "name")


def _record(spark: SparkSession, base: str, collection: str, name: str, folder: str, status: str) -> None:
    registry = _registry(spark, base)
    n = registry.last() + 1
    registry.append(spark.createDataFrame([(collection, name, folder, status, n, n)], SCHEMA), n)


def apply(spark: SparkSession, base: str, declared: list[SearchIndex], allowance: int, prune: bool = False) -> list[str]:
    """Brings a store to its declaration and returns what was done, in order.

    Collections that are missing are made. Undeclared indexes take up a place; with ``prune`` they are dropped (their files stay for readers
    under way). Nothing is built if more indexes than ``allowance`` would result. A build that dies isn't recorded, and is made anew the next time.
    """
    done = [f"created collection {name}" for name in ensure_tables(spark, base)]
    held = {f"{r.collection}.{r.name}": r for r in survey(spark, base).collect()}
    known = {i.label for i in declared}
    obsolete = sorted(set(held) - known)
    for label in obsolete:
        if not prune:
            log.warning("undeclared search index %s takes up a place; prune drops it", label)
            continue
        _record(spark, base, held[label].collection, held[label].name, held[label].folder, "dropped")
        done.append(f"dropped search index {label}")
    wanted = len(declared) + (0 if prune else len(obsolete))
    if wanted > allowance:
        raise OverAllowance(f"{wanted} search indexes wanted, {allowance} allowed")
    for index in declared:
        if index.label in held:
            continue
        folder = f"{base}/_indexes/data/{index.label}-{_registry(spark, base).last() + 1}"
        index.build(spark, folder)
        _record(spark, base, index.collection, index.name, folder, "ready")
        done.append(f"created search index {index.label}")
    return done
