"""Writes as relational operations: upserts, insert-or-ignore, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(versions: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the last by order. max_by combines before the shuffle; a hot key doesn't sort."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*").select(*versions.columns)


def first_wins(versions: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by order: insert or ignore."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*").select(*versions.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """rows over table: a row of the same key replaces what is there."""
    new = last_wins(rows, keys, order)
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """table, and rows of keys it lacks."""
    return table.unionByName(first_wins(rows, keys, order).join(table.select(*keys), keys, "left_anti"))


def delete(table: DataFrame, gone: DataFrame, keys: dict[str, str] | list[str]) -> DataFrame:
    """table without the rows whose key columns equal those of gone; keys may rename: {table's: gone's}."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    return table.join(gone.select(*[F.col(b).alias(a) for a, b in names.items()]), list(names), "left_anti")


def delete_projects(gone: DataFrame, projects: DataFrame, sessions: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """All tables without some projects (id): their sessions and what belongs to these go too."""
    lost = sessions.join(gone.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("id")
    out = {"projects": delete(projects, gone, ["id"]), "sessions": delete(sessions, lost, ["id"])}
    return out | {name: delete(t, lost, {"session_id": "id"}) for name, t in children.items()}


def newest_first(table: DataFrame, column: str) -> DataFrame:
    return table.orderBy(F.col(column).desc(), "id")
