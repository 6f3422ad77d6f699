"""Tables read in keyset pages, and rows as documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import stored


def check_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.]+", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def after_cursor(updated: str, key: str, cursor: tuple | None) -> Column:
    """Rows after (updated, key) of the cursor, in a form that reaches the scan's filters."""
    if cursor is None or cursor[0] is None:
        return F.lit(True) if cursor is None or cursor[1] is None else F.col(key) > F.lit(cursor[1])
    at = F.lit(cursor[0])
    return (F.col(updated) > at) | ((F.col(updated) == at) & (F.col(key) > F.lit(cursor[1])))


def keyset_page(table: DataFrame, updated: str, key: str, cursor: tuple | None, rows: int) -> DataFrame:
    """The next page in order of (updated, key). Rows without a time are outside the keyset; read them with undated()."""
    check_identifier(updated), check_identifier(key)
    return table.where(F.col(updated).isNotNull() & after_cursor(updated, key, cursor)).orderBy(updated, key).limit(rows)


def undated(table: DataFrame, updated: str, key: str, cursor_key=None) -> DataFrame:
    rows = table.where(F.col(updated).isNull())
    return rows if cursor_key is None else rows.where(F.col(key) > F.lit(cursor_key))


def next_cursor(page: DataFrame, updated: str, key: str, cursor: tuple | None = None) -> tuple | None:
    """The largest (updated, key) of a page; the one before if the page is empty or has no times."""
    last = page.agg(F.max(F.when(F.col(updated).isNotNull(), F.struct(updated, key))).alias("c")).first()["c"]
    return cursor if last is None else (last[0], last[1])


def drain(table: DataFrame, updated: str, key: str, cursor: tuple | None, rows: int, handle) -> tuple | None:
    """Hand over page after page until none is left; the cursor moves only after a page was handled."""
    while True:
        page = stored(keyset_page(table, updated, key, cursor, rows), "keyset-page")
        if page.isEmpty():
            return cursor
        handle(page)
        cursor = next_cursor(page, updated, key, cursor)


def change_op(deleted: Column | None) -> Column:
    """delete for rows whose soft-delete column is set, else upsert."""
    return F.lit("upsert") if deleted is None else F.when(F.coalesce(deleted.cast("boolean"), F.lit(False)), "delete").otherwise("upsert")


def rows_as_json(table: DataFrame, columns: list[str]) -> Column:
    """The columns as one JSON object with names in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def jdbc_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], **partitioning) -> DataFrame:
    """A database table; partitioning takes column, lowerBound, upperBound and numPartitions for parallel reads."""
    check_identifier(table)
    return spark.read.jdbc(url, table, properties=properties, **partitioning)
