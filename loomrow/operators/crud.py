"""Reads and writes of records by primary key, each a new DataFrame.

Keys are columns; a table may have several rows of a key, and all of them are
updated or deleted. Null key values match nothing. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrow.functions.keys import Key
from loomrow.operators.frames import small


def point_read(table: DataFrame, key: Key) -> DataFrame:
    """The first row (by all columns) of a key, none if it is absent. The predicate reaches the scan."""
    return table.where(key.predicate()).orderBy(*table.columns).limit(1)


def read_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is among keys; absent keys give none."""
    return table.join(small(keys.select(*on).distinct()), list(on), "left_semi")


def batch_read(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of all keys; the job fails with the key's name if one is absent."""
    wanted = keys.select(*on).distinct()
    found = wanted.join(table.withColumn("is found", F.lit(True)), list(on), "left")
    named = F.concat(F.lit("no record of key "), F.to_json(F.struct(*on)))
    checked = F.when(F.col("is found").isNull(), F.raise_error(named)).otherwise(F.col("is found"))
    return found.where(checked.cast("boolean")).select(*table.columns)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows; keys aren't checked (see duplicate_keys)."""
    return table.unionByName(rows.select(*table.columns))


def duplicate_keys(table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return table.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def update(table: DataFrame, changes: DataFrame, on: Sequence[str], dirty: str | None = None) -> DataFrame:
    """table with the fields of changes (one row a key) put in.

    A field is put in if its name is in the array column dirty; without that
    column, if it isn't null. Rows without a change stay.
    """
    fields = [c for c in changes.columns if c not in on and c != dirty]
    new = changes.select(*on, F.lit(True).alias("is changed"), *([F.col(dirty).alias("dirty fields")] if dirty else []), *(F.col(c).alias(f"new {c}") for c in fields))
    joined = table.join(new, list(on), "left")

    def put(c: str) -> Column:
        given = F.array_contains("dirty fields", c) if dirty else F.col(f"new {c}").isNotNull()
        return F.when(F.col("is changed") & given, F.col(f"new {c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(put(c) if c in fields else F.col(c) for c in table.columns))


def found_by_update(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """keys with updated: whether the table has such a row."""
    there = table.select(*on).distinct().withColumn("updated", F.lit(True))
    return keys.join(there, list(on), "left").withColumn("updated", F.coalesce("updated", F.lit(False)))


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """table without the rows of keys."""
    return table.join(small(keys.select(*on).distinct()), list(on), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Updates what is there and inserts the rest; rows has one row a key, and null fields leave a found row's as they are."""
    fields = [c for c in table.columns if c not in on]
    new = rows.select(*on, *(F.col(c).alias(f"new {c}") for c in fields))
    both = table.join(new, list(on), "full")
    return both.select(*(F.coalesce(f"new {c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def read_through(cache: DataFrame, table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of keys from the cache, else from the table, with from_cache; absent keys give none."""
    wanted = keys.select(*on).distinct()
    cached = cache.select(*table.columns).join(wanted, list(on), "left_semi")
    rest = wanted.join(cached.select(*on).distinct(), list(on), "left_anti")
    stored = table.join(rest, list(on), "left_semi")
    return cached.withColumn("from_cache", F.lit(True)).unionByName(stored.withColumn("from_cache", F.lit(False)))


def write_back(cache: DataFrame, table: DataFrame, rows: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The cache and the table after rows are written to whichever holds the key; unknown keys go to the table."""
    held = cache.select(*on).distinct()
    return upsert(cache, rows.join(held, list(on), "left_semi"), on), upsert(table, rows.join(held, list(on), "left_anti"), on)


def evict(cache: DataFrame, table: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The cache without keys, and the table with the records it held."""
    leaving = cache.join(keys.select(*on).distinct(), list(on), "left_semi")
    return cache.join(keys.select(*on).distinct(), list(on), "left_anti"), insert(table, leaving)


# Records in change: columns of a row that say what has been done to it.
OP, DIRTY, SOURCE_TX = "_op", "_dirty", "_src_tx"


def as_records(table: DataFrame, tx: int | Column = -1, op: str = "R") -> DataFrame:
    """table with the change columns: operation (R, U, I or D), changed fields, and version."""
    tx = F.lit(tx) if isinstance(tx, int) else tx
    return table.withColumns({OP: F.lit(op), DIRTY: F.array().cast("array<string>"), SOURCE_TX: tx.cast("long")})


def set_values(records: DataFrame, values: Mapping[str, Column], on: Sequence[str]) -> DataFrame:
    """Sets fields that exist and are no key fields; each is marked once."""
    if bad := [f for f in values if f in on or f not in records.columns]:
        raise ValueError(f"{bad[0]} is a key field or no field at all")
    marked = F.array_union(DIRTY, F.array(*map(F.lit, values)))
    op = F.when(F.col(OP) == "R", "U").otherwise(F.col(OP))
    return records.withColumns({**values, DIRTY: marked, OP: op})


def remove_field(records: DataFrame, field: str, on: Sequence[str]) -> DataFrame:
    """Drops a field and its mark."""
    if field in on:
        raise ValueError(f"{field} is a key field")
    return records.drop(field).withColumn(DIRTY, F.array_remove(DIRTY, field))


def mark_all(records: DataFrame, on: Sequence[str]) -> DataFrame:
    """Marks every field that is no key field; the operation stays."""
    fields = [c for c in records.columns if c not in (*on, OP, DIRTY, SOURCE_TX)]
    return records.withColumn(DIRTY, F.array(*map(F.lit, fields)).cast("array<string>"))


def removed(records: DataFrame) -> DataFrame:
    """Tombstones."""
    return records.withColumn(OP, F.lit("D"))


def value(field: str) -> Column:
    """A record's value, null once it is deleted."""
    return F.when(F.col(OP) != "D", F.col(field))
