"""Keys of records: values in Python, and the columns that stand for them in tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class FieldNotFoundError(KeyError):
    """A key or record has no such field."""


@dataclass(frozen=True)
class Key:
    """A table's name with ordered fields and their values; equal by value whatever its use."""

    table: str
    fields: tuple[str, ...]
    values: tuple[Any, ...]

    def __post_init__(self) -> None:
        if len(self.fields) != len(self.values) or not self.fields:
            raise ValueError("a key has as many values as fields, one at least")

    @classmethod
    def of(cls, table: str, **values: Any) -> Key:
        return cls(table, tuple(values), tuple(values.values()))

    def __contains__(self, field: str) -> bool:
        return field in self.fields

    def __len__(self) -> int:
        return len(self.fields)

    def get(self, field: str) -> Any:
        """The field's value, None if there is no such field."""
        return self.values[self.fields.index(field)] if field in self.fields else None

    def predicate(self) -> Column:
        """Equality on every field; null values match nothing."""
        return reduce(and_, (F.col(f) == F.lit(v) for f, v in zip(self.fields, self.values, strict=True)))

    def search_values(self, fields: Sequence[str]) -> tuple[Any, ...]:
        """Values in the order of an index's fields."""
        if missing := [f for f in fields if f not in self.fields]:
            raise FieldNotFoundError(f"{missing[0]} is no field of {self}")
        return tuple(self.get(f) for f in fields)

    def partitioning(self, field: str | None = None) -> Key:
        """The key that decides the partition: all of this one, or one field of it."""
        if field is None:
            return self
        return Key(self.table, (field,), self.search_values([field]))

    def __str__(self) -> str:
        return "{" + self.table + ": " + ", ".join(f"{f} -> {v}" for f, v in zip(self.fields, self.values, strict=True)) + "}"

    def to_json(self) -> str:
        return json.dumps([self.table, [[f, v] for f, v in zip(self.fields, self.values, strict=True)]])

    @classmethod
    def from_json(cls, text: str) -> Key:
        table, pairs = json.loads(text)
        return cls(table, tuple(f for f, _ in pairs), tuple(v for _, v in pairs))


class KeyBuilder:
    """Makes keys of one table step by step."""

    def __init__(self, table: str):
        self.table, self._values = table, {}

    def add(self, field: str, value: Any) -> KeyBuilder:
        self._values[field] = value
        return self

    def set(self, field: str, value: Any) -> KeyBuilder:
        if field not in self._values:
            raise FieldNotFoundError(f"{field} hasn't been added to the key of {self.table}")
        return self.add(field, value)

    def build(self) -> Key:
        return Key.of(self.table, **self._values)


def key_text(table: Column | str, fields: Mapping[str, Column | str]) -> Column:
    """The printed form of a key: {table: field -> value, ...}."""
    table = F.lit(table) if isinstance(table, str) else table
    parts = [F.concat(F.lit(f"{f} -> "), (F.col(c) if isinstance(c, str) else c).cast("string")) for f, c in fields.items()]
    return F.concat(F.lit("{"), table, F.lit(": "), F.concat_ws(", ", *parts), F.lit("}"))


def record_text(table: str, keys: Sequence[str], others: Sequence[str]) -> Column:
    """The printed form of a record: key fields are starred, null values read null."""
    shown = lambda f: F.concat(F.lit(f"*{f}: " if f in keys else f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("null")))
    return F.concat(F.lit(f"{table}: {{"), F.concat_ws(", ", *map(shown, [*keys, *others])), F.lit("}"))


def truncate(x: Column, digits: int = 4) -> Column:
    """Cuts (does not round) after so many decimals; the whole part is cut first, so the result is exact."""
    scale = 10**digits
    whole = x.cast("long")
    return whole + ((x - whole) * F.lit(float(scale))).cast("long") / F.lit(float(scale))


def truncated(x: float, digits: int = 4) -> float:
    """truncate() for one number."""
    return int(x) + int((x - int(x)) * 10**digits) / 10**digits


def sink_id(part: Column) -> Column:
    """The negative transaction number that stands for a partition's storage."""
    return -(part.cast("long") + 1)
