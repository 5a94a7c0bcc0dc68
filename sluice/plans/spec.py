"""What a load declares about its target: types, NOT NULL, CHECK and unique keys, which Parquet tables cannot hold."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Declared type names and the Spark type each becomes (fixed values).
TYPES = {
    "int2": "smallint", "smallint": "smallint", "int4": "int", "int": "int", "integer": "int", "int8": "bigint",
    "bigint": "bigint", "float4": "float", "real": "float", "float": "float", "float8": "double", "double": "double", "text": "string",
    "timestamp": "timestamp_ntz", "fast_timestamp": "timestamp_ntz", "date": "date", "bool": "boolean", "boolean": "boolean",
}


@dataclass(frozen=True)
class ColumnSpec:
    """A column: ``kind`` is a declared type, with its length or precision in brackets where it has one."""

    name: str
    kind: str
    not_null: bool = False

    @property
    def base(self) -> str:
        return re.split(r"\s*\(", self.kind.strip().lower())[0]

    @property
    def arguments(self) -> list[int]:
        found = re.search(r"\(([^)]*)\)", self.kind)
        return [int(x) for x in found[1].split(",")] if found else []

    @property
    def spark_type(self) -> str:
        if self.base in ("char", "character", "varchar", "character varying"):
            return "string"
        if self.base in ("numeric", "decimal"):
            p, s = (*self.arguments, 38, 18)[:2] if not self.arguments else (*self.arguments, 0)[:2]
            return f"decimal({p},{s})"
        if self.base not in TYPES:
            raise ValueError(f"unknown type {self.kind!r}")
        return TYPES[self.base]


@dataclass(frozen=True)
class UniqueKey:
    """A unique key: SQL expressions, for the rows that ``where`` holds for; nulls differ from each other unless ``nulls_distinct`` is off."""

    expressions: tuple[str, ...]
    where: str | None = None
    nulls_distinct: bool = True


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[ColumnSpec, ...]
    unique: tuple[UniqueKey, ...] = ()
    #: Names and SQL expressions; one that yields null passes.
    checks: tuple[tuple[str, str], ...] = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.spark_type}" for c in self.columns)


def spec_of(columns: str, unique: tuple = (), checks: tuple = ()) -> TableSpec:
    """From ``name type [not null], ...``; commas in brackets belong to a type."""
    found = []
    for part in re.split(r",(?![^(]*\))", columns):
        m = re.fullmatch(r"\s*(\w+)\s+(.+?)(\s+not\s+null)?\s*", part, re.I)
        if not m:
            raise ValueError(f"can't read column {part!r}")
        found.append(ColumnSpec(m[1], m[2], bool(m[3])))
    return TableSpec(tuple(found), tuple(unique), tuple(checks))
