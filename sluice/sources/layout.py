"""Fixed-width layouts: ``TYPE [(length | offset+length | begin:end)] [NULLIF 'text' | hex]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Type names, the struct code and bytes of each number (fixed values); text has no code.
NUMBERS = {
    ("SMALLINT", 2): "i2", ("INTEGER", 4): "i4", ("BIGINT", 8): "i8", ("UNSIGNED SMALLINT", 2): "u2",
    ("UNSIGNED INTEGER", 4): "u4", ("FLOAT", 4): "f4", ("DOUBLE", 8): "f8",
}
NAMES = {
    "CHAR": "CHAR", "CHARACTER": "CHAR", "VARCHAR": "VARCHAR", "CHARACTER VARYING": "VARCHAR", "SMALLINT": "SMALLINT",
    "SHORT": "SMALLINT", "INTEGER": "INTEGER", "INT": "INTEGER", "BIGINT": "BIGINT", "LONG": "BIGINT",
    "UNSIGNED SMALLINT": "UNSIGNED SMALLINT", "UNSIGNED SHORT": "UNSIGNED SMALLINT", "UNSIGNED INTEGER": "UNSIGNED INTEGER",
    "UNSIGNED INT": "UNSIGNED INTEGER", "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE",
}
DEFAULT = {"SMALLINT": 2, "INTEGER": 4, "BIGINT": 8, "UNSIGNED SMALLINT": 2, "UNSIGNED INTEGER": 4, "FLOAT": 4, "DOUBLE": 8}
#: A name with another length is another type.
RESIZED = {
    ("INTEGER", 2): "SMALLINT", ("INTEGER", 8): "BIGINT", ("UNSIGNED INTEGER", 2): "UNSIGNED SMALLINT", ("FLOAT", 8): "DOUBLE",
}
SPARK = {"i2": "smallint", "i4": "int", "i8": "bigint", "u2": "int", "u4": "bigint", "f4": "float", "f8": "double"}


@dataclass(frozen=True)
class Field:
    """``code`` is a number's format; text has none. ``nullif`` are the bytes that mean null."""

    kind: str
    offset: int
    length: int
    code: str | None
    nullif: bytes | None

    @property
    def spark_type(self) -> str:
        return SPARK[self.code] if self.code else "string"


def parse_field(spec: str, at: int = 0, preserve: bool = False, output: bool = False) -> Field:
    """One column; without an offset it begins at ``at``, the end of the column before. Output layouts take lengths only."""
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z\s]*?|)\s*(?:\(\s*([\d+:\s]+)\)|([\d+:\s]+))?\s*(?:NULLIF\s*(.+?))?\s*", spec, re.I | re.S)
    if not m:
        raise ValueError(f"can't read column {spec!r}")
    name = " ".join(m[1].upper().split())
    if not name:
        if output:
            raise ValueError("an output column needs a type")
        name = "VARCHAR" if preserve else "CHAR"
    elif name not in NAMES or m[3]:
        raise ValueError(f"unknown type in {spec!r}")
    kind = NAMES[name]
    place = re.sub(r"\s", "", m[2] or m[3] or "")
    offset, length = at, None
    if place:
        p = re.fullmatch(r"(?:(\d+)([+:]))?(\d+)", place)
        if not p:
            raise ValueError(f"can't read the place in {spec!r}")
        length = int(p[3])
        if p[1]:
            if output:
                raise ValueError("an output column takes a length only")
            offset = int(p[1]) - 1
            length = length - int(p[1]) + 1 if p[2] == ":" else length
            if offset < 0:
                raise ValueError(f"offsets begin with 1: {spec!r}")
    text = kind in ("CHAR", "VARCHAR")
    if length is None:
        if text:
            raise ValueError(f"a length is needed: {spec!r}")
        length = DEFAULT[kind]
    kind = RESIZED.get((kind, length), kind)
    if length <= 0 or not text and (kind, length) not in NUMBERS:
        raise ValueError(f"invalid length in {spec!r}")
    nullif = None
    if m[4]:
        if (q := m[4])[0] in "'\"":
            if len(q) < 2 or q[-1] != q[0]:
                raise ValueError(f"a quote is not closed: {spec!r}")
            nullif = q[1:-1].encode()
        else:
            if not re.fullmatch(r"([0-9A-Fa-f]{2})+", q):
                raise ValueError(f"hex digits come in pairs: {spec!r}")
            nullif = bytes.fromhex(q)
        if len(nullif) > length or not text and len(nullif) != length:
            raise ValueError(f"NULLIF doesn't fit: {spec!r}")
    return Field(kind, offset, length, NUMBERS.get((kind, length)), nullif)


def parse_layout(columns: list[tuple[str, bool]] | list[str], stride: int = 0, output: bool = False) -> tuple[list[Field], int]:
    """All columns, and a record's bytes: up to the last column's end, or more if ``stride`` says so."""
    found, at = [], 0
    for c in columns:
        spec, preserve = c if isinstance(c, tuple) else (c, False)
        found.append(parse_field(spec, at, preserve, output))
        at = found[-1].offset + found[-1].length
    if not found:
        raise ValueError("at least one column is needed")
    least = max(f.offset + f.length for f in found)
    if stride and stride < least:
        raise ValueError(f"STRIDE is {stride}, columns need {least}")
    return found, stride or least


def spelled(f: Field) -> str:
    """The column as a control file has it."""
    name = f"{f.kind}({f.length})" if f.kind in ("CHAR", "VARCHAR") else f.kind
    return name + (f" NULLIF {f.nullif.hex().upper()}" if f.nullif is not None else "")
