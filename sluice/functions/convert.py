"""Text to typed values, each with an error code instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import ColumnSpec

INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
#: A timestamp in the usual form: 19 characters.
PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
#: A date, and a date with a time that may have a zone, which doesn't count. The year 0 doesn't exist.
DATE = r"(?!0000-)\d{4,6}-\d{1,2}-\d{1,2}"
TIME = r"\d{1,2}:\d{2}(:\d{2}(\.\d*)?)?(\s*(Z|[+-]\d{1,2}(:?\d{2})?))?"
MOMENT = rf"^\s*{DATE}([ T]{TIME})?\s*$"
COMPACT = r"^\s*(?!0000)(\d{4})(\d{2})(\d{2})\s*$"
#: A number that isn't zero.
NONZERO = r"^[^eE]*[1-9]"
#: More digits of a second than are kept: they are rounded. The end of a day is the beginning of the next one.
FINE = r"^\s*(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})(\.\d{7,})\s*$"
MIDNIGHT = r"^\s*(\d{4}-\d{2}-\d{2})[ T]24:00(:00(\.0*)?)?\s*$"
#: Beginnings of words for booleans, and what else stands for one (fixed values).
TRUE = "t tr tru true y ye yes on 1"
FALSE = "f fa fal fals false n no of off 0"


def trimmed(text: Column, length: int) -> Column:
    """Text without the trailing blanks that go beyond ``length``."""
    rest = text.substr(F.lit(length + 1), F.length(text))
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.rtrim(rest))).otherwise(text)


def typed(text: Column, column: ColumnSpec) -> Column:
    """The value, or null where the text has no value of the type."""
    base, kind = column.base, column.spark_type
    if base in ("char", "character", "varchar", "character varying"):
        return trimmed(text, _limit(column)) if _limit(column) else text
    if kind == "string":
        return text
    if kind in ("smallint", "int", "bigint"):
        return F.when(text.rlike(INTEGER), F.trim(text).try_cast(kind))
    if kind in ("float", "double"):
        value = F.trim(text).try_cast(kind)
        # A number too large becomes infinite, one too small zero: both are out of range.
        fits = (F.abs(value) < F.lit(float("inf"))) & ((value != 0) | ~text.rlike(NONZERO))
        return F.when(text.rlike(NUMBER), F.when(fits, value)).when(text.rlike(SPECIAL), value)
    if kind.startswith("decimal"):
        return F.when(text.rlike(NUMBER), F.trim(text).try_cast(kind))
    if base == "fast_timestamp":
        return F.when(text.rlike(PLAIN), carried(text)).otherwise(typed(text, ColumnSpec(column.name, "timestamp", column.not_null)))
    if kind == "timestamp_ntz":
        second = F.regexp_extract(text, FINE, 1).try_cast(kind)
        part = F.round(F.concat(F.lit("0"), F.substring(F.regexp_extract(text, FINE, 2), 1, 20)).try_cast("decimal(20,18)"), 6)
        next_day = F.date_add(F.regexp_extract(text, MIDNIGHT, 1).try_cast("date"), 1).cast(kind)
        return (
            F.when(text.rlike(PLAIN), F.coalesce(F.when(~F.startswith(text, F.lit("0000")), text.try_cast(kind)), next_day))
            .when(text.rlike(FINE), second + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), part))
            .when(text.rlike(MIDNIGHT), next_day)
            .when(text.rlike(MOMENT), F.trim(text).try_cast(kind))
            .when(text.rlike(COMPACT), _dashed(text).try_cast(kind))
        )
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word.isin(TRUE.split()), True).when(word.isin(FALSE.split()), False)
    if kind == "date":
        return F.when(text.rlike(MOMENT), F.trim(text).try_cast(kind)).when(text.rlike(COMPACT), _dashed(text).try_cast(kind))
    return F.trim(text).try_cast(kind)


def _dashed(text: Column) -> Column:
    return F.regexp_replace(text, COMPACT, "$1-$2-$3")


def carried(text: Column) -> Column:
    """A time stamp in ``PLAIN`` form from its digits, without a check of parts: what a part has too much goes to the next one."""
    part = lambda at, n: F.substring(text, at, n).cast("int")
    day = F.date_add(F.add_months(F.make_date(part(1, 4), F.lit(1), F.lit(1)), part(6, 2) - 1), part(9, 2) - 1)
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), part(12, 2), part(15, 2), part(18, 2).cast("decimal(18,6)"))


def _limit(column: ColumnSpec) -> int | None:
    """Most characters, where the type has such a bound."""
    if column.base in ("char", "character", "varchar", "character varying"):
        return column.arguments[0] if column.arguments else 1 if column.base in ("char", "character") else None
    return None


def faulty(text: Column, value: Column, column: ColumnSpec) -> Column:
    """Whether a text, of which ``typed`` made ``value``, isn't null and has no value of the type."""
    if n := _limit(column):
        return F.length(value) > n
    return F.lit(False) if column.spark_type == "string" else text.isNotNull() & value.isNull()


def code(text: Column, column: ColumnSpec) -> Column:
    """``length``, ``range`` or ``syntax``: what is wrong with a faulty text."""
    kind = column.spark_type
    if kind == "string":
        return F.lit("length")
    if kind in ("timestamp_ntz", "date", "boolean"):
        return F.lit("syntax")
    return F.when(text.rlike(INTEGER if kind in ("smallint", "int", "bigint") else NUMBER), "range").otherwise("syntax")
