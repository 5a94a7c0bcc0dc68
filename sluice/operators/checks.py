"""Fields to typed rows, with the first error of each record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.convert import code, faulty, typed
from ..plans.spec import TableSpec
from ..workspace import compiled

ERR = "struct<code: string, col: int, msg: string>"


def error(name: str | Column, col: int | Column | None = None, msg: str | Column = "") -> Column:
    """A code, the column (for a wrong number of fields: how many there are), a message."""
    name, col, msg = (x if isinstance(x, Column) else F.lit(x) for x in (name, col, msg))
    return F.struct(name.alias("code"), col.cast("int").alias("col"), msg.alias("msg")).cast(ERR)


def first_of(errors: list[Column]) -> Column:
    """The first error, as a column that Spark computes where it is made.

    A filter on a column made of others is pushed below them: each use of a text or value in the errors would then cut
    and convert the record again. One that names a row's place isn't moved.
    """
    return F.when(F.monotonically_increasing_id() >= 0, F.coalesce(*errors, F.lit(None).cast(ERR)))


def text_of(position: int, null: str, force: bool, plain: bool) -> Column:
    """A field's text; null if it is the null string and had no quotes. ``plain`` fields are texts, and none had."""
    field = F.try_element_at("fields", F.lit(position + 1))
    if force:
        return field if plain else field["t"]
    return F.when(field != null, field) if plain else F.when((field["t"] != null) | field["q"], field["t"])


def checked_values(rows: DataFrame, spec: TableSpec) -> tuple[DataFrame, list[Column], list[Column]]:
    """``rows`` with the values of the texts ``_t0``, ``_t1``, ..., the value columns, and each one's error.

    Texts and values are columns of their own: both are looked at more than once, and Spark computes columns once.
    """
    compiled(rows.sparkSession)
    texts = [F.col(f"_t{i}") for i in range(len(spec.columns))]
    values = [F.col(f"_v{i}") for i in range(len(spec.columns))]
    rows = rows.select("*", *(typed(t, c).cast(c.spark_type).alias(f"_v{i}") for i, (t, c) in enumerate(zip(texts, spec.columns, strict=True))))
    errors = [F.when(faulty(t, v, c), error(code(t, c), i + 1, c.name)) for i, (t, v, c) in enumerate(zip(texts, values, spec.columns, strict=True))]
    return rows, values, errors


def convert_fields(records: DataFrame, spec: TableSpec, null: str = "", force: tuple[str, ...] = (), least: int | None = None, defaults: dict | None = None) -> DataFrame:
    """``rec_no``, ``raw``, ``err`` and the columns of ``spec`` from ``fields``.

    Errors in the order in which they are looked for: an open quote, too few or too many fields, then types from left
    to right. From ``least`` fields on, missing trailing ones take their value in ``defaults``.
    """
    wanted = len(spec.columns)
    plain = isinstance(records.schema["fields"].dataType.elementType, StringType)
    texts = [text_of(i, null, c.name in force, plain).alias(f"_t{i}") for i, c in enumerate(spec.columns)]
    rows = records.select("rec_no", "raw", F.col("fields").isNull().alias("_open"), F.size("fields").alias("_n"), *texts)
    rows, values, wrong = checked_values(rows, spec)
    n, names = F.col("_n"), F.array(*(F.lit(c.name) for c in spec.columns)) if spec.columns else F.array().cast("array<string>")
    errors = [
        F.when(F.col("_open"), error("quote", 1, "unterminated quote")),
        F.when(n > wanted, error("arity", n, "extra data after last expected column")),
        F.when(n < (wanted if least is None else least), error("arity", n, F.concat(F.lit('missing data for column "'), F.try_element_at(names, n + 1), F.lit('"')))),
    ]
    columns = []
    for i, (v, c) in enumerate(zip(values, spec.columns, strict=True)):
        if defaults and c.name in defaults:
            v = F.when(n <= i, F.lit(defaults[c.name]).cast(c.spark_type)).otherwise(v)
        columns.append(v.alias(c.name))
    return rows.select("rec_no", "raw", first_of(errors + wrong).alias("err"), *columns)


def constrain(rows: DataFrame, spec: TableSpec, checks: bool = False) -> DataFrame:
    """Adds NOT NULL violations (always) and CHECK violations (if asked for) to ``err``; a CHECK that is null passes."""
    errors = [F.col("err")]
    errors += [F.when(F.col(f"`{c.name}`").isNull(), error("not_null", i + 1, c.name)) for i, c in enumerate(spec.columns) if c.not_null]
    if checks:
        errors += [F.when(~F.expr(x), error("check", None, name)) for name, x in spec.checks]
    return rows.withColumn("err", reduce(lambda a, b: F.coalesce(a, b), errors))


class ShapeError(ValueError):
    """Rows that no coercion makes rows of the target."""


def coerce(rows: DataFrame, source: TableSpec, target: TableSpec) -> DataFrame:
    """Row-shape coercion: columns by position; equal types pass, others go through their text. Counts must match."""
    if len(source.columns) != len(target.columns):
        raise ShapeError(f"{len(source.columns)} columns returned, {len(target.columns)} expected")
    pairs = list(zip(source.columns, target.columns, strict=True))
    same = [a.spark_type == b.spark_type and not b.arguments for a, b in pairs]
    texts = [F.col(f"`{a.name}`").cast("string").alias(f"_t{i}") for i, (a, _) in enumerate(pairs)]
    kept = [F.col(f"`{a.name}`").alias(f"_s{i}") for i, (a, _) in enumerate(pairs)]
    rows, values, wrong = checked_values(rows.select("rec_no", "raw", "err", *kept, *texts), target)
    columns = [(F.col(f"_s{i}") if same[i] else v).alias(c.name) for i, (v, c) in enumerate(zip(values, target.columns, strict=True))]
    errors = [w for w, x in zip(wrong, same, strict=True) if not x]
    return rows.select("rec_no", "raw", first_of([F.col("err"), *errors]).alias("err"), *columns)
