"""Functions by name: FILTER (a row to a row) and sources (a call to rows)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import first_of
from ..plans.spec import ColumnSpec, TableSpec

if TYPE_CHECKING:
    import numpy as np

MOST_ARGUMENTS = 100


class FunctionError(ValueError):
    """A call that no function, or more than one, fits; or a function that can't be used here."""


class BadRows(ValueError):
    """Raised by a filter over batches that knows the rows it refuses: a boolean for each row that it was given (a null
    counts as false), and a message that holds for all of them."""

    def __init__(self, rows, message: str):
        super().__init__(message)
        self.rows = rows


@dataclass(frozen=True)
class Filter:
    """``body`` takes columns and gives a list of result columns, or (``python``) takes values and gives a tuple or None,
    or (``batch``) takes pandas series of values (of pandas' types with nulls) and gives a sequence of result series, a row of nulls standing for None.

    A filter over batches is called with some thousands of rows at once, so it should look at rows one by one only where
    it must. If it raises ``BadRows``, it is called again without these rows. If it raises another exception, the batch is
    halved until the rows that cause it are alone, which with many bad rows takes about a call a row; so it may be called
    again with the same rows, and what it gives for a row must not depend on the others.

    ``arguments`` and ``result`` are columns; the last ``defaults`` arguments have these values. A strict one isn't
    called with a null: its result is then all nulls.
    """

    name: str
    arguments: tuple[ColumnSpec, ...]
    result: tuple[ColumnSpec, ...]
    body: Callable
    defaults: tuple = ()
    strict: bool = False
    python: bool = False
    batch: bool = False


@dataclass(frozen=True)
class Source:
    """``body(spark, *values)`` gives a DataFrame, or ``body`` is the class of a Python table function, which Spark calls; a
    variadic one takes any number of values of the last type.

    An argument of type ``table`` is a table or view of the session, ``TABLE(name)`` in a call; its rows go to the table
    function in parallel, a partition to each of its instances.
    """

    name: str
    arguments: tuple[str, ...]
    body: Callable[..., DataFrame] | type
    defaults: tuple = ()
    variadic: bool = False
    strict: bool = False


@dataclass(frozen=True)
class TableArgument:
    name: str


#: Types that a filter's arguments and results can't have (fixed values).
REFUSED = ("any", "anyelement", "anyarray", "anynonarray", "anyenum", "internal", "record", "void", "trigger", "cstring")


@dataclass
class Registry:
    filters: list[Filter] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)

    def filter_named(self, call: str) -> Filter:
        """``name`` must be the only one of its name; ``name(type, ...)`` names the types as well."""
        m = re.fullmatch(r"\s*([\w.\"]+)\s*(?:\((.*)\))?\s*", call, re.S)
        if not m:
            raise FunctionError(f"can't read {call!r}")
        name = m[1].replace('"', "").rpartition(".")[2].lower()
        found = [f for f in self.filters if f.name.lower() == name]
        if m[2] is not None:
            kinds = [ColumnSpec("x", x.strip()).spark_type for x in m[2].split(",") if x.strip()]
            found = [f for f in found if [a.spark_type for a in f.arguments] == kinds]
        if len(found) != 1:
            raise FunctionError(f"function {call} " + ("is not unique" if found else "does not exist"))
        refuse(found[0])
        return found[0]

    def source_called(self, call: str) -> tuple[Source, list]:
        name, values = parse_call(call)
        found = []
        for s in (s for s in self.sources if s.name.lower() == name.rpartition(".")[2].lower()):
            least = len(s.arguments) - len(s.defaults) - s.variadic
            if len(values) >= least and (s.variadic or len(values) <= len(s.arguments)):
                kinds = [s.arguments[min(i, len(s.arguments) - 1)] for i in range(len(values))]
                fits = [_fit(v, k) for v, k in zip(values, kinds, strict=True)]
                if all(f is not None for f in fits):
                    found.append((sum(f or 0 for f in fits), s, kinds))
        if not found:
            raise FunctionError(f"function {call} does not exist")
        best = max(x[0] for x in found)
        top = [x for x in found if x[0] == best]
        if len(top) > 1:
            raise FunctionError(f"function {call} is not unique")
        _, source, kinds = top[0]
        values = [_as(v, k) for v, k in zip(values, kinds, strict=True)]
        fixed = len(source.arguments) - source.variadic
        if len(values) < fixed:
            values += source.defaults[len(source.defaults) - (fixed - len(values)) :]
        if source.strict and any(v is None for v in values):
            raise FunctionError(f"function {source.name} takes no nulls")
        return source, values


def refuse(f: Filter) -> None:
    """Raise an error for a filter that can't be used: of an unknown or pseudo type, without a row as its result, with more
    defaults than arguments, or with too many arguments."""
    if len(f.arguments) > MOST_ARGUMENTS:
        raise FunctionError("too many arguments")
    if not f.result:
        raise FunctionError(f"function {f.name} doesn't return a row")
    if len(f.defaults) > len(f.arguments):
        raise FunctionError(f"function {f.name} has more defaults than arguments")
    for c in (*f.arguments, *f.result):
        if c.base in REFUSED or c.kind.strip().lower().startswith(("setof", "variadic")):
            raise FunctionError(f"function {f.name} has a column of type {c.kind}, which can't be used")
        try:
            c.spark_type
        except ValueError as e:
            raise FunctionError(f"function {f.name}: {e}") from e


def _fit(value, kind: str) -> int | None:
    """How well a literal fits a type; None if not at all."""
    if (kind == "table") != isinstance(value, TableArgument):
        return None
    if kind == "table":
        return 2
    if value is None or isinstance(value, str):
        return 1 if value is None or kind == "text" else 0
    order = {"int2": 15, "int4": 31, "int8": 63}
    if kind in order:
        return (2 if kind == "int4" else 1) if isinstance(value, int) and abs(value) < 1 << order[kind] else None
    return 0 if kind in ("numeric", "float8") else None


def _as(value, kind: str):
    if isinstance(value, str) and kind in ("int2", "int4", "int8"):
        return int(value)
    if isinstance(value, str) and kind in ("numeric", "float8"):
        return Decimal(value)
    return value


def parse_call(call: str) -> tuple[str, list]:
    """A name and literals: ``'text'`` with doubled quotes, NULL, numbers with any number of signs apart from ``--``, ``TABLE(name)``."""
    m = re.fullmatch(r"\s*((?:\"(?:[^\"]|\"\")+\"|\w+)(?:\.(?:\"(?:[^\"]|\"\")+\"|\w+))*)\s*\((.*)\)\s*;?\s*", call, re.S)
    if not m:
        raise FunctionError(f"can't read {call!r}")
    rest, values = m[2].strip(), []
    literal = re.compile(r"\s*(?:'((?:[^']|'')*)'|(null)\b|([-+\s]*)(\d+\.?\d*(?:e[-+]?\d+)?|\.\d+)|table\s*\(\s*([\w.`]+)\s*\))\s*(,|$)", re.I)
    at = 0
    while at < len(rest):
        x = literal.match(rest, at)
        if not x or "--" in (x[3] or ""):
            raise FunctionError(f"can't read an argument: {rest[at:]!r}")
        if x[1] is not None:
            values.append(x[1].replace("''", "'"))
        elif x[2]:
            values.append(None)
        elif x[5]:
            values.append(TableArgument(x[5]))
        else:
            number = int(x[4]) if x[4].isdigit() else Decimal(x[4])
            values.append(-number if x[3].count("-") % 2 else number)
        at = x.end()
        if x[6] == "," and at >= len(rest):
            raise FunctionError("an argument is missing")
    if len(values) > MOST_ARGUMENTS:
        raise FunctionError("too many arguments")
    return m[1].replace('"', ""), values


def apply_filter(rows: DataFrame, f: Filter) -> DataFrame:
    """``rec_no``, ``raw``, ``err`` and the filter's result columns from a row of its arguments.

    A null result, or a null argument of a strict filter, is a row of nulls, which is kept. An exception of a Python
    filter rejects its row only.
    """
    names = [a.name for a in f.arguments]
    own = [F.col(f"`{x}`") for x in names]
    nulls = F.lit(False)
    for x in own if f.strict else []:
        nulls = nulls | x.isNull()
    if not (f.python or f.batch):
        values = f.body(*own)
        columns = [F.when(F.col("err").isNull() & ~nulls, v).cast(c.spark_type).alias(c.name) for v, c in zip(values, f.result, strict=True)]
        return rows.select("rec_no", "raw", "err", *columns)
    if f.batch:
        return _filtered_batches(rows, f, own, nulls)
    body, width = f.body, len(f.result)
    inner = ", ".join(f"r{i}: {c.spark_type}" for i, c in enumerate(f.result))

    def call(skip: bool, *values):
        if skip:
            return (None, None)
        try:
            found = body(*values)
            return (None, tuple(found) if found is not None else (None,) * width)
        except Exception as e:  # the filter's own: a reject, not a failure
            return (str(e) or type(e).__name__, None)

    run = F.udf(call, f"struct<msg: string, row: struct<{inner}>>", useArrow=True)
    found = rows.withColumn("_f", run(F.col("err").isNotNull() | nulls, *own))
    failed = F.when(F.col("_f.msg").isNotNull(), F.struct(F.lit("filter").alias("code"), F.lit(None).cast("int").alias("col"), F.col("_f.msg").alias("msg")))
    columns = [F.col(f"_f.row.r{i}").cast(c.spark_type).alias(c.name) for i, c in enumerate(f.result)]
    return found.select("rec_no", "raw", first_of([F.col("err"), failed]).alias("err"), *columns)


def halved(body: Callable, columns: list, n: int) -> tuple[list[tuple[int, int, list]], list[tuple[int, str]]]:
    """(first row, rows, result columns) of the parts of a batch that ``body`` takes, and (row, message) of rows that it doesn't.

    A row that fails costs as many calls as halving a batch down to it, so good rows still go in large parts.
    """
    good, bad, parts = [], [], [(0, n)] if n else []
    while parts:
        at, size = parts.pop()
        try:
            found = list(body(*(c.iloc[at : at + size] for c in columns)))
            if any(len(x) != size for x in found):
                raise ValueError(f"{size} rows were given, and results have others")
            good.append((at, size, found))
        except Exception as e:  # the filter's own: a reject, not a failure
            if size == 1:
                bad.append((at, str(e) or type(e).__name__))
            else:
                half = size // 2
                parts += [(at, half), (at + half, size - half)]
    return good, bad


#: Calls for one batch in which a filter may name bad rows before the rest is halved: one that named a row a call would be as slow as the batch is long, squared.
MOST_NAMINGS = 8


def tried(body: Callable, columns: list, n: int) -> tuple[np.ndarray, list[tuple[int, int, list]], list[tuple[int, str]]]:
    """``halved`` without the rows that ``body`` names as bad: the places of the others, their parts by place among these, (row, message) of bad rows."""
    import numpy as np
    import pandas as pd

    left, named = np.arange(n), []
    for _ in range(MOST_NAMINGS if n else 0):
        try:
            found = list(body(*columns))
        except BadRows as e:
            mark = pd.array(e.rows, dtype="boolean").fillna(False).to_numpy(bool)
            if len(mark) != len(left) or not mark.any():
                break
            named += [(int(i), str(e) or type(e).__name__) for i in left[mark]]
            left, columns = left[~mark], [c[~mark].reset_index(drop=True) for c in columns]
            if not len(left):
                return left, [], named
        except Exception:  # the filter's own, of rows that only halving finds
            break
        else:
            if any(len(x) != len(left) for x in found):
                break
            return left, [(0, len(left), found)], named
    good, bad = halved(body, columns, len(left))
    return left, good, named + [(int(left[i]), message) for i, message in bad]


def _filtered_batches(rows: DataFrame, f: Filter, own: list[Column], nulls: Column) -> DataFrame:
    """``apply_filter`` for a filter over batches: Arrow columns go to Python and back, rows are never made of them."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    body, names, width = f.body, [f"r{i}" for i in range(len(f.result))], len(own)
    inner = ", ".join(f"{x} {c.spark_type}" for x, c in zip(names, f.result, strict=True))
    schema = StructType.fromDDL(f"msg string, {inner}")
    kinds = [to_arrow_type(x.dataType) for x in schema.fields]

    nullable = {
        pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.float32(): pd.Float32Dtype(),
        pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype("pyarrow"),
    }

    def call(given: pa.Array) -> pa.Array:
        n = len(given)
        taken = np.flatnonzero(~given.field(0).to_numpy(zero_copy_only=False).astype(bool))
        at_all = pa.array(taken)
        # Types that have nulls of their own: a null doesn't turn whole numbers into others.
        columns = [given.field(1 + i).take(at_all).to_pandas(types_mapper=lambda t: nullable.get(t, pd.ArrowDtype(t))) for i in range(width)]
        left, good, bad = tried(body, columns, len(taken))
        told: list[str | None] = [None] * n
        for at, message in bad:
            told[taken[at]] = message
        taken = taken[left]
        # Where each row's result lies among the parts, which are Arrow arrays of the declared types from here on.
        place = np.full(n, -1, np.int64)
        before = 0
        for at, size, _ in good:
            place[taken[at : at + size]] = np.arange(before, before + size)
            before += size
        index = pa.array(place, mask=place < 0)
        out = [pa.array(told, pa.string())]
        for i, kind in enumerate(kinds[1:]):
            parts = [pa.array(found[i], kind, from_pandas=True) for _, _, found in good]
            whole = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts] or [pa.nulls(0, kind)])
            out.append(whole.take(index))
        return pa.StructArray.from_arrays(out, ["msg", *names])

    call.__annotations__ = {"given": pa.Array, "return": pa.Array}
    given = F.struct((F.col("err").isNotNull() | nulls).alias("skip"), *(x.alias(f"a{i}") for i, x in enumerate(own)))
    found = rows.withColumn("_f", F.arrow_udf(call, schema)(given))
    failed = F.when(F.col("_f.msg").isNotNull(), F.struct(F.lit("filter").alias("code"), F.lit(None).cast("int").alias("col"), F.col("_f.msg").alias("msg")))
    columns = [F.col(f"_f.{x}").cast(c.spark_type).alias(c.name) for x, c in zip(names, f.result, strict=True)]
    return found.select("rec_no", "raw", first_of([F.col("err"), failed]).alias("err"), *columns)


def as_spec(columns: tuple[ColumnSpec, ...]) -> TableSpec:
    return TableSpec(columns)


def _called(spark: SparkSession, source: Source, values: list) -> DataFrame:
    """A table function registered with the session and called in SQL, where its own ``analyze`` or return type tells the columns."""
    from pyspark.sql.functions import udtf

    body = udtf(source.body) if hasattr(source.body, "analyze") else udtf(source.body, returnType=source.body.columns)
    name = f"sluice_{source.name.lower()}"
    spark.udtf.register(name, body)
    given, literals = [], {}
    for i, v in enumerate(values):
        if isinstance(v, TableArgument):
            given.append(f"TABLE({v.name})")
        else:
            given.append(f":a{i}")
            literals[f"a{i}"] = v
    return spark.sql(f"SELECT * FROM {name}({', '.join(given)})", args=literals)


def from_source(spark: SparkSession, registry: Registry, call: str, most: int | None = None) -> DataFrame:
    """``rec_no`` and the columns of the rows that a source call gives, in its order; of the first ``most`` (some thousands) only."""
    from ..sources.ordinal import numbered

    source, values = registry.source_called(call)
    rows = _called(spark, source, values) if isinstance(source.body, type) else source.body(spark, *values)
    if most is not None:  # Spark runs as few tasks as it takes
        rows = spark.createDataFrame(rows.take(most), rows.schema).coalesce(1)
    rows = rows.withColumn("_block", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id())
    return numbered(rows, "_block", "_within", "rec_no").drop("_block", "_within")


def columns_as_text(columns: list[Column]) -> Column:
    """A row as one line: null empty; quoted if empty or with a quote, backslash, bracket, comma or white space."""
    parts = []
    for c in columns:
        text = c.cast("string")
        doubled = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\\\\\"), '"', '""')
        quoted = F.concat(F.lit('"'), doubled, F.lit('"'))
        parts.append(F.when(text.isNull(), "").when((text == "") | text.rlike(r'["\\(),\s]'), quoted).otherwise(text))
    return F.concat_ws(",", *parts)
