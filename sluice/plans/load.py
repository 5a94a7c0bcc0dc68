"""The load: source, conversion, filter, checks, cutoff, unique keys, sinks."""

from __future__ import annotations

import resource
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import Registry, apply_filter, as_spec, columns_as_text, from_source
from ..operators.checks import ERR, coerce, constrain, convert_fields
from ..operators.cutoff import last_record
from ..operators.dedup import deduplicate
from ..operators.encoding import encoding_named
from ..sinks import files, fixed as fixed_sink, summaries, table
from ..sources import fixed, text
from ..sources.layout import parse_layout
from ..workspace import new_path, send_package, written
from .options import INFINITE, LoadOptions, OptionError, echo, options_of, with_reports
from .spec import TableSpec


class DuplicateError(RuntimeError):
    """More duplicates than allowed: nothing is committed. ``code`` is ``unique_violation`` if none is allowed and the
    input itself repeats a key, ``duplicate_errors`` otherwise."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class LoadPlan:
    """What a load would do: ``accepted`` (the rows that the table has afterwards), rejects and counters."""

    accepted: DataFrame
    new_rows: DataFrame
    parse_rejects: DataFrame
    duplicate_rejects: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class LoadResult:
    skip: int
    count: int
    parse_errors: int
    duplicate_new: int
    duplicate_old: int
    system_time: float
    user_time: float
    duration: float

    @property
    def exit_code(self) -> int:
        """3 if a record was rejected or a new duplicate removed; old rows that were replaced don't count."""
        return 3 if self.parse_errors or self.duplicate_new else 0


def parsed(spark: SparkSession, o: LoadOptions, spec: TableSpec, registry: Registry | None = None, most: int | None = None) -> DataFrame:
    """``rec_no``, ``raw``, ``err`` and the table's columns of each record of the input, or of a source's first ``most`` rows."""
    send_package(spark)
    registry = registry or Registry()
    f = registry.filter_named(o.FILTER) if o.FILTER else None
    own = as_spec(f.arguments) if f else spec
    if o.FAST_TIMESTAMP:
        own = replace(own, columns=tuple(replace(c, kind="fast_timestamp") if c.base == "timestamp" else c for c in own.columns))
    if unknown := set(o.FORCE_NOT_NULL) - set(own.names):
        raise OptionError(f"unknown column {sorted(unknown)[0]}")
    if o.TYPE == "FUNCTION":
        rows = from_source(spark, registry, o.INPUT, most)
        names = [c for c in rows.columns if c != "rec_no"]
        line = columns_as_text([F.col(f"`{c}`") for c in names])
        rows = rows.select("rec_no", line.alias("raw"), F.lit(None).cast(ERR).alias("err"), *(F.col(f"`{c}`") for c in names))
        if len(names) != len(spec.columns):
            raise OptionError(f"the function returns {len(names)} columns, {len(spec.columns)} expected")
        rows = rows.select("rec_no", "raw", "err", *(F.col(f"`{a}`").cast(c.spark_type).alias(c.name) for a, c in zip(names, spec.columns, strict=True)))
        return constrain(rows, spec, o.CHECK_CONSTRAINTS)
    path = o.INPUT
    if isinstance(path, str) and path.lower() == "stdin":
        path, _ = spooled(spark, o.TYPE)
    encoding = encoding_named(o.ENCODING) if o.ENCODING else None
    other = None if encoding == "utf-8" else encoding
    defaults = dict(zip([a.name for a in f.arguments][len(f.arguments) - len(f.defaults) :], f.defaults, strict=True)) if f and f.defaults else None
    if o.TYPE == "CSV":
        records = text.read_records(spark, path, text.Dialect(o.DELIMITER, o.QUOTE, o.ESCAPE), o.SKIP, other, texts=True)
        least = len(own.columns) - len(defaults or {})
        if f and not own.columns:  # a filter without arguments takes blank lines
            rows = records.select("rec_no", "raw", F.when(F.col("raw") != "", F.struct(F.lit("arity").alias("code"), F.lit(1).alias("col"), F.lit("").alias("msg"))).cast(ERR).alias("err"))
        else:
            rows = convert_fields(records, own, o.NULL, tuple(o.FORCE_NOT_NULL), least, defaults)
        if encoding:
            wrong = F.contains("raw", F.lit("\ufffd")) if other else ~F.is_valid_utf8("raw")
            bad = F.when(wrong, F.struct(F.lit("encoding").alias("code"), F.lit(None).cast("int").alias("col"), F.lit("").alias("msg")).cast(ERR))
            rows = rows.withColumn("err", F.coalesce("err", bad))
    else:
        fields, stride = parse_layout(o.COL, o.STRIDE)
        rows = fixed.convert_fields(fixed.read_records(spark, path, stride, o.SKIP, fields, other), fields, own, defaults)
    if f:
        rows = coerce(apply_filter(rows, f), as_spec(f.result), spec)
    return constrain(rows, spec, o.CHECK_CONSTRAINTS)


#: Bytes of an input that a load with a bound looks at before it reads on; then eight times as many, and again.
HEAD_BYTES, HEAD_STEPS = 16 << 20, 3
#: A bound of errors alone is looked for at the beginning of inputs of so many times ``HEAD_BYTES`` and more.
LONG_INPUT = 64
#: Rows of a source that are looked at first.
HEAD_ROWS = (1_000, 32_000)


def spooled(spark: SparkSession, kind: str, most: int | None = None, before: str | None = None) -> tuple[str, bool]:
    """Standard input as a file in the shared folder, and whether it has ended: bytes up to the end or, for CSV, a line ``\\.``.

    With ``most``, about so many bytes are read, whole lines of CSV; what was read ``before`` comes first.
    """
    path, ended, n = new_path(spark, "stdin"), False, 0
    fs, place = table.file_system(spark, path)
    out = fs.create(place, True)
    try:
        if before:
            _copy(spark, before, out)
        while not ended and (most is None or n < most):
            if kind == "CSV":
                data = sys.stdin.buffer.readline()
                ended = not data or data.rstrip(b"\r\n") == b"\\."
            else:
                data = sys.stdin.buffer.read(1 << 20 if most is None else min(1 << 20, most - n))
                ended = not data
            if not ended:
                out.write(bytearray(data))
                n += len(data)
    finally:
        out.close()
    return path, ended


def _copy(spark: SparkSession, path: str, out, most: int | None = None) -> None:
    """Bytes of a file, in the JVM."""
    fs, place = table.file_system(spark, path)
    stream = fs.open(place)
    try:
        spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, fs.getFileStatus(place).getLen() if most is None else most)
    finally:
        stream.close()


def _beginnings(spark: SparkSession, o: LoadOptions) -> Iterator[tuple[LoadOptions, int | None, bool]]:
    """The load over growing parts of its input, at last over all of it: options, most rows of a source, and whether it is all.

    Of a folder whole files are taken, in the order of their names; a single file's beginning is copied (by the driver's
    JVM, as a stream, a GiB at most in one step). An input whose bound can't be near is read at once.
    """
    bounded = o.LIMIT != INFINITE or o.PARSE_ERRORS != INFINITE
    if o.TYPE == "FUNCTION":
        for most in HEAD_ROWS if bounded else ():
            yield o, most, False
        yield o, None, True
        return
    if o.INPUT.lower() == "stdin":
        path, ended = spooled(spark, o.TYPE, HEAD_BYTES if bounded else None)
        if not ended:
            yield replace(o, INPUT=path), None, False
            path, _ = spooled(spark, o.TYPE, None, path)
        yield replace(o, INPUT=path), None, True
        return
    if bounded:
        fs, place = table.file_system(spark, o.INPUT)
        files = sorted((str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(place) if s.isFile() and s.getPath().getName()[0] not in "._")
        total = sum(n for _, n in files)
        size = HEAD_BYTES
        for _ in range(HEAD_STEPS):
            if size * 2 > total or (o.LIMIT == INFINITE and total < LONG_INPUT * HEAD_BYTES):
                break
            taken, n = [], 0
            while n < size:
                taken.append(files[len(taken)][0])
                n += files[len(taken) - 1][1]
            if n <= 2 * size:
                yield replace(o, INPUT=taken), None, False
            elif len(taken) > 1:
                yield replace(o, INPUT=taken[:-1]), None, False
            else:
                path = new_path(spark, "head")
                fs, place = table.file_system(spark, path)
                out = fs.create(place, True)
                try:
                    _copy(spark, taken[0], out, size)
                finally:
                    out.close()
                yield replace(o, INPUT=path), None, False
            size *= 8
    yield o, None, True


@dataclass
class Staged:
    """Checked records, written once: good rows in ``folder/_good=true``, rejects in ``folder/_good=false``."""

    spark: SparkSession
    folder: str
    ddl: str
    good: int
    bad: int
    most: int
    raw: str = "string"

    @property
    def rows(self) -> str:
        return f"{self.folder}/_good=true"

    def read(self, good: bool = True) -> DataFrame:
        kind, there = (f"rec_no long, {self.ddl}", self.good) if good else (f"rec_no long, raw {self.raw}, err {ERR}", self.bad)
        if not there:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/_good={str(good).lower()}")

    def delete(self) -> None:
        fs, place = table.file_system(self.spark, self.folder)
        fs.delete(place, True)


def stage(rows: DataFrame, spec: TableSpec, folder: str) -> Staged:
    """Write checked records in one pass that also counts them; only rejects keep their text."""
    spark, seen = rows.sparkSession, Observation()
    good = F.col("err").isNull()
    own = [F.col(f"`{c}`") for c in spec.names]
    flagged = rows.select("rec_no", F.when(~good, F.col("raw")).alias("raw"), "err", *own, good.alias("_good"))
    counted = flagged.observe(seen, F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"), F.max("rec_no").alias("most"))
    with sorted_by_nothing(spark):
        counted.write.partitionBy("_good").parquet(folder)
    n = seen.get
    return Staged(spark, folder, spec.ddl, n["good"], n["bad"], n["most"] or 0, rows.schema["raw"].dataType.simpleString())


@contextmanager
def sorted_by_nothing(spark: SparkSession):
    """Two open files a task, for accepted and rejected rows, instead of a sort by which of them a row is."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def cut(staged: Staged, o: LoadOptions) -> int:
    """The last record that is processed; ``INFINITE`` if reading doesn't end before the input."""
    if staged.good < o.LIMIT and staged.bad <= o.PARSE_ERRORS:
        return INFINITE
    flags = [staged.read(good).select("rec_no", F.lit(None if good else "").alias("err").cast("string")) for good in (True, False)]
    return last_record(flags[0].unionByName(flags[1]), o.LIMIT, o.PARSE_ERRORS)


def staged_input(spark: SparkSession, o: LoadOptions, spec: TableSpec, registry: Registry | None, new: Callable[[], str]) -> tuple[Staged, int]:
    """The records that are processed, staged in a folder named by ``new``, and the last one's number.

    A load that ends early, by ``LIMIT`` or ``PARSE_ERRORS``, doesn't read on.
    """
    hopeless = False
    for part, most, whole in _beginnings(spark, o):
        if hopeless and not whole:
            continue
        try:
            rows = parsed(spark, part, spec, registry, most)
        except text.ShortInput:
            if whole:
                raise
            continue
        if o.WRITER == "BINARY":
            rows = fixed_sink.check_output(rows, spec.names, parse_layout(o.OUT_COL, output=True)[0])
        staged = stage(rows, spec, new())
        last = cut(staged, o)
        # The last record of a part of the input may not be whole.
        if whole or last < staged.most:
            return staged, last
        staged.delete()
        hopeless = o.LIMIT == INFINITE and not staged.bad  # no error so far: the bound isn't near


def load_rows(rows: DataFrame, o: LoadOptions, spec: TableSpec, existing: DataFrame | None = None) -> LoadPlan:
    """From checked records to what stays; ``rows`` is read several times, so it should be cheap or written."""
    last = last_record(rows, o.LIMIT, o.PARSE_ERRORS)
    done = rows if last == INFINITE else rows.where(F.col("rec_no") <= last)
    own = [F.col(f"`{c}`") for c in spec.names]
    good = done.where(F.col("err").isNull()).select("rec_no", *own)
    bad = done.where(F.col("err").isNotNull()).select("rec_no", "raw", "err")
    found = deduplicate(good, existing, spec, o.ON_DUPLICATE_KEEP)
    kept, removed = found.kept, found.removed
    one = lambda condition, name: F.count_if(condition).alias(name)
    flags = done.select(F.col("err").isNull().alias("good"), F.lit(None).cast("int").alias("removed"))
    flags = flags.unionByName(removed.select(F.lit(None).cast("boolean").alias("good"), F.col("is_new").alias("removed")))
    n = flags.agg(one(F.col("good"), "good"), one(~F.col("good"), "bad"), one(F.col("removed") == 1, "new"), one(F.col("removed") == 0, "old"))
    summary = n.select(
        F.lit(o.SKIP).cast("long").alias("skip"),
        (F.col("good") - F.col("new")).alias("count"),
        F.col("bad").alias("parse_errors"),
        F.col("new").alias("duplicate_new"),
        F.col("old").alias("duplicate_old"),
    )
    return LoadPlan(kept.select(*own), kept.where("is_new = 1").select(*own), bad, removed, summary)


def load(
    spark: SparkSession,
    options: dict[str, str] | list[tuple[str, str]],
    spec: TableSpec,
    registry: Registry | None = None,
    reports: str | None = None,
    expiry: float = table.EXPIRY,
) -> LoadResult:
    """Run a load and commit it: to a table folder, or to a fixed-width file with ``WRITER=BINARY``.

    Parse rejects beyond ``PARSE_ERRORS`` end the reading, and what was read is committed; duplicates beyond
    ``DUPLICATE_ERRORS`` raise ``DuplicateError``, and nothing is, not even a TRUNCATE. A load of a table that another load
    is running on raises ``TableBusy``; one that finds the table changed at its end (its claim expired, see
    ``sinks.table``) raises ``Conflict``, and nothing of it is committed. Log and reject files without a name of their own
    go to the folder ``reports``, if it is given; otherwise they are not kept.

    Accepted rows are written once, where the table has them, by the pass that parses and counts them. Duplicates are
    settled by keys, against those files of the table that can hold one; rows that go are marked, in old and new files.
    """
    began, used = time.time(), resource.getrusage(resource.RUSAGE_SELF)
    o = options_of(options)
    if reports:
        o = with_reports(o, reports, began)
    if o.WRITER == "BINARY":
        n, staged, last, gone = _export(spark, o, spec, registry)
    else:
        with table.Claim(spark, o.OUTPUT, expiry) as claim:
            n, staged, last, gone = _load_table(spark, o, spec, registry, claim)
    n = {"skip": o.SKIP} | n
    rejects = staged.read(False) if last == INFINITE else staged.read(False).where(F.col("rec_no") <= last)
    if o.PARSE_BADFILE and n["parse_errors"]:
        files.write_rejects(rejects, o.PARSE_BADFILE, o.TYPE == "BINARY")
    if o.DUPLICATE_BADFILE and gone is not None:
        line = columns_as_text([F.col(f"`{c}`") for c in spec.names])
        files.write_rejects(gone.select(F.col("seq").alias("rec_no"), line.alias("raw")), o.DUPLICATE_BADFILE)
    after = resource.getrusage(resource.RUSAGE_SELF)
    result = LoadResult(**n, system_time=after.ru_stime - used.ru_stime, user_time=after.ru_utime - used.ru_utime, duration=time.time() - began)
    if o.LOGFILE:
        said = files.messages(rejects, o.SKIP) if n["parse_errors"] else None
        counters = "".join(f"  {v} rows: {k}\n" for k, v in n.items())
        files.write_log(spark, o.LOGFILE, echo(o) + "\n", said, f"{counters}  {result.duration:.2f} s\n\n", o.VERBOSE)
    fs, place = table.file_system(spark, f"{staged.folder}/_good=false")
    fs.delete(place, True)
    return result


def _export(spark: SparkSession, o: LoadOptions, spec: TableSpec, registry: Registry | None) -> tuple[dict, Staged, int, None]:
    fields, _ = parse_layout(o.OUT_COL, output=True)
    fixed_sink.must_not_exist(spark, o.OUTPUT)
    staged, last = staged_input(spark, o, spec, registry, lambda: new_path(spark, "staged"))
    good, bad = (staged.read(x) if last == INFINITE else staged.read(x).where(F.col("rec_no") <= last) for x in (True, False))
    written_rows = fixed_sink.write_fixed(good, spec.names, fields, o.OUTPUT)
    rejected = staged.bad if last == INFINITE else bad.count()
    return {"count": written_rows, "parse_errors": rejected, "duplicate_new": 0, "duplicate_old": 0}, staged, last, None


#: Share of a load's own rows that may be marked as deleted; with more, the rows that stay are written again.
MOST_MARKED = 0.3


def _load_table(spark: SparkSession, o: LoadOptions, spec: TableSpec, registry: Registry | None, claim: table.Claim) -> tuple[dict, Staged, int, DataFrame | None]:
    """Counters, the staged records, the last one processed, and removed duplicates as rows (``is_new``, ``seq``, the columns)."""
    version = table.current(spark, o.OUTPUT)
    made: list[str] = []

    def new(kind: str) -> str:
        made.append(f"{o.OUTPUT}/{table.new_folder(kind, version)}")
        return made[-1]

    try:
        staged, last = staged_input(spark, o, spec, registry, lambda: new("v"))
        bad, good, rows = staged.bad, staged.good, staged.rows
        if last != INFINITE:
            bad = staged.read(False).where(F.col("rec_no") <= last).count()
            rows = new("v")
            staged.read().where(F.col("rec_no") <= last).write.parquet(rows)
            good = spark.read.schema(spec.ddl).parquet(rows).count()
        base = table.Version() if o.TRUNCATE else version
        gone, removed, marks = None, {1: 0, 0: 0}, base.marks
        if spec.unique and good:
            gone, removed = _duplicates(spark, o, spec, base, rows)
            if sum(removed.values()) > o.DUPLICATE_ERRORS:
                raise _too_many(spark, o, spec, rows, sum(removed.values()))
            marked = gone.select("is_new", "_file", "_row")
            if removed[1] > MOST_MARKED * good:
                fresh, rows = _placed(spark, spec, rows), new("v")
                fresh.join(marked, ["_file", "_row"], "left_anti").drop("_file", "_row").write.parquet(rows)
                marked = marked.where("is_new = 0")
            if removed[0] or removed[1] and removed[1] <= MOST_MARKED * good:
                folder = new("d")
                marked.select("_file", "_row").write.parquet(folder)
                marks = (*marks, folder.rpartition("/")[2])
        data = base.data
        if good - removed[1]:
            name = rows[len(o.OUTPUT) + 1 :]
            if spec.unique:
                made.append(f"{o.OUTPUT}/{summaries.folder_of(name)}")
                summaries.write(spark, made[-1], rows, spec)
            data = (*data, (name, tuple(summaries.signature(k) for k in spec.unique)))
        table.commit(spark, o.OUTPUT, version, table.Version(0, data, marks), claim)
    except BaseException:
        for folder in made:
            fs, place = table.file_system(spark, folder)
            fs.delete(place, True)
        raise
    if rows != staged.rows:  # the rows that stay were written again
        fs, place = table.file_system(spark, staged.rows)
        fs.delete(place, True)
    n = {"count": good - removed[1], "parse_errors": bad, "duplicate_new": removed[1], "duplicate_old": removed[0]}
    return n, staged, last, gone if sum(removed.values()) else None


def _placed(spark: SparkSession, spec: TableSpec, rows: str) -> DataFrame:
    return spark.read.schema(f"rec_no long, {spec.ddl}").parquet(rows).select("*", *(F.col(c).alias(x) for x, c in table.PLACE.items()))


def _duplicates(spark: SparkSession, o: LoadOptions, spec: TableSpec, base: table.Version, rows: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows that unique keys remove, with their places, and how many new (1) and old (0) ones there are."""
    fresh = _placed(spark, spec, rows)
    old = None
    if base.data:
        old = table.rows_at(spark, o.OUTPUT, base, spec.ddl, summaries.files_with(spark, o.OUTPUT, base, fresh, spec))
    found = deduplicate(fresh, old, spec, o.ON_DUPLICATE_KEEP, ("_file", "_row"))
    gone = written(found.removed)
    counts = {r[0]: r[1] for r in gone.groupBy("is_new").count().collect()}
    return gone, {1: counts.get(1, 0), 0: counts.get(0, 0)}


def _too_many(spark: SparkSession, o: LoadOptions, spec: TableSpec, rows: str, n: int) -> DuplicateError:
    """Without any duplicate allowed, one inside the input is told apart from one with a stored row."""
    if not o.DUPLICATE_ERRORS and deduplicate(_placed(spark, spec, rows), None, spec).removed.limit(1).count():
        return DuplicateError("unique_violation", "the input has two rows with one unique key")
    return DuplicateError("duplicate_errors", f"{n} duplicates; {o.DUPLICATE_ERRORS} are allowed")
