"""Registered queries: each renders a table to the input of a load, runs the load, and returns what it accepted.

Faults are put in by arithmetic on keys, so that SQL can say what must come out. The rendered input stays in the
shared folder as part files in the order of the records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions.registry import BadRows, Filter, Registry, Source
from .operators.checks import coerce, constrain
from .operators.encoding import decoded
from .plans.load import LoadPlan, load, load_rows, parsed
from .plans.options import options_of
from .plans.spec import TableSpec, UniqueKey, spec_of
from .sinks import table
from .sinks.fixed import check_output, chunks, write_fixed
from .sinks.ordered import write_chunks
from .sources import fixed, ranges
from .sources.layout import parse_layout
from .workspace import new_path, send_package, written

LINEITEM = spec_of(
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag text, l_linestatus text, l_shipdate timestamp"
)
ORDERS = spec_of(
    "o_orderkey bigint not null, o_custkey bigint, o_orderstatus text, o_totalprice double, o_orderdate timestamp, o_orderpriority text"
)
CUSTOMER = spec_of("c_custkey bigint, c_name text, c_nationkey int, c_acctbal double, c_mktsegment text")
PART = spec_of("p_partkey bigint, p_name text, p_brand text, p_type text, p_size int, p_retailprice double")
NATION = spec_of("n_nationkey int, n_name text, n_regionkey int")
EVENTS = spec_of("event_id bigint, ts timestamp, user_id bigint, event_type text, value double, props text")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = send_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    times = [c for c, k in rows.dtypes if k == "timestamp"]
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else rows


def _rendered(rows: DataFrame, line, order: list[str]) -> str:
    """One text line a row, in the order of ``order``."""
    path = new_path(rows.sparkSession, "input")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows.select(line.alias("value")).write.text(path)
    return path


def _line(columns: list, delimiter: str = "|"):
    """Fields joined; nulls empty."""
    return F.concat_ws(delimiter, *(F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def _csv(rows: DataFrame, columns: list, order: list[str], spec: TableSpec, existing: DataFrame | None = None, registry: Registry | None = None, **options: str) -> LoadPlan:
    """A load of the rendered rows; every reject and duplicate is allowed unless ``options`` say otherwise."""
    o = {"DELIMITER": "|", "PARSE_ERRORS": "INFINITE", "DUPLICATE_ERRORS": "INFINITE"} | options
    path = _rendered(rows, _line(columns, o["DELIMITER"]), order)
    o = options_of(o | {"INPUT": path, "OUTPUT": "t"})
    records = parsed(rows.sparkSession, o, spec, registry)
    return load_rows(written(records) if o.LIMIT + o.PARSE_ERRORS < 1 << 63 else records, o, spec, existing)


def csv_load_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return _csv(rows, LINEITEM.names, LINEITEM.names[:4], LINEITEM).accepted


def csv_quoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    spec = spec_of("doc_id bigint, text text, lang text")
    return _csv(rows, ["doc_id", quoted, "lang"], ["doc_id"], spec, DELIMITER=",").accepted


def csv_quoted_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the first half of the ids are skipped: more than the first part of the input holds."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit('\n"x"')).alias("text"), "lang")
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    half = rows.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0]
    lines = rows.where(F.col("doc_id") < half).agg(F.sum(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"))))).first()[0]
    spec = spec_of("doc_id bigint, text text, lang text")
    return _csv(rows, ["doc_id", quoted, "lang"], ["doc_id"], spec, DELIMITER=",", SKIP=str(lines or 0)).accepted


def csv_escape_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escape other than the quote, carriage returns inside quotes, and records that end with CR LF."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit('\r\n\\ "x"\\')).alias("text"), "lang")
    inner = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    spec = spec_of("doc_id bigint, text text, lang text")
    lang = F.concat("lang", F.lit("\r"))
    return _csv(rows, ["doc_id", F.concat(F.lit('"'), inner, F.lit('"')), lang], ["doc_id"], spec, DELIMITER=",", ESCAPE="\\").accepted


def csv_null_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kind = "CASE WHEN event_id % 11 = 0 THEN '\"\\\\N\"' ELSE event_type END"
    value = "CASE WHEN event_id % 7 = 0 THEN '\\\\N' ELSE cast(value as string) END"
    spec = spec_of("event_id bigint, event_type text, value double")
    return _csv(rows, ["event_id", kind, value], ["event_id"], spec, NULL="\\N").accepted


def csv_force_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    columns = [*CUSTOMER.names[:4], "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END"]
    path = _rendered(rows, _line(columns), ["c_custkey"])
    o = options_of([("INPUT", path), ("OUTPUT", "t"), ("DELIMITER", "|"), ("FORCE_NOT_NULL", "c_mktsegment")])
    return load_rows(parsed(spark, o, CUSTOMER), o, CUSTOMER).accepted


def csv_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines to skip, then every 13th record is bad; a hundred good ones are loaded."""
    rows = _read(spark, sf_dir, "orders")
    columns = ["CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE cast(o_orderkey as string) END", *ORDERS.names[1:]]
    return _csv(rows, columns, ["o_orderkey"], ORDERS, SKIP="10", LIMIT="100").accepted


def csv_arity_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    last = "CASE WHEN p_partkey % 10 = 3 THEN concat(p_retailprice, '|more') ELSE cast(p_retailprice as string) END"
    size = "CASE WHEN p_partkey % 10 = 7 THEN '' ELSE concat(cast(p_size as string), '|') END"
    both = F.concat(F.expr(size), F.expr(last))
    return _csv(rows, [*PART.names[:4], both], ["p_partkey"], PART).accepted


def _bad_orders(rows: DataFrame) -> list[str]:
    return ["o_orderkey", "CASE WHEN o_orderkey % 10 = 4 THEN 'bad' ELSE cast(o_custkey as string) END", *ORDERS.names[2:]]


def parse_errors_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return _csv(rows, _bad_orders(rows), ["o_orderkey"], ORDERS, PARSE_ERRORS="5").accepted


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    found = _csv(rows, _bad_orders(rows), ["o_orderkey"], ORDERS).parse_rejects
    return found.select(F.split("raw", "\\|")[0].cast("long").alias("o_orderkey"), "err.code", "err.col")


def not_null_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    columns = ["CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE cast(o_orderkey as string) END", *ORDERS.names[1:]]
    return _csv(rows, columns, ["o_orderkey"], ORDERS).accepted


def check_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    spec = TableSpec(LINEITEM.columns, checks=(("small", "l_quantity < 30"),))
    columns = [*LINEITEM.names[:4], "CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE cast(l_quantity as string) END", *LINEITEM.names[5:]]
    return _csv(rows, columns, LINEITEM.names[:4], spec, CHECK_CONSTRAINTS="YES").accepted


def varchar_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks beyond the length are dropped, other characters reject the row."""
    rows = _read(spark, sf_dir, "part")
    spec = spec_of("p_partkey bigint, p_name varchar(12)")
    return _csv(rows, ["p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, '                    ') ELSE p_name END"], ["p_partkey"], spec).accepted


def decimal_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    spec = spec_of("l_orderkey bigint, l_linenumber int, price numeric(7,2)")
    return _csv(rows, ["l_orderkey", "l_linenumber", "cast(l_extendedprice as decimal(12,2))"], LINEITEM.names[:4], spec).accepted


def strict_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without a day, days and floats that don't exist, and text of any length; the rest is loaded, by a load."""
    rows, path = _read(spark, sf_dir, "orders"), new_path(spark, "target")
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    date = f"CASE o_orderkey % 7 WHEN 0 THEN substr({day}, 1, 4) WHEN 1 THEN substr({day}, 1, 7) WHEN 2 THEN replace({day}, '-', '') ELSE {day} END"
    moment = "CASE o_orderkey % 5 WHEN 0 THEN substr(cast(o_orderdate as string), 1, 4) ELSE cast(o_orderdate as string) END"
    small = "CASE o_orderkey % 11 WHEN 0 THEN '1e-50' WHEN 1 THEN '1e-30' WHEN 2 THEN '0e-50' ELSE '2.5' END"
    tiny = "CASE o_orderkey % 13 WHEN 0 THEN '1e-400' WHEN 1 THEN '1e309' ELSE '-1e-300' END"
    spec = spec_of("o_orderkey bigint, d date, t timestamp, small real, tiny float8, said varchar")
    given = _rendered(rows, _line(["o_orderkey", date, moment, small, tiny, "concat(o_orderpriority, repeat('x', 40))"]), ["o_orderkey"])
    load(spark, {"INPUT": given, "OUTPUT": path, "DELIMITER": "|", "PARSE_ERRORS": "INFINITE"}, spec)
    return table.read_table(spark, path, spec.ddl).withColumn("d", F.col("d").cast("string"))


def fast_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, minutes and seconds beyond their ends carry over; a text of another form is read as usual."""
    rows, path = _read(spark, sf_dir, "orders"), new_path(spark, "target")
    text = "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' ', lpad(o_orderkey % 90, 2, '0'), ':99:61') END"
    spec = spec_of("o_orderkey bigint, t timestamp")
    given = _rendered(rows, _line(["o_orderkey", text]), ["o_orderkey"])
    load(spark, {"INPUT": given, "OUTPUT": path, "DELIMITER": "|", "FAST_TIMESTAMP": "YES"}, spec)
    return table.read_table(spark, path, spec.ddl)


def dedup_input_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return _csv(rows, ORDERS.names, ["o_orderkey"], TableSpec(ORDERS.columns, (UniqueKey(("o_custkey",)),))).accepted


def _with_existing(spark: SparkSession, sf_dir: str, keep: str) -> LoadPlan:
    rows = _read(spark, sf_dir, "customer")
    existing = rows.withColumns({"c_custkey": F.col("c_custkey") * 2, "c_acctbal": F.lit(-1.0)})
    spec = TableSpec(CUSTOMER.columns, (UniqueKey(("c_custkey",)),))
    return _csv(rows, CUSTOMER.names, ["c_custkey"], spec, existing, ON_DUPLICATE_KEEP=keep)


def _merged(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    """Two loads into one table, with keys that both have."""
    rows, path = _read(spark, sf_dir, "customer"), new_path(spark, "target")
    old = rows.withColumns({"c_custkey": F.col("c_custkey") * 2, "c_acctbal": F.lit(-1.0)})
    spec = TableSpec(CUSTOMER.columns, (UniqueKey(("c_custkey",)),))
    for part in (old, rows):
        given = {"INPUT": _rendered(part, _line(CUSTOMER.names), ["c_custkey"]), "OUTPUT": path, "DELIMITER": "|", "DUPLICATE_ERRORS": "INFINITE"}
        load(spark, given | {"ON_DUPLICATE_KEEP": keep}, spec)
    return table.read_table(spark, path, spec.ddl)


def dedup_keep_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "NEW")


def dedup_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "OLD")


def dedup_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_existing(spark, sf_dir, "NEW").duplicate_rejects.select("is_new", *CUSTOMER.names)


def dedup_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    spec = TableSpec(PART.columns, (UniqueKey(("p_partkey % 700",)), UniqueKey(("p_name", "p_size"))))
    return _csv(rows, PART.names, ["p_partkey"], spec).accepted


def _null_keys(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id")
    spec = TableSpec(spec_of("event_id bigint, user_id bigint").columns, (UniqueKey(("user_id",), nulls_distinct=distinct),))
    return _csv(rows, ["event_id", "CASE WHEN event_id % 4 = 0 THEN '' ELSE cast(user_id as string) END"], ["event_id"], spec).accepted


def dedup_nulls_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_keys(spark, sf_dir, True)


def dedup_nulls_not_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_keys(spark, sf_dir, False)


def dedup_partial_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    spec = TableSpec(ORDERS.columns, (UniqueKey(("o_custkey",), "o_orderstatus = 'O'"),))
    return _csv(rows, ORDERS.names, ["o_orderkey"], spec).accepted


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    spec = TableSpec(ORDERS.columns, (UniqueKey(("o_custkey",)),))
    return _csv(rows, _bad_orders(rows), ["o_orderkey"], spec).summary


def _with_tail(rows: DataFrame, names: list[str], fields: list, tail: bytes) -> str:
    """Rows as fixed-width records, and some bytes more."""
    path = new_path(rows.sparkSession, "fixed")
    last = rows.sparkSession.createDataFrame([(1, bytearray(tail))], "n long, data binary").coalesce(1)
    write_chunks(chunks(rows, names, fields).unionByName(last), path)
    return path


FIXED_LINEITEM = ["BIGINT", "INTEGER", "DOUBLE", "FLOAT", "CHAR(3)", "VARCHAR(5)"]


def fixed_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export, then import with the layout of the control file."""
    rows = _read(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("rec_no"), "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("float").alias("l_quantity"), "l_returnflag", "l_linestatus"
    )
    spec = spec_of("l_orderkey bigint, l_linenumber int, l_extendedprice double, l_quantity float, l_returnflag text, l_linestatus text")
    fields, stride = parse_layout(FIXED_LINEITEM, output=True)
    path = new_path(spark, "fixed")
    write_fixed(rows, spec.names, fields, path)
    back = fixed.convert_fields(fixed.read_records(spark, path, stride, fields=fields), fields, spec)
    return back.where("err IS NULL").select(*spec.names[:-1], F.trim("l_linestatus").alias("l_linestatus"))


def fixed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all widths and text of both kinds, at offsets, in records longer than their columns; a part record at the end."""
    rows = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rec_no"),
        "o_orderkey",
        F.pmod("o_custkey", F.lit(60000)).alias("cust"),
        (-F.pmod("o_orderkey", F.lit(3000))).alias("neg"),
        "o_orderpriority",
        "o_orderstatus",
    )
    fields, _ = parse_layout(["BIGINT", "UNSIGNED SMALLINT", "SMALLINT", "CHAR(15)", "CHAR(3)"], output=True)
    path = _with_tail(rows, rows.columns[1:], fields, b"rest")
    columns = ["BIGINT", "UNSIGNED SMALLINT", "SMALLINT", "CHAR(13:27)", "VARCHAR (28 + 1)"]
    fields, stride = parse_layout(columns, stride=30)
    spec = spec_of("o_orderkey bigint, cust int, neg int, o_orderpriority text, o_orderstatus text")
    return fixed.convert_fields(fixed.read_records(spark, path, stride, fields=fields), fields, spec).where("err IS NULL").select(*spec.names)


def fixed_partial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of lineitem, all text without a line feed, and all but one byte of another one, which is left out."""
    rows = _read(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("rec_no"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    texts = rows.select("rec_no", *(F.col(c).cast("string") for c in rows.columns[1:]))
    fields, stride = parse_layout(["CHAR(20)", "CHAR(11)", "CHAR(24)", "CHAR(19)"], output=True)
    path = _with_tail(texts, texts.columns[1:], fields, b"x" * (stride - 1))
    spec = spec_of("l_orderkey bigint, l_linenumber int, l_extendedprice double, l_shipdate timestamp")
    return fixed.convert_fields(fixed.read_records(spark, path, stride, fields=fields), fields, spec).where("err IS NULL").select(*spec.names)


def fixed_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of records as a view, made and read in SQL."""
    rows = _read(spark, sf_dir, "orders").withColumn("rec_no", F.col("o_orderkey"))
    columns = ["BIGINT", "INTEGER", "CHAR(1)", "CHAR(15)"]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    path = new_path(spark, "fixed")
    write_fixed(rows, names, parse_layout(columns, output=True)[0], path)
    ranges.register(spark)
    given = f"input '{path}', col '{'; '.join(columns)}', names '{', '.join(names)}'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW sluice_fixed_orders USING sluice_fixed OPTIONS ({given})")
    return spark.sql("SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS first_priority, count(*) AS n, sum(o_orderkey) AS keys FROM sluice_fixed_orders GROUP BY ALL")


def fixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the file as columns of other types: narrower integers wrap, decimals are exact, text has six digits after the point."""
    rows = _read(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("rec_no"), "l_orderkey", (F.col("l_orderkey") * 1000003).alias("big"), (F.col("l_linenumber") * 9001).alias("mid"), F.col("l_quantity").cast("float").alias("quantity"), "l_extendedprice")
    fields, stride = parse_layout(["BIGINT", "BIGINT", "INTEGER", "FLOAT", "DOUBLE"], output=True)
    path = new_path(spark, "fixed")
    write_fixed(rows, rows.columns[1:], fields, path)
    spec = spec_of("l_orderkey bigint, wrapped int, short smallint, quantity numeric(16,4), price text")
    return fixed.convert_fields(fixed.read_records(spark, path, stride, fields=fields), fields, spec).where("err IS NULL").select(*spec.names)


def fixed_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").withColumn("rec_no", F.col("n_nationkey").cast("long"))
    rows = rows.withColumn("n_name", F.expr("CASE WHEN n_nationkey % 4 <> 0 THEN n_name END"))
    rows = rows.withColumn("n_regionkey", F.expr("CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END"))
    fields, stride = parse_layout(["INTEGER", "CHAR(20) NULLIF 'none'", "INTEGER NULLIF FFFFFFFF"], output=True)
    path = new_path(spark, "fixed")
    write_fixed(rows, NATION.names, fields, path)
    wide = [f if f.code else type(f)(f.kind, f.offset, f.length, None, f.nullif.ljust(f.length)) for f in fields]
    return fixed.convert_fields(fixed.read_records(spark, path, stride, fields=wide), wide, NATION).select(*NATION.names)


def unsigned_range_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_no"), F.lit(None).cast("struct<code:string,col:int,msg:string>").alias("err"), "p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN -1 WHEN p_partkey % 7 = 0 THEN 70000 ELSE p_size END").alias("n"))
    fields, _ = parse_layout(["BIGINT", "UNSIGNED SMALLINT"], output=True)
    return check_output(rows, ["p_partkey", "n"], fields).where("err IS NULL").select("p_partkey", "n")


FILTERED = spec_of("event_id bigint, kind text, value double")


def _filters() -> Registry:
    arguments = spec_of("a bigint, b text, c double").columns
    return Registry(
        [
            Filter("by_columns", arguments, FILTERED.columns, lambda a, b, c: [a * 2, F.upper(b), F.when(a % 7 != 0, c + 1)]),
            Filter("by_python", arguments, FILTERED.columns, _row_filter, python=True),
            Filter("by_batches", arguments, FILTERED.columns, _batch_filter, batch=True),
            Filter("strict", arguments, FILTERED.columns, lambda a, b, c: [a, b, c], strict=True),
            Filter("with_defaults", arguments, FILTERED.columns, lambda a, b, c: [a, b, c], defaults=("none", 1.5)),
        ]
    )


def _row_filter(a: int, b: str, c: float):
    if a % 5 == 0:
        raise ValueError("five")
    return None if a % 7 == 0 else (a * 2, b.upper(), c + 1)


def _batch_filter(a, b, c):
    """As ``_row_filter``, for series: rows with sevenths become nulls, rows with fifths are refused by name."""
    if (fives := a % 5 == 0).any():
        raise BadRows(fives, "five")
    keep = a % 7 != 0
    return (a * 2).where(keep, None), b.str.upper().where(keep, None), (c + 1).where(keep, None)


def _filtered(spark: SparkSession, sf_dir: str, name: str, columns: list) -> DataFrame:
    return _csv(_read(spark, sf_dir, "events"), columns, ["event_id"], FILTERED, registry=_filters(), FILTER=name).accepted


def filter_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "by_columns", ["event_id", "event_type", "value"])


def filter_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "by_python(bigint, text, double)", ["event_id", "event_type", "value"])


def filter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "by_batches", ["event_id", "event_type", "value"])


def filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "strict", ["event_id", "CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END", "value"])


def filter_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.expr("CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('|', event_type) ELSE concat('|', event_type, '|', value) END")
    return _filtered(spark, sf_dir, "with_defaults", [F.concat(F.col("event_id").cast("string"), rest)])


class OrdersWith:
    """Orders of a status, with what is said of them; the kind of the key is that of the table."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, status: AnalyzeArgument, *said: AnalyzeArgument) -> AnalyzeResult:
        key = next(f for f in rows.dataType.fields if f.name == "o_orderkey")
        return AnalyzeResult(StructType().add("o_orderkey", key.dataType).add("said", "string"))

    def eval(self, row: Row, status: str | None, *said: str):
        if row["o_orderstatus"] == status:
            for x in said:
                yield row["o_orderkey"], x + row["o_orderpriority"]


ORDERS_WITH = Source("orders_with", ("table", "text", "text"), OrdersWith, variadic=True)
SAID = spec_of("o_orderkey bigint not null, said text")


def function_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over ``orders`` with two values for its last argument, one of them with a quote."""
    _read(spark, sf_dir, "orders").createOrReplaceTempView("sluice_orders")
    o = options_of({"TYPE": "FUNCTION", "INPUT": "orders_with(TABLE(sluice_orders), 'F', 'it''s ', 'also ')", "OUTPUT": "t"})
    return load_rows(parsed(spark, o, SAID, Registry(sources=[ORDERS_WITH])), o, SAID).accepted


def function_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows that a table function gives for ``orders`` are loaded; its beginning is all that is run."""
    _read(spark, sf_dir, "orders").createOrReplaceTempView("sluice_orders")
    path = new_path(spark, "target")
    given = {"TYPE": "FUNCTION", "INPUT": "orders_with(TABLE(sluice_orders), 'O', '')", "OUTPUT": path, "LIMIT": "100"}
    load(spark, given, SAID, Registry(sources=[ORDERS_WITH]))
    return table.read_table(spark, path, SAID.ddl)


def encoding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in EUC-JP, some with a byte that it doesn't have; what is well formed comes back as it was."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.hex(F.encode(F.regexp_replace("text", "[^\\x00-\\x7F]", ""), "US-ASCII")), F.lit("A4A2")).alias("h"))
    raw = F.unhex(F.concat("h", F.when(F.col("doc_id") % 6 == 0, "A4").otherwise("")))
    return decoded(rows.select("doc_id", raw.alias("raw")), "EUC_JP").where("text IS NOT NULL").select("doc_id", "text")


def coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    source = spec_of("a text, b text, c int, d double")
    target = spec_of("s_suppkey bigint, s_name varchar(30), s_nationkey bigint, s_acctbal numeric(12,2)")
    shaped = rows.select(F.col("s_suppkey").alias("rec_no"), F.lit("").alias("raw"), F.lit(None).cast("struct<code:string,col:int,msg:string>").alias("err"), F.expr("CASE WHEN s_suppkey % 9 = 0 THEN 'x' ELSE cast(s_suppkey as string) END").alias("a"), F.col("s_name").alias("b"), F.col("s_nationkey").alias("c"), F.col("s_acctbal").alias("d"))
    return constrain(coerce(shaped, source, target), target).where("err IS NULL").select(*target.names)


def _twice(spark: SparkSession, sf_dir: str, truncate: str) -> DataFrame:
    """Two loads into one table."""
    rows, path = _read(spark, sf_dir, "nation"), new_path(spark, "target")
    for part, again in (("n_nationkey < 15", "NO"), ("n_nationkey >= 10", truncate)):
        given = _rendered(rows.where(part), _line(NATION.names), ["n_nationkey"])
        load(spark, {"INPUT": given, "OUTPUT": path, "DELIMITER": "|", "TRUNCATE": again}, NATION)
    return table.read_table(spark, path, NATION.ddl)


def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir, "NO")


def load_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir, "YES")


_first = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS r FROM {t}) WHERE {w}"
_li, _or, _cu, _pa = (", ".join(s.names) for s in (LINEITEM, ORDERS, CUSTOMER, PART))
_old = "SELECT c_custkey * 2 AS c_custkey, c_name, c_nationkey, -1.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer"

SQL = {
    "csv_load_lineitem": f"SELECT {_li} FROM lineitem",
    "csv_quoted_documents": "SELECT doc_id, text, lang FROM documents",
    "csv_quoted_skip": "SELECT doc_id, text || chr(10) || '\"x\"' AS text, lang FROM documents WHERE doc_id >= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents)",
    "csv_escape_documents": "SELECT doc_id, text || chr(13) || chr(10) || '\\ \"x\"\\' AS text, lang FROM documents",
    "csv_null_string": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '\\N' ELSE event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events",
    "csv_force_not_null": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "csv_skip_limit": f"SELECT {_or} FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 10 AND o_orderkey % 13 <> 0 ORDER BY o_orderkey LIMIT 100",
    "csv_arity_reject": f"SELECT {_pa} FROM part WHERE p_partkey % 10 NOT IN (3, 7)",
    "parse_errors_cap": f"SELECT {_or} FROM (SELECT *, sum(CASE WHEN o_orderkey % 10 = 4 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad <= 5 AND o_orderkey % 10 <> 4",
    "parse_rejects": "SELECT o_orderkey, 'syntax' AS code, 2 AS col FROM orders WHERE o_orderkey % 10 = 4",
    "not_null_reject": f"SELECT {_or} FROM orders WHERE o_orderkey % 3 <> 0",
    "check_constraint": f"SELECT {_li.replace('l_quantity', 'CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END AS l_quantity')} FROM lineitem WHERE l_orderkey % 9 = 0 OR l_quantity < 30",
    "varchar_limit": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN rpad(p_name, 12, ' ') ELSE p_name END AS p_name FROM part WHERE length(p_name) <= 12",
    "decimal_cast": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(7,2)) AS price FROM lineitem WHERE l_extendedprice < 99999.995",
    "strict_casts": "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d, o_orderdate AS t, CASE o_orderkey % 11 WHEN 1 THEN 1e-30 WHEN 2 THEN 0 ELSE 2.5 END::FLOAT AS small, -1e-300::DOUBLE AS tiny, o_orderpriority || repeat('x', 40) AS said FROM orders WHERE o_orderkey % 7 NOT IN (0, 1) AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 NOT IN (0, 1)",
    "fast_timestamps": "SELECT o_orderkey, date_trunc('day', o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 0 SECOND ELSE to_hours(o_orderkey % 90) + to_minutes(99) + to_seconds(61) END AS t FROM orders",
    "dedup_input_first": _first.format(c=_or, k="o_custkey", o="o_orderkey", t="orders", w="r = 1"),
    "dedup_keep_new": f"SELECT {_cu} FROM customer UNION ALL {_old} WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "dedup_keep_old": f"SELECT {_cu} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL {_old}",
    "dedup_rejects": f"SELECT 0 AS is_new, {_cu} FROM ({_old} WHERE c_custkey * 2 IN (SELECT c_custkey FROM customer))",
    "dedup_two_keys": f"WITH a AS ({_first.format(c=_pa, k='p_partkey % 700', o='p_partkey', t='part', w='r = 1')}) " + _first.format(c=_pa, k="p_name, p_size", o="p_partkey", t="a", w="r = 1"),
    "dedup_nulls_distinct": "WITH e AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id FROM events) " + _first.format(c="event_id, user_id", k="user_id", o="event_id", t="e", w="r = 1 OR user_id IS NULL"),
    "dedup_nulls_not_distinct": "WITH e AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id FROM events) " + _first.format(c="event_id, user_id", k="user_id", o="event_id", t="e", w="r = 1"),
    "dedup_partial_key": _first.format(c=_or, k="o_orderstatus = 'O', o_custkey", o="o_orderkey", t="orders", w="r = 1 OR o_orderstatus <> 'O'"),
    "load_summary": "SELECT 0::BIGINT AS skip, count(DISTINCT o_custkey) FILTER (o_orderkey % 10 <> 4) AS count, count(*) FILTER (o_orderkey % 10 = 4) AS parse_errors, count(*) FILTER (o_orderkey % 10 <> 4) - count(DISTINCT o_custkey) FILTER (o_orderkey % 10 <> 4) AS duplicate_new, 0::BIGINT AS duplicate_old FROM orders",
    "fixed_write_roundtrip": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity::FLOAT AS l_quantity, l_returnflag, l_linestatus FROM lineitem",
    "fixed_read": "SELECT o_orderkey, (o_custkey % 60000)::INT AS cust, (-(o_orderkey % 3000))::INT AS neg, o_orderpriority, o_orderstatus FROM orders",
    "fixed_partial_tail": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem",
    "fixed_in_sql": "SELECT o_custkey::INT AS o_custkey, o_orderstatus, min(o_orderpriority) AS first_priority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL",
    "fixed_numbers": "SELECT l_orderkey, (((l_orderkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INT AS wrapped, (((l_linenumber * 9001 + 32768) % 65536 + 65536) % 65536 - 32768)::SMALLINT AS short, l_quantity::DECIMAL(16,4) AS quantity, format('{:.6f}', l_extendedprice) AS price FROM lineitem",
    "fixed_nullif": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS n_regionkey FROM nation",
    "unsigned_range_reject": "SELECT p_partkey, p_size AS n FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    "filter_expression": "SELECT event_id * 2 AS event_id, upper(event_type) AS kind, CASE WHEN event_id % 7 <> 0 THEN value + 1 END AS value FROM events",
    "filter_udf": "SELECT CASE WHEN event_id % 7 <> 0 THEN event_id * 2 END AS event_id, CASE WHEN event_id % 7 <> 0 THEN upper(event_type) END AS kind, CASE WHEN event_id % 7 <> 0 THEN value + 1 END AS value FROM events WHERE event_id % 5 <> 0",
    "filter_batches": "SELECT CASE WHEN event_id % 7 <> 0 THEN event_id * 2 END AS event_id, CASE WHEN event_id % 7 <> 0 THEN upper(event_type) END AS kind, CASE WHEN event_id % 7 <> 0 THEN value + 1 END AS value FROM events WHERE event_id % 5 <> 0",
    "filter_strict": "SELECT CASE WHEN event_id % 6 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events",
    "filter_defaults": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 2 THEN value ELSE 1.5 END AS value FROM events",
    "function_source": "SELECT o_orderkey, s || o_orderpriority AS said FROM orders, (VALUES ('it''s '), ('also ')) v(s) WHERE o_orderstatus = 'F'",
    "function_limit": "SELECT o_orderkey, o_orderpriority AS said FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100",
    "encoding_validate": "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || chr(12354) AS text FROM documents WHERE doc_id % 6 <> 0",
    "coercion": "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal::DECIMAL(12,2) AS s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0",
    "load_append": "SELECT * FROM nation WHERE n_nationkey < 15 UNION ALL SELECT * FROM nation WHERE n_nationkey >= 10",
    "load_truncate": "SELECT * FROM nation WHERE n_nationkey >= 10",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
