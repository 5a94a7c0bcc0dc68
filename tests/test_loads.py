import os
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.functions.registry import Filter, FunctionError, Registry, Source, parse_call
from sluice.operators.cutoff import last_record
from sluice.operators.dedup import deduplicate
from sluice.plans.load import DuplicateError, load
from sluice.plans.options import INFINITE, OptionError, boolean, keyword, options_of, parse_control, with_paths
from sluice.plans.spec import TableSpec, UniqueKey, spec_of
from sluice.sinks import table
from sluice.sources import text
from sluice.sources.layout import parse_field, parse_layout, spelled

#: Rooms of a building: a room has one name, and on each floor a number is given once, if it has any.
ROOMS = spec_of(
    "name varchar(6) not null, floor smallint, number int, seats numeric(4,1) not null",
    (UniqueKey(("floor", "number")), UniqueKey(("lower(name)",))),
    (("some", "seats > 0"),),
)


def room_lines(seed, n):
    """Lines with faults of several kinds, at places that ``seed`` draws."""
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        name = rng.choice(["Oak", "oak", "Elm", "Fir", "", "Larch", "Sequoia", "Yew", "Ash", "Box"])
        seats = rng.choice(["4", "12.5", "0", "-1", "", "many", "9999.9", "7"])
        lines.append(",".join([name, rng.choice(["1", "2", "", "70000"]), rng.choice(["", "10", "11", "12", "13", "x"]), seats] + ["more"] * (rng.random() < 0.05)))
    return lines


def slow_rooms(lines, stored=(), cap=None, limit=None, checks=False, keep="NEW"):
    """The rules of a load as a loop: (loaded, rejects, new duplicates, old ones), the rows, the rejected lines."""
    good, bad = [], []
    for line in lines:
        if limit is not None and len(good) >= limit or cap is not None and len(bad) > cap:
            break
        parts = line.split(",")
        try:
            if len(parts) != 4:
                raise ValueError
            name, floor, number, seats = (x or None for x in parts)
            if name and len(name) > 6 or floor and int(floor) > 32767:
                raise ValueError
            row = (name, floor and int(floor), number and int(number), seats and round(Decimal(seats), 1))
            if row[3] is not None and abs(row[3]) >= 1000 or row[0] is None or row[3] is None or checks and row[3] <= 0:
                raise ValueError
            good.append(row)
        except (ValueError, ArithmeticError):
            bad.append(line)
    rows, counts = [(0, i, r) for i, r in enumerate(stored)] + [(1, i, r) for i, r in enumerate(good)], [0, 0]
    for key in (lambda r: None if None in r[1:3] else r[1:3], lambda r: r[0].lower()):
        best = {}
        for x in sorted(rows, key=lambda x: (-x[0] if keep == "NEW" else x[0], x[1])):
            if key(x[2]) is not None:
                best.setdefault(key(x[2]), x)
        kept = [x for x in rows if key(x[2]) is None or best[key(x[2])] is x]
        for x in rows:
            counts[x[0]] += x not in kept
        rows = kept
    return (len(good) - counts[1], len(bad), counts[1], counts[0]), [x[2] for x in rows], bad


@pytest.fixture
def run(spark, tmp_path):
    def go(content, spec, registry=None, **options):
        path = str(tmp_path / f"in{len(os.listdir(tmp_path))}.txt")
        with open(path, "wb") as file:
            file.write(content if isinstance(content, bytes) else content.encode())
        given = {"INPUT": path, "OUTPUT": str(tmp_path / "table"), "PARSE_ERRORS": "INFINITE", "DUPLICATE_ERRORS": "INFINITE"}
        r = load(spark, given | options, spec, registry)
        return (r.skip, r.count, r.parse_errors, r.duplicate_new, r.duplicate_old)

    go.rows = lambda spec: sorted((tuple(r) for r in table.read_table(spark, str(tmp_path / "table"), spec.ddl).collect()), key=str)
    go.folder = tmp_path
    return go


@pytest.mark.parametrize("checks", [False, True])
def test_constraints_and_two_keys(run, checks):
    lines = room_lines(5, 60)
    counts, rows, _ = slow_rooms(lines, checks=checks)
    assert run("\n".join(lines) + "\n", ROOMS, CHECK_CONSTRAINTS="yes" if checks else "no") == (0, *counts)
    assert run.rows(ROOMS) == sorted(rows, key=str)
    assert min(counts) == 0 and counts[1] > 5 and counts[2] > 2


@pytest.mark.parametrize("cap", [0, 4])
def test_cap_stops_reading_and_commits(run, cap):
    lines = room_lines(8, 40)
    counts, rows, bad = slow_rooms(lines, cap=cap)
    assert run("\n".join(lines), ROOMS, PARSE_ERRORS=str(cap), PARSE_BADFILE=str(run.folder / "bad")) == (0, *counts)
    assert len(bad) == cap + 1 and (run.folder / "bad").read_text() == "".join(f"{x}\n" for x in bad)
    assert run.rows(ROOMS) == sorted(rows, key=str)


@pytest.mark.parametrize("keep", ["NEW", "OLD"])
def test_loads_into_a_table_with_rows(run, keep):
    """Three loads, each against what the ones before have left; removed rows are told as lines."""
    rows = []
    for seed in (1, 2, 3):
        lines = room_lines(seed, 40)
        counts, after, _ = slow_rooms(lines, rows, keep=keep)
        bad = run.folder / f"dup{seed}"
        assert run("\n".join(lines), ROOMS, ON_DUPLICATE_KEEP=keep, DUPLICATE_BADFILE=str(bad)) == (0, *counts)
        assert run.rows(ROOMS) == sorted(after, key=str)
        assert (len(bad.read_text().splitlines()) if bad.exists() else 0) == counts[2] + counts[3]
        rows = after
        assert seed == 1 or counts[3 if keep == "NEW" else 2]


def test_too_many_duplicates_change_nothing(run):
    spec = spec_of("k text, v int", (UniqueKey(("k",)),))
    assert run("pear,1\nplum,2\n", spec) == (0, 2, 0, 0, 0)
    for data, code in (("plum,3\nfig,4\n", "duplicate_errors"), ("fig,4\nfig,5\nplum,6\n", "unique_violation")):
        with pytest.raises(DuplicateError) as found:
            run(data, spec, DUPLICATE_ERRORS="0", TRUNCATE="NO")
        assert found.value.code == code
    with pytest.raises(DuplicateError) as found:
        run("fig,4\nfig,5\nplum,6\n", spec, DUPLICATE_ERRORS="1", TRUNCATE="NO")
    assert found.value.code == "duplicate_errors"
    assert run.rows(spec) == [("pear", 1), ("plum", 2)]
    assert sorted(x.name[0] for x in (run.folder / "table").iterdir() if not x.name.startswith(".")) == ["_", "s", "v"]


@pytest.mark.parametrize("alike", [False, True])
def test_null_keys(run, alike):
    spec = spec_of("n int, w text", (UniqueKey(("n",), nulls_distinct=not alike),))
    data = "".join(f"{'' if i % 3 == 1 else i % 8},{i}\n" for i in range(20))
    want = {}
    for i in range(20):
        key = None if i % 3 == 1 else i % 8
        want.setdefault((key, i if key is None and not alike else 0), (key, str(i)))
    assert run(data, spec) == (0, len(want), 0, 20 - len(want), 0)
    assert run.rows(spec) == sorted(want.values(), key=str)


def test_the_same_rows_again_and_again(run, spark):
    spec = spec_of("a int, b int", (UniqueKey(("a", "b")),))
    data = "\n".join(f"{i % 9},{i * i}" for i in range(150))
    assert run(data, spec) == (0, 150, 0, 0, 0)
    for _ in range(2):
        assert run(data, spec) == (0, 150, 0, 0, 150)
    want = run.rows(spec)
    assert len(want) == 150
    assert table.compact(spark, str(run.folder / "table"), spec.ddl) == 2
    assert run.rows(spec) == want and run(data, spec, ON_DUPLICATE_KEEP="OLD") == (0, 0, 0, 150, 0)


def test_a_replaced_row_touches_one_file(run, spark, monkeypatch):
    """Ten loads make files of their own; a load of one key looks into the one that has it, and writes a row and a mark."""
    spec = spec_of("k bigint, v text", (UniqueKey(("k",)),))
    for i in range(10):
        run("\n".join(f"{(k * 10 + i) * 7},{i}" for k in range(200)), spec)
    seen, whole = [], table.rows_at
    monkeypatch.setattr(table, "rows_at", lambda s, t, v, ddl, files=None: seen.append(files) or whole(s, t, v, ddl, files))
    folder = run.folder / "table"
    before = {x for x in folder.rglob("part-*")}
    assert run("2135,new\n999999,more\n", spec) == (0, 2, 0, 0, 1)
    every = table._files(spark, str(folder), table.current(spark, str(folder)).folders)
    assert len(seen[0]) <= 2 < 10 <= len(every) - 1
    made = [x for x in folder.rglob("part-*") if x not in before]
    assert sum(spark.read.parquet(str(x)).count() for x in made if "/d=" in str(x)) == 1
    assert sum(spark.read.parquet(str(x)).count() for x in made if "/v=" in str(x)) == 2
    assert len(run.rows(spec)) == 2001 and (2135, "new") in run.rows(spec)


def test_summaries_find_every_file_that_holds_a_key(spark, tmp_path):
    from sluice.sinks import summaries

    rng = random.Random(9)
    spec = spec_of("a int, b text", (UniqueKey(("a", "b"), "a > 3"), UniqueKey(("b",), nulls_distinct=False)))
    files = {}
    for i in range(6):
        rows = [(rng.randrange(40), rng.choice([None, "x", "y", "zz", f"own{rng.randrange(99)}"])) for _ in range(12)]
        spark.createDataFrame(rows, spec.ddl).coalesce(1).write.parquet(f"{tmp_path}/v={i}-t")
        summaries.write(spark, f"{tmp_path}/s={i}-t", f"{tmp_path}/v={i}-t", spec)
        files[i] = rows
    version = table.Version(6, tuple((f"v={i}-t", tuple(summaries.signature(k) for k in spec.unique)) for i in range(5)) + (("v=5-t", ()),), ())
    found_less = False
    for _ in range(12):
        new = [(rng.randrange(40), rng.choice([None, "x", f"own{rng.randrange(99)}"])) for _ in range(rng.choice([0, 1, 2]))]
        found = summaries.files_with(spark, str(tmp_path), version, spark.createDataFrame(new, spec.ddl), spec)
        got = {int(x[2]) for x in found}
        keys = [{(a, b) for a, b in new if a > 3 and b is not None}, {b for _, b in new}]
        want = {i for i, rows in files.items() if {(a, b) for a, b in rows if a > 3} & keys[0] or {b for _, b in rows} & keys[1]}
        assert want | {5} <= got
        found_less |= len(got) < 6
    assert found_less


class Paused(Exception):
    pass


def test_a_second_load_is_refused(run, spark, monkeypatch):
    """While a load has read the table and not committed yet, another one can't begin; afterwards it can, and no row is lost."""
    spec = spec_of("k int, v text", (UniqueKey(("k",)),))
    run("1,a\n2,b\n", spec)
    commit, refused = table.commit, []

    def during(*args):
        with pytest.raises(table.TableBusy):
            run("3,c\n4,d\n", spec)
        refused.append(True)
        return commit(*args)

    monkeypatch.setattr(table, "commit", during)
    assert run("1,x\n5,e\n", spec) == (0, 2, 0, 0, 1)
    monkeypatch.setattr(table, "commit", commit)
    assert refused and run("3,c\n4,d\n", spec) == (0, 2, 0, 0, 0)
    assert run.rows(spec) == [(1, "x"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


@pytest.mark.parametrize("data", ["1,x\n5,e\n", "7,first\n"])
def test_a_claim_that_expired_while_its_load_lived(run, spark, monkeypatch, data):
    """The slow load finds that the table has changed; all rows of the finished one stay."""
    spec = spec_of("k int, v text", (UniqueKey(("k",)),))
    path = str(run.folder / "table")
    run("1,a\n2,b\n", spec)
    commit = table.commit

    def late(*args):
        monkeypatch.setattr(table, "commit", commit)
        os.utime(run.folder / "table" / "_CLAIM", (0, 0))
        assert run("3,c\n7,second\n", spec) == (0, 2, 0, 0, 0)
        return commit(*args)

    monkeypatch.setattr(table, "commit", late)
    with pytest.raises(table.Conflict):
        run(data, spec)
    assert run.rows(spec) == [(1, "a"), (2, "b"), (3, "c"), (7, "second")]
    version = table.current(spark, path)
    assert table.commit(spark, path, version, version).number == version.number + 1
    with pytest.raises(table.Conflict):
        table.commit(spark, path, version, version)


def test_a_dead_load_s_claim_is_taken_over(run, spark):
    spec = spec_of("k int")
    path = str(run.folder / "table")
    dead = table.Claim(spark, path)
    assert table._create(spark, f"{path}/_CLAIM", '{"owner": "dead"}') and not dead.held()
    with pytest.raises(table.TableBusy):
        run("1\n", spec)
    os.utime(run.folder / "table" / "_CLAIM", (0, 0))
    assert run("1\n", spec) == (0, 1, 0, 0, 0)
    assert not (run.folder / "table" / "_CLAIM").exists()


def test_a_claim_is_renewed(spark, tmp_path):
    import time

    with table.Claim(spark, str(tmp_path / "t"), expiry=2) as claim:
        time.sleep(3)
        with pytest.raises(table.TableBusy):
            table.Claim(spark, str(tmp_path / "t"), expiry=2).__enter__()
        assert claim.held()


def test_a_load_that_fails_leaves_nothing(run, spark):
    spec = spec_of("k int")
    run("1\n", spec)
    before = sorted(str(x) for x in (run.folder / "table").rglob("*"))
    broken = Registry([Filter("f", spec.columns, spec.columns, lambda k: [F.raise_error(F.lit("no")) + k])])
    with pytest.raises(Exception, match="no"):
        run("1\n", spec, broken, FILTER="f")
    assert sorted(str(x) for x in (run.folder / "table").rglob("*")) == before


def test_checked_rows_are_scanned_once(run, spark):
    """Without bounds and keys a load parses its records in one pass, which counts and writes them."""
    from sluice.functions import convert  # noqa: F401

    seen = spark.sparkContext.accumulator(0)

    def body(k):
        seen.add(1)
        return (k,)

    spec = spec_of("k int")
    f = Registry([Filter("f", spec.columns, spec.columns, body, python=True)])
    assert run("".join(f"{i}\n" for i in range(50)) + "x\n", spec, f, FILTER="f") == (0, 50, 1, 0, 0)
    assert seen.value == 50


def test_limit_counts_good_rows_and_skip_lines(run):
    spec = spec_of("i int")
    assert run("head\n1\nx\n2\n3\n4\n", spec, SKIP="1", LIMIT="3") == (1, 3, 1, 0, 0)
    assert run("1\n", spec, LIMIT="0", TRUNCATE="yes") == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="skip"):
        run("1\n", spec, SKIP="5")


def test_filter(run):
    arguments = spec_of("a int, b int, c int, d text").columns
    result = spec_of("x int, y text, z int").columns

    def body(a, b, c, d):
        if a % 9 == 4:
            raise ValueError("four")
        return None if a % 9 == 7 else (b * c, d + "!", a)

    rng, want, bad = random.Random(12), [], 0
    lines = []
    for a in range(70):
        parts = [str(a), rng.choice(["3", "5", ""]), rng.choice(["2", "", "z"]), "t", "more"][: rng.choice([1, 2, 3, 4, 4, 5])]
        lines.append(",".join(parts))
        values = [*parts, *["8", "none"][len(parts) - 2 :]] if 2 <= len(parts) < 4 else parts
        if len(values) != 4 or values[2] == "z":
            bad += 1
        elif "" in values or a % 9 == 7:
            want.append((None,) * 3)
        elif a % 9 == 4:
            bad += 1
        else:
            want.append((int(values[1]) * int(values[2]), values[3] + "!", a))
    data = "\n".join(lines)
    f = Registry([Filter("f", arguments, result, body, (8, "none"), strict=True, python=True)])
    spec = spec_of("product int, word text, id int")
    assert run(data, spec, f, FILTER="f") == (0, len(want), bad, 0, 0)
    assert run.rows(spec) == sorted(want, key=str)
    assert run(data, spec, f, FILTER="f", PARSE_ERRORS="3", TRUNCATE="yes")[2] == 4
    none = Registry([Filter("n", (), result, lambda: [F.lit(1), F.lit("call"), F.lit(3)])])
    assert run("\n" * 5, spec, none, FILTER="n", TRUNCATE="yes") == (0, 5, 0, 0, 0)
    with pytest.raises(FunctionError):
        f.filter_named("g")


def test_reject_classes(run):
    spec = spec_of("a int not null, b smallint, c varchar(3), d char(2), e timestamp, f numeric(5,2), g float4, h float8")
    good = "1,2,abc  ,ab,2024-01-02 03:04:05,12.345,1.5,2.5"
    bad = ["12a,2,a,a,,,,", "1,40000,a,a,,,,", "3000000000,2,a,a,,,,", "1,2,abcd,a,,,,", "1,2,a,abc,,,,", "1,2,a,a,2024-13-01 00:00:00,,,",
           "1,2,a,a,,1000,,", "1,2,a,a,,x,,", "1,2,a,a,,,1e39,", "1,2,a,a,,,,1e309", ",2,a,a,,,,", "1,2", "1,2,a,a,,,,,9"]
    assert run("\n".join([*bad, good, '1,"open']) + "\n", spec) == (0, 1, 14, 0, 0)
    (row,) = run.rows(spec)
    assert row[2] == "abc" and str(row[5]) == "12.35"


def slow_records(data, d):
    """The rules one character at a time."""
    records, raw, fields, part, quoted, inside, at = [], "", [], "", False, False, 0
    while at < len(data):
        c = data[at]
        if inside and c == d.escape and data[at + 1 : at + 2] in (d.quote, d.escape) and at + 1 < len(data):
            raw += c + data[at + 1]
            part += data[at + 1]
            at += 2
            continue
        if c == d.quote:
            inside, quoted, raw = not inside, True, raw + c
        elif not inside and c in "\r\n":
            if c == "\r" and data[at + 1 : at + 2] == "\n":
                at += 1
            records.append((raw, [*fields, (part, quoted)]))
            raw, fields, part, quoted = "", [], "", False
        elif not inside and c == d.delimiter:
            fields.append((part, quoted))
            raw, part, quoted = raw + c, "", False
        else:
            raw, part = raw + c, part + c
        at += 1
    if raw:
        records.append((raw, None if inside else [*fields, (part, quoted)]))
    return records


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_parallel_records_are_the_sequential_ones(spark, tmp_path, escape):
    rng, d = random.Random(7), text.Dialect(escape=escape)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for i in range(6):
            data = "".join(rng.choice('ab,,"\\\n\n\r') for _ in range(rng.randrange(1, 900))).rstrip("\r\n") + "\n"
            path = tmp_path / f"{i}.csv"
            path.write_bytes(data.encode())
            rows = text.read_records(spark, str(path), d).orderBy("rec_no").collect()
            want = slow_records(data, d)
            assert [r.rec_no for r in rows] == list(range(1, len(want) + 1))
            assert [None if r.fields is None else [tuple(f) for f in r.fields] for r in rows] == [f for _, f in want], data
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cutoff_is_the_loop(spark):
    rng = random.Random(1)
    for _ in range(5):
        flags = [rng.random() < 0.3 for _ in range(300)]
        rows = spark.createDataFrame([(i + 1, "x" if b else None) for i, b in enumerate(flags)], "rec_no long, err string")
        for limit, cap in ((10, 1000), (1000, 5), (30, 7), (INFINITE, INFINITE)):
            good = bad = last = 0
            for i, b in enumerate(flags):
                if good >= limit or bad > cap:
                    break
                good, bad, last = good + (not b), bad + b, i + 1
            assert min(last_record(rows, limit, cap, bucket=16), 300) == last


def test_dedup_is_the_loop(spark):
    rng = random.Random(4)
    spec = TableSpec(spec_of("a int, b int").columns, (UniqueKey(("a",)), UniqueKey(("b",), "b > 1", False)))
    new = [(i, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, 0, 1, 2, 3, 4])) for i in range(1, 40)]
    old = [(1, 9), (7, 3)]
    for keep in ("NEW", "OLD"):
        rows = [(0, 0, *r) for r in old] + [(1, *r) for r in new]
        for at, use in ((2, lambda r: r[2] is not None), (3, lambda r: r[3] is not None and r[3] > 1)):
            best = {}
            for r in sorted(filter(use, rows), key=lambda r: (-r[0] if keep == "NEW" else r[0], r[1])):
                best.setdefault(r[at], r)
            rows = [r for r in rows if not use(r) or best[r[at]] == r]
        found = deduplicate(spark.createDataFrame(new, "rec_no long, a int, b int"), spark.createDataFrame(old, "a int, b int"), spec, keep)
        assert sorted(map(str, (tuple(r) for r in found.kept.collect()))) == sorted(map(str, rows))


def test_function_source(run):
    series = Source("f", ("int4", "int4", "text"), lambda s, a, b, t: s.range(a, b + 1).select(F.col("id").cast("int").alias("i"), F.lit(t).alias("t")), ("default value",))
    registry, spec = Registry(sources=[series]), spec_of("i int, t text", (UniqueKey(("i",)),))
    assert run("", spec, registry, TYPE="FUNCTION", INPUT="f(1,5,'A''')", LIMIT="3") == (0, 3, 0, 0, 0)
    assert run("", spec, registry, TYPE="FUNCTION", INPUT="f( - - - 3, -+- 5,'''B')", ON_DUPLICATE_KEEP="OLD") == (0, 6, 0, 3, 0)
    for wrong in ("f(--3, 1)", "f(1,)", "g(1)", "f", "f(1,2,3,4,5)"):
        with pytest.raises(FunctionError):
            registry.source_called(wrong)
    assert parse_call("a.\"b\"('x''y', NULL, - - 5, 1.5)")[1][:3] == ["x'y", None, 5]


def test_fixed_width(run):
    spec = spec_of("a int, b text, c smallint, d numeric(16,4)")
    rec = lambda a, b, c, d: struct.pack("<i5sif", a, b, c, d)
    data = rec(1, b"ab   ", 70000, 12345.6789) + rec(2, b"none\0", 7, 0.5) + b"rest"
    o = [("INPUT", str(run.folder / "x.bin")), ("OUTPUT", str(run.folder / "table")), ("TYPE", "fixed"), ("COL", "INT"), ("COL", "CHAR(5) NULLIF 'none'"), ("COL", "INTEGER"), ("COL", "FLOAT")]
    (run.folder / "x.bin").write_bytes(data)
    from pyspark.sql import SparkSession

    r = load(SparkSession.getActiveSession(), o, spec)
    assert (r.count, r.parse_errors, r.exit_code) == (2, 0, 0)
    rows = run.rows(spec)
    assert rows[0][:3] == (1, "ab", 70000 - 65536) and float(rows[0][3]) == 12345.7
    assert rows[1][:3] == (2, None, 7)


def test_export_and_control_file(run):
    spec = spec_of("v smallint not null, n text")
    out = str(run.folder / "out.bin")
    o = [("INPUT", str(run.folder / "e.csv")), ("OUTPUT", out), ("WRITER", "BINARY"), ("OUT_COL", "UNSIGNED SMALLINT"), ("OUT_COL", "CHAR(4) NULLIF 'null'"), ("PARSE_ERRORS", "-1")]
    (run.folder / "e.csv").write_text("1,ab\n-1,x\n2,\n3,toolong\n")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = load(spark, o, spec)
    assert (r.count, r.parse_errors) == (2, 2) or r.parse_errors == 2
    assert open(out, "rb").read() == b"\1\0ab  \2\0null"
    pairs = [p for p in parse_control(open(f"{out}.ctl").read())]
    back = load(spark, [*pairs, ("OUTPUT", str(run.folder / "table"))], spec)
    assert back.count == 2 and run.rows(spec) == [(1, "ab"), (2, None)]
    with pytest.raises(FileExistsError):
        load(spark, o, spec)


def test_layouts():
    f = parse_field("char ( 110 : 111 )")
    assert (f.kind, f.offset, f.length) == ("CHAR", 109, 2)
    assert parse_field("Unsigned  Integer(2)").code == "u2" and parse_field("16", preserve=True).kind == "VARCHAR"
    fields, stride = parse_layout(["CHAR(10)", "CHAR(70+20)", "INTEGER NULLIF FFFFFFFF"], stride=100)
    assert stride == 100 and fields[2].offset == 89 and spelled(fields[2]) == "INTEGER NULLIF FFFFFFFF"
    for wrong in ("CHAR", "INTEGER(3)", "CHAR(2) NULLIF 'abc'", "INTEGER NULLIF F", "CHAR(2) NULLIF 'a", "NUMBER(3)"):
        with pytest.raises(ValueError):
            parse_field(wrong)
    with pytest.raises(ValueError):
        parse_field("CHAR(1+3)", output=True)


def test_options():
    assert keyword("parse-errors") == keyword("Max Err Cnt") == "PARSE_ERRORS"
    assert boolean("y") and not boolean("off")
    text_ = 'TYPE = CSV # comment\n\nNULL = "a # \\" b"\nINPUT = data.csv\n'
    assert parse_control(text_) == [("TYPE", "CSV"), ("NULL", 'a # " b'), ("INPUT", "data.csv")]
    assert with_paths([("INPUT", "x"), ("OUTPUT", "t"), ("LOGFILE", "l")], "/d") == [("INPUT", "/d/x"), ("OUTPUT", "t"), ("LOGFILE", "/d/l")]
    base = {"INPUT": "/x", "OUTPUT": "t"}
    assert options_of(base | {"LOAD": "7", "loader": "parallel"}).LIMIT == 7
    for wrong in ({"INPUT": "x"}, {"NULL": ","}, {"DELIMITER": "ab"}, {"STRIDE": "3"}, {"TYPE": "XML"}, {"LIMIT": "-2"}, {"NO_SUCH": "1"}, {"LOGFILE": "/x"}, {"TYPE": "BINARY"}):
        with pytest.raises(OptionError):
            options_of(base | wrong)
    with pytest.raises(OptionError, match="twice"):
        options_of([*base.items(), ("SKIP", "1"), ("OFFSET", "2")])


def test_log_and_cli(run, capsys, monkeypatch):
    from sluice import cli

    (run.folder / "a.csv").write_text("1\nx\n")
    (run.folder / "a.ctl").write_text(f"INPUT = a.csv\nOUTPUT = {run.folder / 'table'}\nLOGFILE = a.log\nPARSE_ERRORS = 5\n")
    assert cli.main([str(run.folder / "a.ctl"), "--columns", "i int"]) == 3
    said = (run.folder / "a.log").read_text()
    assert "record 1, input record 2, column 1: syntax i" in said and "PARSE_ERRORS = 5" in said
    assert cli.main([str(run.folder / "a.ctl"), "--columns", "i int", "-o", "BAD=1"]) == 1
    assert cli.main([str(run.folder / "none.ctl"), "--columns", "i int"]) == 4
    assert cli.main([str(run.folder / "a.ctl"), "--columns", "i"]) == 3
    (run.folder / "b.ctl").write_text("INPUT\n")
    assert cli.main([str(run.folder / "b.ctl"), "--columns", "i int"]) == 3


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_skip_goes_beyond_the_first_block(spark, tmp_path, small_splits):
    head = "".join(f'header line {i} with " one quote\n' for i in range(20))
    for records, n in (('1,"a"\n2,"b"\n', 2), ("1,a\n2,b\n", 2), ('1,"a\n\n\nb"\r2,"b"\r\n' * 30, 60)):
        (tmp_path / "in.csv").write_text(head + records)
        rows = text.read_records(spark, str(tmp_path / "in.csv"), skip=20).orderBy("rec_no").collect()
        assert [r.rec_no for r in rows] == list(range(1, n + 1)) and all(len(r.fields) == 2 for r in rows)
    (tmp_path / "in.csv").write_text('a\rb\r\nc\n"d"\n')
    assert [r.raw for r in text.read_records(spark, str(tmp_path / "in.csv"), skip=1).orderBy("rec_no").collect()] == ["b", "c", '"d"']
    with pytest.raises(text.ShortInput):
        text.read_records(spark, str(tmp_path / "in.csv"), skip=5)


def test_records_that_are_too_long(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(text, "MOST_CHARS", 1000)
    lines = ['1,"a"', '2,"' + "x\n" * 2000 + '"', "3," + "y" * 900, "4," + "z" * 2000, '5,"b"', '6,"never closed'] + ["more"] * 500
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    rows = text.read_records(spark, str(tmp_path / "in.csv")).orderBy("rec_no").collect()
    assert [(r.rec_no, r.raw[:2], r.fields is None) for r in rows] == [(1, "1,", False), (2, "2,", True), (3, "3,", False), (4, "4,", True), (5, "5,", False), (6, "6,", True)]
    assert all(len(r.raw) < 3200 for r in rows)


def test_byte_ranges_of_whole_records(spark, tmp_path, small_splits):
    """Any bytes, with a part of a record at the end, in many tasks; a folder's files follow each other."""
    from sluice.sources import fixed

    rng = random.Random(3)
    for stride, n, tail in ((7, 400, 3), (1, 500, 0), (300, 9, 299), (13, 0, 5), (64, 100, 1)):
        data = bytes(rng.choice(b"\n\x00\xffab") for _ in range(stride * n + tail))
        (tmp_path / "in.bin").write_bytes(data)
        rows = fixed.read_records(spark, str(tmp_path / "in.bin"), stride)
        found = rows.orderBy("rec_no").collect()
        assert [r.rec_no for r in found] == list(range(1, n + 1))
        assert b"".join(bytes(r.raw) for r in found) == data[: stride * n]
        assert rows.rdd.getNumPartitions() >= min(n, stride * n // 200)
    assert fixed.read_records(spark, str(tmp_path / "in.bin"), 64, skip=98).count() == 2
    with pytest.raises(text.ShortInput):
        fixed.read_records(spark, str(tmp_path / "in.bin"), 64, skip=101)
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"part-{i}").write_bytes(bytes([65 + i]) * (10 * i + 5) + b"\n")
    found = fixed.read_records(spark, str(tmp_path / "many"), 5, skip=2).orderBy("rec_no").collect()
    assert [bytes(r.raw) for r in found] == [b"BBBBB"] * 2 + [b"CCCCC"] * 5


def test_files_written_by_tasks(spark, tmp_path):
    from sluice.sinks.ordered import write_lines

    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("row "), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.lit("\n")).cast("binary").alias("data"))
    assert write_lines(rows.orderBy(F.rand(1)), "k", str(tmp_path / "deep" / "out")) == 5000
    assert (tmp_path / "deep" / "out").read_text() == "".join(f"row {i}{'x' * (i % 50)}\n" for i in range(5000))
    assert write_lines(rows.where("false"), "k", str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()


def test_standard_input(spark, monkeypatch):
    import io

    from sluice.plans.load import spooled

    for kind, want in (("CSV", b"1,a\n2,b\n"), ("BINARY", b"1,a\n2,b\n\\.\n\x00\xff\n\\")):
        for most in (None, 3):
            monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"1,a\n2,b\n\\.\n\x00\xff\n\\")))
            path, ended = spooled(spark, kind, most)
            if most:
                assert not ended and len(spark.read.format("binaryFile").load(path).first().content) < len(want)
                path, ended = spooled(spark, kind, None, path)
            assert ended and bytes(spark.read.format("binaryFile").load(path).first().content) == want


def test_a_bounded_load_of_standard_input_reads_no_further(spark, tmp_path, monkeypatch):
    import io

    from sluice.plans import load as module

    monkeypatch.setattr(module, "HEAD_BYTES", 1000)
    given = io.BytesIO("".join(f"{i}\n" for i in range(5000)).encode())
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(given))
    options = {"INPUT": "stdin", "OUTPUT": str(tmp_path / "t"), "LIMIT": "20"}
    assert load(spark, options, spec_of("i int")).count == 20 and given.tell() < 20_000
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("".join(f"{i}\n" for i in range(5000)).encode())))
    assert load(spark, options | {"LIMIT": "4000", "TRUNCATE": "YES"}, spec_of("i int")).count == 4000


def test_a_bounded_load_opens_a_few_files_of_a_folder(spark, tmp_path, monkeypatch):
    from sluice.plans import load as module

    monkeypatch.setattr(module, "HEAD_BYTES", 500)
    (tmp_path / "in").mkdir()
    for k in range(100):
        (tmp_path / "in" / f"part-{k:03d}").write_text("".join(f"{k * 40 + i}\n" for i in range(40)))
    seen, whole = [], module.parsed
    monkeypatch.setattr(module, "parsed", lambda s, o, *rest: seen.append(o.INPUT) or whole(s, o, *rest))
    options = {"INPUT": str(tmp_path / "in"), "OUTPUT": str(tmp_path / "t")}
    assert load(spark, options | {"LIMIT": "100"}, spec_of("i int")).count == 100
    assert len(seen) == 1 and len(seen[0]) <= 5
    assert load(spark, options | {"LIMIT": "500", "TRUNCATE": "YES"}, spec_of("i int")).count == 500
    assert [len(x) for x in seen[1:]] == [len(seen[0]), 30] or len(seen[-1]) < 60
    assert sorted(r.i for r in table.read_table(spark, str(tmp_path / "t"), "i int").collect()) == list(range(500))
    assert load(spark, options | {"LIMIT": "3990", "TRUNCATE": "YES"}, spec_of("i int")).count == 3990 and seen[-1] == str(tmp_path / "in")


def test_a_bounded_load_reads_the_beginning(run, spark, monkeypatch):
    from sluice.plans import load as module

    monkeypatch.setattr(module, "HEAD_BYTES", 100)
    seen, whole = [], module.parsed
    monkeypatch.setattr(module, "parsed", lambda s, o, *rest: seen.append(o.INPUT) or whole(s, o, *rest))
    spec = spec_of("i int, t text")
    data = "".join(f'{i},"text\n{i}"\n' for i in range(1, 500))
    assert run(data, spec, LIMIT="3") == (0, 3, 0, 0, 0) and len(seen) == 1 and "head" in seen[0]
    assert run("x,y\n" * 3000, spec, PARSE_ERRORS="4", TRUNCATE="YES") == (0, 0, 5, 0, 0) and len(seen) == 2
    assert run("1,y\n" * 3000, spec, PARSE_ERRORS="4", TRUNCATE="YES") == (0, 3000, 0, 0, 0) and len(seen) == 4
    assert run(data, spec, LIMIT="30", TRUNCATE="YES") == (0, 30, 0, 0, 0) and len(seen) == 6 and "head" in seen[5]
    assert run(data, spec, LIMIT="490", TRUNCATE="YES") == (0, 490, 0, 0, 0) and seen[-1].endswith(".txt")
    assert run(data, spec, SKIP="600", LIMIT="3", TRUNCATE="YES") == (600, 3, 0, 0, 0)
    assert [i for i, _ in run.rows(spec)] == [301, 302, 303]


def test_times_and_booleans(run):
    from datetime import datetime

    spec = spec_of("t timestamp, b boolean")
    data = "2020-01-31 24:00:00,on\n2020-01-31 23:59:59.9999996,tr\n2020-01-01 00:00:00.1234567,OFF\n2020-01-01 24:00:01,1\n2020-01-01,o\n2020-12-31 24:00,fals\n"
    assert run(data, spec) == (0, 4, 2, 0, 0)
    assert run.rows(spec) == sorted([(datetime(2020, 2, 1), True), (datetime(2020, 2, 1), True), (datetime(2020, 1, 1, 0, 0, 0, 123457), False), (datetime(2021, 1, 1), False)], key=str)


def test_numbers_of_fields_in_errors(spark, tmp_path):
    from sluice.operators.checks import convert_fields

    (tmp_path / "in.csv").write_text("1,2,3,4,5\n1\n1,2,x\n")
    found = convert_fields(text.read_records(spark, str(tmp_path / "in.csv")), spec_of("a int, b int, c int")).orderBy("rec_no").collect()
    assert [(r.err.code, r.err.col, r.err.msg) for r in found] == [
        ("arity", 5, "extra data after last expected column"), ("arity", 1, 'missing data for column "b"'), ("syntax", 3, "c"),
    ]


@pytest.mark.parametrize(("encoding", "counts"), [(None, (0, 9, 0, 0, 0)), ("UTF8", (0, 6, 3, 0, 0)), ("EUC_JP", (0, 6, 3, 0, 0))])
def test_encodings(run, encoding, counts):
    spec = spec_of("id int, str text, master int")
    data = (b"1,aaa,1\n2," + "あ".encode() + b",2\n3,\xa4\xa2 ,3\n") * 3
    assert run(data, spec, **({"ENCODING": encoding} if encoding else {})) == counts
    if encoding == "EUC_JP":
        assert (3, "あ ", 3) in run.rows(spec)
    with pytest.raises(ValueError, match="encoding"):
        run(data, spec, ENCODING="nonsense")


def test_reports_without_names(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1\nx\n2\n2\n")
    spec = TableSpec(spec_of("id int").columns, (UniqueKey(("id",)),))
    options = {"INPUT": str(tmp_path / "in.csv"), "OUTPUT": str(tmp_path / "t"), "PARSE_ERRORS": "1", "DUPLICATE_ERRORS": "1"}
    load(spark, options, spec, reports=str(tmp_path / "reports"))
    found = {"_".join(x.name.split("_")[1:]): x.read_text() for x in (tmp_path / "reports").iterdir()}
    assert found.pop("t.prs.csv") == "x\n" and found.pop("t.dup.csv") == "2\n"
    assert "1 rows: parse_errors" in found.pop("t.log") and not found


def test_one_place_under_two_names(tmp_path):
    for other in ("OUTPUT", "LOGFILE", "PARSE_BADFILE"):
        with pytest.raises(OptionError, match="must differ"):
            options_of({"INPUT": "/a/in.csv", "OUTPUT": "/a/t", other: "/a/b/../in.csv"})


def test_batches_are_halved_down_to_bad_rows():
    import pandas as pd

    from sluice.functions.registry import halved

    calls = []

    def body(a, b):
        calls.append(len(a))
        if (a % 100 == 37).any():
            raise ValueError(f"row of {int(a[a % 100 == 37].iloc[0])}")
        return a + b, b.astype(str)

    a = pd.Series(range(1000))
    good, bad = halved(body, [a, a * 2], 1000)
    assert sorted(bad) == [(100 * i + 37, f"row of {100 * i + 37}") for i in range(10)]
    whole = sorted((at + i, int(x)) for at, n, found in good for i, x in enumerate(found[0]))
    assert whole == [(i, 3 * i) for i in range(1000) if i % 100 != 37]
    assert len(calls) < 250
    assert halved(body, [a[:0], a[:0]], 0) == ([], [])
    assert halved(lambda a: [a[:-1]], [a[:1]], 1)[1] == [(0, "1 rows were given, and results have others")]


def test_batches_without_the_rows_that_a_filter_names():
    import pandas as pd

    from sluice.functions.registry import BadRows, tried

    calls = []

    def body(a, b):
        calls.append(len(a))
        if (a % 5 == 0).any():
            raise BadRows(a % 5 == 0, "five")
        if (a % 7 == 0).any():
            raise BadRows(list(a % 7 == 0), "seven")
        if (a == 501).any():
            raise ValueError("another")
        return a + b, b.astype(str)

    a = pd.Series(range(1000))
    left, good, bad = tried(body, [a, a * 2], 1000)
    want = {i: "five" if i % 5 == 0 else "seven" if i % 7 == 0 else "another" for i in range(1000) if i % 5 == 0 or i % 7 == 0 or i == 501}
    assert dict(bad) == want and len(bad) == len(want)
    whole = sorted((int(left[at + i]), int(x)) for at, n, found in good for i, x in enumerate(found[0]))
    assert whole == [(i, 3 * i) for i in range(1000) if i not in want]
    assert len(calls) < 30
    assert tried(body, [a[:0], a[:0]], 0)[1:] == ([], [])
    assert [x[1:] for x in (tried(body, [a[:1], a[:1]], 1),)] == [([], [(0, "five")])]

    def one_by_one(a):  # names a row a call, or rows that aren't there: halved
        if (a % 2 == 0).any():
            raise BadRows(a == a[a % 2 == 0].iloc[0] if len(a) % 3 else [True] * (len(a) + 1), "even")
        return [a]

    left, good, bad = tried(one_by_one, [a[:64]], 64)
    assert sorted(bad) == [(i, "even") for i in range(0, 64, 2)]
    assert sorted(int(x) for _, _, found in good for x in found[0]) == list(range(1, 64, 2))


def test_batch_filter(run):
    """Nulls of every type, strict arguments, rows of nulls, and rejects of the filter and of the parser, against a loop."""
    arguments = spec_of("a bigint, b text, c double, d int").columns
    result = spec_of("x bigint, y text, z double").columns

    def body(a, b, c, d):
        if (b == "bad").any():
            raise ValueError("bad word")
        assert (a % 2 >= 0).all() and b.str.len().min() > 0
        return (a * 2).where(d != 3, None), (b + "!").where(d != 3, None), (c / 2).where(d != 3, None)

    rng, lines, want, bad = random.Random(8), [], [], 0
    for _ in range(300):
        a, b, c, d = rng.choice(["", str(2**53 + 1), "5", "x"]), rng.choice(["ok", "bad", "", "ü"]), rng.choice(["1.5", ""]), rng.choice(["1", "3"])
        lines.append(f"{a},{b},{c},{d}")
        if a == "x":
            bad += 1
        elif "" in (a, b, c, d):
            want.append((None,) * 3)
        elif b == "bad":
            bad += 1
        else:
            want.append((None,) * 3 if d == "3" else (2 * int(a), b + "!", float(c) / 2))
    spec = spec_of("x bigint, y text, z double")
    f = Registry([Filter("f", arguments, result, body, strict=True, batch=True)])
    assert run("\n".join(lines), spec, f, FILTER="f") == (0, len(want), bad, 0, 0)
    assert run.rows(spec) == sorted(want, key=str)


def test_functions_that_are_refused():
    good = spec_of("a int").columns
    for arguments, result, more in (
        (spec_of("a anyelement").columns, good, {}),
        (spec_of("a internal").columns, good, {}),
        (good, spec_of("a record").columns, {}),
        (good, spec_of("a setof int").columns, {}),
        (good, (), {}),
        (good, spec_of("a nonsense").columns, {}),
        (good, good, {"defaults": (1, 2)}),
        (spec_of(", ".join(f"a{i} int" for i in range(101))).columns, good, {}),
    ):
        with pytest.raises(FunctionError):
            Registry([Filter("f", arguments, result, lambda *a: a, **more)]).filter_named("f")
    assert Registry([Filter("f", good, good, lambda a: [a])]).filter_named("f")


def test_table_functions(run, spark):
    class Pairs:
        columns = "k int, word string"

        def eval(self, row, word, times):
            for i in range(times):
                yield row["n"] + 1000 * i, word

    source = Source("pairs", ("table", "text", "int4"), Pairs, defaults=(2,), strict=True)
    registry, spec = Registry(sources=[source]), spec_of("k int not null, word text")
    spark.range(40).selectExpr("cast(id as int) n").createOrReplaceTempView("forty")
    assert run("", spec, registry, TYPE="FUNCTION", INPUT="pairs(TABLE(forty), 'it''s')") == (0, 80, 0, 0, 0)
    assert run.rows(spec) == sorted(((n + 1000 * i, "it's") for n in range(40) for i in range(2)), key=str)
    assert run("", spec, registry, TYPE="FUNCTION", INPUT="pairs(table(forty), 'x', 1)", LIMIT="7", TRUNCATE="YES") == (0, 7, 0, 0, 0)
    for wrong in ("pairs('forty', 'x')", "pairs(TABLE(forty), TABLE(forty))", "pairs(TABLE(forty), NULL)"):
        with pytest.raises(FunctionError):
            registry.source_called(wrong)


def test_dates_and_floats_are_strict(run):
    spec = spec_of("d date, t timestamp, f float8, r real, v varchar, c char")
    good = ["2024-02-29,2024-02-29,1e-300,1e-40,any length at all,x", "20240229,20240229,0e-999,0.0e-99,v,x ", "2024-2-9,2024-02-29 10:30,-0,1e38,,", "2024-02-29 10:00:00,2024-02-29T10:30:00.5+02,nan,inf,v,"]
    bad = ["2024,,,,,", "2024-02,,,,,", ",2024,,,,", ",2024-02,,,,", ",2024-02-29 10,,,,", "0000-01-01,,,,,", ",0000-01-01,,,,", "2023-02-29,,,,,", "20230229,,,,,",
           ",,1e-400,,,", ",,-3.5e-400,,,", ",,,1e-50,,", ",,,1e39,,", ",,,,,xy"]
    assert run("\n".join(good + bad), spec) == (0, len(good), len(bad), 0, 0)


def test_fast_timestamps(run):
    from datetime import datetime, timedelta

    spec = spec_of("t timestamp")
    rng, lines, want = random.Random(2), [], []
    for _ in range(60):
        y, mo, d, h, mi, s = 2000 + rng.randrange(30), rng.randrange(1, 13), rng.randrange(1, 100), rng.randrange(100), rng.randrange(100), rng.randrange(100)
        lines.append(f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}")
        want.append((datetime(y, mo, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s),))
    assert run("\n".join(lines), spec, FAST_TIMESTAMP="YES") == (0, 60, 0, 0, 0)
    assert run.rows(spec) == sorted(want, key=str)
    assert run("\n".join(["2024-13-40", "2024-01-01 24:00", *lines]), spec, TRUNCATE="YES")[2] > 30


def test_fixed_width_in_sql(spark, tmp_path):
    from sluice.sources import ranges

    (tmp_path / "in.bin").write_bytes(b"".join(struct.pack("<i6sh", i, f"n{i}".ljust(6).encode() if i % 3 else b"none  ", -i) for i in range(50)) + b"rest")
    ranges.register(spark)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY VIEW fixed_rows USING sluice_fixed OPTIONS (input '{tmp_path}/in.bin', skip '2', "
        "col 'INT; CHAR(6) NULLIF ''none  ''; SMALLINT', names 'id, name, small')"
    )
    found = spark.sql("SELECT id, name, small FROM fixed_rows WHERE small < -4 ORDER BY id").collect()
    assert [tuple(r) for r in found] == [(i, f"n{i}" if i % 3 else None, -i) for i in range(5, 50)]
    plain = spark.sql("SELECT count(*) FROM fixed_rows").first()[0]
    assert plain == 48


def test_writing_holds_small_batches_and_one_worker(spark, tmp_path):
    """Chunks go to Python in batches of a few MB, and their places are known without a step in Python."""
    import inspect

    from sluice.sinks import ordered
    from sluice.workspace import send_package

    assert send_package(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    assert inspect.getsource(ordered.write_chunks).count(".mapInArrow(") == 1
    rows = [(1, bytes([65 + i % 26]) * (i % 7 * 300_000 + 1)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "n long, data binary").repartitionByRange(3, "data").sortWithinPartitions("data")
    want = b"".join(bytes(r.data) for r in chunks.collect())
    assert ordered.write_chunks(chunks, f"file://{tmp_path}/out") == 40
    assert (tmp_path / "out").read_bytes() == want


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_good_records_are_converted_once(spark, tmp_path):
    """The filter on errors stays above the columns that it is made of, so a line is cut once."""
    from sluice.plans.load import parsed

    path = tmp_path / "in"
    path.write_text("".join(f"{i},{i / 8},2024-01-02 03:04:05,{i % 3 or 'x'}\n" for i in range(60)))
    spec = spec_of("a bigint, b double, c timestamp, d int")
    good = parsed(spark, options_of({"INPUT": str(path), "OUTPUT": "t", "PARSE_ERRORS": "INFINITE"}), spec).where("err IS NULL").select(*spec.names)
    assert _plan(good).count("split(") == 1
    assert sorted(r["a"] for r in good.collect()) == [i for i in range(60) if i % 3]


def test_checked_records_are_converted_once(spark, tmp_path):
    """As above with a CHECK constraint, which is one more use of each value."""
    from sluice.plans.load import parsed

    path = tmp_path / "in"
    path.write_text("".join(f"{i},{i / 8}\n" for i in range(60)))
    spec = TableSpec(spec_of("a bigint, b double").columns, checks=(("small", "b < 5 AND a % 2 = 0"),))
    o = options_of({"INPUT": str(path), "OUTPUT": "t", "PARSE_ERRORS": "INFINITE", "CHECK_CONSTRAINTS": "YES"})
    good = parsed(spark, o, spec).where("err IS NULL").select(*spec.names)
    assert _plan(good).count("split(") == 1
    assert sorted(r["a"] for r in good.collect()) == list(range(0, 40, 2))


def test_filters_in_python_are_called_once_a_row(spark, tmp_path):
    from sluice.plans.load import parsed

    path, calls = tmp_path / "in", tmp_path / "calls"
    path.write_text("".join(f"{i},{i % 3 or 'x'}\n" for i in range(60)))
    spec = spec_of("a bigint, d int")

    def body(a, d):
        with open(calls, "a") as f:
            f.write("x" * (len(a) if hasattr(a, "iloc") else 1))
        return [a, d]

    for more in ({"python": True}, {"batch": True}):
        calls.write_text("")
        f = Registry([Filter("f", spec.columns, spec.columns, body, **more)])
        o = options_of({"INPUT": str(path), "OUTPUT": "t", "PARSE_ERRORS": "INFINITE", "FILTER": "f"})
        assert len(parsed(spark, o, spec, f).where("err IS NULL").select(*spec.names).collect()) == 40
        assert len(calls.read_text()) == 40
