"""Delimited text: records, fields and nulls, read in parallel.

A file is read as lines. One row for each block (the part of a file that one task reads) goes to the driver: how many
lines it has, and whether any holds a quote. Without quotes a line is a record, and Spark splits it.

Otherwise quoting decides which line ends are data, and whether a block begins inside quotes depends on all blocks before
it. So each block is scanned once for both cases, one row a block settles which case each block is in and which number
its first record has, and a second scan cuts, splits and numbers the records inside the task. Only the two ends of a
block can hold parts of records that cross it: these parts, which the first scan left in a table, are put together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import written


@dataclass(frozen=True)
class Dialect:
    """Single bytes that separate, quote and escape; an escape works inside quotes, before a quote or an escape."""

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'


class ShortInput(ValueError):
    """Fewer lines or records than are to be skipped."""


FIELDS = "array<struct<t: string, q: boolean>>"
#: Characters of a record; a longer one is rejected like one whose quote is not closed (fixed value).
MOST_CHARS = 16 * 1024 * 1024


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``block``, ``within``, ``value``: lines (by line feeds) and their order. A folder's files are read by name."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.concat("_metadata.file_path", F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("block"),
        F.monotonically_increasing_id().alias("within"),
        "value",
    )


@functools.cache
def _specials(*characters: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(characters)) + "]")


def _toggles(text: str, d: Dialect, inside: bool, *others: str) -> Iterator[tuple[int, str, bool]]:
    """Places of quotes that open or close, of escapes before what they escape, and of ``others``, with whether each stands inside quotes."""
    after = 0
    for found in _specials(d.quote, d.escape, *others).finditer(text):
        i, c = found.start(), found[0]
        if i < after:
            continue
        if inside and c == d.escape and text[i + 1 : i + 2] in (d.quote, d.escape) and i + 1 < len(text):
            after = i + 2
            yield i, "escape", True
        elif c == d.quote:
            yield i, "quote", inside
            inside = not inside
        elif c in others:
            yield i, c, inside


def line_state(line: str, d: Dialect, inside: bool) -> tuple[bool, int]:
    """Whether a line ends inside quotes, and how many carriage returns in it end a record. One at its end belongs to the line feed."""
    if d.quote not in line:
        return inside, 0 if inside or "\r" not in line else line.count("\r") - line.endswith("\r")
    if d.escape == d.quote and "\r" not in line:
        return inside ^ (line.count(d.quote) % 2 == 1), 0
    breaks = 0
    for i, what, within in _toggles(line, d, inside, "\r"):
        if what == "quote":
            inside = not within
        elif what == "\r" and not within:
            breaks += i + 1 < len(line)
    return inside, breaks


def records_in(text: str, d: Dialect) -> list[str]:
    """``text``, which begins outside quotes, cut at carriage returns (with a line feed or without) outside quotes."""
    if "\r" not in text:
        return [text]
    found, start = [], 0
    for i, what, within in _toggles(text, d, False, "\r"):
        if what == "\r" and not within:
            found.append(text[start:i])
            start = i + 1
    # A carriage return at the end is the first half of the line end.
    return found + [text[start:]] if start < len(text) or not found else found


def fields_of(record: str, d: Dialect) -> list[tuple[str, bool]] | None:
    """The record's fields without quote marks, and whether each had any; None if a quote is not closed or it is too long."""
    if len(record) > MOST_CHARS:
        return None
    if d.quote not in record:
        return [(x, False) for x in record.split(d.delimiter)]
    found, part, quoted, inside, at = [], [], False, False, 0
    for i, what, within in _toggles(record, d, False, d.delimiter):
        if what == "escape":
            part += [record[at:i], record[i + 1]]
            at = i + 2
        elif what == "quote":
            part.append(record[at:i])
            inside, quoted, at = not within, True, i + 1
        elif not within:
            part.append(record[at:i])
            found.append(("".join(part), quoted))
            part, quoted, at = [], False, i + 1
    if inside:
        return None
    return [*found, ("".join([*part, record[at:]]), quoted)]


def _without_return(value):
    """A line without the carriage return before its line feed."""
    return F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def _simple(lines: DataFrame, blocks: list, d: Dialect, skip: int, texts: bool) -> DataFrame:
    """Lines as records. What is broadcast is a row a block. ``fields`` are plain texts, if ``texts``."""
    starts, before = [], 0
    for b in blocks:
        starts.append((b["block"], before - b["first"] + 1 - skip))
        before += b["n"]
    offsets = lines.sparkSession.createDataFrame(starts, "block string, _offset long")
    value = _without_return(F.col("value"))
    rows = lines.join(F.broadcast(offsets), "block").select((F.col("within") + F.col("_offset")).alias("rec_no"), value.alias("raw"))
    # The quote that an unclosed quotation would need is nowhere, so each record has its fields.
    split = F.split("raw", d.delimiter if d.delimiter.isalnum() else "\\" + d.delimiter, -1)
    fields = split if texts else F.transform(split, lambda t: F.struct(t.alias("t"), F.lit(False).alias("q")))
    return rows.where("rec_no > 0").select("rec_no", "raw", fields.alias("fields"))


def _runs(batches: Iterator[pa.RecordBatch], skips: dict[str, int]) -> Iterator[tuple[str, list[str]]]:
    """(block, lines) as a task reads them, in order, without so many line ends at the beginning as ``skips`` says of a block."""
    current, left = None, 0
    for batch in batches:
        names, values = (x.to_pylist() for x in batch.columns)
        at = 0
        while at < len(names):
            block, end = names[at], len(names)
            if names[-1] != block:
                end = next(i for i in range(at, len(names)) if names[i] != block)
            if block != current:
                current, left = block, skips.get(block, 0)
            own = values[at:end]
            at = end
            first = 0
            while left and first < len(own):
                ends = 1 + own[first].count("\r") - own[first].endswith("\r")
                if left < ends:
                    own[first] = own[first].split("\r", left)[left]
                    left = 0
                    break
                left -= ends
                first += 1
            if first < len(own):
                yield block, own[first:] if first else own


class _Ends:
    """What a block's first scan tells, for a beginning outside quotes (0) and inside (1): how it ends, how many records
    begin in it, and the parts of records that cross its ends."""

    def __init__(self, block: str):
        self.block, self.inside, self.begun = block, [False, True], [0, 0]
        self.lead, self.lead_chars, self.lead_open = [], 0, True
        self.tails: list[list[str]] = [[], []]
        self.tail_chars, self.tail_begun = [0, 0], [0, 0]

    def add(self, line: str, d: Dialect) -> None:
        for s in (0, 1):
            before = self.inside[s]
            after, breaks = line_state(line, d, before)
            begun = breaks + (not before)
            self.inside[s] = after
            self.begun[s] += begun
            if s and self.lead_open:
                if self.lead_chars <= MOST_CHARS:
                    self.lead.append(line)
                self.lead_chars += len(line) + 1
                self.lead_open = after
            elif not after:
                self.tails[s], self.tail_chars[s], self.tail_begun[s] = [], 0, 0
            else:
                if self.tail_chars[s] <= MOST_CHARS:
                    self.tails[s].append(line)
                self.tail_chars[s] += len(line) + 1
                self.tail_begun[s] += begun

    def row(self) -> dict:
        lead = "\n".join(self.lead) if self.lead_chars <= MOST_CHARS else None
        found = {"block": self.block, "lead": lead, "lead_chars": self.lead_chars, "lead_open": self.lead_open}
        for s in (0, 1):
            found |= {f"inside{s}": self.inside[s], f"begun{s}": self.begun[s], f"tail{s}": "\n".join(self.tails[s])}
            found |= {f"tail_chars{s}": self.tail_chars[s], f"tail_begun{s}": self.tail_begun[s]}
        return found


_ENDS = pa.schema(
    [("block", pa.string()), ("lead", pa.string()), ("lead_chars", pa.int64()), ("lead_open", pa.bool_())]
    + [
        (f"{name}{s}", kind)
        for s in (0, 1)
        for name, kind in (("inside", pa.bool_()), ("begun", pa.int64()), ("tail", pa.string()), ("tail_chars", pa.int64()), ("tail_begun", pa.int64()))
    ]
)
_ENDS_DDL = "block string, lead string, lead_chars long, lead_open boolean, " + ", ".join(
    f"inside{s} boolean, begun{s} long, tail{s} string, tail_chars{s} long, tail_begun{s} long" for s in (0, 1)
)


def _split(rows: list[tuple[int, str, bool]], d: Dialect) -> pa.RecordBatch:
    """``rec_no``, ``raw``, ``fields`` of records; those marked have none."""
    offsets, texts, quoted, none = [0], [], [], []
    for _, raw, long in rows:
        fields = None if long else fields_of(raw, d)
        none.append(fields is None)
        for t, q in fields or ():
            texts.append(t)
            quoted.append(q)
        offsets.append(len(texts))
    values = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(quoted, pa.bool_())], ["t", "q"])
    fields = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(none, pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), fields], ["rec_no", "raw", "fields"])


def _quoted(lines: DataFrame, d: Dialect, skips: dict[str, int]) -> DataFrame:
    """A block is a part of a file that one task reads, so the two scans see the same lines in the same order."""
    lines = lines.select("block", "value")
    context = lines.sparkSession.sparkContext

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = None
        for block, values in _runs(batches, skips):
            if ends is None or ends.block != block:
                if ends:
                    yield pa.RecordBatch.from_pylist([ends.row()], _ENDS)
                ends = _Ends(block)
            for value in values:
                ends.add(value, d)
        if ends:
            yield pa.RecordBatch.from_pylist([ends.row()], _ENDS)

    ends = written(lines.mapInArrow(scan, _ENDS_DDL))
    begins, pieces, chars = {}, {}, {}  # an entry a block: its first case and number; the records its ends belong to; a record's length
    inside, begun, crossing = False, 0, 0
    for b in ends.drop("lead", "tail0", "tail1").orderBy("block").toLocalIterator():
        s = int(inside)
        begins[b["block"]] = (inside, begun)
        lead = crossing if inside else None
        begun += b[f"begun{s}"]
        if inside:
            chars[crossing] += b["lead_chars"]
        inside = b[f"inside{s}"]
        tail = None
        if inside and not (s and b["lead_open"]):
            tail = crossing = begun - b[f"tail_begun{s}"] + 1
            chars[crossing] = b[f"tail_chars{s}"]
        if lead is not None or tail is not None:
            pieces[b["block"]] = (lead, tail, f"tail{s}")
    long = {k for k, n in chars.items() if n > MOST_CHARS}
    sent, parts = context.broadcast(begins), context.broadcast((pieces, long))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that begin and end in a block."""
        current, inside, begun, lead, part, size, breaks, rows = None, False, 0, False, [], 0, 0, []
        for block, values in _runs(batches, skips):
            if block != current:
                current, part, size, breaks = block, [], 0, 0
                inside, begun = sent.value[block]
                lead = inside
            for value in values:
                inside, more = line_state(value, d, inside)
                if lead:  # the end of a record that begins in an earlier block
                    begun += more
                    lead = inside
                    continue
                breaks += more
                if size <= MOST_CHARS:
                    part.append(value)
                size += len(value) + 1
                if inside:
                    continue
                text = "\n".join(part)
                if size > MOST_CHARS + 1:
                    rows.append((begun + 1, text, True))
                else:
                    rows += [(begun + 1 + i, raw, False) for i, raw in enumerate(records_in(text, d))]
                begun += 1 + breaks
                part, size, breaks = [], 0, 0
            if len(rows) >= 4096:
                yield _split(rows, d)
                rows = []
        if rows:
            yield _split(rows, d)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of records that cross blocks; of too long ones only the first."""
        pieces, long = parts.value
        for batch in batches:
            for row in batch.to_pylist():
                lead, tail, name = pieces.get(row["block"], (None, None, ""))
                found = [(tail, row[name])] if tail is not None else []
                found += [(lead, row["lead"])] if lead is not None and lead not in long else []
                if found:
                    columns = [pa.array([x for x, _ in found], pa.int64()), pa.array([row["block"]] * len(found)), pa.array([x for _, x in found], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["rec_no", "block", "text"])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, long = parts.value
        for batch in batches:
            for rec_no, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                cuts = [text] if rec_no in long else records_in(text, d)
                yield _split([(rec_no + i, raw, rec_no in long) for i, raw in enumerate(cuts)], d)

    ddl = f"rec_no long, raw string, fields {FIELDS}"
    crossed = ends.select("block", "lead", "tail0", "tail1").mapInArrow(pick, "rec_no long, block string, text string")
    crossed = crossed.groupBy("rec_no").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
    crossed = crossed.select("rec_no", F.array_join("p.text", "\n").alias("text")).mapInArrow(tokenize, ddl)
    return lines.mapInArrow(cut, ddl).unionByName(crossed)


def in_encoding(lines: DataFrame, encoding: str) -> DataFrame:
    """Lines whose bytes are of another encoding as text; U+FFFD, which none of these has, stands for malformed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([x.decode(encoding, "replace") for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], text], ["block", "within", "value"])

    raw = lines.select("block", "within", F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(run, "block string, within long, value string")


def read_records(
    spark: SparkSession, path: str, dialect: Dialect | None = None, skip: int = 0, encoding: str | None = None, texts: bool = False
) -> DataFrame:
    """``rec_no`` (from 1, after ``skip`` lines), ``raw``, ``fields`` (null if a quote is not closed, or in a record of
    more than ``MOST_CHARS``) of a text file.

    Records end at a line feed, a carriage return or both, outside quotes; a blank line is a record of one empty field.
    ``skip`` counts such line ends wherever they stand, whatever quotes say, and quoting begins after them; an input with fewer lines
    raises ``ShortInput``. With ``texts``, fields of an input without quotes are plain texts, which Spark reads faster.
    """
    d = dialect or Dialect()
    lines = lines_of(spark, path)
    if encoding:
        lines = in_encoding(lines, encoding)
    value = F.col("value")
    returns = F.length(value) - F.length(F.replace(value, F.lit("\r"))) - F.endswith(value, F.lit("\r")).cast("int")
    returns = F.when(F.contains(value, F.lit("\r")), returns).otherwise(0)
    per = lines.groupBy("block").agg(F.count("*").alias("n"), F.sum(returns).alias("returns"), F.max(F.contains(value, F.lit(d.quote))).alias("quotes"), F.min("within").alias("first"))
    blocks = per.orderBy("block").collect()  # a row for each part of a file that a task reads
    total = sum(b["n"] + b["returns"] for b in blocks)
    if total < skip:
        raise ShortInput(f"cannot skip {skip} lines: the input has {total}")
    if not any(b["quotes"] or b["returns"] for b in blocks):
        return _simple(lines, blocks, d, skip, texts)
    skips = {}
    for b in blocks:
        skips[b["block"]] = min(skip, b["n"] + b["returns"])
        skip -= skips[b["block"]]
    return _quoted(lines, d, {k: n for k, n in skips.items() if n})
