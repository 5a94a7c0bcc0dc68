"""Tables of plain Parquet files whose versions are committed at once.

A table is a folder with data folders ``v=...``, deletion marks ``d=...``, key summaries ``s=...`` and version files
``_versions/000000000001.json``, ... A version names the folders that it consists of. A load writes new folders beside
the old ones and then creates the next version file, which only one load can do: readers see the old rows or the new
ones, and a load that dies leaves the table as it was. Stored rows are never rewritten by a load: rows that it replaces
are marked as deleted, by file and position.

Two loads of one table: the first one holds a claim from before it reads the table until after its commit, and a second
one is refused. A claim that nobody has renewed for ``EXPIRY`` seconds belongs to a load that died, and is taken over.
Should its owner wake up again, it finds its version file there already, and fails.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS, CLAIM = "_versions", "_CLAIM"
#: Seconds without a sign of life after which a claim may be taken over.
EXPIRY = 600


class TableBusy(RuntimeError):
    """Another load of the table is running."""


class Conflict(RuntimeError):
    """The table has changed since this load read it; nothing is committed."""


@dataclass(frozen=True)
class Version:
    """Number 0 is a table that isn't there yet. ``data``: folder and the signatures of the keys that its summary in ``s=`` has."""

    number: int = 0
    data: tuple[tuple[str, tuple[str, ...]], ...] = ()
    marks: tuple[str, ...] = ()

    @property
    def folders(self) -> list[str]:
        return [x for x, _ in self.data]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def plain_files(spark: SparkSession, path: str):
    """As ``file_system``; local files get no file of checksums beside them, and can be appended to."""
    fs, place = file_system(spark, path)
    if str(fs.getUri().getScheme()) == "file":
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).getRawFileSystem()
    return fs, place


def _read(spark: SparkSession, path: str) -> str:
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet, at once; False if it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, place = file_system(spark, path)
    _, part = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext
    context = files.getFileContext(fs.getUri(), conf)
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(place), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(place):
            return False
        raise e


def current(spark: SparkSession, table: str) -> Version:
    """The table's last version."""
    fs, place = file_system(spark, f"{table}/{VERSIONS}")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    numbers = [int(x[:-5]) for x in names if x.endswith(".json")]
    if not numbers:
        return _older(spark, table)
    found = json.loads(_read(spark, f"{table}/{VERSIONS}/{max(numbers):012d}.json"))
    return Version(max(numbers), tuple((d, tuple(k)) for d, k in found["data"]), tuple(found["marks"]))


def _older(spark: SparkSession, table: str) -> Version:
    """A table that has no version file yet: none, or one with the pointer file that tables had before."""
    fs, place = file_system(spark, f"{table}/_CURRENT")
    folders = json.loads(_read(spark, f"{table}/_CURRENT"))["folders"] if fs.exists(place) else []
    return Version(0, tuple((d, ()) for d in folders))


class Claim:
    """The right to load a table, renewed by a thread until it is given back.

    ``with Claim(...)`` raises ``TableBusy`` if another load holds it.
    """

    def __init__(self, spark: SparkSession, table: str, expiry: float = EXPIRY):
        self.spark, self.table, self.expiry = spark, table, expiry
        self.owner, self._stop = uuid.uuid4().hex, threading.Event()

    def __enter__(self) -> Claim:
        path = f"{self.table}/{CLAIM}"
        fs, place = file_system(self.spark, path)
        if not _create(self.spark, path, json.dumps({"owner": self.owner})):
            other = self._holder()
            if other and time.time() - other[1] < self.expiry:
                raise TableBusy(f"another load of {self.table} is running")
            # Only one of those who see a dead claim can move it away. What was moved must be what was seen.
            _, aside = file_system(self.spark, f"{path}.{self.owner}.dead")
            if other and fs.rename(place, aside):
                moved = json.loads(_read(self.spark, str(aside.toString())))["owner"]
                if moved != other[0]:
                    fs.rename(aside, place)
                    raise TableBusy(f"another load of {self.table} has begun")
                fs.delete(aside, False)
            if not _create(self.spark, path, json.dumps({"owner": self.owner})):
                raise TableBusy(f"another load of {self.table} has begun")
        self._thread = threading.Thread(target=self._renew, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self._stop.set()
        self._thread.join()
        fs, place = file_system(self.spark, f"{self.table}/{CLAIM}")
        if self.held():
            fs.delete(place, False)

    def _holder(self) -> tuple[str, float] | None:
        """Who holds the claim, and when it was renewed last; None if nobody does."""
        fs, place = file_system(self.spark, f"{self.table}/{CLAIM}")
        try:
            return json.loads(_read(self.spark, f"{self.table}/{CLAIM}"))["owner"], fs.getFileStatus(place).getModificationTime() / 1000
        except Exception:
            if fs.exists(place):
                raise
            return None

    def held(self) -> bool:
        return (self._holder() or ("",))[0] == self.owner

    def _renew(self) -> None:
        fs, place = file_system(self.spark, f"{self.table}/{CLAIM}")
        while not self._stop.wait(self.expiry / 4):
            try:
                if self.held():
                    fs.setTimes(place, int(time.time() * 1000), -1)
            except Exception:  # a store that is away for a moment; the claim expires if it stays away
                continue


def new_folder(kind: str, version: Version) -> str:
    """A name that no other load has given."""
    return f"{kind}={version.number + 1}-{uuid.uuid4().hex[:12]}"


def commit(spark: SparkSession, table: str, read: Version, new: Version, claim: Claim | None = None) -> Version:
    """Make ``new`` the version after ``read``, unless another load has made one meanwhile."""
    if claim and not claim.held():
        raise Conflict(f"the claim of {table} was taken over")
    new = replace(new, number=read.number + 1)
    text = json.dumps({"data": [[d, list(k)] for d, k in new.data], "marks": list(new.marks)})
    # Versions have no gaps, so that a load which read an older one finds its number taken.
    if current(spark, table).number != read.number or not _create(spark, f"{table}/{VERSIONS}/{new.number:012d}.json", text):
        raise Conflict(f"{table} has changed since it was read; nothing is committed")
    return new


#: A row's place: the file's name, and which of its rows it is.
PLACE = {"_file": "_metadata.file_name", "_row": "_metadata.row_index"}


def marks_of(spark: SparkSession, table: str, version: Version) -> DataFrame:
    """``_file``, ``_row`` of deleted rows. Names of files are unique in a table."""
    return spark.read.schema("_file string, _row long").parquet(*(f"{table}/{x}" for x in version.marks))


def rows_at(spark: SparkSession, table: str, version: Version, ddl: str, files: list[str] | None = None) -> DataFrame | None:
    """Rows that aren't deleted, with ``_file`` and ``_row``; only those in ``files`` (folder/name), if given. None without files.

    Only files that have marks are joined with them.
    """
    paths = version.folders if files is None else files
    if not paths:
        return None
    places = [F.col(c).alias(x) for x, c in PLACE.items()]
    if not version.marks:
        return spark.read.schema(ddl).parquet(*(f"{table}/{x}" for x in paths)).select("*", *places)
    marks = marks_of(spark, table, version)
    marked = {r[0] for r in marks.select("_file").distinct().collect()}  # a name a file, as for Spark's own listing
    every = files if files is not None else _files(spark, table, version.folders)
    found = None
    for own, has in (([x for x in every if x.rpartition("/")[2] not in marked], False), ([x for x in every if x.rpartition("/")[2] in marked], True)):
        if own:
            rows = spark.read.schema(ddl).parquet(*(f"{table}/{x}" for x in own)).select("*", *places)
            rows = rows.join(marks, ["_file", "_row"], "left_anti").select(*rows.columns) if has else rows
            found = found.unionByName(rows) if found is not None else rows
    return found


def _files(spark: SparkSession, table: str, folders: list[str]) -> list[str]:
    fs, _ = file_system(spark, table)
    return sorted(f"{d}/{s.getPath().getName()}" for d in folders for s in fs.listStatus(file_system(spark, f"{table}/{d}")[1]) if s.getPath().getName().startswith("part-"))


def read_table(spark: SparkSession, table: str, ddl: str) -> DataFrame | None:
    """The rows of the last version; None if there is no table."""
    version = current(spark, table)
    rows = rows_at(spark, table, version, ddl)
    if rows is None:
        return spark.createDataFrame([], ddl) if version.number else None
    return rows.drop("_file", "_row")


def compact(spark: SparkSession, table: str, ddl: str, share: float = 0.3) -> int:
    """Rewrite the folders of which more than ``share`` of the rows are deleted, and drop their marks; how many there were.

    The new folder has no key summary, so its files are looked into by the next load with a key.
    """
    with Claim(spark, table) as claim:
        version = current(spark, table)
        if not version.marks:
            return 0
        marks, all_files = marks_of(spark, table, version).distinct(), _files(spark, table, version.folders)
        names = spark.createDataFrame([(x.rpartition("/")[2], x.rpartition("/")[0]) for x in all_files], "_file string, folder string")
        deleted = {r[0]: r[1] for r in marks.join(names, "_file").groupBy("folder").count().collect()}
        worn = [d for d in version.folders if deleted.get(d, 0) > share * spark.read.schema(ddl).parquet(f"{table}/{d}").count()]
        if not worn:
            return 0
        data, kept_marks = new_folder("v", version), new_folder("d", version)
        old = [x for x in all_files if x.rpartition("/")[0] in worn]
        rows_at(spark, table, version, ddl, old).drop("_file", "_row").write.parquet(f"{table}/{data}")
        gone = names.where(F.col("folder").isin(worn)).select("_file")
        marks.join(gone, "_file", "left_anti").write.parquet(f"{table}/{kept_marks}")
        left = tuple(x for x in version.data if x[0] not in worn)
        commit(spark, table, version, Version(0, (*left, (data, ())), (kept_marks,)), claim)
        return len(worn)
