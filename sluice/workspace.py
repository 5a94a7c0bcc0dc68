"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sluice-")


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``. Only where one process is the whole cluster may it be unset: then a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/sluice-{uuid.uuid4().hex}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from the shared folder."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _send(application: str, context) -> None:
    top = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='sluice-')}/sluice.zip"
    with zipfile.ZipFile(path, "w") as file:
        for module in top.rglob("*.py"):
            file.write(module, module.relative_to(top.parent))
    context.addPyFile(path)


#: Bytes of an Arrow batch handed to Python: a worker holds a batch several times over.
ARROW_BYTES = "2m"


def send_package(spark: SparkSession) -> SparkSession:
    """The package's modules to the executors, whatever their Python path; the batch size for Python stages where it is Spark's default."""
    _send(spark.sparkContext.applicationId, spark.sparkContext)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


#: Bytes of a method beyond which HotSpot only interprets it.
COMPILED_BYTES = "8000"


def compiled(spark: SparkSession) -> None:
    """Whole-stage code that HotSpot wouldn't compile, as that of a dozen conversions, gives way to code by operator, where the limit is Spark's default."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
