"""What the operators share: the tables, the shared folder and rows by record batch."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.sources import files

#: Rows that a Python worker turns into one record batch.
OUT_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.evened(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine (a local master) a folder of its own, which
    is then set for the session.

    On a cluster that names none this raises, as a local folder would be lost with its executor.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="refrain-")
    spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    return f"file://{found}"


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder. What is there when the program ends goes with it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends here."""
    return _at(df, new_path(df.sparkSession, what))


def _at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are dropped as soon as those made from them are stored too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(new_path(self.spark, what))
        return _at(df, self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


#: Paths in shared folders that this program has made and not yet deleted.
_left: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _left.discard(path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession() if _left else None
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_left):
            _delete(spark, path)


atexit.register(_sweep)


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session hands Python at most 8 MB at once (or less, where that is set), so that long texts don't add up."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(key).lower())
    if not now or int(now[1]) * 1024 ** " kmg".index(now[2] or " ") > 8_388_608:
        conf.set(key, "8388608b")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(names: Iterable[str]) -> list:
    """Columns by name, also where the name holds dots or backticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def as_bytes(column: str, name: str | None = None):
    """The UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(quoted([column])[0].cast("binary"), F.lit(b"")).alias(name or column)


def with_computed(docs: DataFrame, source: str, name: str, kind: T.DataType, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """docs, with a column computed from the bytes of another (null as empty), a record batch at a time; one of the same name is replaced.

    make is called once per task, and returns the function of a batch.
    """
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    inner = [f"c{i}" for i in range(len(keep))]  # Spark's Arrow functions take no names with dots

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in stream:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], compute(batch.column(len(keep)))], names=[*inner, "found"])

    own = docs.select(*(c.alias(i) for c, i in zip(quoted(keep), inner, strict=True)))
    given = docs.select(*(c.alias(i) for c, i in zip(quoted(keep), inner, strict=True)), as_bytes(source, "raw"))
    return small_batches(given).mapInArrow(run, own.schema.add("found", kind)).toDF(*keep, name)


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, so many at a time."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
