"""What the text operators share: the shared work folder, cut lineage, bounded Arrow batches, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table that lower-cases A-Z only; the other bytes, so all of a multi-byte character, stay.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (local mode only) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of written() tables, once all that was made of them is a written table itself."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


#: Bytes that one batch may hold beside its last row.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once, in rows and in bytes, also where texts are long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns freed memory to the system. Python workers go from task to task, and would keep what each one's caches took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow where f yields dicts of columns (lists, numpy or Arrow arrays), in any order."""
    small_batches(df.sparkSession)
    empty = df.sparkSession.createDataFrame([], schema)
    types = pa.schema([pa.field(c.name, _arrow(c.dataType)) for c in empty.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in f(batches):
                yield pa.RecordBatch.from_arrays([out[t.name].cast(t.type) if isinstance(out[t.name], pa.Array) else pa.array(out[t.name], type=t.type, from_pandas=False) for t in types], schema=types)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, f: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """map_arrow over dicts of column lists."""
    return map_arrow(df, lambda batches: f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches), schema)


def numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that lie sorted by the whole numbers in `by`, in tables that end where a group ends, and where groups begin and end."""
    held: list[pa.RecordBatch] = []

    def cut(table):
        keys = [numbers(table.column(c)) for c in by]
        return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(table)]

    for b in batches:
        if b.num_rows:
            table = pa.Table.from_batches([*held, b])
            ends = cut(table)
            if len(ends) > 2:
                yield table.slice(0, ends[-2]).combine_chunks(), ends[:-1]
            held = table.slice(ends[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII alone take the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_bytes(text: str | None) -> bytes:
    """UTF-8; unpaired surrogates can't come from Spark's strings. Null is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the graph with the links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star until no link changes, so rounds grow with the logarithm of the
    longest path. Each round is a table in the shared folder; groups hold no lists, only minima.
    """
    spark = edges.sparkSession
    path, n = None, 0
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    stamp = None
    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # large-star: a node's larger neighbours go to its least neighbour
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        own = large.groupBy("v").agg(F.min("u").alias("m"))
        # small-star: a node and its smaller neighbours go to the least of them
        small = large.join(own, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        new = new_path(spark, name)
        small.write.parquet(new)
        links = spark.read.schema("v long, u long").parquet(new)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if path:
            remove(spark, path)
        path, n = new, n + 1
        if tuple(now) == stamp:
            return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
        stamp = tuple(now)


class Shared:
    """A broadcast of an object of this package, by value; get() unpacks it once in each Python worker's function."""

    def __init__(self, spark: SparkSession, what):
        from pyspark import cloudpickle

        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(what))

    def get(self):
        import pickle

        return pickle.loads(self.sent.value)
