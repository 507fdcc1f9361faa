"""Tables in the folder that all executors share, and Bloom filters in front of joins with texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import kernels as K

#: Bits of a Bloom filter for each key, and at most: 16 MB are sent to the executors. Beyond so many keys more rows pass, none is lost.
BITS_A_KEY, MOST_BITS, PROBES = 12, 1 << 27, 3
_WORD = 1 << 15  # bits in a row of bitmap_construct_agg
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset and the master local, a temporary one, which goes with this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application's tables are in."""
    return f"{shared_folder(spark)}/codeloom-{spark.sparkContext.applicationId}"


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and the plan with all that was derived about it.
    Results are lazy and read these tables, so they stay until discard() or release(). The shuffle files of df go at once;
    else Spark keeps them until the driver happens to collect its garbage, and those of all steps add up."""
    path = f"{own_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of checkpoint() that nothing will read any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/table-" in path:
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this application. To be called once its results are written."""
    _delete(spark, own_folder(spark))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield (K.mix(keys.view(np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bits)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys, whole numbers in a table of one column. Tasks make partial bitmaps, which Spark adds
    up; only the bits, whose number is bounded, come to the driver."""
    bits = max(_WORD, min(MOST_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // _WORD), pa.array(at % _WORD)], ["word", "at"])

    some = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where("key is not null")
    rows = some.mapInArrow(place, "word long, at long").groupBy("word").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    packed = np.zeros(bits // 8, np.uint8)
    for word, value in zip(rows.column("word").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        packed[word * _WORD // 8 :][: len(value)] = np.frombuffer(value, np.uint8)
    return packed


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    hit = np.ones(len(keys), bool)
    for p in _places(keys, len(packed) * 8):
        hit &= (packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return hit


def may_be_in(packed: np.ndarray, column: Column) -> Column:
    """Whether a value of `column` may be among the keys of the filter; a null is not."""

    def run(given: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(packed, given.fill_null(0).to_numpy(zero_copy_only=False)) & given.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "boolean")(column.cast("long"))


def split_by(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of the keys, and the others; only the first need take part in a join."""
    may = may_be_in(bitmap(keys), F.col(column))
    return rows.where(may), rows.where(~may)
