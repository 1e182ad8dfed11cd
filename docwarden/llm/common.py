"""What several of these operators share: reading tables, tables written on the way, grids of blocks."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest finite double; a component beyond it, or NaN (which Spark orders above all numbers), is not finite.
LARGEST = 1.7976931348623157e308


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a folder of its own where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docwarden-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing uses yet; it is deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds only finite components."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(LARGEST), F.lit(False)))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def blocks(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows of one side of a grid: block ``own`` by a hash of ``key``, repeated for each block ``other`` of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    )


def matrix(column: pa.ChunkedArray, dtype=np.float64, width: int = 0) -> np.ndarray:
    """Vectors of a block as rows of a matrix; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    lengths = np.diff(column.offsets.to_numpy())
    if not len(lengths):
        return np.zeros((0, width), dtype)
    width = max(width, int(lengths.max()))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def one_per_id(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of id; of rows with the same id, the smallest vector stands for all."""
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], x[first]
