"""Shared pieces of the training-data operators: shared-folder tables, batch walks, exact ranks."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import ship

#: Unicode White_Space, as a character class body for `re` (Python's own \s also has \x1c-\x1f).
WHITE = r"\t-\r \x85\xa0  -     　"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tabloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) has one of its own; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_folder()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of an equi-join that is to shuffle both, whatever Spark thinks of its size.

    Spark goes by the size of the files, not of the rows that explode makes of them, and builds what it broadcasts on the driver.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes, so that Python objects for one slice stay few."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def give_back() -> None:
    """What a Python worker has freed goes back to the system at the end of a task; else it is held while later stages run."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def as_schema(ddl: str) -> pa.Schema:
    """Arrow's schema for a DDL string, as mapInArrow wants its batches; the executors get the code that makes them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(SparkSession.active())
    return to_arrow_schema(StructType.fromDDL(ddl))


def whole_number_id(df: DataFrame, id_col: str) -> None:
    """Raises unless ids are whole numbers, which operators need that work on ranges of ids."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; this operator goes by ranges of ids and needs whole numbers")


def range_of(cuts: list[int], key: str) -> Column:
    """The number of cuts below the key, by halving."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) > cuts[mid], part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(cuts))


def spread(key: Column, buckets: Column | int) -> Column:
    """A bucket from 0 for an even spread of rows by their key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets).cast("bigint") if isinstance(buckets, int) else buckets.cast("bigint"))


def with_before(sums: DataFrame, by: list[str], bucket: str, sizes: dict[str, str], wide: int = 1000) -> DataFrame:
    """sums (one row for each `by` and number `bucket`) with, for each size and name in `sizes`, the sum of the size over all lower buckets.

    `wide` buckets are summed together first, so that one task's rows are a thousandth of the buckets.
    """
    rows = sums.withColumn("_wide", F.floor(F.col(bucket) / wide))
    own = Window.partitionBy(*by, "_wide").orderBy(bucket)
    rows = rows.select("*", *((F.sum(c).over(own) - F.col(c)).alias(f"_in_{name}") for c, name in sizes.items()))
    up = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_wide")
    tops = sums.groupBy(*by, F.floor(F.col(bucket) / wide).alias("_wide")).agg(*(F.sum(c).alias(f"_sum_{name}") for c, name in sizes.items()))
    tops = tops.select(*by, "_wide", *((F.sum(f"_sum_{name}").over(up) - F.col(f"_sum_{name}")).alias(f"_top_{name}") for name in sizes.values()))
    return rows.join(tops, [*by, "_wide"]).select(*sums.columns, *((F.col(f"_in_{name}") + F.col(f"_top_{name}")).alias(name) for name in sizes.values()))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
