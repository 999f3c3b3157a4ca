"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.shipping import ship
from lexweave.storage import shared_folder, stored

__all__ = ["cut", "dealt", "map_rows", "numbered", "stored", "table", "utf8_bytes"]

#: Rows that a Python worker turns into objects at once; a record batch can hold ten thousand long texts.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work in Python workers: one in fewer splits than there are cores is dealt out to all.

    Large tables have more splits than cores and are read as they lie, without a shuffle.
    """
    found, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it with a short lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a struct ``name`` (file, at) that tells rows apart and is the same at every read.

    Rows of files are known by a hash of the file's path and their place in it, so nothing is written;
    other rows are numbered and written down.
    """
    try:
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return cut(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))))


class _Columns(dict):
    """A record batch's columns as lists, each made when it is asked for."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self.batch = batch

    def __missing__(self, name: str) -> list:
        got = self[name] = self.batch.column(name).to_pylist()
        return got


def map_rows(
    df: DataFrame,
    schema: T.StructType,
    each: Callable[[dict[str, list]], dict[str, list]],
    rows: int = SLICE,
) -> DataFrame:
    """Applies ``each`` to column lists of at most ``rows`` rows; what it returns has ``schema``.

    Columns of ``schema`` that ``each`` doesn't return are carried over as they are. Narrow and
    stateless: no shuffle, and a lost task is simply run again.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = each(_Columns(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) if f.name in got else part.column(f.name) for f in out],
                    names=out.names,
                )

    return df.mapInArrow(run, schema)


def utf8_bytes(column: str) -> F.Column:
    """UTF-8 bytes of a text column, none for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
