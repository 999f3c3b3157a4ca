"""Template counts over a stream of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexweave.operators import inventory as I


def running_groups(stream: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Groups of a stream so far, for output modes update and complete; state is one row for each template."""
    return I.groups(stream, key, value)


def upsert_catalog(catalog_path: str):
    """A ``foreachBatch`` function that keeps a Parquet table of first-seen templates, one folder for each batch.

    A batch that is run again replaces its own folder, so templates appear once.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = I.groups(batch)
        try:
            known = batch.sparkSession.read.parquet(f"{catalog_path}/batch=*").select("template", "_batch").where(f"_batch <> {number}")
            fresh = fresh.join(known.select("template").distinct(), "template", "left_anti")
        except Exception as x:
            if "PATH_NOT_FOUND" not in str(x):
                raise
        from pyspark.sql import functions as F

        fresh.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{catalog_path}/batch={number}")

    return each
