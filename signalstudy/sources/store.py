"""Intermediate tables that a study reads more than once."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names, read back: what reads it several times does not
    compute it again, and lost executors lose nothing. A temporary folder serves where none is named on a local master."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # the first to come names it
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="signalstudy-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/signalstudy/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def all_written(*named: tuple[DataFrame, str]) -> list[DataFrame]:
    """written() of each, side by side: tables that don't need one another."""
    with ThreadPoolExecutor(len(named)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(written), df, name) for df, name in named]]
