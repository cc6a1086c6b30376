"""Shared helpers: table reading, tables cut into the shared folder, text constants."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One run of white space, as every operator here understands it (Java and Python syntax alike).
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is named only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="signalstudy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/signalstudy/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def norm_ws(col):
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), WS, " ")


def give_back() -> None:
    """Return freed memory to the system when a task's Python part is over: its worker stays and others need the room."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Texts go to Python in Arrow batches of at most so many rows: some are very long, and workers' memory is small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def col(name: str) -> Column:
    """The column of this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(df: DataFrame, **more: Column) -> DataFrame:
    """df's rows as one struct column, row, beside the columns more: names of df's columns can't clash with those."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def by_bitmap(rows: DataFrame, key: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not in keys (columns key), and the others, which may be in it.

    A bitmap of hashed keys, 16 bits a key and 16 MB at most, is broadcast.
    """
    bits = min(max(20, (16 * max(keys.count(), 1) - 1).bit_length()), 27)
    place = F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)
    at = F.col("place")
    bitmap = keys.select(place.alias("place")).groupBy(F.floor(at / 32768).alias("bucket")).agg(F.bitmap_construct_agg(at % 32768).alias("bits"))
    marked = rows.withColumn("place", place).withColumn("bucket", F.floor(at / 32768)).join(F.broadcast(bitmap.limit(1 << (bits - 15))), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), at % 8).cast("int")) != 0, F.lit(False))
    return marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns)


def drop_rows(df: DataFrame, key: dict[str, Column], gone: DataFrame) -> DataFrame:
    """df without the rows whose key is in gone (columns named as in key; nulls equal nulls).

    Rows without their bit in the bitmap of gone stay where they are; only the others, mostly rows to drop, are
    shuffled for the exact join.
    """
    sure, unsure = by_bitmap(wrapped(df, **key), list(key), gone)
    theirs = gone.select(*[F.col(k).alias(f"gone_{k}") for k in key])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in key])
    return unwrapped(sure.unionByName(unsure.join(theirs, same, "left_anti")))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with rank long, their place from 0 in this order (unique), written as a table. A range sort: no task sees
    all rows, and one row per partition is broadcast."""
    mark, low = F.col("mark"), (1 << 33) - 1
    s = cut(rows.orderBy(*order).withColumn("mark", F.monotonically_increasing_id()), name)
    parts = s.groupBy(F.shiftright(mark, 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.broadcast(parts.select("part", before.alias("before")))
    return s.join(ahead, F.shiftright(mark, 33) == F.col("part")).withColumn("rank", F.col("before") + mark.bitwiseAND(F.lit(low))).drop("mark", "part", "before")


def join_shared(rows: DataFrame, groups: DataFrame, key: str, count: str, most: int = 1024) -> DataFrame:
    """Inner join of rows (a written table) with groups, unique by key. The most groups of the greatest counts are
    broadcast, so that rows of frequent keys stay where they are."""
    top = cut(groups.orderBy(F.desc(count), key).limit(most), "most-shared")
    named = F.broadcast(top.select(key))
    rest = rows.join(named, key, "left_anti").join(groups.join(named, key, "left_anti"), key)
    return rows.join(F.broadcast(top), key).select(*rest.columns).unionByName(rest)
