"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary finds the digests that many rows share. Their counts and winners are then verified by a
map-side aggregate and broadcast (at most k rows), so their rows never shuffle; all other digests, none of
which is frequent, are aggregated and joined back by ordinary shuffles.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bitmap, col, cut, drop_rows, norm_ws, unwrapped, wrapped

#: Counters of a summary: bounds the broadcast, and digests of over 2/k of all rows are sure to be found.
COUNTERS = 1024


def _prune(counts: dict, k: int) -> dict:
    """Merge-and-prune step of Misra-Gries: subtract the (k+1)-th largest count, keep what stays positive."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return {v: c - off for v, c in counts.items() if c > off}


def misra_gries(df: DataFrame, name: str, k: int = COUNTERS) -> list:
    """At most k values of the column name, with every value that more than 2/k of the rows hold among them. Nulls do not count."""

    def part(batches):
        counts: dict = {}
        for b in batches:
            seen = pc.value_counts(b.column(0))
            for v, c in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                counts[v] = counts.get(v, 0) + c
            if len(counts) > 8 * k:
                counts = _prune(counts, k)
        counts = _prune(counts, k)
        counts.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), kind), pa.array(list(counts.values()), pa.int64())], names=["value", "n"])

    kind = pa.binary() if df.schema[name].dataType.simpleString() == "binary" else pa.string()
    merged = df.select(col(name)).mapInArrow(part, f"value {df.schema[name].dataType.simpleString()}, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return [r.value for r in merged.orderBy(F.desc("n"), "value").limit(k).collect() if r.n > 1]


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(norm_ws(col(text_col)).cast("binary"), 256))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per row of df: id, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when equal after each run of white space becomes one space (null counts as empty, and empty
    texts are equal to one another). The smallest id of a group stays; null ids lose against any other id, and a
    group of null ids keeps them all. Each row is decided by its own id and text; rows equal in both stay or go
    together. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = cut(df.select(col(id_col).alias("id"), text_digest(text_col).alias("digest")), "exact-digests")
    spark = df.sparkSession
    heavy = spark.createDataFrame([(bytearray(v),) for v in misra_gries(rows, "digest", k)], "digest binary")
    verified = [F.min("id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = F.broadcast(cut(rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*verified).limit(k), "exact-winners"))
    many = rows.join(winners, "digest")
    # the rest by an aggregate combined on the map side and a join back, whose left side may be split where it is skewed
    rare = rows.join(F.broadcast(heavy), "digest", "left_anti")
    shared = cut(rare.groupBy("digest").agg(*verified).filter("group_size > 1"), "exact-shared")
    few = rare.join(shared, "digest", "left")
    few = few.select("digest", "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    out = many.select(*few.columns).unionByName(few)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """df without the rows whose text another row with a smaller id has, decided row by row: an id's other texts stay.

    Rows with a null id go where any id has their text and else stay, all of them. Of rows equal in id and text (white
    space aside) one stays, that of the least raw text. Null texts are empty ones. df may have columns of any name.
    """
    groups = exact_groups(df.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text", k)
    groups = cut(groups.select("id", F.unhex("text_sha256").alias("digest"), "kept"), "exact-kept")
    key = {"id": col(id_col), "digest": text_digest(text_col)}
    # an id goes as a whole unless another of its rows stays or it is null: only then are rows told apart by their text
    apart = F.bool_or(~F.col("kept")) & (F.bool_or("kept") | F.col("id").isNull())
    if not groups.groupBy("id").agg(apart.alias("apart")).filter("apart").take(1):
        key.pop("digest")
    left = drop_rows(df, key, cut(groups.filter("not kept").select(*key).distinct(), "exact-dropped"))
    again = groups.filter("kept and id is not null").groupBy("id", "digest").count().filter("count > 1").select("id", "digest")
    if not again.take(1):
        return left
    again = cut(again, "exact-repeated")
    key = {"id": col(id_col), "digest": text_digest(text_col)}
    plain = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    sure, unsure = by_bitmap(wrapped(left, **key, least=F.struct(col(text_col), F.xxhash64(*plain))), list(key), again)
    once = unsure.join(again, list(key), "left_semi").groupBy(*key).agg(F.min_by("row", "least").alias("row"))
    return unwrapped(sure.select("row").unionByName(unsure.join(again, list(key), "left_anti").select("row")).unionByName(once.select("row")))
