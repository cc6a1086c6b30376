"""URL filters by a temporal list join.

Dated list entries (host pattern, action, day) become validity intervals: an entry holds from its day until the next
entry of its pattern, or until it is removed. Captures ask for each of their hosts' parent domains that the list names, and an as-of
join finds the interval that each of these had at fetch time; the most specific entry in force decides.

The as-of join sorts entries and captures together by pattern and time, by range partitions, so that a pattern which
covers a third of all captures spreads over as many tasks as it needs. Within a partition the last entry is carried
along; the last entry of the partitions before is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, wrapped

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Characters of a host name at most (a fixed value of the domain name system): longer ones match no entry.
MOST_HOST = 253


def host_of(url: Column) -> Column:
    """The host in lower case, without a closing dot; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: pattern, action, added (a time) and, if it has that column, removed. Gives pattern, action, added, until (null:
    still in force): the next entry's time or the removal, whichever is first.

    Of entries of one pattern at one time the greatest action holds. Entries without pattern or time are ignored.
    """
    removed = F.col("removed") if "removed" in entries.columns else F.lit(None).cast(entries.schema["added"].dataType)
    one = entries.filter("pattern is not null and added is not null").groupBy(F.lower("pattern").alias("pattern"), "added").agg(F.max(F.struct("action", removed.alias("removed"))).alias("e"))
    following = F.lead("added").over(Window.partitionBy("pattern").orderBy("added"))
    return one.select("pattern", "e.action", "added", F.least(following, F.col("e.removed")).alias("until"))


def as_of(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points: pattern, at, host (distinct). spans as from intervals(). Gives those points at which an entry of the pattern is in
    force, with it as entry (action, added, until)."""
    kind = points.schema["at"].dataType
    entry = F.struct("action", "added", "until")
    listed = spans.select("pattern", F.col("added").cast(kind).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), entry.alias("entry"))
    asked = points.select("pattern", "at", F.lit(1).alias("kind"), "host", F.lit(None).cast(listed.schema["entry"].dataType).alias("entry"))
    ordered = listed.unionByName(asked).repartitionByRange("pattern", "at", "kind", "host").withColumn("part", F.spark_partition_id())
    ordered = cut(ordered, "url-ordered")
    last = F.last("entry", ignorenulls=True).over(Window.partitionBy("part", "pattern").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    # of each partition's pattern the last entry, carried to the partitions after it
    ends = ordered.groupBy("part", "pattern").agg(F.max_by("entry", F.when(F.col("kind") == 0, F.col("at"))).alias("end"))
    carry = F.last("end", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = ends.withColumn("before", carry).filter("before is not null").select("part", "pattern", "before")
    held = ordered.withColumn("inside", last).filter("kind = 1").join(before, ["part", "pattern"], "left").withColumn("entry", F.coalesce("inside", "before"))
    in_force = F.col("entry").isNotNull() & (F.col("entry.until").isNull() | (F.col("at") < F.col("entry.until")))
    return held.filter(in_force).select("pattern", "at", "host", "entry")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with host, pattern, action and entry_added of the entry in force at fetch time; nulls where none is.

    An entry matches its host and all hosts below it; of those in force the longest pattern decides. A capture without
    host or time, or with a host of more than 253 characters, matches nothing. Every row of captures is kept once, rows
    that repeat included. Columns of captures with the names of the four added ones are replaced, others may have any name.
    An empty list leaves all captures without an entry.
    """
    keep = [c for c in captures.columns if c not in ("host", "pattern", "action", "entry_added")]
    rows = wrapped(captures.select(*[col(c) for c in keep]), host=host_of(col(url_col)), at=col(time_col))
    spans = cut(intervals(entries), "url-spans")
    points = rows.filter("host is not null and at is not null").select("host", "at").distinct()
    hosts = rows.select("host").filter(F.length("host") <= MOST_HOST).distinct().withColumn("labels", F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    found = hosts.select("host", F.explode(suffix).alias("pattern")).join(spans.select("pattern").distinct(), "pattern")
    held = as_of(points.join(found, "host").select("pattern", "at", "host"), spans)
    best = held.groupBy("host", "at").agg(F.max(F.struct(F.length("pattern").alias("depth"), "pattern", "entry")).alias("held"))
    out = rows.join(best, ["host", "at"], "left")
    return out.select("row.*", "host", "held.pattern", "held.entry.action", F.col("held.entry.added").alias("entry_added"))


#: Minutes of a year, the span of the fetch times and list entries given to the synthetic pages.
YEAR = 527_040


def dated_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time in 2024 that follows from page_id (null where that is null)."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR)) * 60).cast("timestamp_ntz").alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list that grows with the pages: entries for a registered domain in three and a host in five, lifted again after
    days that follow from their hash, and three entries on whole name spaces. Urls without a host give none."""
    host = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    domain = host.select(F.regexp_extract("host", r"[^.]+\.[^.]+\.[^.]+$", 0).alias("pattern")).filter("pattern <> ''").distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    when = lambda day: F.timestamp_seconds(F.lit(1704067200) + day * 86400).cast("timestamp_ntz")

    def listed(df: DataFrame, every: int, first: str, then: str) -> DataFrame:
        x = df.withColumn("h", h).filter(F.col("h") % every == 0)
        start = F.col("h") % 200
        return x.select("pattern", F.explode(F.array(F.struct(F.lit(first).alias("action"), when(start).alias("added")), F.struct(F.lit(then).alias("action"), when(start + 1 + F.col("h") % 90).alias("added")))).alias("e")).select("pattern", "e.action", "e.added")

    fixed = domain.sparkSession.createDataFrame([("example.net", "block", 60), ("example.net", "allow", 180), ("com", "review", 250)], "pattern string, action string, day long").select("pattern", "action", when(F.col("day")).alias("added"))
    return listed(domain, 3, "block", "allow").unionByName(listed(host.select(F.col("host").alias("pattern")), 5, "allow", "block")).unionByName(fixed)


ORACLE = r"""
WITH caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 7919) % 527040 AS BIGINT)) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM caps WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) AS pattern FROM hosts),
hashed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS h, 3 AS every, 'block' AS one, 'allow' AS two FROM domains WHERE pattern <> ''
  UNION ALL SELECT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT), 5, 'allow', 'block' FROM hosts),
raw AS (
  SELECT pattern, one AS action, TIMESTAMP '2024-01-01' + to_days(CAST(h % 200 AS INT)) AS added FROM hashed WHERE h % every = 0
  UNION ALL SELECT pattern, two, TIMESTAMP '2024-01-01' + to_days(CAST(h % 200 + 1 + h % 90 AS INT)) FROM hashed WHERE h % every = 0
  UNION ALL SELECT * FROM (VALUES ('example.net', 'block', TIMESTAMP '2024-03-01'), ('example.net', 'allow', TIMESTAMP '2024-06-29'), ('com', 'review', TIMESTAMP '2024-09-07')) v(pattern, action, added)),
one AS (SELECT pattern, added, MAX(action) AS action FROM raw GROUP BY 1, 2),
spans AS (SELECT *, lead(added) OVER (PARTITION BY pattern ORDER BY added) AS until FROM one),
hit AS (
  SELECT c.page_id, c.fetched_at, arg_max(s.pattern, length(s.pattern)) AS pattern, arg_max(s.action, length(s.pattern)) AS action, arg_max(s.added, length(s.pattern)) AS entry_added
  FROM caps c JOIN spans s ON (c.host = s.pattern OR suffix(c.host, '.' || s.pattern)) AND s.added <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until)
  GROUP BY 1, 2)
SELECT c.page_id, c.host, c.fetched_at, h.pattern, h.action, h.entry_added FROM caps c LEFT JOIN hit h ON h.page_id = c.page_id AND h.fetched_at = c.fetched_at
"""
