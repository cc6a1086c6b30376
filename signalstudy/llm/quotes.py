"""Quotation linking, in DataFrame functions only.

A message's lines carry a quote level (their leading '>' marks). Runs of non-blank lines of one level are passages.
Passages are normalised and hashed; quoted ones are joined to the messages that first said them, which gives every
message its parent and leaves conversations in reply order without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, col, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"^(?:[ \t]*>)+"
TURNS_A_BUCKET = 1024


def passage_hash(text: Column) -> Column:
    """MD5 of a passage with A-Z in lower case and white space in single spaces, none at the ends."""
    return F.md5(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), WS, " ")))


def parse_quotes(text: Column) -> tuple[Column, Column, Column]:
    """Expressions on a message text: lines, their levels, their contents without marks. Null is an empty text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    levels = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")))
    return lines, levels, F.transform(lines, lambda x: F.regexp_replace(x, MARKS + r"[ \t]?", ""))


def _passages(levels: Column, contents: Column, starts: Column) -> Column:
    def passage(s: Column, k: Column) -> Column:
        after = F.coalesce(F.get(starts, k + 1), F.size(levels))
        return F.struct(F.get(levels, s).alias("level"), passage_hash(F.array_join(F.slice(contents, s + 1, after - s), " ")).alias("h"), k.alias("at"), F.array_join(F.slice(contents, s + 1, after - s), "").rlike(r"[^\x20\x09-\x0D]").alias("said"))

    return F.filter(F.transform(starts, passage), lambda p: p.said)


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, for sorting by conversation and position: conv, turn, role, position long, text (without
    quotes), parent_turn, foreign_conv and foreign_turn, n_quotes, n_linked, n_foreign (linked to another conversation only)
    and max_level (ints).

    A quoted passage is linked to the latest earlier message of its conversation that says the passage itself
    (unquoted), else to the first message that does in the least other conversation (the greatest, where the least is
    its own): foreign_conv and foreign_turn are those of the first such passage. The parent is the message that the first linked passage
    of the least level leads to; messages without one are roots (null). A parent's turn is smaller, so positions by turn
    are a reply order. Passages are whole runs of lines: a quoted part of one links to nothing. Null conversations form one conversation; messages with a null turn come first and are never
    parents. Empty texts have no passages. Rows that repeat conversation and turn are each kept.
    """
    _, levels, contents = parse_quotes(F.col("body"))
    m = messages.select(col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), col(role_col).alias("role"), col(text_col).alias("body"))
    m = m.withColumn("levels", levels).withColumn("contents", contents)
    blank = F.transform("contents", lambda c: ~c.rlike(r"[^\x20\x09-\x0D]"))
    lv, bl = F.col("levels"), F.col("blank")
    m = m.withColumn("blank", blank).withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(lv) - 1), lambda i: (i == 0) | (F.get(lv, i) != F.get(lv, i - 1)) | (F.get(bl, i) != F.get(bl, i - 1))))
    own = F.array_join(F.transform(F.filter(F.arrays_zip("levels", "contents"), lambda z: z.levels == 0), lambda z: z.contents), "\n")
    m = m.select("conv", "turn", "role", F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("text"), _passages(lv, F.col("contents"), F.col("starts")).alias("passages"))
    # rows may repeat, so each gets a number of its own; it is stored with them
    m = cut(m.withColumn("row", F.monotonically_increasing_id()), "quotes-messages")
    said = m.select("conv", "turn", "row", F.explode("passages").alias("p")).select("conv", "turn", "row", "p.level", "p.h", "p.at")
    own, quoted = said.filter("level = 0"), said.filter("level > 0")
    # as-of in the conversation: the greatest turn below the quote's at which the passage is said. Turns meet within
    # buckets, then with the last such turn of the buckets before, so one passage all over a huge conversation is not one task
    points = said.filter("turn is not null").groupBy("conv", "h", "turn").agg(F.max(F.when(F.col("level") == 0, F.col("turn"))).alias("last"), F.max("level").alias("deepest")).withColumn("bucket", F.floor(F.col("turn") / TURNS_A_BUCKET))
    inside = F.max("last").over(Window.partitionBy("conv", "h", "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.max("last").over(Window.partitionBy("b_conv", "b_h").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = points.groupBy(F.col("conv").alias("b_conv"), F.col("h").alias("b_h"), F.col("bucket").alias("b_bucket")).agg(F.max("last").alias("last")).withColumn("earlier", earlier).filter("earlier is not null").drop("last")
    asof = points.withColumn("inside", inside).filter("deepest > 0").join(ends, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("h") == F.col("b_h")) & (F.col("bucket") == F.col("b_bucket")), "left")
    asof = asof.select(F.col("conv").alias("p_conv"), F.col("h").alias("p_h"), F.col("turn").alias("p_turn"), F.coalesce("inside", "earlier").alias("to")).filter("to is not null")
    linked = quoted.join(asof, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("h") == F.col("p_h")) & (F.col("turn") == F.col("p_turn")), "left").drop("p_conv", "p_h", "p_turn")
    # for those without a link, the first message of another conversation; each conversation asks once for a passage
    place = F.struct(F.col("conv"), F.col("turn"))
    firsts = own.groupBy("conv", "h").agg(F.min("turn").alias("turn")).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    asked = linked.filter("to is null").select("conv", "h").distinct().join(firsts, "h")
    outside = F.when(~F.col("first.conv").eqNullSafe(F.col("conv")), F.col("first")).when(~F.col("last.conv").eqNullSafe(F.col("conv")), F.col("last"))
    asked = asked.select(F.col("conv").alias("f_conv"), F.col("h").alias("f_h"), outside.alias("outside")).filter("outside is not null")
    links = linked.join(asked, F.col("to").isNull() & F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("h") == F.col("f_h")), "left")
    best = F.min(F.when(F.col("to").isNotNull(), F.struct("level", "at", "to")))
    abroad = F.min(F.when(F.col("outside").isNotNull(), F.struct("level", "at", "outside")))
    per = links.groupBy("row").agg(F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), F.count("outside").alias("n_foreign"), F.max("level").alias("max_level"), best.alias("best"), abroad.alias("abroad"))
    # positions: within buckets of turns, then shifted by the buckets before, so a huge conversation is not one task
    # messages without a turn come before all buckets of turns, in buckets of their row numbers
    untimed = F.lit(-(1 << 62)) + F.shiftright("row", 12)
    m = m.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURNS_A_BUCKET), untimed)).withColumn("within", F.row_number().over(Window.partitionBy("conv", "bucket").orderBy("turn", "row")))
    before = F.sum("n").over(Window.partitionBy("b_conv").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ahead = m.groupBy(F.col("conv").alias("b_conv"), F.col("bucket").alias("b_bucket")).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(before, F.lit(0))).filter("ahead > 0")
    m = m.join(ahead, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("bucket") == F.col("b_bucket")), "left").join(per, "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return m.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), (F.col("within") + F.coalesce("ahead", F.lit(0))).cast("long").alias("position"), F.col("text").alias(text_col), F.col("best.to").alias("parent_turn"), F.col("abroad.outside.conv").alias("foreign_conv"), F.col("abroad.outside.turn").alias("foreign_turn"), count("n_quotes"), count("n_linked"), count("n_foreign"), count("max_level"))


def as_replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a mail-like rendering: each message quotes the message before at level 1 and the
    one before that at level 2, then says its own text after an empty line. A turn that repeats quotes the least text
    of the turns before; messages without conversation, turn or predecessor quote nothing, and a null text is empty."""
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(k: int, marks: str) -> DataFrame:
        body = F.concat(F.lit(marks), F.regexp_replace("said", "\n", "\n" + marks), F.lit("\n"))
        return said.select("conv_id", (F.col("turn") + k).alias("turn"), body.alias(f"q{k}"))

    m = messages.join(back(1, "> "), ["conv_id", "turn"], "left").join(back(2, ">> "), ["conv_id", "turn"], "left")
    return m.select("conv_id", "turn", "role", F.concat(F.coalesce("q2", F.lit("")), F.coalesce("q1", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


ORACLE = r"""
WITH said AS (SELECT conv_id, turn, MIN(text) AS said FROM conversations GROUP BY 1, 2),
body AS (
  SELECT m.conv_id, m.turn, m.role, row_number() OVER () AS id,
    coalesce('>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10), '') || coalesce('> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10), '') || chr(10) || coalesce(m.text, '') AS text
  FROM conversations m LEFT JOIN said a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN said b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
split AS (SELECT id, conv_id, turn, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM body),
lines AS (SELECT id, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM split),
parsed AS (
  SELECT id, conv_id, turn, n, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+', 0), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS content FROM lines),
flag AS (SELECT *, NOT regexp_matches(content, '[^\x20\x09-\x0D]') AS blank FROM parsed),
runs AS (
  SELECT *, SUM(CASE WHEN prev IS NULL OR prev <> level OR was <> blank THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY n) AS prev, lag(blank) OVER (PARTITION BY id ORDER BY n) AS was FROM flag)),
passages AS (
  SELECT id, conv_id, turn, run, any_value(level) AS level,
    md5(trim(regexp_replace(translate(string_agg(content, ' ' ORDER BY n), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS h
  FROM runs WHERE NOT blank GROUP BY id, conv_id, turn, run),
linked AS (
  SELECT q.id, q.run, q.level, (SELECT MAX(o.turn) FROM passages o WHERE o.level = 0 AND o.h = q.h AND o.conv_id = q.conv_id AND o.turn < q.turn) AS target,
    CASE WHEN f.least <> q.conv_id THEN f.least WHEN f.most <> q.conv_id THEN f.most END AS elsewhere,
    CASE WHEN f.least <> q.conv_id THEN f.least_turn WHEN f.most <> q.conv_id THEN f.most_turn END AS elsewhere_turn
  FROM passages q LEFT JOIN (
    SELECT h, MIN(conv_id) AS least, MAX(conv_id) AS most, arg_min(turn, conv_id) AS least_turn, arg_max(turn, conv_id) AS most_turn
    FROM (SELECT conv_id, h, MIN(turn) AS turn FROM passages WHERE level = 0 GROUP BY 1, 2) GROUP BY h) f ON f.h = q.h
  WHERE q.level > 0),
per AS (
  SELECT id, COUNT(*) AS n_quotes, COUNT(target) AS n_linked, COUNT(*) FILTER (WHERE target IS NULL AND elsewhere IS NOT NULL) AS n_foreign,
    arg_min(elsewhere, level * 1000000 + run) FILTER (WHERE target IS NULL AND elsewhere IS NOT NULL) AS foreign_conv,
    arg_min(elsewhere_turn, level * 1000000 + run) FILTER (WHERE target IS NULL AND elsewhere IS NOT NULL) AS foreign_turn, MAX(level) AS max_level,
    arg_min(target, level * 1000000 + run) FILTER (WHERE target IS NOT NULL) AS parent_turn
  FROM linked GROUP BY id),
own AS (SELECT id, regexp_replace(string_agg(content, chr(10) ORDER BY n) FILTER (WHERE level = 0), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text FROM flag GROUP BY id)
SELECT b.conv_id, b.turn, b.role, CAST(row_number() OVER (PARTITION BY b.conv_id ORDER BY b.turn) AS BIGINT) AS position, md5(coalesce(own.text, '')) AS text_md5, per.parent_turn, per.foreign_conv, per.foreign_turn,
  CAST(coalesce(n_quotes, 0) AS INT) AS n_quotes, CAST(coalesce(n_linked, 0) AS INT) AS n_linked, CAST(coalesce(n_foreign, 0) AS INT) AS n_foreign, CAST(coalesce(max_level, 0) AS INT) AS max_level
FROM body b LEFT JOIN per USING (id) LEFT JOIN own USING (id)
"""
