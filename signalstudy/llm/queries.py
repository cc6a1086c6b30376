"""One query per operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hnsw, minhash, mixing, quotes, sharding, spm, toxicity, urlfilter, warc
from .common import table

#: Name of the installed public tokenizer file; another model's path may be given to op9_sentencepiece.
PIECES = "piece_bpe_32k.model"


def piece_model(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    return spm.load_model(path)


def held_out(col):
    return F.crc32(col.cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_tree_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(quotes.as_replies(table(spark, sf_dir, "conversations")))
    return out.withColumn("text_md5", F.md5("text")).drop("text")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_captures(urlfilter.dated_pages(pages), urlfilter.dated_list(pages)).drop("url")


def op6_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.curriculum(table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0)))
    return out.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    model = piece_model(model_path)
    out = spm.decode(spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return out.select("doc_id", F.size("token_ids").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"), F.md5("decoded").alias("decoded_md5"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {f.__name__: f for f in (op1_kd_tree_sharding, op2_toxicity, op3_nearest_neighbours, op4_quotation_linking, op5_url_filter, op6_curriculum_mixing, op7_exact_dedup, op8_warc_bundles, op9_sentencepiece, op10_circulant_minhash)}

ORACLE: dict[str, str] = {
    "op4_quotation_linking": quotes.ORACLE,
    "op5_url_filter": urlfilter.ORACLE,
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, MIN(doc_id) OVER w AS keep_id, CAST(COUNT(*) OVER w AS BIGINT) AS group_size, doc_id = MIN(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
    "op8_warc_bundles": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
c AS (SELECT i, CAST('0x' || substr(hex, 1 + 10 * i, 10) AS BIGINT) AS n, page_id, hex FROM p, range(4) r(i)),
b AS (
  SELECT page_id, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((n >> (35 - 5 * k)) & 31) AS BIGINT), 1), '' ORDER BY i, k) AS payload_digest
  FROM c, range(8) s(k) GROUP BY page_id, hex),
m AS (SELECT hex, MAX(page_id) AS first_id FROM p GROUP BY hex)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, b.payload_digest, CASE WHEN p.page_id = m.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> m.first_id THEN m.first_id END AS refers_to
FROM p JOIN m USING (hex) JOIN b ON b.page_id = p.page_id AND b.hex = p.hex
""",
    "op10_circulant_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0) q),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS to_id FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.to_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, MIN(to_id) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
""",
}
