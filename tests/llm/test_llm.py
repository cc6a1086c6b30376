"""The corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalstudy.llm import exact, hnsw, minhash, mixing, quotes, sharding, spm, toxicity, urlfilter, warc
from signalstudy.llm.common import drop_rows
from signalstudy.llm.queries import ORACLE, QUERIES, piece_model, toxicity_model

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, value double"
BASE = " ".join(f"w{k}" for k in range(60))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, BASE, "en", "a", 1), (5, BASE + " x", "en", None, 1), (6, BASE.replace(" ", "\n", 3), "en", "a", 1),
    (7, "long " * 60000, "en", "a", 300000), (8, "few words", "de", "b", 9), (8, "few words", "de", "b", 9), (None, "few words", "de", "b", 9), (9, "FEW  WORDS", "de", "b", 9), (10, "é日本 😀 ▁ tab\there", "xx", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_shards(spark, odd, none):
    d = docs(spark)
    for frame, n in ((d, 5), (odd, 3)):
        got = sharding.kd_tree_shards(frame, n_shards=n).toPandas()
        assert len(got) == frame.count() and set(got["shard"]) <= set(range(n))
        assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    got = sharding.kd_tree_shards(d, target_bytes=150_000).toPandas()
    sizes, text = got.groupby("shard")["size"].sum(), d.toPandas().set_index("doc_id").text
    assert sizes.sum() / len(sizes) <= 150_000 and sizes.max() - sizes.min() <= 3 * got["size"].max()
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and len(text[r.doc_id].encode()) + 8 == r.size for r in got.itertuples())
    assert sharding.kd_tree_shards(none, n_shards=4).count() == 0


def test_exact(spark, odd, none):
    got = exact.exact_groups(odd).toPandas()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in ODD}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        same = [i for i, t, *_ in ODD if re.sub(r"[\x20\x09-\x0D]+", " ", t or "") == norm[r.doc_id]]
        assert r.group_size == len(same) and r.keep_id == min(i for i in same if i is not None) and r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    left = sorted(r.doc_id for r in exact.exact_dedup(odd).collect() if r.doc_id is not None)
    assert left == [1, 3, 4, 5, 7, 8, 9, 10]
    assert exact.exact_groups(none).count() == 0 and exact.exact_dedup(none).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert exact.misra_gries(many, "text", 8)[:1] == ["hot"]
    assert exact.exact_groups(many, k=8).filter("group_size = 1667 and keep_id = 0").count() == 1667


def test_exact_null_ids(spark):
    rows = [(None, "a  b"), (4, "a b"), (None, "a b"), (2, "a b"), (None, "alone"), (None, "alone"), (None, None), (None, "x"), (6, "x"), (0, "y")]
    left = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(2, "a b"), (None, "alone"), (None, "alone"), (None, None), (6, "x"), (0, "y")], key=str)


def test_drop_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 10 = 9, null, id) as k", "'x' as place", "'y' as bucket", "'z' as row")
    left = drop_rows(rows, {"id": F.col("k")}, spark.range(0, 3000, 7))
    got = left.collect()
    assert sorted(r.k for r in got if r.k is not None) == [k for k in range(3000) if k % 10 != 9 and k % 7]
    assert sum(r.k is None for r in got) == 300 and left.columns == rows.columns and {(r.place, r.bucket, r.row) for r in got} == {("x", "y", "z")}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def near_by_force(rows, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        old = dict(comp)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if old == comp:
            break
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t, *_ in ODD if i is not None and i != 7]
    for k in range(60):
        w = BASE.split()
        for at in rng.choice(60, rng.integers(1, 6), replace=False):
            w[at] = f"new{rng.integers(3)}"
        rows.append((100 + k, " ".join(w)))
    rows = list(dict(rows).items())
    for percent in (80, 85):
        got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_by_force(rows, percent)
    got = minhash.near_groups(odd).collect()
    assert len(got) == len(ODD) and all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_groups(none).count() == 0 and minhash.near_dedup(none).count() == 0
    assert {4, 5, 6} & {r.doc_id for r in minhash.near_dedup(odd).collect()} == {4}


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, ""), (7, b + " x"), (8, "A0 " + a[3:].replace(" ", "\n")), (9, c), (9, c + " x"), (10, c + " y"), (11, None), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert plain(exact.exact_dedup(df)) == sorted([(1, a), (5, b), (5, ""), (7, b + " x"), rows[5], (9, c), (9, c + " x"), (10, c + " y")], key=str)
    got = minhash.near_groups(df).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.component_id, r.kept) for r in got} == {1: (1, True), 5: (1, False), 7: (1, False), 8: (1, False), 9: (9, True), 10: (9, False), 11: (11, True)}
    assert all(len({r.component_id for r in got if r.doc_id == i}) == 1 for i in (5, 9))
    kept = plain(minhash.near_dedup(df))
    first = [r for r in kept if r[0] == 9]
    assert len(first) == 1 and first[0][1] in (c, c + " x") and [r for r in kept if r[0] != 9] == sorted([(1, a), (5, ""), (5, b), (5, b), (11, None)], key=str)


def test_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    rows = [(k, f"{BASE} v{k}") for k in range(50)]
    assert {r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_mixing(spark, odd, none):
    got = mixing.curriculum(docs(spark)).toPandas()
    per = got.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), big=("size", "max"))
    assert (per.target <= 3 * per["size"] + 1e-6).all() and abs(per.target.sum() - got["size"].sum()) < 1e-3
    assert ((per.taken - per.target).abs() <= per.big).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.curriculum(docs(spark).repartition(7)).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    assert mixing.curriculum(odd).count() == len(ODD) and mixing.curriculum(none).count() == 0 and mixing.mix(none).count() == 0
    times = spark.createDataFrame([(0.0,), (0.75,), (1.0,)], "s double").select(mixing.invert(((0.0, 2.0), (1.0, 0.0)), F.col("s")).alias("t")).collect()
    assert np.allclose([r.t for r in times], [0, 0.5, 1])


def test_toxicity(spark, odd, none):
    model = toxicity_model(spark, SF)
    toxic = [(k, ("you are a stupid idiot " if k % 2 else "a kind and patient friend ") + f"number{k}", k % 2) for k in range(400)]
    d = spark.createDataFrame([(k, t) for k, t, _ in toxic], "doc_id long, text string")
    fitted = toxicity.fit(d, spark.createDataFrame([(k, y) for k, _, y in toxic], "doc_id long, toxic int"))
    assert fitted.scores(["such a stupidd idiott"])[0] > fitted.scores(["a patientt frend"])[0]
    got = {r.doc_id: r.score for r in toxicity.score(d, fitted).collect()}
    assert np.mean([got[k] >= 0.5 for k, _, y in toxic if y]) > 0.95 > 0.05 > np.mean([got[k] >= 0.5 for k, _, y in toxic if not y])
    for frame in (odd, none):
        assert toxicity.score(frame, model).count() == frame.count() and toxicity.keep_clean(frame, fitted).columns == frame.columns
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    one = toxicity.fit(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert one.scores(["x"])[0] < 0.7


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    v[100:160] = v[100]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, shard_rows=400).toPandas()
    hit = total = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        want = [i for i in sorted(range(1500), key=lambda i: (-s[i], i)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[mine.vec_id], rtol=1e-12) and mine.score.is_monotonic_decreasing
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9 and set(got.query_id) == set(range(0, 1500, 20))
    few = hnsw.nearest(df.filter("vec_id < 3")).collect()
    assert [r.query_id for r in few] == [0, 0]
    assert hnsw.nearest(df.filter("vec_id < 0")).count() == 0


def test_nearest_repeats(spark, monkeypatch):
    """Rows that repeat, ids with several vectors, and more dimensions than are broadcast."""
    monkeypatch.setattr(hnsw, "MOST_DIMENSIONS", 1)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [3.0, 1.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5]), (40, [1.0, 2.0, 3.0]), (5, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 3.0), (0, 2, 20, 2.0), (0, 3, 1, 1.0), (0, 4, 3, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 3, 1.5), (40, 1, 5, 6.0)]


def test_warc(spark):
    rows = [(1, "http://a b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000), (None, "u", "x"), (2, None, "x")]
    bundles = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), frame_bytes=1000)
    got = {(r.record_id.rpartition(":")[2], r.payload_bytes): r for r in warc.read_archives(bundles, with_payload=True).collect()}
    assert got["1", 1].refers_to.endswith(":2") and got["2", 1].record_type == "response" and got["4", 0].record_type == "response" and got["3", 0].refers_to.endswith(":4") and got["", 1].record_type == "revisit"
    assert bytes(got["5", 800_000].payload).decode() == "é" * 400_000 and got["1", 1].uri == "http://a%20b%0A"
    for r in warc.record_index(bundles).collect():
        assert warc.read_record(r.path, r.frame, r.offset, r.length)["warc-record-id"] == f"<{r.record_id}>"
    import zstandard

    path = bundles.first().path
    with open(path.removeprefix("file://"), "rb") as f:  # any reader of Zstandard files can open it
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 7
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_sentencepiece(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    model = piece_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = spm.Transducer(model)
    rng = np.random.default_rng(2)
    texts = ["", "  ", "   a  b ", "x\n\n\ty", "😀 日本語 ▁▁y", "it's (ok), no. 'q' — 1.5%"] + ["".join(rng.choice(list(" aeinrst.,'ab\n▁é日1"), rng.integers(1, 40))) for _ in range(400)] + [r.text for r in docs(spark).limit(40).collect()]
    for x in texts:
        assert t.encode(x).tolist() == lib.encode(x) and t.decode(t.encode(x)) == lib.decode(lib.encode(x))
    got = spm.decode(spm.encode(odd, model), model).select("doc_id", "text", "token_ids", "decoded").collect()
    assert all(r.decoded == (r.text and r.text.replace("▁", " ")) for r in got) and len(got) == len(ODD)
    assert spm.encode(none, model).count() == 0


def test_quotes(spark):
    rows = [("c", 0, "u", "Hello there\nfriend"), ("c", 1, "a", "> hello THERE\n> friend\n\nHi!"), ("c", 2, "u", ">> Hello there friend\n> Hi!\nOk"), ("d", 0, "u", "> Hi!\nwhat"), ("d", 1, "u", None), (None, None, None, ""), ("d", 1, "u", None)]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got["c", 1].parent_turn == 0 and got["c", 1].text == "Hi!" and got["c", 2].parent_turn == 1 and got["c", 2].n_linked == 2 and got["c", 2].max_level == 2
    assert got["d", 0].n_foreign == 1 and (got["d", 0].foreign_conv, got["d", 0].foreign_turn) == ("c", 1) and got["c", 1].foreign_conv is None and got["d", 0].parent_turn is None and got["d", 1].text == "" and got["c", 2].position == 3
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).count() == 0


def test_quotes_hot_passage(spark, monkeypatch):
    """One passage said and quoted all over one conversation, whose turns span many buckets, against a plain loop."""
    monkeypatch.setattr(quotes, "TURNS_A_BUCKET", 4)
    rng = np.random.default_rng(5)
    rows = [(None if k % 3 else "c", int(t), "u", ("> Thanks\n\nok" if rng.random() < 0.5 else "Thanks") + f"\n\nn{k}") for k, t in enumerate(rng.integers(-40, 40, 300))]
    rows += [("c", None, "u", f"> Thanks\n\nnone{k}") for k in range(5)]
    got = {r.text.split("\n")[-1]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    for conv, turn, _, text in rows:
        r = got[text.split("\n")[-1]]
        before = [t for c, t, _, x in rows if c == conv and x.startswith("Thanks") and turn is not None and t is not None and t < turn]
        assert r.parent_turn == (max(before, default=None) if text.startswith(">") else None)
    for conv in ("c", None):
        mine = sorted((r for r in got.values() if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        turns = [-1000 if r.turn is None else r.turn for r in mine]
        assert turns == sorted(turns)


def test_url_filter(spark):
    entries = spark.createDataFrame([("b.com", "block", "2024-01-10"), ("b.com", "allow", "2024-02-01"), ("x.b.com", "allow", "2024-01-15"), (None, "block", "2024-01-01")], "pattern string, action string, added string").withColumn("added", F.to_timestamp("added"))
    rows = [(1, "http://b.com/", "2024-01-09"), (2, "https://u@A.B.com.:80/p", "2024-01-10"), (3, "http://x.b.com", "2024-01-20"), (4, "http://b.com", "2024-02-01"), (5, None, "2024-01-20"), (6, "http://b.com", None), (7, "http://notb.com", "2024-01-20")]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("action", F.lit("old"))
    got = {r.page_id: r.action for r in urlfilter.filter_captures(caps, entries).collect()}
    assert got == {1: None, 2: "block", 3: "allow", 4: "allow", 5: None, 6: None, 7: None}
    assert urlfilter.filter_captures(caps.limit(0), entries).count() == 0 and urlfilter.filter_captures(caps, entries.limit(0)).count() == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    cols = sorted(got.columns)
    text = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: v if v is None else str(int(v)) if isinstance(v, (float, np.integer)) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)).values.tolist()), key=str)
    assert cols == sorted(want.columns) and text(got) == text(want)


def test_pipeline(spark):
    table = docs(spark)
    clean = corpus_pipeline.clean(spark, table, SF)
    rows = {r.doc_id: r.text for r in table.collect()}
    scores = toxicity_model(spark, SF).scores(list(rows.values()))
    assert clean.columns == table.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in zip(rows, scores) if p < 0.7)
    distinct = corpus_pipeline.distinct(spark, table, SF)
    firsts = {}
    for i in sorted(rows):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(firsts.values())
    # the whole run, stage by stage against plain Python
    kept = {i: t for i, t, p in zip(rows, rows.values(), scores) if p < 0.7}
    firsts = {}
    for i in sorted(kept):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    some = [(i, kept[i]) for i in sorted(firsts.values())]
    single = sorted(i for i, (_, c) in near_by_force(some, 80).items() if i == c)
    novel = table.filter(F.col("doc_id").isin(single))
    copies = {r.doc_id: r.copies for r in mixing.curriculum(novel).collect() if r.copies}
    out = corpus_pipeline.run(spark, SF).collect()
    assert pd.Series([r.doc_id for r in out]).value_counts().to_dict() == copies and all(r.round_trip for r in out)
    mixed = corpus_pipeline.mixed(spark, novel, SF)
    assert mixed.columns == table.columns and pd.Series([r.doc_id for r in mixed.collect()]).value_counts().to_dict() == copies
