"""Operators that SQL can't express, against plain Python: k-d trees, mixing, toxicity scores, neighbours, exact modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalstudy.llm import exact, hnsw, minhash, mixing, quotes, sharding, spm, toxicity, urlfilter, warc
from signalstudy.llm.common import col
from signalstudy.llm.queries import QUERIES, held_out, op2_toxicity, piece_model

SF = "/root/testdata/sf0.001"


def tree_by_force(x, tie, size, leaves=None, target=None):
    """Shard of every row: each node is sorted, its weighted quantile taken as it is."""
    span = np.maximum(x.max(0) - x.min(0), 1).astype(float)
    out = []

    def part(rows, leaves):
        weight = size[rows].sum()
        if target:
            leaves = -(-int(weight) // target)
        if leaves < 2 or len(rows) < 2:
            out.append(rows)
            return
        widest = max(range(x.shape[1]), key=lambda d: ((int(x[rows, d].max()) - int(x[rows, d].min())) / span[d], -d))
        rows = rows[np.lexsort((tie[rows], x[rows, widest]))]
        upto, goal = np.cumsum(size[rows]), leaves // 2 / leaves * weight
        k = min(int(np.searchsorted(upto, goal)), len(rows) - 1)
        cut = min((abs(w - goal), at) for at, w in ((k, upto[k] - size[rows[k]]), (k + 1, upto[k])) if 0 < w < weight)[1]
        part(rows[:cut], leaves // 2)
        part(rows[cut:], leaves - leaves // 2)

    part(np.arange(len(x)), leaves or 1)
    shard = np.empty(len(x), int)
    for k, rows in enumerate(out):
        shard[rows] = k
    return shard


@pytest.mark.parametrize("how", [{"leaves": 7}, {"target": 400}])
def test_tree(spark, how):
    rng = np.random.default_rng(2)
    n = 300
    x = np.c_[np.where(rng.random(n) < 0.5, 0, rng.integers(-5, 5, n)), rng.integers(0, 2**60, n) * np.where(rng.random(n) < 0.3, -4, 1), np.full(n, 3)].astype(np.int64)
    tie, size = rng.permutation(n).astype(np.int64) * 1_000_003, rng.integers(1, 40, n)
    meta = spark.createDataFrame([(int(s), int(t), *map(int, r)) for s, t, r in zip(size, tie, x)], "size long, tie long, x0 long, x1 long, x2 long")
    tree = sharding.grow(meta, 3, how.get("leaves"), how.get("target"), 0.0).arrays()
    got = tree["shard"][sharding.descend(tree, x, tie.astype(np.uint64))]
    assert (got == tree_by_force(x, tie, size, **how)).all()
    if "target" in how:
        assert np.bincount(got, size).max() <= 400


def test_tree_coordinates(spark):
    """Long common prefixes, extreme exponents, nulls, equal rows: every shard reaches its bytes."""
    rows = [(k, "t" * 12, f"https://example.org/a/long/common/prefix/{k % 50:03d}", v) for k, v in enumerate([1e308, -1e308, 5e-324, -5e-324, 0.0, float("inf"), -float("inf"), float("nan"), None, 1.0] * 30)]
    rows += [(7, "same", "same", 1.0)] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, v double")
    for dims in (("url",), ("v",), ("url", "v", "doc_id")):
        got = sharding.kd_tree_shards(df, dims=dims, target_bytes=200).toPandas()
        assert len(got) == len(rows) and got.groupby("shard")["size"].sum().max() <= 200
        assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
        even = sharding.kd_tree_shards(df, dims=dims, n_shards=8).toPandas().groupby("shard")["size"].sum()
        assert len(even) == 8 and even.max() - even.min() <= 60
    urls = sharding.kd_tree_shards(df.filter("text <> 'same'"), dims=("url",), n_shards=2).toPandas().merge(df.filter("text <> 'same'").toPandas(), on="doc_id")
    assert urls[urls["shard"] == 0].url.max() <= urls[urls["shard"] == 1].url.min()


def test_mixing_by_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(rows[0][0], "another text of the first id", rows[0][2]), (None, "a b c", None), (None, "d e", None), (90001, None, "zz"), (90002, "", "zz")] + [(90003, "w " * 5, "zz")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("text").alias("tie"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)).alias("h")).collect()
    size = lambda t: len([w for w in t.encode().split()])
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size(t or "") for _, t, q in rows if q == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        rest, free = sum(total.values()) - sum(3 * total[s] for s in full), [s for s in sources if s not in full]
        target = {s: 3 * total[s] if s in full else rest * weight[s] / sum(weight[q] for q in free) for s in sources}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        full |= over

    def passed(schedule, t):  # integral of the schedule up to t
        out = 0.0
        for (a, x), (b, y) in zip(schedule, schedule[1:]):
            d = min(max(t - a, 0), b - a)
            out += x * d + (y - x) / (b - a) * d * d / 2
        return out

    want = []
    for k, s in enumerate(sources):
        at = 0
        mine = sorted((r for r in hashed if r.source == s), key=lambda r: (r.h % 2**64, (r.doc_id is not None, r.doc_id or 0), r.tie or 0))
        for r in mine:
            n, schedule = size(r.t), mixing.CURRICULUM[k % 3]
            copies = sum(at + j * total[s] + n / 2 < target[s] for j in range(3))
            times = []
            for j in range(copies):
                goal, lo, hi = min(1, (at + j * total[s]) / target[s]) * mixing.integral(schedule), 0.0, 1.0
                for _ in range(60):
                    lo, hi = ((lo + hi) / 2, hi) if passed(schedule, (lo + hi) / 2) < goal else (lo, (lo + hi) / 2)
                times.append(hi)
            want.append((r.doc_id, s, n, total[s], copies, n * copies, times, target[s]))
            at += n
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[4], sum(r[6]))
    got = sorted(((r.doc_id, r.source, r["size"], r.source_size, r.copies, r.taken, r.positions, r.target) for r in mixing.curriculum(df).collect()), key=key)
    want.sort(key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6] and np.allclose(g[6], w[6], atol=1e-7) and abs(g[7] - w[7]) < 1e-6
    flat = sorted(((t, i) for i, *_, times, _ in want for t in times), key=lambda x: x[0])
    mixed = [r.doc_id for r in mixing.mix(df).collect()]
    assert sorted(map(str, mixed)) == sorted(str(i) for _, i in flat)
    place = {}
    for t, i in flat:
        place.setdefault(i, []).append(t)
    once = [place[i][0] for i in mixed if len(place[i]) == 1]
    assert np.all(np.diff(once) >= -1e-7)


def test_toxicity_scores_by_force():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), 0.25)
    separates = lambda c: not c.isalnum() if ord(c) < 128 else bool(toxicity._SEPARATOR[min(ord(c), len(toxicity._SEPARATOR) - 1)])

    def score(text):
        marked = "".join(" " if separates(c) else c for c in "\n" + " ".join(dict.fromkeys(text.lower().split())) + "\n")
        words, total, n = marked.split(), 0.0, 0
        for w in words:
            w = [0, *map(ord, w), 0]
            for size in toxicity.NGRAMS:
                for k in range(len(w) - size + 1):
                    if not w[k] and not w[k + size - 1]:
                        continue  # a whole word with both its ends
                    h = 0
                    for c in w[k : k + size]:
                        h = (h * 0x9E3779B97F4A7C15 + c) % 2**64 if h or c else 0
                    h = (h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * size) % 2**64
                    total, n = total + model.effect[h >> 64 - toxicity.BUCKET_BITS], n + 1
        return total / (n + toxicity.PRIOR) + model.bias

    texts = ["", "a", "Some words, some WORDS again; it's odd", "日本語 texts é", "x" * 40] + [" ".join("".join(rng.choice(list("abcdeé,."), rng.integers(1, 9))) for _ in range(80)) for _ in range(5)]
    assert np.allclose(model.logits(texts), [score(t) for t in texts])
    whole = model.logits(texts)
    was, toxicity.CHUNK_CHARS = toxicity.CHUNK_CHARS, 64
    try:  # windows over a text change nothing
        assert np.allclose(model.logits(texts), whole) and all((a == b).all() for t in texts for a, b in zip(toxicity.bag(t), np.unique(toxicity.ngram_buckets([t])[0], return_counts=True)))
    finally:
        toxicity.CHUNK_CHARS = was


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = op2_toxicity(spark, sf).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert got.held_out.all() and (got.score >= 0.7).eq(got.predicted == 1).all()
    assert got[got.toxic == 1].predicted.mean() >= 0.6 and got[got.toxic == 0].predicted.mean() <= 0.02


def test_neighbours_of_several_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.asarray(r.embedding, float) for r in df.collect()}
    ids = np.asarray(sorted(rows))
    v = np.stack([rows[i] for i in ids])
    for how, least in (({"shard_rows": max(50, len(ids) // 5)}, 0.9), ({"shard_rows": max(50, len(ids) // 3), "exact": True}, 1.0)):
        got = hnsw.nearest(df, **how).toPandas()
        hit = total = 0
        for q in ids[ids % 20 == 0]:
            s = v @ rows[q]
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
            mine = got[got.query_id == q].sort_values("rank")
            hit, total = hit + len(set(ids[order]) & set(mine.vec_id)), total + len(order)
            assert np.allclose(mine.score, [rows[i] @ rows[q] for i in mine.vec_id], rtol=1e-12)
        assert hit / total >= least


def near_texts(rng, n):
    base = [f"w{k}" for k in range(50)]
    out = []
    for k in range(n):
        w = list(base) if k % 3 else [f"v{j}" for j in range(50)]
        for at in rng.choice(50, rng.integers(0, 4), replace=False):
            w[at] = f"new{rng.integers(4)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_groups_by_force(spark, monkeypatch, block):
    """Bands and prefix keys, small and large groups; a chain whose ends are linked by its middle alone."""
    from test_llm import near_by_force

    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    rows = near_texts(np.random.default_rng(8), 90)
    rows += [(200 + k, " ".join(f"c{j}" for j in range(k * 3, k * 3 + 60))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_force(rows, 80)
    for how in ({}, {"exact": True}):
        got = minhash.near_groups(df, percent=80, **how).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_shingles_of_long_texts(monkeypatch):
    """Pieces and digests of long words change no set but by the long word's own hash, which is the same everywhere."""
    rng = np.random.default_rng(6)
    text = b" ".join(b"%d" % n for n in rng.integers(0, 50, 400)) + b"\t\n" + b"z" * 90 + b" tail of it"
    whole = minhash.shingle_sets([text.replace(b"z" * 90, b"q")])[0]
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 64)
    cut = minhash.shingle_sets([text, b"", text.replace(b"z" * 90, b"q"), b"a " * 33 + text, text + b" " + b"z" * 90])
    assert (cut[2] == whole).all() and len(cut[1]) == 0
    assert set(cut[0]) <= set(cut[3]) and set(cut[0]) <= set(cut[4]) and len(set(cut[0]) - set(cut[2])) == 4
    assert max(map(len, minhash._pieces(b"y " * 5000))) <= 128


CLASH = ("_id", "_place", "_bucket", "_bits", "_position", "id", "row", "digest", "place", "bucket", "bits", "key", "keys", "h", "at", "tie", "size", "copies", "positions", "spans", "_host", "held", "hosts", "entry", "part", "kind", "turn_", "words", "node", "conv", "odd `name`", "a.b")


def test_clashing_names(spark):
    """Columns with the names that operators use inside come back as they were."""
    rows = [(1, "A a"), (5, "A a"), (5, "unique text B"), (7, "x  y"), (7, "x y"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang"), *[F.lit(f"kept {n}").alias(n) for n in CLASH])
    same = lambda got: all(r[n] == f"kept {n}" for r in got for n in CLASH)
    kept = exact.exact_dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "A a"), (5, "unique text B"), (7, "x  y")] and same(kept.collect())
    near = minhash.near_dedup(df)
    assert near.columns == df.columns and sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", "A a"), ("5", "unique text B"), ("7", "x  y"), ("7", "x y"), ("None", "x y")]) and same(near.collect())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and same(mixed.collect())
    assert exact.exact_groups(df).count() == minhash.near_groups(df).count() == mixing.curriculum(df).count() == sharding.kd_tree_shards(df, n_shards=2).count() == 6
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS), -3.0)
    assert same(toxicity.keep_clean(df, model).collect()) and toxicity.score(df, model).count() == 6
    ids = spm.decode(spm.encode(df, piece_model(), check_col="same"), piece_model())
    assert ids.columns == [*df.columns, "token_ids", "same", "decoded"] and same(ids.collect()) and all(r.decoded == r.text and r.same for r in ids.collect())
    pages = df.select(F.lit("http://b.com/").alias("url"), F.to_timestamp(F.lit("2024-01-01")).alias("fetched_at"), F.col("doc_id").alias("page_id"), F.col("text").alias("html"), *map(col, CLASH))
    entries = spark.createDataFrame([("b.com", "block", "2020-01-01")], "pattern string, action string, added string").withColumn("added", F.to_timestamp("added"))
    got = urlfilter.filter_captures(pages, entries).collect()
    assert len(got) == 6 and same(got) and {r.action for r in got} == {"block"}
    assert warc.read_archives(warc.write_archives(pages)).count() == 6
    talk = df.select(F.lit("c").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("u").alias("role"), "text", *map(col, CLASH))
    assert quotes.link_quotes(talk).count() == 6
    vectors = df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *map(col, CLASH))
    assert {r.query_id for r in hnsw.nearest(vectors, every=1).collect()} == {1, 5, 7}


def test_as_of_by_force(spark):
    """One pattern that all captures ask for, over many range partitions, removals and equal times."""
    rng = np.random.default_rng(9)
    entries = [("com", f"e{k}", int(t), int(t + r) if (r := rng.integers(1, 400)) < 200 else None) for k, t in enumerate(rng.integers(0, 2000, 60))]
    entries += [("h1.com", "deep", 500, 900), ("other.org", "no", 0, None)]
    caps = [(k, f"http://h{rng.integers(4)}.com/" if k % 9 else None, int(t) if k % 11 else None) for k, t in enumerate(rng.integers(0, 2200, 700))] + [(7, "http://" + "x." * 200 + "com/", 5)]
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    e = spark.createDataFrame(entries, "pattern string, action string, added long, removed long").select("pattern", "action", at("added"), at("removed"))
    c = spark.createDataFrame(caps, "page_id long, url string, fetched_at long").select("page_id", "url", at("fetched_at")).repartition(8)
    got = sorted(((r.page_id, r.url, r.action) for r in urlfilter.filter_captures(c, e).collect()), key=str)

    def force(url, t):
        host = url and url[7:].strip("/")
        found = []
        for p in {p for p, *_ in entries}:
            if host and len(host) <= 253 and t is not None and (host == p or host.endswith("." + p)):
                mine = [x for x in entries if x[0] == p and x[2] <= t]
                if mine:
                    last = max(mine, key=lambda x: (x[2], x[1]))
                    if last[3] is None or t < last[3]:
                        found.append((len(p), last[1]))
        return max(found)[1] if found else None

    assert got == sorted(((i, u, force(u, t)) for i, u, t in caps), key=str)


def test_queries_are_complete():
    assert len(QUERIES) == 10
