"""Toxicity by a subword-bag linear softmax.

A text is the mean of the embeddings of its distinct words' character n-grams (word ends marked), drawn slightly
towards zero so that a few words alone prove little; a softmax on that mean gives the class. Embeddings and softmax are trained together, in numpy, by AdaGrad. A misspelt word shares most of its
n-grams with the word it was made of, so it needs no training row of its own. Since the model is linear in the
mean, an n-gram's whole effect is one number, and scoring sums numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, give_back, small_batches, unwrapped, wrapped

NGRAMS = (3, 4, 5)
BUCKET_BITS = 20
#: Bounds of the labelled rows of class 0 and 1 that a model is fitted on; beyond them, those of the smallest hashed ids.
MOST_ROWS = (4000, 2000)
#: N-grams of fewer training texts have no embedding.
LEAST_TEXTS = 3
#: N-grams without effect that every mean counts besides a text's own.
PRIOR = 100
CHUNK_CHARS = 1 << 18

_SEPARATOR = np.zeros(0x3040, bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]
_SEPARATOR[0x80:0xAA] = _SEPARATOR[0x2000:0x2070] = _SEPARATOR[0x3000:0x3040] = True


def _windows(texts: list[str], bits: int, ngrams: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of all texts' distinct words, and of each its text's number, for n-grams that begin in one
    stretch of CHUNK_CHARS after another."""
    low = [" ".join(dict.fromkeys(t.lower().split())) + "\n" for t in texts]
    code = np.frombuffer("".join(["\n", *low]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    doc = np.r_[doc[:1], doc]  # the leading separator
    sep = _SEPARATOR[np.minimum(code, len(_SEPARATOR) - 1)]
    keep = ~sep | np.r_[True, ~sep[:-1]]  # one separator between words
    code, doc, letter = np.where(sep, 0, code)[keep], doc[keep], ~sep[keep]
    for lo in range(0, len(code), CHUNK_CHARS):
        part, owner, known = (a[lo : lo + CHUNK_CHARS + max(ngrams) - 1] for a in (code, doc, letter))
        part = part.astype(np.uint64)
        upto, h = np.r_[0, np.cumsum(known)], part
        for n in range(2, max(ngrams) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            size = min(len(h), CHUNK_CHARS)
            if n not in ngrams or size <= 0:
                continue
            inner = upto[n - 1 : n - 1 + size] - upto[1 : 1 + size]  # letters strictly inside
            at = np.flatnonzero((inner == n - 2) & (known[:size] | known[n - 1 : n - 1 + size]))
            mixed = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            yield (mixed >> np.uint64(64 - bits)).astype(np.int64), owner[at + 1]


def ngram_buckets(texts: list[str], bits: int = BUCKET_BITS, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts' distinct words, and of each its text's number."""
    found = list(_windows(texts, bits, ngrams))
    return np.concatenate([b for b, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([d for _, d in found] or [np.zeros(0, np.int32)])


def bag(text: str, bits: int = BUCKET_BITS, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's n-grams and how often each occurs."""
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for buckets, _ in _windows([text], bits, ngrams):
        more, n = np.unique(buckets, return_counts=True)
        ids, at = np.unique(np.r_[ids, more], return_inverse=True)
        counts = np.bincount(at, np.r_[counts, n], minlength=len(ids)).astype(np.int64)
    return ids, counts


def _chunks(texts):
    """Runs of whole texts of about CHUNK_CHARS; one longer text is a run of its own."""
    run, size = [], 0
    for t in texts if isinstance(texts, list) else (x for lo in range(0, len(texts), 128) for x in texts.slice(lo, 128).to_pylist()):
        run.append(t or "")
        size += len(run[-1])
        if size >= CHUNK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


@dataclass
class Model:
    effect: np.ndarray  # of each bucket on the log odds of class 1
    bias: float

    def logits(self, texts) -> np.ndarray:
        """texts: a list, or an Arrow array."""
        out = []
        for run in _chunks(texts):
            n, total = np.zeros(len(run)), np.zeros(len(run))
            for buckets, docs in _windows(run, len(self.effect).bit_length() - 1, NGRAMS):
                n += np.bincount(docs, minlength=len(run))
                total += np.bincount(docs, self.effect[buckets], minlength=len(run))
            out.append(total / (n + PRIOR) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 4, epochs: int = 10, steps: int = 1500, rate: float = 0.5, batch: int = 64, bits: int = BUCKET_BITS, seed: int = 1) -> Model:
    """bags: distinct buckets of each text and their shares. Classes weigh alike. One class or none gives a constant.

    The texts are passed epochs times, or as often as makes steps batches: few texts need more passes.
    """
    labels = np.asarray(labels, int)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(1 << bits), float(np.log(share / (1 - share))))
    texts = np.zeros(1 << bits, np.int32)
    for ids, _ in bags:
        texts[ids] += 1
    used = np.flatnonzero(texts >= min(LEAST_TEXTS, max(1, len(labels) // 20)))
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    for k, (ids, shares) in enumerate(bags):  # in place: the caller's bags are not needed again
        known = place[ids] >= 0
        bags[k] = (place[ids][known], shares[known])
    rng = np.random.default_rng(seed)
    e = (rng.random((len(used), dim), np.float32) - 0.5) / dim
    w, b = (rng.random((dim, 2), np.float32) - 0.5), np.zeros(2, np.float32)
    e_sq, w_sq, b_sq = np.full(len(used), 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    weight = (len(labels) / (2 * np.bincount(labels, minlength=2)))[labels].astype(np.float32)
    order = rng.permutation(len(labels))
    for _ in range(max(epochs, -(-steps // -(-len(order) // batch)))):
        for lo in rng.permutation(np.arange(0, len(order), batch)):
            at = order[lo : lo + batch]
            ids, part = np.concatenate([bags[i][0] for i in at]), np.concatenate([bags[i][1] for i in at])[:, None]
            row = np.repeat(np.arange(len(at)), [len(bags[i][0]) for i in at])
            if not len(ids):
                continue
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, ids[by][1:] != ids[by][:-1]])
            own = ids[by][first]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            mean = np.zeros((len(at), dim), np.float32)
            mean[row[starts]] = np.add.reduceat(e[ids] * part, starts)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            g = p * weight[at][:, None] / len(at)
            back = (g @ w.T).astype(np.float32)
            step = np.add.reduceat((back[row] * part)[by], first)
            gw, gb = mean.T @ g, g.sum(0)
            e_sq[own] += (step**2).mean(1)
            e[own] -= rate * step / np.sqrt(e_sq[own])[:, None]
            w_sq += gw**2
            b_sq += gb**2
            w -= rate * gw / np.sqrt(w_sq)
            b -= rate * gb / np.sqrt(b_sq)
    effect = np.zeros(1 << bits)
    effect[used] = e @ (w[:, 1] - w[:, 0])
    return Model(effect, float(b[1] - b[0]))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: tuple[int, int] = MOST_ROWS) -> Model:
    """Fit on at most most_rows[c] labelled rows of class c, on whole texts; null labels and ids are skipped and
    an id labelled twice counts as the greater label; of an id with several texts each is a training row. The driver gets
    only their n-gram bags, in turn. No labels, or labels of one class, give a constant model."""
    small_batches(documents.sparkSession)
    one = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    one = one.withColumn("h", F.xxhash64(F.lit(29), id_col))
    picked = one.filter("label = 1").orderBy("h", id_col).limit(most_rows[1]).unionByName(one.filter("label = 0").orderBy("h", id_col).limit(most_rows[0]))
    rows = documents.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(picked.select(F.col(id_col).alias("id"), "label")), "id")

    def bags(batches):
        for b in batches:
            for i, label, text in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist()):
                ids, n = bag(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([label], pa.int32()), pa.array([ids.astype(np.int32).tobytes()]), pa.array([(n / (n.sum() + PRIOR)).astype(np.float32).tobytes()])], names=["id", "label", "ids", "share"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, label int, ids binary, share binary"
    table = cut(rows.select("id", F.col("label").cast("int"), "text").mapInArrow(bags, kind), "toxicity-bags")
    # one partition after another: the driver's JVM never holds them all
    found = [(r.id, r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r.share, np.float32)) for r in table.toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[2].tobytes()))
    held, classes = [r[2:] for r in found], np.asarray([r[1] for r in found], int)
    del found  # train() lets go of each bag once it has cut it down
    model = train(held, classes)
    del held
    give_back()
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score double in [0, 1], of every whole text. A null text is an empty one; both score the bias alone."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.effect.astype(np.float32), model.bias))

    def run(batches):
        m = Model(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1)), pa.float64())], names=["id", "score"])

    rows = documents.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """documents without those that score threshold or more, columns and rows otherwise as they are: null ids and rows that
    repeat are judged by their texts alone. A null text is an empty one; both score the bias, which is below 0.7 unless
    the training rows were nearly all toxic. Whole texts are judged, each held by its task."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.effect.astype(np.float32), model.bias))
    at = documents.columns.index(text_col)

    def run(batches):
        m = Model(*held.value)
        for b in batches:
            yield b.filter(pa.array(m.scores(b.column(0).field(at)) < threshold))
        give_back()

    rows = wrapped(documents)
    return unwrapped(rows.mapInArrow(run, rows.schema))
