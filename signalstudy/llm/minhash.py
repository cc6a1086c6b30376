"""Near-dedup by circulant MinHash, banding and exact verification.

One permutation of the hash space places a shingle; a second one, shifted by one step per coordinate, ranks it: two
permutations give all coordinates of a signature. Documents that agree in a whole band are candidates; a candidate pair
becomes a link only after its full shingle sets have been compared.

Equal word sequences are one node. Within a bucket, signatures tell which pairs can reach the similarity; a spanning
forest of those gives clusters, in which pairs are compared on their full sets by products of incidence matrices. A
large group is compared inside blocks, then with the best linked member of each block; only members that are still
apart from the rest meet all others. Rows between steps are members and forest edges, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, by_bitmap, col, cut, drop_rows, give_back, join_shared, small_batches
from .quotes import LOWER, UPPER

SHINGLE = 5
BANDS, ROWS = 28, 5
COORDINATES = BANDS * ROWS
CHUNK_BYTES = 1 << 18
#: Members of a group, and their bytes, that one task compares with as many others.
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 1 << 24
#: Bytes of smaller groups that share a task, and the least number of such tasks.
TASK_BYTES, LEAST_TASKS = 1 << 22, 256
#: Buckets of so many members are told apart by their members alone.
FEW = 32

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.ones(max(n, CHUNK_BYTES * 3 // 2), np.uint64)
            p[1:] = base
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> list[bytes]:
    """A text in pieces of bounded length, cut at white space. A word of more than CHUNK_BYTES is given as its digest."""
    at, out = 0, []
    while len(text) - at > CHUNK_BYTES:
        probe = at + CHUNK_BYTES
        after = _SPACES.search(text, probe)
        end = after.start() if after else len(text)
        begin = max([at, *(text.rfind(c, at, probe) + 1 for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))])
        if end - begin > CHUNK_BYTES:
            out += [text[at:begin], b"\xff" + hashlib.sha256(text[begin:end]).digest().hex().encode()]
        else:
            out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _word_hashes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all pieces' words, and the number of words of each piece."""
    data = np.frombuffer(b"\n".join([b"", *pieces, b""]), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    power, inverse = _power_tables(len(data) + 1)
    upto = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)]
    words = _mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in pieces])))


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; texts in lower case already. A text of fewer words
    has its whole sequence as one shingle, a text without words none. Texts of any length are hashed in pieces."""
    found, counts, run, owner, size = [], np.zeros(len(texts), np.int64), [], [], 0
    for k, t in enumerate(texts):
        for piece in _pieces(t):
            run.append(piece)
            owner.append(k)
            size += len(piece)
            if size >= CHUNK_BYTES:
                words, n = _word_hashes(run)
                found.append(words)
                np.add.at(counts, owner, n)
                run, owner, size = [], [], 0
    if run:
        words, n = _word_hashes(run)
        found.append(words)
        np.add.at(counts, owner, n)
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    first = np.r_[0, np.cumsum(counts)]
    odd = [np.uint64(_BASE ** (2 * j + 1) % (1 << 64) | 1) for j in range(width)]
    many = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width if len(many) else 0):
        many += words[j : j + len(many)] * odd[j]
    many = _mix(many)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(many[a : b - width + 1]))
        elif b > a:
            h = sum((words[a + j : a + j + 1] * odd[j] for j in range(b - a)), np.uint64(b - a) * np.ones(1, np.uint64))
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Coordinate j is the least pi(sigma(s) + j) over the set; sigma and pi are bijections modulo 2^32 of its hashes."""
    place = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    shift = np.arange(k, dtype=np.uint32)[:, None]
    for lo in range(0, len(place), 512):
        h = place[lo : lo + 512][None, :] + shift
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        np.minimum(best, h.min(1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature (2-d)."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(_BASE)
    for j in range(rows):
        h = _mix(h ^ parts[:, :, j]) + np.uint64(j)
    return h.astype(np.int64)


def _runs(column: pa.Array):
    """Start, and whole texts in lower case, of runs of about CHUNK_BYTES; null is empty. bytes.lower() changes A-Z only."""
    run, size, start = [], 0, 0
    for lo in range(0, len(column), 128):
        for t in pc.cast(column.slice(lo, 128), pa.binary()).to_pylist():
            run.append(t.lower() if t is not None else b"")
            size += len(run[-1])
            if size >= CHUNK_BYTES:
                yield start, run
                run, size, start = [], 0, start + len(run)
    if run:
        yield start, run


def word_digest(text_col: str) -> Column:
    """The digest that sketch gives a text's word sequence, as an expression."""
    words = F.trim(F.regexp_replace(F.translate(col(text_col), UPPER, LOWER), WS, " "))
    return F.substring(F.unhex(F.sha2(words.cast("binary"), 256)), 1, 16)


def prefix_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set: two sets of at least this similarity share one of theirs, without exception."""
    n = len(shingles)
    return shingles[: n - -(-percent * n // 100) + 1].astype(np.int64) if n else np.zeros(0, np.int64)


def sketch(documents: DataFrame, id_col: str, text_col: str, exact: int | None = None) -> DataFrame:
    """id, n (set size), words (digest of the word sequence, null without words), sig binary and keys array<long>: those of
    the bands, or with exact (a percentage) prefix keys."""

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for at, texts in _runs(b.column("text")):
                sets = shingle_sets(texts)
                sig = np.stack([signature(s) for s in sets])
                keys = [prefix_keys(x, exact) for x in sets] if exact else [k if len(x) else np.zeros(0, np.int64) for k, x in zip(band_keys(sig), sets)]
                some = np.asarray([len(s) > 0 for s in sets])
                digests = [hashlib.sha256(b" ".join(t.split())).digest()[:16] if ok else None for t, ok in zip(texts, some)]
                offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys), pa.int64()))],
                    names=["id", "n", "words", "sig", "keys"],
                )
        give_back()

    small_batches(documents.sparkSession)
    rows = documents.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, words binary, sig binary, keys array<long>")


def shingles_of(documents: DataFrame, id_col: str, text_col: str, ids: DataFrame, words: bool = False) -> DataFrame:
    """id, set (packed hashes) and, if asked for, digest of the word sequence of the documents whose id may be in ids: a
    bitmap of them lets one row in thousands through beside."""
    texts = documents.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).filter("id is not null")

    def run(batches):
        for b in batches:
            for at, some in _runs(b.column("text")):
                digests = [pa.array([hashlib.sha256(b" ".join(t.split())).digest()[:16] for t in some], pa.binary())] if words else []
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(some)), pa.array([s.tobytes() for s in shingle_sets(some)], pa.binary()), *digests], names=["id", "s", "words"][: 2 + words])
        give_back()

    return by_bitmap(texts, ["id"], ids)[1].mapInArrow(run, "id long, s binary" + ", words binary" * words)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this adjacency matrix."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        stack = [root] if left[root] else []
        left[root] = False
        while stack:
            k = stack.pop()
            new = np.flatnonzero(linked[k] & left)
            left[new] = False
            out += [(k, int(n)) for n in new]
            stack += new.tolist()
    return out


def common(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Exact sizes of all pairs' intersections, by products of blocks of the incidence matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def _dealt(members: DataFrame, name: str) -> DataFrame:
    """members (g, id, cost) with size and bytes of their group, blocks (1 for one that a task can hold), and their block."""
    sizes = cut(members.groupBy("g").agg(F.count("*").alias("size"), F.sum("cost").alias("bytes")), f"near-sizes-{name}")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    m = join_shared(members, sizes.withColumn("blocks", blocks), "g", "size")
    return m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def merges(linked: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """One link for each step of joining these components, no link inside one."""
    _, comp = np.unique(comp, return_inverse=True)
    a, b = np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :])))
    pair = np.minimum(comp[a], comp[b]) * (comp.max() + 1) + np.maximum(comp[a], comp[b])
    _, first = np.unique(pair, return_index=True)
    a, b = a[first], b[first]
    between = np.full((comp.max() + 1, comp.max() + 1), -1)
    between[comp[a], comp[b]] = between[comp[b], comp[a]] = np.arange(len(a))
    return [(a[k], b[k]) for i, j in forest(between >= 0) for k in [between[i, j]]]


def group_edges(members: DataFrame, payload: DataFrame, links: Callable[[pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """Edges (a, b) with the components that all pairs of each group, compared, would have.

    members: g, id, cost (bytes). payload: id and what links reads; links gives the adjacency matrix of some members of one
    group. Small groups share tasks of bounded bytes. The members of a large one are compared inside blocks, then with the best linked
    member of every block; copies of one original are one component by then. Those still outside the greatest
    component meet every member, so that no link between components is missed: pairs inside one need no comparing.
    """

    def each(pdf: pd.DataFrame, hubs: bool = False, comps: bool = False) -> pd.DataFrame:
        edges = []
        for g, x in pdf.groupby("g", sort=False):
            x = x.drop_duplicates("id").sort_values("id")
            linked, ids_ = links(x), x.id.to_numpy()
            edges += [(g, ids_[a], ids_[b]) for a, b in (merges(linked, x.comp.to_numpy()) if comps else forest(linked))]
            edges += [(g, ids_[k], ids_[k]) for k in [linked.sum(1).argmax()] if hubs]  # an edge to itself marks a hub
        if len(pdf) >= BLOCK_MEMBERS // 2:
            give_back()
        return pd.DataFrame(edges, columns=["g", "a", "b"]).astype("int64")

    kind = "g long, a long, b long"
    dealt = cut(_dealt(members, name), f"near-dealt-{name}")
    total = dealt.filter("blocks = 1").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("n")).first().n
    tasks = max(LEAST_TASKS, ceil(total / TASK_BYTES))
    small = dealt.filter("blocks = 1").select("g", "id").join(payload, "id").withColumn("t", F.pmod(F.xxhash64("g"), F.lit(tasks)))
    out = [cut(small.groupBy("t").applyInPandas(lambda pdf: each(pdf), kind).select("a", "b"), f"near-small-{name}")]
    if not dealt.filter("blocks > 1").take(1):
        return out[0]
    found = lambda: reduce(DataFrame.unionByName, out)
    held = cut(dealt.filter("blocks > 1").select("g", "id", "cost", "block", "blocks").join(payload, "id"), f"near-large-{name}")
    data = held.select("g", "id", *[c for c in payload.columns if c != "id"])
    places = held.select("g", "id", "cost", "block", "blocks")

    first = cut(held.groupBy("g", "block").applyInPandas(lambda pdf: each(pdf, hubs=True), kind), f"near-inside-{name}")
    out.append(first.filter("a <> b").select("a", "b"))
    # hubs only hasten things: of more blocks than a task holds, every so many'th
    hub = places.join(first.filter("a = b").select("g", F.col("a").alias("id")), ["g", "id"])
    hub = hub.filter(F.col("block") % F.ceil(F.col("blocks") / BLOCK_MEMBERS) == 0)
    hub = hub.select("g", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    meet = places.select("g", "id", "block").unionByName(hub).distinct().join(data, ["g", "id"])
    out.append(cut(meet.groupBy("g", "block").applyInPandas(lambda pdf: each(pdf), kind).select("a", "b"), f"near-hubs-{name}"))

    two = cut(places.join(components(found()), "id", "left").withColumn("comp", F.coalesce("comp", "id")), f"near-places-{name}")
    main = two.groupBy("g", "comp").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m")).select("g", F.col("m.comp").alias("main"))
    apart = cut(two.join(main, "g").filter("comp <> main").select("g", "id", "comp", "cost", F.col("blocks").alias("all")), f"near-apart-{name}")
    if not apart.take(1):
        return found()
    few = _dealt(apart, f"apart-{name}").withColumnRenamed("block", "i")
    wide = few.groupBy("g").agg(F.max("blocks").alias("parts"))
    few = few.select("g", "id", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    all_ = two.join(wide, "g").select("g", "id", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"))
    meet = few.unionByName(all_).distinct().join(data, ["g", "id"])
    out.append(cut(meet.groupBy("g", "i", "j").applyInPandas(lambda pdf: each(pdf, comps=True), kind).select("a", "b"), f"near-met-{name}"))
    return found()


def components(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id reachable over edges (a, b), for every id that has one. Labels shrink to their
    neighbours' least, then jump to their label's label; every round is a written table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "near-edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "near-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("m"))
        one = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("comp", "m").alias("c1"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("j"), F.col("comp").alias("c2"))
        new = cut(one.join(jump, F.col("c1") == F.col("j")).select("id", F.least("c1", "c2").alias("comp"), "was"), "near-labels")
        labels = new.select("id", "comp")
        if not new.filter("comp <> was").take(1):
            return labels


def numbered(rows: DataFrame) -> DataFrame | None:
    """id, words, node: a number for each text of each id, in their order. None if no id has two texts: ids are the nodes."""
    again = rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    if not again.take(1):
        return None
    several = (F.min("words") < F.max("words")) | F.count("words").between(1, F.count("*") - 1)
    if not rows.join(again, "id").groupBy("id").agg(several.alias("several")).filter("several").take(1):
        return None
    return cut(rows.filter("words is not null and id is not null").select("id", "words").distinct().orderBy("id", "words").withColumn("node", F.monotonically_increasing_id()), "near-nodes")


def linked_rows(documents: DataFrame, id_col: str, text_col: str, percent: int, exact: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """One row per row: id, n, words, node and comp (the smallest node reachable; both null without words or id), and what
    numbered() gives. Each text of an id is a node of its own."""
    sketches = cut(sketch(documents, id_col, text_col, percent if exact else None), "near-sketches")
    valid = sketches.filter("words is not null and id is not null")
    nodes = numbered(sketches)
    if nodes is not None:
        valid = cut(valid.join(nodes, ["id", "words"]).select(F.col("node").alias("id"), "n", "words", "sig", "keys"), "near-sketches")
    # equal word sequences: their least id stands for them
    least = cut(valid.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1"), "near-shared")
    copies = cut(join_shared(valid.select("id", "words"), least, "words", "rows").filter("id <> rep").select("id", "rep").distinct(), "near-copies")

    keyed = valid.select("id", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = keyed.join(full, "key").join(copies.select("id"), "id", "left_anti").distinct()
    buckets = cut(buckets, "near-buckets")
    sizes = cut(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "near-bucket-sizes")
    buckets = join_shared(buckets, sizes, "key", "size")
    # the same few members meet in many buckets: once is enough
    few = buckets.filter(F.col("size") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    few = few.select(F.xxhash64("ids").alias("g"), F.explode("ids").alias("id"))
    groups = cut(few.unionByName(buckets.filter(F.col("size") > FEW).select(F.col("key").alias("g"), "id")).distinct(), "near-groups")

    # candidates: signatures of one bucket that allow the similarity. A spanning forest of them will do, since all pairs
    # of the clusters that it gives are compared on their full sets
    s = percent / 100
    least_equal = COORDINATES * (s - 5 * np.sqrt(s * (1 - s) / COORDINATES))

    def alike(x: pd.DataFrame) -> np.ndarray:
        sig, n = np.frombuffer(b"".join(x.sig), np.uint32).reshape(len(x), -1), x.n.to_numpy()
        same = np.stack([(sig == row).sum(1) for row in sig]) >= least_equal
        return same & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))

    if exact:
        clusters = groups
    else:
        # of a large bucket all members are candidates of one another: a star of edges says so
        large = groups.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("a")).filter(F.col("n") > BLOCK_MEMBERS)
        large = cut(large.select("g", "a", "n"), "near-large-buckets")
        star = join_shared(groups, large, "g", "n").filter("id <> a").select("a", F.col("id").alias("b"))
        groups = cut(groups.join(large.select("g"), "g", "left_anti"), "near-small-buckets")
        sigs = by_bitmap(valid.select("id", "n", "sig"), ["id"], cut(groups.select("id").distinct(), "near-members"))[1].dropDuplicates(["id"])
        near = group_edges(groups.withColumn("cost", F.lit(64 + 4 * COORDINATES).cast("long")), sigs, alike, "candidates")
        clusters = cut(components(near.unionByName(star)).select(F.col("comp").alias("g"), "id"), "near-clusters")
    ids = cut(clusters.select("id").distinct(), "near-members")
    costs = by_bitmap(valid.select("id", "n"), ["id"], ids)[1].dropDuplicates(["id"]).select("id", (64 + 8 * F.col("n")).alias("cost"))
    clusters = cut(clusters.join(costs, "id"), "near-clusters")

    def verified(x: pd.DataFrame) -> np.ndarray:
        sets = [np.frombuffer(v, np.uint64) for v in x.s]
        n, both = np.asarray([len(v) for v in sets], float), common(sets)
        return (100 * both >= percent * (np.add.outer(n, n) - both)) & (both > 0)

    if nodes is None:
        sets = shingles_of(documents, id_col, text_col, ids).dropDuplicates(["id"])
    else:
        members = nodes.join(ids.select(F.col("id").alias("node")), "node")
        sets = shingles_of(documents, id_col, text_col, cut(members.select("id").distinct(), "near-members"), True).join(members, ["id", "words"])
        sets = sets.select(F.col("node").alias("id"), "s").dropDuplicates(["id"])
    comps = components(group_edges(clusters, sets, verified, "links"))

    # a copy's component is that of the document that stands for it
    node = copies.select(F.col("id").alias("node"), "rep").join(comps, F.col("rep") == F.col("id"), "left").select("node", F.coalesce("comp", "rep").alias("comp"))
    node = node.unionByName(comps.select(F.col("id").alias("node"), "comp")).groupBy("node").agg(F.min("comp").alias("comp"))
    out = sketches.select("id", "n", "words")
    out = out.withColumn("at", F.when(F.col("words").isNotNull(), F.col("id"))) if nodes is None else out.join(nodes.withColumnRenamed("node", "at"), ["id", "words"], "left")
    return out.join(node, F.col("at") == F.col("node"), "left").select("id", "n", "words", F.col("at").alias("node"), F.coalesce("comp", "at").alias("comp")), nodes


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, exact: bool = False) -> DataFrame:
    """One row per row: id, n_shingles long, component_id (smallest id reachable), kept boolean.

    Two documents are linked when 100 * intersection >= percent * union of their sets of five-word shingles (A-Z in
    lower case; fewer words: the whole sequence). At similarity 0.8 a pair escapes all bands with probability 1.4e-5,
    at 0.85 with 7e-8, and the signatures' test one of five standard deviations. With exact no pair escapes: candidates
    share one of the least hashes of their sets (percent of a set must be shared, so one of the rest of it plus one
    is), which costs a row per hash where bands cost 28 a document.

    Ids are integers. Documents without words, or with a null id, are linked with nothing; a null id keeps its row and
    has no component. Rows that repeat an id are one document, linked with whatever one of its texts is linked with. An
    empty table gives no rows; other columns are ignored.
    """
    rows, nodes = linked_rows(documents, id_col, text_col, percent, exact)
    if nodes is None:
        rows = rows.withColumn("component_id", F.coalesce("comp", "id"))
    else:
        rows = cut(rows.select("id", "n", "comp"), "near-rows")
        edges = rows.join(nodes.select(F.col("node").alias("comp"), F.col("id").alias("b")), "comp").filter("id <> b").select(F.col("id").alias("a"), "b")
        ids = components(edges).select(F.col("id").alias("a"), F.col("comp").alias("least"))
        rows = rows.join(ids, F.col("id") == F.col("a"), "left").withColumn("component_id", F.coalesce("least", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, exact: bool = False) -> DataFrame:
    """documents with one of each group of linked texts: that of the smallest id, and of that id's texts in the group one.

    Rows are decided by id and text: an id's other texts stay, rows equal in id and words stay or go together. Rows without
    words (null texts too) or with a null id stay. Ids are integers. Columns are as in documents, whatever their names.
    """
    rows, nodes = linked_rows(documents, id_col, text_col, percent, exact)
    gone = rows.filter("node <> comp")
    key = {"id": col(id_col).cast("long")}
    if nodes is not None:
        key["words"] = word_digest(text_col)
    return drop_rows(documents, key, cut(gone.select(*key).distinct(), "near-dropped"))
