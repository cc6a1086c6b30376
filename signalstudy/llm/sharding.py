"""K-d tree sharding: weighted median splits along the widest metadata dimension.

The tree is grown level by level. Coordinates are 64-bit integers that keep their dimension's order: numbers and dates as
they are, floating-point numbers by their ordered bits, texts by their rank among the distinct values. Each pass over
the small metadata table (never the texts) is one map-side histogram of all open nodes; a node's split point is narrowed
bin by bin until what is left in the bin is below the tolerance. A pass divides the range by BINS, so 64 bits are used
up after eight of them, and equal coordinates are told apart by 63 more bits, a hash of the row: a value that holds
a third of all rows splits like any other, and no level sorts or gathers rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, ranked

BINS = 512
#: Bounds of a table of a text dimension's distinct values that is broadcast: values and bytes.
MOST_VALUES, MOST_BYTES = 100_000, 16 << 20
TIE_END = 1 << 63
#: Rows that one task numbers within a shard, about.
NUMBERED_ROWS = 50_000


@dataclass
class Tree:
    """Flat arrays; a node with dim -1 is a leaf. A row goes left if (x, tie) < (cut, tie_cut)."""

    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    tie_cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)

    def add(self, leaves: int = 1) -> int:
        for name, value in (("dim", -1), ("cut", 0), ("tie_cut", 0), ("left", -1), ("right", -1), ("leaves", leaves), ("shard", -1)):
            getattr(self, name).append(value)
        return len(self.dim) - 1

    def number(self) -> int:
        """Numbers the leaves from the left; returns how many there are."""
        stack, n = [0], 0
        while stack:
            k = stack.pop()
            if self.dim[k] < 0:
                self.shard[k], n = n, n + 1
            else:
                stack += [self.right[k], self.left[k]]
        return n

    def arrays(self) -> dict[str, np.ndarray]:
        out = {k: np.asarray(getattr(self, k), np.int64) for k in ("dim", "cut", "left", "right", "shard")}
        return out | {"tie_cut": np.asarray(self.tie_cut, np.uint64)}


def descend(tree: dict[str, np.ndarray], x: np.ndarray, tie: np.ndarray) -> np.ndarray:
    node = np.zeros(len(tie), np.int64)
    rows = np.arange(len(tie))
    while True:
        dim = tree["dim"][node]
        inner = dim >= 0
        if not inner.any():
            return node
        value = x[rows, np.maximum(dim, 0)]
        at = tree["cut"][node]
        left = (value < at) | ((value == at) & (tie < tree["tie_cut"][node]))
        node = np.where(inner, np.where(left, tree["left"][node], tree["right"][node]), node)


def ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of these doubles (no NaN): their bits, the negative ones reversed."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _coordinates(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.empty((batch.num_rows, dims), np.int64)
    for i in range(dims):
        value = batch.column(f"x{i}").to_numpy(zero_copy_only=False)
        x[:, i] = ordered(value) if value.dtype.kind == "f" else value
    return x, batch.column("tie").to_numpy(zero_copy_only=False).astype(np.uint64), batch.column("size").to_numpy(zero_copy_only=False)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal groups side by side, and where each begins in it."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    return order, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def _ranges(meta: DataFrame, tree: Tree, active: list[int], dims: int) -> dict[int, dict]:
    """Of each open node: weight, and the least and greatest coordinate in every dimension and of the ties."""
    arrays = tree.arrays()
    wanted = np.zeros(len(tree.dim), bool)
    wanted[active] = True
    names = [f"{end}{i}" for i in range(dims + 1) for end in ("lo", "hi")]

    def part(batches):
        for b in batches:
            x, tie, size = _coordinates(b, dims)
            node = descend(arrays, x, tie)
            at = np.flatnonzero(wanted[node])
            if not len(at):
                continue
            order, first = _runs(node[at])
            at = at[order]
            found = {"node": pa.array(node[at][first], pa.int64()), "weight": np.add.reduceat(size[at], first)}
            for i in range(dims + 1):
                key = x[at, i] if i < dims else tie[at].astype(np.int64)
                found |= {f"lo{i}": np.minimum.reduceat(key, first), f"hi{i}": np.maximum.reduceat(key, first)}
            yield pa.RecordBatch.from_pydict(found)

    rows = meta.mapInArrow(part, "node long, weight long, " + ", ".join(f"{n} long" for n in names))
    rows = rows.groupBy("node").agg(F.sum("weight").alias("weight"), *[(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in names])
    return {r.node: {"weight": r.weight, "lo": [r[f"lo{i}"] for i in range(dims + 1)], "hi": [r[f"hi{i}"] for i in range(dims + 1)]} for r in rows.collect()}


def _narrow(meta: DataFrame, tree: Tree, state: dict[int, dict], dims: int) -> list:
    """One pass: per open node the bin in which its weighted quantile lies, with what lies below it."""
    arrays = tree.arrays()
    slot = np.full(len(tree.dim), -1)
    slot[list(state)] = np.arange(len(state))
    nodes, s = np.asarray(list(state)), list(state.values())
    dim, tied = np.asarray([v["dim"] for v in s]), np.asarray([v["value"] is not None for v in s])
    value = np.asarray([v["value"] or 0 for v in s], np.int64)
    lo, hi = np.asarray([v["lo"] for v in s], np.int64), np.asarray([v["hi"] for v in s], np.int64)
    width = (hi.view(np.uint64) - lo.view(np.uint64)) // np.uint64(BINS) + np.uint64(1)
    need = np.asarray([v["goal"] - v["below"] for v in s], float)

    def part(batches):
        for b in batches:
            x, tie, size = _coordinates(b, dims)
            to = slot[descend(arrays, x, tie)]
            row = np.flatnonzero(to >= 0)
            to = to[row]
            at = x[row, dim[to]]
            key = np.where(tied[to], tie[row].astype(np.int64), at)
            ok = (~tied[to] | (at == value[to])) & (key >= lo[to]) & (key <= hi[to])
            row, to, key = row[ok], to[ok], key[ok]
            if not len(row):
                continue
            bin_ = ((key.view(np.uint64) - lo[to].view(np.uint64)) // width[to]).astype(np.int64)
            order, first = _runs(to * BINS + bin_)
            to, bin_, key, weight = to[order], bin_[order], key[order], size[row][order]
            yield pa.RecordBatch.from_pydict({"node": nodes[to[first]], "bin": bin_[first], "weight": np.add.reduceat(weight, first), "lo": np.minimum.reduceat(key, first), "hi": np.maximum.reduceat(key, first), "need": need[to[first]]})

    hist = meta.mapInArrow(part, "node long, bin long, weight long, lo long, hi long, need double")
    hist = hist.groupBy("node", "bin").agg(F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("need").alias("need"))
    upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    mine = F.struct("bin", "upto", "weight", "lo", "hi")
    pick = F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), mine)), F.max(mine))
    hist = hist.withColumn("upto", upto).groupBy("node").agg(pick.alias("b"), F.max("upto").alias("all"))
    return hist.select("node", "b.upto", "b.weight", "b.lo", "b.hi").collect()


def grow(meta: DataFrame, dims: int, leaves: int | None, target: int | None, tolerance: float) -> Tree:
    """meta: size long, tie long from 0, x0 .. x{dims-1} long or double without nulls. The driver holds a few numbers per node.

    With leaves, so many are made. With target, a node splits until it weighs no more than that, or can't be split:
    its rows are one row, or agree in everything.
    """
    tree = Tree()
    tree.add(leaves or 1)
    active, span, slack = ([0] if target or (leaves or 1) > 1 else []), None, 0.0
    while active:
        state, weights = {}, {}
        for n, r in _ranges(meta, tree, active, dims).items():
            if span is None:
                span = [max(h - low, 1) for low, h in zip(r["lo"], r["hi"])]
                slack = tolerance * (target or r["weight"] / tree.leaves[n])
            if target:
                tree.leaves[n] = ceil(r["weight"] / target)
            if tree.leaves[n] < 2 or r["lo"] == r["hi"]:
                continue
            widest = max(range(dims), key=lambda d: ((r["hi"][d] - r["lo"][d]) / span[d], -d))
            share = (tree.leaves[n] // 2) / tree.leaves[n]
            weights[n] = r["weight"]
            state[n] = {"dim": widest, "lo": r["lo"][widest], "hi": r["hi"][widest], "value": None, "goal": share * r["weight"], "below": 0}
        split, done = dict(state), {}
        while state:  # each pass cuts a range by BINS, and once only it passes from coordinates to ties
            for r in _narrow(meta, tree, state, dims):
                s = state[r.node]
                below, single = s["below"] + r.upto - r.weight, r.lo == r.hi
                # a side must not be empty
                sides = [(abs(w - s["goal"]), at) for w, at in ((below, (r.lo, 0)), (below + r.weight, (r.hi, 1))) if 0 < w < weights[r.node]]
                if sides and (r.weight <= slack or single and s["value"] is not None):
                    at, after = min(sides)[1]
                    done[r.node] = (at, TIE_END if after else 0) if s["value"] is None else (s["value"], at + after)
                    del state[r.node]
                elif single and s["value"] is None:
                    s |= {"value": r.lo, "lo": 0, "hi": TIE_END - 1, "below": below}
                elif single:
                    del state[r.node]  # rows that agree in everything
                else:
                    s |= {"lo": r.lo, "hi": r.hi, "below": below}
        active = []
        for n, (at, tie) in sorted(done.items()):
            half = tree.leaves[n] // 2
            tree.dim[n], tree.cut[n], tree.tie_cut[n] = split[n]["dim"], at, tie
            tree.left[n], tree.right[n] = tree.add(half), tree.add(tree.leaves[n] - half)
            active += [c for c in (tree.left[n], tree.right[n]) if target or tree.leaves[c] > 1]
    tree.number()
    return tree


def coordinates(df: DataFrame, dims: tuple[str, ...]) -> tuple[DataFrame, int]:
    """df (columns d0, d1 ...: the dimensions' values) with x0, x1 ... in their place, long or double, null where the value is."""
    for i in range(len(dims)):
        kind, value = df.schema[f"d{i}"].dataType, F.col(f"d{i}")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            values = ranked(df.select(value.alias(f"v{i}")).filter(F.col(f"v{i}").isNotNull()).distinct(), [F.col(f"v{i}")], "kd-values").withColumnRenamed("rank", f"x{i}")
            few = values.limit(MOST_VALUES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(f"v{i}")), F.lit(0)).alias("bytes")).first()
            small = few.n <= MOST_VALUES and few.bytes <= MOST_BYTES
            df = df.join(F.broadcast(values) if small else values, value == F.col(f"v{i}"), "left").drop(f"d{i}", f"v{i}")
        else:
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                x: Column = F.unix_micros(value.cast("timestamp"))
            elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                x = value.cast("long")
            elif isinstance(kind, T.NumericType):
                x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
            else:
                raise ValueError(f"{dims[i]} has no order: {kind.simpleString()}")
            df = df.withColumn(f"x{i}", x).drop(f"d{i}")
    return df, len(dims)


def kd_tree_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source", "doc_id"), target_bytes: int | None = None, n_shards: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """Shards of nearly equal bytes that are boxes in metadata space.

    With n_shards so many leaves are made. With target_bytes nodes split until each weighs no more, so every shard does,
    but for a single row that is larger. Sizes are UTF-8 bytes plus 8 (a null text has 8). Besides dims (those that
    df has), the logarithm of the size is a dimension. A null or NaN coordinate counts as the least. Rows equal in all
    dimensions, repeated rows too, are told apart by a hash of id, text and place. An empty table gives no rows. Other
    columns of df are ignored.

    Returns id, size long, text_crc32 long, shard int, slot long (gapless from 0 within a shard).
    """
    if not (n_shards or target_bytes):
        raise ValueError("n_shards or target_bytes must be given")
    text = F.coalesce(col(text_col), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    dims = tuple(d for d in dims if d in df.columns)
    crc = F.crc32(text.cast("binary"))
    rows = df.select(col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), *[col(d).alias(f"d{i}") for i, d in enumerate(dims)])
    # 40 bits of id and text, then 23 of the row's place: rows that repeat are told apart, others fall alike at every run
    high = F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 24)
    rows = cut(rows.withColumn("tie", F.shiftleft(high, 23).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 41))), "kd-rows")
    meta, n = coordinates(rows, dims)
    meta = cut(meta.withColumn(f"x{n}", F.log(F.col("size").cast("double"))), "kd-meta")
    xs = [f"x{i}" for i in range(n + 1)]
    least = meta.agg(F.count("*").alias("n"), *[F.min(x).alias(x) for x in xs]).first()
    filled = meta.select("id", "size", "crc", "tie", *[F.coalesce(F.col(x), F.lit(least[x] or 0).cast(meta.schema[x].dataType)).alias(x) for x in xs])
    tree = grow(filled, n + 1, n_shards, target_bytes, tolerance).arrays()

    def assign(batches):
        for b in batches:
            x, tie, _ = _coordinates(b, n + 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("crc"), b.column("tie"), pa.array(tree["shard"][descend(tree, x, tie)], pa.int32())], names=["id", "size", "crc", "tie", "shard"])

    # gapless numbers without one task per shard: number within (shard, bucket), then add the rows of the buckets before
    buckets = max(64, ceil(least.n / (tree["shard"].max() + 1) / NUMBERED_ROWS))
    kind = meta.schema["id"].dataType.simpleString()
    placed = filled.mapInArrow(assign, f"id {kind}, size long, crc long, tie long, shard int").withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int"))
    ahead = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size", "tie")) - 1
    out = placed.withColumn("within", within).join(ahead, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("within") + F.col("ahead")).cast("long").alias("slot"))
