"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled into three transducers, composed with each text lazily: the normaliser (its character map's rules,
longest match first, and the treatment of spaces), the lexicon of pieces, and byte fallback, whose arcs spell a
character without a piece and are added when such a character is met. The path of least weight in the tropical semiring
is the text's encoding. In a unigram model an arc weighs minus the piece's score. In a BPE model the weights are those of a context
acceptor over neighbouring pieces: 0 where the merges of the two pieces' joined text give just these two pieces, infinite
otherwise. A sequence is the result of the merges exactly if all its neighbours are such pairs, so the one path of finite
weight is the encoding, and no state needs more than one predecessor. Runs of the space mark, where merges tie, are weighed
by their merges directly, by a heap in n log n steps.

Text is cut where no piece can reach across: before a space mark that follows anything else, between a letter and a mark
that follows a letter in no piece, and around characters that no longer piece holds. A bounded memory keeps the encodings of segments met before.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, give_back, small_batches, wrapped

SPACE = "▁"
#: Segments whose encodings a worker remembers.
MEMORY = 240_000
#: Pairs of pieces whose weights a worker remembers.
PAIRS = 200_000
INF = float("inf")
LETTER = r"[^\W\d_]"


def _fields(raw: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Normaliser:
    """The normaliser's transducer: rules of a character map, protected user-defined symbols, and spaces.

    The map is a little-endian size, a double-array trie of that many bytes, and the texts that its leaves point to.
    """

    def __init__(self, charsmap: bytes, dummy_prefix: bool, trim: bool, escape: bool, symbols: list[str]):
        self.dummy_prefix, self.trim, self.space = dummy_prefix, trim, SPACE if escape else " "
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist() if size else []
        self.texts = charsmap[4 + size :]

    def _rule(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """End and output of the longest rule that matches at i."""
        units, found = self.units, None
        at = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for j in range(i, len(data)):
            at ^= data[j]
            if at >= len(units) or units[at] & 0x800000FF != data[j]:
                break
            leaf = units[at] >> 8 & 1
            at ^= (units[at] >> 10) << ((units[at] & 512) >> 6)
            if leaf:
                found = j + 1, units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def _mapped(self, text: str) -> Iterator[bytes]:
        """Outputs of the map's arcs along a text without symbols; characters without a rule are copied in runs."""
        data, i, copied = text.encode(), 0, 0
        while i < len(data):
            rule = self._rule(data, i)
            if rule is None:
                i += 1
                while i < len(data) and data[i] & 0xC0 == 0x80:
                    i += 1
                continue
            if copied < i:
                yield data[copied:i]
            yield rule[1]
            i = copied = rule[0]
        if copied < i:
            yield data[copied:i]

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.units:
            last, parts = 0, []
            for m in self.symbols.finditer(text) if self.symbols else ():
                parts += [*self._mapped(text[last : m.start()]), m[0].encode()]
                last = m.end()
            text = b"".join([*parts, *self._mapped(text[last:])]).decode()
        if self.trim:
            text = re.sub(" +", " ", text).lstrip(" ")
        text = (self.space if self.dummy_prefix else "") + text.replace(" ", self.space)
        return text.rstrip(self.space) if self.trim else text


class Transducer:
    """Compiled model: arcs is a trie of pieces (None: the accepted piece's id), weight the tropical weight of each."""

    def __init__(self, raw: bytes):
        self.pieces, self.kinds, scores = [], [], []
        self.bpe, self.dummy_prefix, self.trim, charsmap, escape, fallback = False, True, True, b"", True, False
        for field, value in _fields(raw):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif field == 2:
                x = dict(_fields(value))
                if x.get(3, 1) not in (1, 2) or x.get(24, 0):
                    raise ValueError("only unigram and BPE models with spaces before words are supported")
                self.bpe, fallback = x.get(3, 1) == 2, bool(x.get(35, 0))
            elif field == 3:
                x = dict(_fields(value))
                charsmap, self.dummy_prefix, self.trim, escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        if self.bpe and UNUSED in self.kinds:
            raise ValueError("BPE models with unused pieces are not supported")
        self.score = scores
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_id = [None] * 256
        self.arcs: dict = {}
        self.id_of: dict[str, int] = {}
        own = {}
        for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE and fallback:
                self.byte_id[int(p[3:5], 16)] = i
            elif kind == NORMAL:
                self.id_of[p] = i
            elif kind == USER_DEFINED:
                own[p] = i
        self.normalise = Normaliser(charsmap, self.dummy_prefix, self.trim, escape, list(own))
        # user-defined symbols: a BPE text is cut at them, in a unigram lattice they outweigh other arcs
        self.symbols, self.symbol_id = self.normalise.symbols, own
        known = [s for s, k in zip(scores, self.kinds) if k == NORMAL]
        top = max([float(np.finfo(np.float32).tiny), *known])
        self.unknown_score = float(np.float32(min(known, default=0.0)) - np.float32(10.0))
        self.arc_score = [s if k != USER_DEFINED else len(p.encode()) * top - 0.1 for p, s, k in zip(self.pieces, scores, self.kinds)]
        # a BPE piece that its own merges don't give is on no path; of the others the last merge is kept
        self.halves: dict[str, tuple[str, str]] = {}
        for p, i in (self.id_of if self.bpe else self.id_of | own).items():
            if not self.bpe or len(p) == 1 or self._derive(p):
                node = self.arcs
                for c in p:
                    node = node.setdefault(c, {})
                node[None] = i
        better = lambda p, q: p not in self.halves or self.score[self.id_of[p]] >= self.score[self.id_of[q]]
        self.in_order = all(better(p, q) for q, parts in self.halves.items() for p in parts)
        self.spines: dict[tuple[str, int], list[str]] = {}
        self.code = "H" if len(self.pieces) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.pairs: dict = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelt: dict[int, list[int]] = {}
        inside = {c for p in self.id_of for c in p if len(p) > 1}
        spans = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.cuts = None
        if self.bpe and escape and not spans:
            alone = "".join(re.escape(c) for c in ("\n", "\t", "\r") if c not in inside)
            # marks that follow a letter in no piece: a run of letters ends before them
            after = {p[k] for p in self.id_of for k in range(1, len(p)) if re.match(LETTER, p[k - 1])}
            ends = "".join(re.escape(c) for c in ".,;:!?|()-'\"" if c not in after)
            self.cuts = re.compile(f"{SPACE}*+{LETTER}++(?![^{SPACE}{alone}{ends}])|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        raw_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.out_len = np.asarray([len(b) for b in raw_bytes], np.int64)
        self.out_at = np.r_[0, np.cumsum(self.out_len)]
        self.out = np.frombuffer(b"".join(raw_bytes) + b"\0", np.uint8)

    def _merge(self, text: str) -> list[str]:
        """The merges of a BPE model, best score first, leftmost of equals: what the weights are defined by."""
        ids, score, n = self.id_of, self.score, len(text)
        if n <= 16:
            parts = list(text)
            while len(parts) > 1:
                best, where = None, -1
                for k in range(len(parts) - 1):
                    i = ids.get(parts[k] + parts[k + 1])
                    if i is not None and (best is None or score[i] > best):
                        best, where = score[i], k
                if best is None:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            return parts
        # part k is text[k:end[k]]; before[k] is where the part before it starts. A heap entry holds where its right part
        # began and ended: it is stale once either part has changed
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(k: int) -> None:
            mid = end[k]
            if mid < n:
                i = ids.get(text[k : end[mid]])
                if i is not None:
                    heap.append((-score[i], k, mid, end[mid]))

        for k in range(n - 1):
            offer(k)
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, k, mid, stop = heappop(heap)
            if not alive[k] or end[k] != mid or end[mid] != stop:
                continue
            end[k], alive[mid] = stop, 0
            if stop < n:
                before[stop] = k
            for at in (before[k], k):
                if at >= 0 and end[at] < n:
                    i = ids.get(text[at : end[end[at]]])
                    if i is not None:
                        heappush(heap, (-score[i], at, end[at], end[end[at]]))
        out, at = [], 0
        while at < n:
            out.append(text[at : end[at]])
            at = end[at]
        return out

    def _derive(self, piece: str) -> bool:
        """Whether a piece's own merges give it; its last merge is kept."""
        parts, ids, score = list(piece), self.id_of, self.score
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], k
            if best is None:
                return False
            if len(parts) == 2:
                self.halves[piece] = parts[0], parts[1]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return True

    def _spine(self, piece: str, side: int) -> list[str]:
        """The parts of a piece at its left (0) or right (1) end as its merges make them, the first character first."""
        out = self.spines.get((piece, side))
        if out is None:
            out, part = [piece], piece
            while part in self.halves:
                part = self.halves[part][side]
                out.append(part)
            out = self.spines[piece, side] = out[::-1]
        return out

    def _weight(self, a: str, b: str) -> float:
        """Of the arc from piece a to piece b in the context acceptor.

        Where scores fall with every merge, only what lies at the border of the two can join them: the parts there grow in the order of
        their scores (leftmost of equals), and the arc is finite unless a merge across the border comes first.
        """
        if not self.in_order:
            return 0.0 if self._merge(a + b) == [a, b] else INF
        left, right, ids, score = self._spine(a, 1), self._spine(b, 0), self.id_of, self.score
        i = j = 0
        while True:
            across = ids.get(left[i] + right[j])
            grow_left = score[ids[left[i + 1]]] if i + 1 < len(left) else -INF
            grow_right = score[ids[right[j + 1]]] if j + 1 < len(right) else -INF
            if across is not None and score[across] > grow_left and score[across] >= grow_right:
                return INF
            if grow_left == grow_right == -INF:
                return 0.0
            if grow_left >= grow_right:
                i += 1
            else:
                j += 1

    def _arcs_at(self, text: str, i: int) -> list[tuple[int, int]]:
        """Ends and pieces of the lexicon's arcs from a position, shortest first; without one of a character, its fallback."""
        node, j, n, out = self.arcs, i, len(text), []
        while j < n:
            node = node.get(text[j])
            j += 1
            if node is None:
                break
            piece = node.get(None)
            if piece is not None:
                out.append((j, piece))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, -1 - ord(text[i])))
        return out

    def _path_bpe(self, text: str) -> list[int]:
        """Ids along the one path of finite weight; a negative id is a character without a piece, as -1 - code point.

        Longest arcs are tried first. Only one path of finite weight leads to a position, so one from which the end
        can't be reached is never tried again.
        """
        n, pairs, dead = len(text), self.pairs, set()
        at, last, path, starts, todo = 0, None, [], [], [self._arcs_at(text, 0)]
        while todo:
            arcs = todo[-1]
            while arcs:
                j, piece = arcs.pop()
                if j in dead:
                    continue
                if last is None:
                    break
                ok = pairs.get(last << 32 ^ piece)
                if ok or ok is None and self._finite(last, piece, text, starts[-1], at, j):
                    break
            else:
                dead.add(at)
                todo.pop()
                if path:
                    path.pop()
                    at = starts.pop()
                    last = path[-1] if path else None
                continue
            path.append(piece)
            if j == n:
                return path
            starts.append(at)
            at, last = j, piece
            todo.append(self._arcs_at(text, j))
        # merges that tie outside runs of spaces
        return [self.id_of[p] if p in self.id_of else -1 - ord(p) for p in self._merge(text)]

    def _finite(self, last: int, piece: int, text: str, start: int, i: int, j: int) -> bool:
        key = last << 32 ^ piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._weight(text[start:i], text[i:j]) < INF
        return ok

    def _path_unigram(self, text: str) -> list[int]:
        """Ids along the path of greatest score, negative as above. Sums are rounded to single precision, like the scores:
        those that nearly tie are decided as models of this kind are run elsewhere."""
        n = len(text)
        best, back = [None] * (n + 1), [(-1, 0)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, j, single = self.arcs, i, False
            here = best[i]
            while j < n:
                node = node.get(text[j])
                j += 1
                if node is None:
                    break
                piece = node.get(None)
                if piece is not None:
                    single |= j == i + 1
                    total = float(np.float32(here + self.arc_score[piece]))
                    if best[j] is None or total > best[j]:
                        best[j], back[j] = total, (i, piece)
            if not single:
                total = float(np.float32(here + self.unknown_score))
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], back[i + 1] = total, (i, -1 - ord(text[i]))
        out, at = [], n
        while at > 0:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]

    def _spell(self, piece: int) -> list[int]:
        """Output of the fallback arc of a character without a piece: the ids of its bytes, or the unknown id."""
        ids = self.spelt.get(piece)
        if ids is None:
            ids = [self.byte_id[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass")]
            ids = self.spelt[piece] = [self.unknown] if None in ids else ids
        return ids

    def segment(self, text: str) -> bytes:
        """The packed ids of a normalised segment."""
        packed = self.older.get(text)
        if packed is not None:
            self._keep(text, packed)
            return packed
        if not self.bpe:
            path = self._path_unigram(text)
        elif text in self.halves:  # the path of one arc
            path = [self.id_of[text]]
        elif SPACE * 2 in text:
            path = [self.id_of[p] if p in self.id_of else -1 - ord(p) for p in self._merge(text)]
        else:
            path = self._path_bpe(text)
        ids: list[int] = []
        for p in path:
            if p >= 0:
                ids.append(p)
            else:
                ids += self._spell(p)
        packed = array(self.code, ids).tobytes()
        if len(text) <= 64:
            self._keep(text, packed)
        return packed

    def forget(self) -> None:
        """Give the memory back when a task is over: its worker lives on."""
        self.memory, self.older, self.pairs, self.spelt = {}, {}, {}, {}
        give_back()

    def _keep(self, text: str, packed: bytes) -> None:
        """Two generations of half of MEMORY each: what is not met again during a generation is forgotten."""
        if len(self.memory) >= MEMORY // 2:
            self.older, self.memory = self.memory, {}
        self.memory[text] = packed

    def _ids(self, text: str) -> bytes:
        segment = self.segment
        parts = self.cuts.findall(text) if self.cuts else [text] if text else []
        return b"".join([self.memory.get(p) or segment(p) for p in parts])

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        if self.bpe and self.symbols:
            packed, last = [], 0
            for m in self.symbols.finditer(text):
                packed += [self._ids(text[last : m.start()]), np.asarray([self.symbol_id[m[0]]], self.kind).tobytes()]
                last = m.end()
            ids = np.frombuffer(b"".join([*packed, self._ids(text[last:])]), self.kind)
        else:
            ids = np.frombuffer(self._ids(text), self.kind)
        if None in self.byte_id and len(ids) > 1:  # a run of unknown characters is one
            ids = ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]]
        return ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes; the dummy prefix's space is taken off again."""
        if not len(ids):
            return b""
        size = self.out_len[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.out_at[ids] - (ends - size), size)
        out = self.out[at].tobytes()
        if self.trim:
            return out.lstrip(b" ")
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compiled(raw: bytes) -> Transducer:
    return Transducer(raw)


def load_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; they travel to the executors as a broadcast of that fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = None) -> DataFrame:
    """documents with the text's piece ids, array<int>, in place of any column of that name.

    A null text has null ids, an empty one none. Whole texts are encoded. The ids are those of the model's own merges
    (BPE) or best path (unigram), without begin and end marks. A run of any length, of spaces too, takes time
    in proportion (spaces: n log n), and a very long text is held by its task as a whole. Columns named ids_col or check_col are replaced. check_col adds whether the ids decode to the text (null for
    a null text), found where the ids are made.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in documents.columns if c not in (ids_col, check_col)]
    rows, at = wrapped(documents.select(*[col(c) for c in keep])), keep.index(text_col)

    def run(batches):
        t = _compiled(held.value)
        for batch in batches:
            texts = batch.column(0).field(at)
            for lo in range(0, batch.num_rows, 512):
                some = texts.slice(lo, 512).to_pylist()
                ids = [t.encode(x) if x is not None else np.zeros(0, t.kind) for x in some]
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                nulls = pa.array([x is None for x in some] + [False])
                flat = pa.array(np.concatenate(ids).astype(np.int32)) if ids else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pc.if_else(nulls, pa.scalar(None, pa.int32()), pa.array(offsets)), flat)
                same = [t.decode_bytes(i) == x.encode() if x is not None else None for i, x in zip(ids, some)] if check_col else [None] * len(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), lists, pa.array(same, pa.bool_())], names=["row", "ids", "same"])
        t.forget()

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]))
    return out.select("row.*", F.col("ids").alias(ids_col), *([F.col("same").alias(check_col)] if check_col else []))


def decode(documents: DataFrame, model: bytes, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """documents with the text of their ids. Null ids give null, no ids the empty text; a literal U+2581 of the text
    encoded comes back as a space, since pieces don't tell the two apart. Bytes that are no UTF-8 become U+FFFD.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in documents.columns if c != text_col]
    rows, at = wrapped(documents.select(*[col(c) for c in keep])), keep.index(ids_col)

    def run(batches):
        t = _compiled(held.value)
        for batch in batches:
            lists, out = batch.column(0).field(at), []
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k in range(batch.num_rows):
                out.append(t.decode_bytes(values[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace") if valid[k] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])
        give_back()

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
    return out.select("row.*", F.col("text").alias(text_col))
