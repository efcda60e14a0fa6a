"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path of pieces through the text; it has the greatest sum of weights between
neighbouring pieces. For a unigram model the weight is the piece's score. For a BPE model it is 0 where
merging the two pieces' characters gives back exactly these two pieces, and minus infinity elsewhere:
then one path is left, and it is the sequence of merges over the whole text.

A document longer than ``CHUNK`` characters is cut anywhere into chunks. The state at a cut is the piece
that covers the character before it. Each chunk yields a matrix from the states at its left cut to those
at its right one; matrices multiply in the max-plus semiring, which is associative, so blocks of
chunks are multiplied side by side and only products are scanned by document. With the states at both
cuts known, every chunk is traced back by itself.

No piece goes on after a letter with the sign of a blank, so a matrix has rank one as soon as the chunk
contains a word boundary: it is the sum of a column up to the first boundary and a row from the last
one, and the words between are segmented one by one, each spelling once per worker (a table of
bounded size). Texts of one chunk start and end at such boundaries.

Characters the model lacks become byte pieces. Decoding joins the pieces' bytes.

Results in special cases: a null text gives null ids and an empty one no ids; the sign U+2581 in a text
decodes to a blank, as in the library; repeated rows are encoded alike; an empty table gives an empty
table. Columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm.arrow import column, lean
from wayloom.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
CONTEXT = 16  # characters around a cut that a piece may reach; at least the longest piece
BLOCK = 256  # chunks whose matrices are multiplied in one task
MEMO = 120_000
BLANK = "▁"
_MINUS = float("-inf")


class Pieces:
    """A model's pieces and the segmentation of texts and parts of texts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        pieces = [(i, p.piece, p.score, p.type) for i, p in enumerate(proto.pieces)]
        kind = pb.ModelProto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        ordinary = [(i, p, s) for i, p, s, t in pieces if t in (kind.NORMAL, kind.USER_DEFINED)]
        self._finish(ordinary, {int(p[3:5], 16): i for i, p, _, t in pieces if t == kind.BYTE}, len(pieces))

    @classmethod
    def of(cls, scores: dict[str, float], bpe: bool) -> Pieces:
        """From pieces and scores, without byte pieces; for tests."""
        self = cls.__new__(cls)
        self.bpe, self.prefix = bpe, False
        self._finish([(i, p, s) for i, (p, s) in enumerate(scores.items())], {}, len(scores))
        return self

    def _finish(self, ordinary: list[tuple[int, str, float]], byte: dict[int, int], size: int) -> None:
        self.score = {i: s for i, _, s in ordinary}
        self.spelled = {i: p for i, p, _ in ordinary}
        self.byte = byte
        self.least = min(self.score.values(), default=0.0) - 10
        if max((len(p) for _, p, _ in ordinary), default=1) > CONTEXT:
            raise ValueError(f"a piece is longer than {CONTEXT} characters")
        #: Every beginning of a piece; the piece's id, or -1 where none ends.
        self.trie: dict[str, int] = {}
        for i, p, _ in ordinary:
            for n in range(1, len(p)):
                self.trie.setdefault(p[:n], -1)
            self.trie[p] = i
        #: The same by characters: the id, and what may follow.
        self.tree: dict[str, tuple[int, dict]] = {}
        nodes, leaf = {"": self.tree}, {}
        inner = {p[:-1] for p in self.trie}
        for p in sorted(self.trie, key=len):
            nodes[p] = {} if p in inner else leaf
            nodes[p[:-1]][p[-1]] = (self.trie[p], nodes[p])
        self.splits = not any(BLANK in p.lstrip(BLANK) for _, p, _ in ordinary)
        line = "\n" not in "".join(self.trie)
        self.units = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if line else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.cut = re.compile(f"(?<=[^{BLANK}])(?={BLANK})" + ("|(?<=\n)|(?=\n)" if line else ""))
        self.size = size
        self.scores = {p: s for _, p, s in ordinary}
        self.courses: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self)
        # For decoding: the bytes of each id, one after the other.
        raw = [b""] * size
        for i, p in self.spelled.items():
            raw[i] = p.replace(BLANK, " ").encode()
        for b, i in byte.items():
            raw[i] = bytes([b])
        self.length = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    # Weights -----------------------------------------------------------------------------------

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, float, float]], list[tuple[str, float, float]]]:
        """BPE of a short text by its definition: the best merge first, the leftmost of equals.

        Returns the parts, and the parts that stood at the left and at the right end in the course of
        it, each with the scores of the merges that made it and that ended it."""
        parts, score = list(text), self.scores.get
        ends = [[[parts[k], float("inf"), _MINUS]] for k in (0, -1)]
        while len(parts) > 1:
            best, at = _MINUS, -1
            for k in range(len(parts) - 1):
                x = score(parts[k] + parts[k + 1], _MINUS)
                if x > best:
                    best, at = x, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            for end, k in zip(ends, (0, -1)):
                if end[-1][0] != parts[k]:
                    end[-1][2] = best
                    end.append([parts[k], best, _MINUS])
        return parts, *[[tuple(x) for x in end] for end in ends]

    def _course(self, i: int):
        """How piece ``i`` comes about: parts at its left and right end; None if BPE never makes it."""
        if i not in self.courses:
            parts, left, right = self.merged(self.spelled[i])
            self.courses[i] = (left, right) if len(parts) == 1 else None
        return self.courses[i]

    def _fit(self, before: int | None, i: int) -> bool:
        """Whether merging the characters of both pieces gives these two pieces again: no part at the
        right end of the first may merge with one at the left end of the second while both stand."""
        b = self._course(i)
        if before is None or before < 0 or b is None:
            return b is not None
        a = self._course(before)
        if a is None:
            return False
        falling = all(x[1] > x[2] for x in [*a[1], *b[0]])
        if not falling:  # scores that rise in the course of merging say nothing about its order
            return self.merged(self.spelled[before] + self.spelled[i])[0] == [self.spelled[before], self.spelled[i]]
        score = self.scores.get
        for x, x_from, x_to in a[1]:
            for y, y_from, y_to in b[0]:
                ends = max(x_to, y_to)
                if min(x_from, y_from) > ends:
                    both = score(x + y)
                    if both is not None and (both > ends or both == y_to > x_to):
                        return False
        return True

    def weight(self, before: int | None, i: int) -> float | None:
        """Weight of piece ``i`` after ``before``; None if it can't follow. Below 0: an unknown character."""
        if not self.bpe:
            return self.score[i] if i >= 0 else self.least
        if i < 0:
            return 0.0
        key = (0 if before is None or before < 0 else before + 1) * self.size + i
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= 2 * MEMO:
                self.fits.clear()
            fit = self.fits[key] = self._fit(before, i)
        return 0.0 if fit else None

    def matches(self, text: str, s: int) -> Iterator[tuple[int, int]]:
        """Pieces that begin at ``s``, with their ends."""
        e, get = s + 1, self.trie.get
        if get(text[s:e], -1) < 0:
            yield -1 - ord(text[s]), e
        while e <= len(text):
            i = get(text[s:e])
            if i is None:
                return
            if i >= 0:
                yield i, e
            e += 1

    # Segmentation ------------------------------------------------------------------------------

    def sweep(self, text: str, begin: dict[int, dict[int | None, tuple]], stop: int) -> tuple[dict, dict]:
        """Best sums from each of some beginnings to every piece that ends at or after ``stop``.

        ``begin``: by place, by the piece that ends there, the sums so far, one for each beginning.
        Returns all sums with the way back, and those of the last pieces by (start, end)."""
        table = {at: {i: (v, None) for i, v in cell.items()} for at, cell in begin.items()}
        last: dict[tuple[int, int], tuple] = {}
        for s in range(min(begin, default=stop), stop):
            cell = table.get(s)
            if not cell:
                continue
            for i, e in self.matches(text, s):
                best, back = None, None
                for before, (v, _) in cell.items():
                    w = self.weight(before, i)
                    if w is None:
                        continue
                    v = tuple(x + w for x in v)
                    if best is None:
                        best, back = v, before
                    else:
                        if max(v) > max(best):
                            back = before
                        best = tuple(map(max, best, v))
                if best is not None:
                    if e < stop:
                        table.setdefault(e, {})[i] = (best, (s, back))
                    else:
                        last[s, e] = (best, i, back)
        return table, last

    def word(self, text: str) -> list[int]:
        """The segmentation of a text between two boundaries."""
        if not self.bpe:
            return self.trace(text, {0: {None: (0.0,)}}, len(text), None)
        # One path leads to each place, so going back from a place that leads nowhere closes it.
        n, first, fits, size = len(text), self.tree.get, self.fits, self.size
        path: list[int] = []
        left: list[tuple[list, int | None, int]] = []
        before: int | None = None
        e = key = 0
        while True:
            found = []
            node = first(text[e])
            if node is None or node[0] < 0:
                found.append((-1 - ord(text[e]), e + 1))
            while node is not None:
                e += 1
                if node[0] >= 0:
                    found.append((node[0], e))
                if e == n:
                    break
                node = node[1].get(text[e])
            while True:
                if not found:
                    found, before, key = left.pop()
                    path.pop()
                    continue
                i, e = found.pop()  # the longest first
                fit = i < 0 or fits.get(key + i)
                if fit is None:
                    fit = self.weight(before, i) is not None
                if fit:
                    break
            path.append(i)
            if e == n:
                return path
            left.append((found, before, key))
            before, key = i, (i + 1) * size if i >= 0 else 0

    def trace(self, text: str, begin: dict, stop: int, target: tuple[int, int] | None) -> list[int]:
        """Pieces of the best path from one beginning to the piece ``target`` (start, end), or to ``stop``."""
        table, last = self.sweep(text, begin, stop)
        if target is None:
            ends = {k: v for k, v in last.items() if k[1] == stop}
            if not ends:
                return []
            target = max(ends, key=lambda k: ends[k][0][0])
        _, i, before = last[target]
        out, s = [i], target[0]
        while table[s][before][1] is not None:
            out.append(before)
            s, before = table[s][before][1]
        return out[::-1]

    def ids(self, pieces: list[int]) -> bytes:
        """Ids as bytes; an unknown character becomes its bytes' pieces (or, without those, id 0)."""
        if min(pieces, default=0) < 0:
            flat = []
            for i in pieces:
                flat += [i] if i >= 0 else [self.byte.get(b, 0) for b in chr(-1 - i).encode("utf-8", "replace")]
            pieces = flat
        return array("i", pieces).tobytes()

    def normal(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, normal: str) -> bytes:
        """Ids of a normalized text that begins and ends at boundaries."""
        if not self.splits:
            return self.ids(self.word(normal))
        return b"".join(map(self.memo.__getitem__, self.units.findall(normal)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        first = np.cumsum(n) - n
        return self.pool[np.repeat(self.begin[ids] - first, n) + np.arange(int(n.sum()))]

    # Chunks ------------------------------------------------------------------------------------

    def states(self, left: str, right: str) -> list[tuple[int, int, int]]:
        """Pieces that may cover the character before a cut: characters before and after the cut, id."""
        out = []
        for back in range(1, min(CONTEXT, len(left)) + 1):
            for ahead in range(min(CONTEXT - back, len(right)) + 1):
                i = self.trie.get(left[len(left) - back :] + right[:ahead], -1)
                if i >= 0:
                    out.append((back, ahead, i))
        if left and self.trie.get(left[-1], -1) < 0:
            out.append((1, 0, -1 - ord(left[-1])))
        return sorted(out)

    def _edges(self, left: str, body: str) -> tuple[int, int] | None:
        """First and last boundary within the body, as places of left + body."""
        if not self.splits:
            return None
        text = left + body
        places = [m.start() for m in self.cut.finditer(text, max(len(left), 0)) if len(left) < m.start() < len(text)]
        return (places[0], places[-1]) if places else None

    def matrix(self, left: str, body: str, right: str) -> np.ndarray:
        """Best sums from each state at the left cut to each one at the right cut."""
        text, p, q = left + body + right, len(left), len(left) + len(body)
        rows = self.states(left, body + right) or [(0, 0, None)]
        cols = self.states((left + body)[-CONTEXT:], right)
        out = np.full((len(rows), len(cols)), _MINUS)
        unit = [tuple(0.0 if k == r else _MINUS for k in range(len(rows))) for r in range(len(rows))]
        begin: dict[int, dict] = {}
        for r, (back, ahead, i) in enumerate(rows):
            if ahead >= len(body) and back:  # the piece goes on beyond this chunk
                for c, (b2, a2, i2) in enumerate(cols):
                    if (b2, a2, i2) == (back + len(body), ahead - len(body), i):
                        out[r, c] = 0.0
            if ahead < len(body):
                cell = begin.setdefault(p + ahead, {})
                cell[i] = tuple(map(max, cell[i], unit[r])) if i in cell else unit[r]
        edges = self._edges(left, body)
        if edges and all(at <= edges[0] for at in begin):
            first, final = edges
            _, last = self.sweep(text[:first], {a: c for a, c in begin.items() if a < first}, first)
            to_first = [v for (_, e), (v, _, _) in last.items() if e == first]
            to_first += list(begin.get(first, {}).values())
            middle = 0.0 if self.bpe else sum(self._sum(u) for u in self.units.findall(text[first:final]))
            column_ = np.max(np.array(to_first), axis=0) if to_first else np.full(len(rows), _MINUS)
            _, last = self.sweep(text, {final: {None: (0.0,)}}, q)
            for c, (b, a, i) in enumerate(cols):
                found = last.get((q - b, q + a))
                if found and found[1] == i:
                    out[:, c] = np.maximum(out[:, c], column_ + middle + found[0][0])
        else:
            _, last = self.sweep(text, begin, q)
            for c, (b, a, i) in enumerate(cols):
                found = last.get((q - b, q + a))
                if found and found[1] == i:
                    out[:, c] = np.maximum(out[:, c], np.array(found[0]))
        return out

    def _sum(self, unit: str) -> float:
        return sum(self.score.get(i, self.least) for i in self.word(unit))

    def chunk_ids(self, left: str, body: str, right: str, row: int, col: int) -> bytes:
        """Ids of the pieces that begin in the body, on the path from state ``row`` to state ``col``."""
        text, p, q = left + body + right, len(left), len(left) + len(body)
        rows = self.states(left, body + right) or [(0, 0, None)]
        back, ahead, i = rows[row]
        b, a, _ = self.states((left + body)[-CONTEXT:], right)[col]
        if ahead >= len(body) and back:
            return b""
        edges = self._edges(left, body)
        begin = {p + ahead: {i: (0.0,)}}
        if not edges or p + ahead > edges[0]:
            return self.ids(self.trace(text, begin, q, (q - b, q + a)))
        first, final = edges
        head = b"" if p + ahead == first else self.ids(self.trace(text[:first], begin, first, None))
        tail = self.ids(self.trace(text, {final: {None: (0.0,)}}, q, (q - b, q + a)))
        return head + (self.encode(text[first:final]) if first < final else b"") + tail


class _Memo(dict):
    """Ids of words seen by this worker. When ``MEMO`` words are held they become the old ones, which are still
    looked up until the next such turn, so that frequent words stay while rare ones go."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.pieces.ids(self.pieces.word(word))
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def _load(model: bytes) -> Pieces:
    return Pieces(model)


def _model(spark, path: str):
    """The model's bytes (about half a megabyte) for the workers; read where the driver sees the path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the max-plus semiring."""
    with np.errstate(invalid="ignore"):
        return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=_MINUS)


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int64).tobytes() + m.astype(np.float64).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64, offset=16).reshape(np.frombuffer(raw, np.int64, 2))


def _choose(matrices: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """State after each matrix on the best path from ``enter``; the last is ``leave`` if given."""
    ahead = [np.full(1, 0.0)] * len(matrices)
    vector = np.full(matrices[0].shape[0], _MINUS)
    vector[enter] = 0.0
    for k, m in enumerate(matrices):
        vector = np.max(vector[:, None] + m, axis=0, initial=_MINUS)
        ahead[k] = vector
    state = int(np.argmax(ahead[-1])) if leave is None else leave
    out = [state]
    for k in range(len(matrices) - 1, 0, -1):
        state = int(np.argmax(ahead[k - 1] + matrices[k][:, state]))
        out.append(state)
    return out[::-1]


def _states_of_chunks(chunks: DataFrame, model) -> DataFrame:
    """Rows key, chunk, enter, leave: the numbers of the states at both cuts of each chunk."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model.value)
        for b in batches:
            parts = zip(*[column(b, c).to_pylist() for c in ("left", "body", "right")], strict=True)
            packed = [_pack(pieces.matrix(*x)) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [column(b, "key"), column(b, "chunk"), pa.array(packed, pa.binary())], names=["key", "chunk", "m"]
            )

    every = materialize(
        chunks.mapInArrow(lean(matrices), "key long, chunk long, m binary").withColumn("block", F.expr(f"chunk div {BLOCK}")),
        "matrices",
    )

    def product(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        m = _unpack(g.m.iloc[0])
        for raw in g.m.iloc[1:]:
            m = times(m, _unpack(raw))
        return pd.DataFrame({"key": g.key.iloc[:1], "block": g.block.iloc[:1], "m": [_pack(m)]})

    def over_blocks(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        leave = _choose([_unpack(x) for x in g.m], 0, None)
        return pd.DataFrame({"key": g.key, "block": g.block, "b_enter": [0, *leave[:-1]], "b_leave": leave})

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        enter = int(g.b_enter.iloc[0])
        leave = _choose([_unpack(x) for x in g.m], enter, int(g.b_leave.iloc[0]))
        return pd.DataFrame({"key": g.key, "chunk": g.chunk, "enter": [enter, *leave[:-1]], "leave": leave})

    blocks = every.groupBy("key", "block").applyInPandas(product, "key long, block long, m binary")
    cuts = blocks.groupBy("key").applyInPandas(over_blocks, "key long, block long, b_enter int, b_leave int")
    return every.join(cuts, ["key", "block"]).groupBy("key", "block").applyInPandas(
        within, "key long, chunk long, enter int, leave int"
    )


def _checked(pieces: Pieces, ids: list[bytes], plain: list[str]) -> list:
    """Columns ids, n_tokens and round_trip of texts and their ids."""
    counts = [len(x) // 4 for x in ids]
    flat = np.frombuffer(b"".join(ids), np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    same = [
        pieces.decode(flat[offsets[k] : offsets[k + 1]]).tobytes() == t.encode("utf-8", "replace")
        for k, t in enumerate(plain)
    ]
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts, pa.int64()), pa.array(same)]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Rows doc_id, chunk, ids, n_tokens, round_trip: the ids of the pieces that begin in each chunk.

    Texts of one chunk are encoded where they are read. Chunks of longer ones are written to the shared
    folder and spread over the cluster by (document, chunk)."""
    held = _model(docs.sparkSession, model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    fields = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType())]
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("chunk", T.LongType())] + [T.StructField(*f) for f in fields]
    )
    names = [f.name for f in schema]
    long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = column(b, "text").to_pylist()
                ids = [pieces.encode(pieces.normal(x)) if x else b"" for x in texts]
                plain = [(" " if pieces.prefix and x else "") + (x or "") for x in texts]
                lists, n, same = _checked(pieces, ids, plain)
                missing = pa.array([x is None for x in texts])
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=missing)
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id"), pa.array(np.zeros(b.num_rows, np.int64)), lists, n, same], names=names
                )

    pieced = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("chunk", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("left", "body", "right")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(held.value)
        for b in batches:
            for r in range(b.num_rows):
                normal = pieces.normal(column(b, "text")[r].as_py())
                for lo in range(0, len(normal), 64 * chunk):
                    at = list(range(lo, min(lo + 64 * chunk, len(normal)), chunk))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([column(b, "key")[r].as_py()] * len(at), pa.int64()),
                            pa.array([column(b, "doc_id")[r].as_py()] * len(at), b.schema.field("doc_id").type),
                            pa.array([s // chunk for s in at], pa.int64()),
                            pa.array([normal[max(0, s - CONTEXT) : s] for s in at]),
                            pa.array([normal[s : s + chunk] for s in at]),
                            pa.array([normal[s + chunk : s + chunk + CONTEXT] for s in at]),
                        ],
                        names=[f.name for f in pieced],
                    )

    keyed = rows.filter(long).withColumn("key", F.monotonically_increasing_id())
    chunks = materialize(keyed.mapInArrow(lean(cut), pieced), "chunks")
    states = _states_of_chunks(chunks, held)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 16):
                b = whole.slice(lo, 16)
                parts = list(zip(*[column(b, c).to_pylist() for c in ("left", "body", "right", "enter", "leave")], strict=True))
                ids = [pieces.chunk_ids(*x) for x in parts]
                # The pieces that begin in the chunk spell it but for what the states at its cuts reach over.
                spelled = []
                for left, body, right, enter, leave in parts:
                    rows_ = pieces.states(left, body + right) or [(0, 0, None)]
                    skip = rows_[enter][1]
                    ahead = pieces.states((left + body)[-CONTEXT:], right)[leave][1]
                    part = body[skip:] + right[:ahead] if skip < len(body) else ""
                    spelled.append(part.replace(BLANK, " "))
                columns = _checked(pieces, ids, spelled)
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "chunk"), *columns], names=names)

    encoded = chunks.join(states, ["key", "chunk"]).drop("key").mapInArrow(lean(back), schema)
    return rows.filter(~long).mapInArrow(lean(short), schema).unionByName(encoded)


def decode(tokens: DataFrame, ids: str = "ids", model: str = MODEL, first: str | None = "chunk") -> DataFrame:
    """``tokens`` with ``decoded``: the text of the ids, without the blank that encoding puts before a text.

    Of a long document's rows only the one with ``first`` = 0 loses that blank; joined in order they
    are the document's text. A row's bytes that are no UTF-8 become U+FFFD."""
    from wayloom.llm.arrow import with_columns

    held = _model(tokens.sparkSession, model)

    def run(b: pa.RecordBatch) -> list:
        pieces = _load(held.value)
        starts = column(b, first).to_pylist() if first else [0] * b.num_rows
        out = []
        for x, s in zip(column(b, ids).to_pylist(), starts, strict=True):
            if x is None:
                out.append(None)
                continue
            t = pieces.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace")
            out.append(t[1:] if s == 0 and pieces.prefix and t[:1] == " " else t)
        return [pa.array(out, pa.string())]

    return with_columns(tokens, "decoded string", run)


def query(docs: DataFrame) -> DataFrame:
    return encode(docs)
