"""N-gram Jaccard join on parity sketches.

A document's set is its distinct shingles of five words (A-Z in lower case). Sets are grouped into size
bands. In a band each shingle is dealt to one of P parts by hash, and a part's sketch is the XOR of its
shingles' hashes. A shingle that only one of two sets holds changes one part, so the parts in which two
sketches differ are at most as many as the symmetric difference, and a similarity of 0.8 bounds
that by (|A| + |B|) / 9, a quarter of the smaller set. With more non-empty parts than that one must be equal
(pigeonhole): documents are joined on (band, part, XOR), exactly, without a cap. A set whose shingles
leave too few parts non-empty is dealt again with further seeds until they don't; two such
sets then share a later dealing. A set near the upper end of its band also joins the next band.

Keys are packed by bucket into one row per batch and bucket, after documents of one batch with an equal key
have been replaced by the smallest of them: a text that a third of all documents hold adds one entry per
batch. In a bucket every document with a key is paired with the key's smallest one, so a group of g
documents gives g - 1 candidate pairs. Those within the bounds of size and of differing parts are verified on
the whole shingle sets.

That is enough for all groups but those where a pair failed: there any two documents may still be
similar. The groups of one smallest document that aren't in one component yet are one cluster, whose documents
are compared in blocks of bounded size, first by their sketches: documents with a partner of another component
within the same two bounds go on. Of these the whole sets are compared in blocks: pairs within the bounds are
verified on the spot, and a link makes two components one. A pair of blocks gives out its links only,
fewer than its documents, and every pair within the bounds is verified or lies within a component.
Links are joined into components.

Results in special cases: null texts and texts without words have the empty set, link with nothing and are
their own component; fewer than five words are one shingle; rows with a null id link with nothing
and have a null component; rows that repeat an id are one document, whose rows are returned each; an
empty table gives an empty table. Extra columns are not read, except by ``deduplicate``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, lean, lean_group
from wayloom.llm.components import components, only
from wayloom.operators.skew import salted_join
from wayloom.session import materialize

SHINGLE = 5
BAND = 1.5  # ratio of the sizes in a band
BUCKET_BYTES = 32 << 20  # of text for each bucket of keys
MIN_BUCKETS = 64
SEEDS = 64
_CODE = np.uint64(4095)  # bands up to 64, so sets of up to 10 ** 11 shingles
BLOCK_BYTES = 8 << 20  # of sketches or shingles for a block in the comparison of failed groups
CALL_BYTES = 24 << 20  # that are compared in one call
BATCH_BYTES = 4 << 20  # of text whose keys are packed at a time


class Sets(NamedTuple):
    doc: np.ndarray  # row of each shingle
    shingle: np.ndarray  # distinct within a row, ascending
    size: np.ndarray  # by row


def shingle_sets(texts: pa.Array) -> Sets:
    """The shingle sets of a slice of texts."""
    w = words.split(texts, lower=True)
    h = words.hashes(w.data, w.start, w.end)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    grams = words.grams(h, SHINGLE)
    whole = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    owner, value = doc[: len(grams)][whole], grams[whole]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short = [words.grams(h[w.first[i] : w.first[i + 1]], int(n[i]), int(n[i])) for i in few]
    owner = np.concatenate([owner, few])
    value = np.concatenate([value, *short]) if short else value
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return Sets(owner, value, np.bincount(owner, minlength=len(n)))


def _bands(largest: int) -> np.ndarray:
    """Smallest size of each band, until beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


def _parts_of(top: np.ndarray) -> np.ndarray:
    """Number of parts for sets of up to ``top`` shingles: enough stay non-empty in nearly all."""
    return (np.ceil(0.27 * top) + np.ceil(0.3 * np.sqrt(top)) + 1).astype(np.int64)


class Sketches(NamedTuple):
    doc: np.ndarray  # of each non-empty part: the row
    key: np.ndarray  # and a hash of (code, part, XOR) whose low bits are the code
    owner: np.ndarray  # of each sketch: the row
    code: np.ndarray  # and SEEDS * the band + the seed
    begin: np.ndarray  # and its first place in ``xor``; one more at the end
    xor: np.ndarray


def sketches(sets: Sets, fine: bool = False) -> list[Sketches]:
    """Parity sketches in each set's own band, and in the next for sets that can link into it. ``fine``
    ones have about a part for each shingle, which bounds the difference more closely."""
    bands = _bands(int(sets.size.max(initial=0)) + 1)
    own = np.searchsorted(bands, sets.size, "right") - 1
    some = sets.size > 0
    bands = np.append(bands, max(bands[-1] + 1, int(bands[-1] * BAND)))
    out = []
    for up in (0, 1):
        rows = some if not up else some & (5 * sets.size >= 4 * bands[np.minimum(own + 1, len(bands) - 1)])
        for seed in range(SEEDS):
            if not rows.any():
                break
            s = _sketch(sets, rows, own + up, bands, seed)
            full = np.bincount(s.doc, minlength=len(rows))
            out.append(_sketch(sets, rows, own + up, bands, seed, fine) if fine else s)
            rows = rows & (full <= sets.size // 4)
    return out


def _sketch(sets: Sets, rows: np.ndarray, band: np.ndarray, bands: np.ndarray, seed: int, fine: bool = False) -> Sketches:
    owner = np.flatnonzero(rows)
    top = bands[np.minimum(band[owner] + 1, len(bands) - 1)] - 1
    parts = top if fine else _parts_of(top)
    begin = np.concatenate([[0], np.cumsum(parts)])
    place = np.zeros(len(rows), np.int64)
    place[owner] = np.arange(len(owner))
    take = rows[sets.doc]
    at, value = place[sets.doc[take]], sets.shingle[take]
    shift = np.uint64(0x9E3779B97F4A7C15 * (4 * seed + 1 + 2 * fine) & (1 << 64) - 1)
    deal = words.mix(value + shift) >> np.uint64(32)
    part = begin[at] + ((deal * parts[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    xor = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(xor, part, value)
    full = np.zeros(begin[-1], bool)
    full[part] = True
    found = np.flatnonzero(full)
    which = np.searchsorted(begin, found, "right") - 1
    code = band[owner] * SEEDS + seed
    salt = words.mix((code[which].astype(np.uint64) << np.uint64(40)) + (found - begin[which]).astype(np.uint64))
    key = words.mix(xor[found] ^ salt) & ~_CODE | code[which].astype(np.uint64)
    return Sketches(owner[which], key, owner, code, begin, xor)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))


def _keys(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (key, id) of a batch and the set sizes of its rows."""
    keys, owners, sizes = [], [], []
    for lo, hi in words.slices(texts):
        sets = shingle_sets(texts.slice(lo, hi - lo))
        sizes.append(sets.size)
        for s in sketches(sets):
            keys.append(s.key)
            owners.append(ids[lo:hi][s.doc])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(keys, np.uint64), join(owners, np.int64), join(sizes, np.int64)


def _smallest(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys once, each with its smallest document, and rows (document, smallest, key) of the others."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = doc[first][np.cumsum(first) - 1]
    other = doc != head
    return key[first], doc[first], np.stack([doc[other], head[other], key[other].view(np.int64)])


def _candidates(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows kind, a, b, key: kind 0 a candidate pair and the key it shares, kind 1 a row's id and set size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in words.slices(column(whole, "text"), BATCH_BYTES):
                b = whole.slice(lo, hi - lo)
                ids = column(b, "id").to_numpy()
                key, doc, sizes = _keys(ids, column(b, "text"))
                key, doc, pairs = _smallest(key, doc)
                bucket = (key >> np.uint64(32)).astype(np.int64) * buckets >> 32
                cut = np.searchsorted(bucket, np.arange(buckets + 1))  # keys ascend, so buckets do
                some = np.flatnonzero(np.diff(cut))
                where = [*some.tolist(), *[-1 - int(ids[0]) % buckets] * 2]
                left = [key[cut[k] : cut[k + 1]].tobytes() for k in some] + [pairs.tobytes(), ids.tobytes()]
                right = [doc[cut[k] : cut[k + 1]].tobytes() for k in some] + [b"", sizes.tobytes()]
                what = [0] * len(some) + [1, 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int64()), pa.array(what, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["bucket", "what", "l", "r"],
                )

    def meet(t: pa.Table) -> pa.Table:
        pairs, sizes = [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        key, doc = [], []
        for what, x, y in zip(*(t.column(c).to_pylist() for c in ("what", "l", "r")), strict=True):
            if what == 0:
                key.append(np.frombuffer(x, np.uint64))
                doc.append(np.frombuffer(y, np.int64))
            elif what == 1:
                pairs.append(np.frombuffer(x, np.int64).reshape(3, -1))
            else:
                sizes.append(np.stack([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)]))
        if key:
            pairs.append(_smallest(np.concatenate(key), np.concatenate(doc))[2])
        (a, b, k), (v, n) = np.concatenate(pairs, 1), np.concatenate(sizes, 1)
        kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(v)])
        return pa.table(
            {"kind": kind, "a": np.append(a, v), "b": np.append(b, n), "key": np.append(k, np.zeros_like(v))}
        )

    packed = rows.mapInArrow(lean(pack), "bucket long, what int, l binary, r binary")
    return packed.groupBy("bucket").applyInArrow(lean_group(meet), "kind int, a long, b long, key long")


def _sketch_table(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows v, code, size, parts: the fine sketches of some documents, four bits of each part's XOR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = column(b, "id").to_numpy(), column(b, "text")
            for lo, hi in words.slices(texts):
                sets = shingle_sets(texts.slice(lo, hi - lo))
                for s in sketches(sets, fine=True):
                    low = s.xor.astype(np.uint8) & np.uint8(15)
                    packed = [_packed(low[s.begin[k] : s.begin[k + 1]]).tobytes() for k in range(len(s.owner))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][s.owner]), pa.array(s.code), pa.array(sets.size[s.owner]), pa.array(packed, pa.binary())],
                        names=["v", "code", "size", "parts"],
                    )

    # A row that repeats an id with another text has sketches of its own, and may be the one that links.
    return only(rows, "id", ids).mapInArrow(lean(run), "v long, code long, size long, parts binary").distinct()


def _packed(low: np.ndarray) -> np.ndarray:
    """Four-bit parts, sixteen to a word."""
    low = np.append(low, np.zeros(-len(low) % 16, np.uint8))
    return (low[::2] << 4 | low[1::2]).view(np.uint64)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of parts in which packed sketches differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def _near(size_a, size_b, differ):
    """What the bounds leave: sizes within 0.8 and no more differing parts than the symmetric difference may have."""
    return (100 * np.minimum(size_a, size_b) >= 80 * np.maximum(size_a, size_b)) & (9 * differ <= size_a + size_b)


def _plausible(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Of the pairs (a, b, code) those whose sketches are near enough, as distinct (a, b)."""
    side = lambda v: table.select(
        F.col("v").alias(v), "code", F.col("size").alias(f"size_{v}"), F.col("parts").alias(f"parts_{v}")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = [
                int(_differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                for x, y in zip(column(b, "parts_a"), column(b, "parts_b"), strict=True)
            ]
            near = _near(column(b, "size_a").to_numpy(), column(b, "size_b").to_numpy(), np.array(differ, np.int64))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(near)) for c in (column(b, "a"), column(b, "b"))], names=["a", "b"]
            )

    # The smallest document of a large cluster is in many pairs.
    joined = salted_join(pairs, side("b"), ["b", "code"], ["a"]).join(side("a"), ["a", "code"])
    return joined.mapInArrow(lean(check), "a long, b long").distinct()


def similar(size_a: np.ndarray, size_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return 100 * both >= 80 * (size_a + size_b - both)


def _set_table(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows v, s: the whole shingle sets of some documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "text")
            for lo, hi in words.slices(texts):
                s = shingle_sets(texts.slice(lo, hi - lo))
                cut = np.searchsorted(s.doc, np.arange(hi - lo + 1))
                packed = [s.shingle[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [words.in_row_order(b, lo, hi, "id"), pa.array(packed, pa.binary())], names=["v", "s"]
                )

    return only(rows, "id", ids).mapInArrow(lean(sets), "v long, s binary")


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether their whole sets are similar."""
    found = _set_table(rows, pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct())
    left = found.select(F.col("v").alias("a"), F.col("s").alias("sa"))
    right = found.select(F.col("v").alias("b"), F.col("s").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(column(b, "sa"), column(b, "sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = np.count_nonzero(y[at] == x) if len(y) else 0
                ok.append(bool(similar(len(x), len(y), both)) and both > 0)
            yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    joined = salted_join(pairs.select("a", "b"), right, ["b"], ["a"]).join(left, "a").select("a", "b", "sa", "sb")
    checked = joined.mapInArrow(lean(check), "a long, b long, ok boolean")
    # Rows that repeat an id have a set each; the document links if one of them does.
    return checked.groupBy("a", "b").agg(F.max("ok").alias("ok"))


def _members(pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows key, v: the documents of the groups in which a pair failed. ``pairs``: all (a, b, key)."""
    keys = pairs.join(failed, ["a", "b"], "left_semi").select("key").distinct()
    own = salted_join(pairs, keys, ["key"], ["a"], "left_semi")
    return own.select("key", F.col("a").alias("v")).unionByName(own.select("key", F.col("b").alias("v"))).distinct()


def _clusters(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows head, code, v, component: the documents of groups that aren't in one component yet, by smallest document."""
    members = members.join(groups, "v", "left").withColumn("component", F.coalesce("component", "v"))
    members = materialize(members, "members")
    # Groups of two have been compared, and those whose documents are all in one component are done.
    open_keys = (
        members.groupBy("key")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"), F.min("v").alias("head"))
        .filter("c0 < c1 and n > 2")
        .select("key", "head", F.col("key").bitwiseAND(F.lit(int(_CODE))).alias("code"))
    )
    # The groups of one smallest document hold much the same documents, and are compared as one cluster.
    return materialize(salted_join(members, open_keys, ["key"], ["v"]).select("head", "code", "v", "component").distinct(), "clusters")


def _by_blocks(clusters: DataFrame, sizes: DataFrame, weight: int, held: DataFrame, on: list[str], what: str, compare, schema: str) -> DataFrame:
    """``compare(code, rows, side)`` for all pairs of blocks of each cluster. ``held`` gives each document its bytes
    ``what``, about ``weight`` for a shingle. ``side`` tells the block of each row; None within one block."""
    size = sizes.groupBy("v").agg(F.sum("n_shingles").alias("n"))  # an id may be on several rows
    bulk = clusters.join(size, "v").groupBy("head", "code").agg((weight * F.sum("n")).alias("bytes"))
    bulk = materialize(bulk.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")), "blocks")
    total = bulk.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    dealt = salted_join(clusters, bulk.drop("bytes"), ["head", "code"], ["v"]).join(held, on)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v", what), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).drop("blocks")
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    bucket = F.pmod(F.xxhash64("head", "code", "i", "j"), F.lit(max(1, -(-total // CALL_BYTES))))

    def run(t: pa.Table) -> pa.Table:
        code, head, i, j, own = (t.column(c).to_numpy() for c in ("code", "head", "i", "j", "own"))
        order = np.lexsort((j, i, code, head))
        begin = np.flatnonzero(np.append(True, np.any([np.diff(x[order]) != 0 for x in (head, code, i, j)], axis=0)))
        out = []
        for at in np.split(order, begin[1:]):
            side = None if i[at[0]] == j[at[0]] else own[at] == i[at[0]]
            if len(at) > 1 and (side is None or 0 < side.sum() < len(at)):
                out.append(compare(int(code[at[0]]), t.take(pa.array(at)).combine_chunks(), side))
        return pa.concat_tables(out) if out else compare(0, t.slice(0, 0).combine_chunks(), None)

    return dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lean_group(run), schema)


def _near_ones(code: int, t: pa.Table, side: np.ndarray | None) -> pa.Table:
    """Rows whose sketch is within the bounds of one in another component."""
    size, group = t.column("size").to_numpy(), t.column("component").to_numpy()
    parts = np.frombuffer(b"".join(t.column("parts").to_pylist()), np.uint64).reshape(max(t.num_rows, 1), -1)[: t.num_rows]
    near = np.zeros(t.num_rows, bool)
    left = np.arange(t.num_rows) if side is None else np.flatnonzero(side)
    right = left if side is None else np.flatnonzero(~side)
    for at, k in enumerate(left):
        some = right[at + 1 :] if side is None else right
        some = some[(group[some] != group[k]) & _near(size[some], size[k], 0)]
        some = some[_near(size[some], size[k], _differing(parts[some], parts[k]))]
        near[some] = True
        near[k] |= len(some) > 0
    return t.select(["head", "code", "v"]).filter(pa.array(near))


def _joining_links(code: int, t: pa.Table, side: np.ndarray | None) -> pa.Table:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
    ids = t.column("v").to_numpy()
    a, b = ids[joining(sets, code, t.column("component").to_numpy(), side)] if sets else np.zeros((2, 0), np.int64)
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _rest(clusters: DataFrame, sizes: DataFrame, table: DataFrame, named: DataFrame) -> DataFrame:
    """Rows a, b: verified links that join two components within a cluster. ``sizes``: rows v, n_shingles of all
    documents. Sketches are compared first; whole sets travel only for documents that have a partner within the bounds."""
    near = _by_blocks(clusters, sizes, 1, table, ["v", "code"], "parts", _near_ones, "head long, code long, v long")
    near = materialize(near.distinct(), "near")
    some = materialize(clusters.join(near, ["head", "code", "v"], "left_semi"), "near-clusters")
    sets = _set_table(named, some.select("v").distinct())
    return _by_blocks(some, sizes, 8, sets, ["v"], "s", _joining_links, "a long, b long").distinct()


def joining(sets: list[np.ndarray], code: int, group: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Pairs (two rows of places) of similar sets in different groups: those that join two groups, each of
    which is one group from then on. ``side``: only sets of different sides are compared. All pairs within
    the bounds of the sketches under ``code`` are verified, unless both sets are in one group by then."""
    size = np.array([len(x) for x in sets], np.int64)
    end = np.cumsum(size)
    begin = end - size
    whole = Sets(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size)
    bands = _bands(1)
    while len(bands) <= code // SEEDS + 1:
        bands = _bands(int(bands[-1]))
    all_rows = np.ones(len(sets), bool)
    s = _sketch(whole, all_rows, np.full(len(sets), code // SEEDS), bands, code % SEEDS, fine=True)
    low = (s.xor.astype(np.uint8) & np.uint8(15)).reshape(len(sets), -1)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16)))
    parts = np.ascontiguousarray(low[:, ::2] << 4 | low[:, 1::2]).view(np.uint64)
    shingles, local = np.unique(whole.shingle, return_inverse=True)
    mark = np.zeros(len(shingles), bool)
    group = np.unique(group, return_inverse=True)[1]
    left = np.arange(len(sets)) if side is None else np.flatnonzero(side)
    right = left if side is None else np.flatnonzero(~side)
    out = []
    for at, k in enumerate(left):
        some = right[at + 1 :] if side is None else right
        some = some[(group[some] != group[k]) & (size[some] > 0) & _near(size[some], size[k], 0)]
        some = some[_near(size[some], size[k], _differing(parts[some], parts[k]))]
        if not len(some):
            continue
        mine = local[begin[k] : end[k]]
        mark[mine] = True
        n = size[some]
        first = np.cumsum(n) - n
        both = np.add.reduceat(mark[local[np.arange(n.sum()) + np.repeat(begin[some] - first, n)]], first, dtype=np.int64)
        mark[mine] = False
        for m in some[similar(size[k], n, both)]:
            if group[m] != group[k]:
                out.append((k, m))
                group[group == group[m]] = group[k]
    return np.array(out, np.int64).reshape(-1, 2).T


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: its id, ``n_shingles`` and ``component_id``."""
    rows = _rows(docs, doc_id, text)
    named, unnamed = rows.filter("id is not null"), rows.filter("id is null")
    size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    found = materialize(_candidates(named, buckets), "candidates")
    pairs = found.filter("kind = 0").select("a", "b", "key")
    coded = pairs.select("a", "b", F.col("key").bitwiseAND(F.lit(int(_CODE))).alias("code")).distinct()
    coded = materialize(coded, "pairs")
    table = materialize(_sketch_table(named, coded.select(F.explode(F.array("a", "b")).alias("v")).distinct()), "sketches")
    checked = materialize(_verified(named, materialize(_plausible(coded, table), "plausible")), "verified")
    good = checked.filter("ok").select("a", "b")
    failed = materialize(coded.select("a", "b").distinct().join(good, ["a", "b"], "left_anti"), "failed")
    groups = materialize(components(good), "components")
    members = materialize(_members(pairs, failed), "failed-groups")
    sizes = found.filter("kind = 1").select(F.col("a").alias("v"), F.col("b").alias("n_shingles"))
    more = materialize(_rest(_clusters(members, groups), sizes, table, named), "rest")
    if more.limit(1).count():
        groups = materialize(components(good.unionByName(more)), "components")
    out = sizes.join(groups, "v", "left").select(
        F.col("v").alias(doc_id), "n_shingles", F.coalesce("component", "v").alias("component_id")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, n = _keys(np.zeros(b.num_rows, np.int64), column(b, "text"))
            nothing = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(n), nothing], names=[doc_id, "n_shingles", "component_id"])

    return out.unionByName(unnamed.mapInArrow(lean(count), f"{doc_id} long, n_shingles long, component_id long"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are in the component of a smaller id; rows with a null id stay."""
    gone = link(docs, doc_id, text).filter(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")


def query(docs: DataFrame) -> DataFrame:
    return link(docs)
