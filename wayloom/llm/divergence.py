"""Audit of sources: how far each source's words diverge from its language's and from other sources'.

Tasks fold whole documents into stripes, one hash table per language that maps a term to its document frequency and to
its count by source. A task that holds ``CELLS`` cells spills them as rows and starts anew; rows are merged by key in a
shuffle. Merged stripes of terms in at least ``min_docs`` documents are kept, and divergences are
emitted from them: a slice of a language's stripes and the totals of its sources meet, the slice adds up
its part of all pairs of sources and sends its best terms of each source.

Terms are runs of letters and characters beyond ASCII, A-Z in lower case. With N the count of kept terms
in a group and V their number, a term's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), also where it doesn't
occur, and the divergence of p from q is floor((p - q)^2 / (p + q)); all in whole numbers. ``pair`` rows sum it over all
kept terms; ``term`` rows list the terms a source uses more than its language does, the farthest ``top`` first.

Sources of a language are dealt to blocks of ``BLOCK``, and terms are met by each pair of blocks that holds one of
their sources. Memory of a task is bounded by the cells of a slice and a matrix of some thousand terms by two blocks.

Results in special cases: null text, language or source counts as the empty text; a language without a kept term has
pair rows of 0 and no term rows; a source without terms takes part with its smoothed shares; a language with one
source has no pair rows; rows that repeat count as documents of their own; an empty table gives an empty table. Other
columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.skew import salted_join
from wayloom.session import materialize

MIN_DOCS = 10
TOP = 10
#: Cells (term, source) that a task holds before it spills them.
CELLS = 400_000
#: Bytes of a text whose words are Python objects at once.
TEXT_BYTES = 1 << 20
#: Sources of a language in one block, and cells of a language in one slice.
BLOCK = 256
SLICE_CELLS = 100_000
#: Terms in one matrix.
ROWS = 2048
SCALE = 1_000_000_000

_LETTER = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``TEXT_BYTES``, cut between words."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + TEXT_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


class Stripes:
    """Term to (document frequency, count by source), of one language. The tables are kept by source, so that
    whole lists of words are added at once."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, Counter] = {}

    def add(self, source: str, text: bytes) -> int:
        """Fold one whole document of letters and spaces; its number of words."""
        counts, n, once = self.counts.setdefault(source, Counter()), 0, set()
        for part in _parts(text):
            words = part.split()
            counts.update(words)
            once.update(words)
            n += len(words)
        self.docs.setdefault(source, Counter()).update(once)
        return n

    def cells(self) -> int:
        return sum(map(len, self.counts.values()))


def _spilled(stripes: dict[str, Stripes]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "term", "source", "df", "n"]
    for lang, s in stripes.items():
        for source, counts in s.counts.items():
            docs = s.docs[source]
            terms = list(counts)
            for lo in range(0, len(terms), 50_000):
                part = terms[lo : lo + 50_000]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array([docs[t] for t in part], pa.int64()),
                    pa.array([counts[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def cells(docs: DataFrame, limit: int = CELLS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows ``lang, term, source, df, n``, merged over all tasks. ``df`` counts documents of that source."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, Stripes] = {}
        held = 0
        for b in batches:
            for t, l, s in zip(*(c for c in b.columns)):
                letters = t.as_py().encode().translate(_LETTER)
                held += stripes.setdefault(l.as_py(), Stripes()).add(s.as_py(), letters)
                # The number of words bounds the number of new cells; count them only when it could matter.
                if held >= limit:
                    held = sum(x.cells() for x in stripes.values())
                    if held >= limit // 2:
                        yield from _spilled(stripes)
                        stripes, held = {}, 0
        yield from _spilled(stripes)

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "t"), (lang, "l"), (source, "s"))]
    spilled = docs.select(read).mapInArrow(fold, "lang string, term string, source string, df long, n long")
    return spilled.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def stripes(
    docs: DataFrame, min_docs: int = MIN_DOCS, limit: int = CELLS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Merged stripes ``lang, term, total, by_source`` (an array of ``source, n``) of the terms to keep."""
    merged = cells(docs, limit, text, lang, source).groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source")
    )
    return merged.filter(F.col("df") >= min_docs)


def groups(docs: DataFrame, kept: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring ``lang, source`` with its number ``k`` in the language, its count ``n`` of kept terms, and
    the language's count ``n_lang``, kept terms ``v`` and cells ``n_cells``."""
    zero = F.lit(0).cast("long")
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))])
    held = kept.select("lang", F.explode("by_source").alias("c")).select("lang", "c.source", "c.n")
    counted = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"), F.sum(F.size("by_source")).cast("long").alias("n_cells")
    )
    rows = found.distinct().join(counted, ["lang", "source"], "left").join(langs, "lang", "left")
    k = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return rows.select(
        "lang", "source", k.cast("long").alias("k"), *[F.coalesce(c, zero).alias(c) for c in ("n", "n_lang", "v", "n_cells")]
    )


def _shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """Shares in whole numbers; beyond what 64 bits hold in Python's whole numbers, with the same result."""
    if counts.size and int(counts.max()) > 9_000_000_000:
        counts, n = counts.astype(object), n.astype(object)
    return 1 + (SCALE * (counts + 2)) // (n + 2 * v)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((p - q) * (p - q)) // (p + q)


def _meet(cell: pa.Table, total: pa.Table, top: int, width: int) -> pa.Table:
    """Divergences from one slice of stripes and the totals of one pair of blocks of sources."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("term", pa.string()), ("value", pa.int64()), ("terms", pa.int64())])
    if not cell.num_rows or not total.num_rows:
        return out.empty_table()
    ks = total["k"].to_numpy()
    order = np.argsort(ks)
    ks, n = ks[order], total["n"].to_numpy()[order]
    block = ks // width
    i, j = block.min(), block.max()
    v, n_lang = total["v"][0].as_py(), total["n_lang"][0].as_py()
    one = cell["term"].combine_chunks().dictionary_encode()
    if isinstance(one, pa.ChunkedArray):
        one = one.combine_chunks()
    names, row = one.dictionary.to_pylist(), one.indices.to_numpy()
    col, count = np.searchsorted(ks, cell["k"].to_numpy()), cell["c"].to_numpy()
    all_of = np.zeros(len(names), np.int64)
    all_of[row] = cell["total"].to_numpy()
    by_row = np.argsort(row, kind="stable")
    row, col, count = row[by_row], col[by_row], count[by_row]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sums = np.zeros((len(left), len(right)), np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in left]
    for lo in range(0, len(names), ROWS):
        hi = min(lo + ROWS, len(names))
        cut = slice(*np.searchsorted(row, [lo, hi]))
        counts = np.zeros((hi - lo, len(ks)), np.int64)
        counts[row[cut] - lo, col[cut]] = count[cut]
        p = _shares(counts, n[None, :], v)
        q = _shares(all_of[lo:hi], np.array([n_lang]), v)
        for x, a in enumerate(left):
            sums[x] += _divergence(p[:, [a]], p[:, right]).sum(axis=0).astype(np.int64)
            if i == j:
                more = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
                f = _divergence(p[more, a], q[more])
                if len(more) > top:  # nothing below the top-th value can be among the first
                    at_least = np.partition(f, len(f) - top)[len(f) - top]
                    more, f = more[f >= at_least], f[f >= at_least]
                best[x] = sorted(best[x] + [(-int(y), names[lo + t]) for t, y in zip(more, f)])[:top]
    a, b = np.meshgrid(ks[left], ks[right], indexing="ij")
    a, b, sums = a.ravel(), b.ravel(), sums.ravel()
    if i == j:
        a, b, sums = a[a != b], b[a != b], sums[a != b]
    else:
        a, b, sums = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sums, sums])
    terms = [(ks[left[x]], t, -f) for x, found in enumerate(best) for f, t in found]
    columns = [
        pa.array(np.concatenate([a, np.array([t[0] for t in terms], np.int64)]), pa.int64()),
        pa.array(b.tolist() + [None] * len(terms), pa.int64()),
        pa.array([None] * len(a) + [t[1] for t in terms], pa.string()),
        pa.array(np.concatenate([sums, np.array([t[2] for t in terms], np.int64)]), pa.int64()),
        pa.array([len(names)] * len(a) + [0] * len(terms), pa.int64()),
    ]
    return pa.Table.from_arrays(columns, schema=out)


def _smoothed(n: str) -> Column:
    """Share of a term that a group doesn't hold."""
    return F.expr(f"CASE WHEN v > 0 THEN 1 + {2 * SCALE}L div ({n} + 2 * v) END")


def divergences(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, slice_cells: int = SLICE_CELLS,
    limit: int = CELLS, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: see the module."""
    kept = materialize(stripes(docs, min_docs, limit, text, lang, source), "stripes")
    known = materialize(groups(docs, kept, text, lang, source), "sources")
    n_slices = F.ceil(F.col("n_cells") / slice_cells)
    n_blocks = known.groupBy("lang").agg((F.floor(F.max("k") / block) + 1).cast("long").alias("blocks"), F.max(n_slices).cast("long").alias("slices"))
    pairs = F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j))")
    # A block's rows go to every pair of blocks that it is part of.
    sides = known.join(n_blocks, "lang").filter("slices > 0").withColumn("own", F.floor(F.col("k") / block).cast("long"))
    dealt = sides.withColumn("at", F.explode(pairs)).select("lang", "source", "k", "n", "n_lang", "v", "slices", "at.i", "at.j")
    total = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    total = materialize(total.select("lang", "i", "j", "slice", "k", "n", "n_lang", "v"), "totals")
    held = kept.select("lang", "term", "total", F.explode("by_source").alias("c")).select("lang", "term", "total", "c.source", F.col("c.n").alias("c"))
    by_source = salted_join(held, dealt.select("lang", "source", "k", "slices", "i", "j"), ["lang", "source"], ["term"])
    slice_of = F.pmod(F.xxhash64("term"), F.col("slices")).cast("long")
    cell = by_source.select("lang", "i", "j", slice_of.alias("slice"), "term", "total", "k", "c")
    keys = ["lang", "i", "j", "slice"]

    def meet(key: tuple, cells_of: pa.Table, totals_of: pa.Table) -> pa.Table:
        found = _meet(cells_of, totals_of, top, block)
        return found.add_column(0, "lang", pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    met = cell.groupBy(*keys).cogroup(total.groupBy(*keys)).applyInArrow(
        meet, "lang string, a long, b long, term string, value long, terms long"
    )
    met = materialize(met, "divergences")
    first = known.select("lang", F.col("source").alias("source"), F.col("k").alias("a"), F.col("n").alias("n_a"), "v")
    other = known.select("lang", F.col("source").alias("item"), F.col("k").alias("b"), F.col("n").alias("n_b"))
    sums = met.filter("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("s"), F.sum("terms").alias("met"))
    both = first.join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    # Kept terms that neither block of a pair holds have the smoothed shares on both sides.
    both = both.withColumn("p", _smoothed("n_a")).withColumn("q", _smoothed("n_b"))
    rest = F.expr("(v - coalesce(met, 0)) * (((p - q) * (p - q)) div (p + q))")
    value = F.when(F.col("v") > 0, F.coalesce("s", F.lit(0)) + rest).otherwise(F.lit(0)).cast("long")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    listed = met.filter("b IS NULL").join(first, ["lang", "a"])
    term = listed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by))
    term = term.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return pair.unionByName(term)


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(cell.c, 0) AS c, kept.c AS c_lang
  FROM g JOIN kept USING (lang) LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = kept.term),
size AS (SELECT lang, source, sum(c)::HUGEINT AS n, sum(c_lang)::HUGEINT AS n_lang, count(*)::HUGEINT AS v FROM full_cell GROUP BY ALL),
share AS (
  SELECT lang, source, term, c, 1 + ({SCALE}::HUGEINT * (c + 2)) // (n + 2 * v) AS p,
    1 + ({SCALE}::HUGEINT * (c_lang + 2)) // (n_lang + 2 * v) AS q FROM full_cell JOIN size USING (lang, source)),
pair AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
rows_of AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM share WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows_of QUALIFY part = 'pair' OR rank <= {TOP}
"""


def query(docs: DataFrame) -> DataFrame:
    return divergences(docs.select("text", "lang", "source"))
