"""Target-distribution importance resampling on CRC buckets of n-grams.

A text is normalised to its words (runs of letters, digits and characters beyond ASCII, A-Z in lower case), joined by
one space. Each normalised document is scanned once: a running CRC-32 is kept at the end of every word, and the one
at the next word's start follows from it by one more space. The CRC of any run of words is then the CRC at its end, cancelled
with the CRC at its start shifted by the run's length, a linear map over GF(2); no run is read again, whatever ``max_n`` is.

A feature's bucket is its CRC modulo ``buckets``. The smoothed log ratio of the target's to the corpus's share of a
bucket is the bucket's gain; a document's weight is the floored mean of its features' gains. Adding Gumbel noise, seeded
by the document id, and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

Work: two scans of the texts without a shuffle of them (bucket counts, then weights); only (id, counts, weight) rows are
written and ranked. Ranks come from counts by score and by (score, range of ids), so no task sorts all rows.

Results in special cases: a null or empty text, or one without a word, has no features and weight 0; a null id draws its
noise as the empty text and loses ties; rows that repeat an id draw the same noise and take ranks of their own; an empty
target or corpus counts nothing and the smoothing alone stands; an empty table gives an empty table; a text of any
length is scanned whole. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm import words
from wayloom.llm.arrow import column, with_columns
from wayloom.session import materialize

MAX_N = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words of a text that are Python objects at once.
CHUNK = 1 << 16
#: Ids of one score that are numbered in one task.
ID_RANGE = 1 << 20


def _byte_table() -> np.ndarray:
    """CRC-32 (reflected polynomial 0xEDB88320) of every byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _byte_table()
_FULL = np.uint32(0xFFFFFFFF)


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _TABLE[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _lookup(one_bit: np.ndarray) -> np.ndarray:
    """Tables (4 x 256) of the linear map that sends bit k to ``one_bit[k]``."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8] ^= np.where((np.arange(256) >> (k % 8)) & 1, one_bit[k], np.uint32(0)).astype(np.uint32)
    return out


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return (
        table[..., 0, c & b] ^ table[..., 1, (c >> np.uint32(8)) & b]
        ^ table[..., 2, (c >> np.uint32(16)) & b] ^ table[..., 3, c >> np.uint32(24)]
    )


def _doublings() -> list[np.ndarray]:
    """Maps that shift a CRC by 1, 2, 4, ... zero bytes; each is the one before, applied twice."""
    bits = _zero_byte(np.uint32(1) << np.arange(32, dtype=np.uint32))
    out = [_lookup(bits)]
    for _ in range(40):
        bits = _apply(out[-1], bits)
        out.append(_lookup(bits))
    return out


_SHIFTS = _doublings()


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC as it stands after ``n_bytes`` zero bytes, without the register's first and last inversion."""
    out, rest, k = crc.copy(), n_bytes, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(_SHIFTS[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def _extend(crc: int, piece: bytes) -> int:
    return crc32(piece, crc)


def _pieces(data: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
    """The words, each after a space."""
    for lo in range(0, len(start), CHUNK):
        for s, e in zip(start[lo : lo + CHUNK].tolist(), end[lo : lo + CHUNK].tolist()):
            yield b" " + data[s:e]


class Grams:
    """Running CRCs of a slice of whole texts, scanned once, and from them the CRC of any run of words.

    The texts follow each other in one normalised stream: what lies before a run cancels out, so the
    documents before it do as well. About 40 bytes a word are held.
    """

    def __init__(self, texts: pa.Array):
        w = words.split(texts, lower=True, letters=True)
        self.n_words = np.diff(w.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        length = w.end - w.start
        self.end = np.cumsum(length + 1)
        self.start = self.end - length
        running = accumulate(_pieces(w.data.tobytes(), w.start, w.end), _extend, initial=0)
        crc = np.fromiter(running, np.uint32, len(length) + 1)
        self.at_end = crc[1:]
        # A word starts one space after the word before it.
        raw = crc[:-1] ^ _FULL
        self.at_start = _TABLE[(raw ^ np.uint32(32)) & np.uint32(255)] ^ (raw >> np.uint32(8)) ^ _FULL

    def crcs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 and document of each run of ``n`` words of one document."""
        m = max(len(self.doc) - n + 1, 0)
        at = np.flatnonzero(self.doc[:m] == self.doc[len(self.doc) - m :])
        to = at + n - 1
        return self.at_end[to] ^ shift(self.at_start[at], self.end[to] - self.start[at]), self.doc[at]


def _slices(texts: pa.Array) -> Iterator[Grams]:
    for lo, hi in words.slices(texts):
        yield Grams(texts.slice(lo, hi - lo))


def bucket_counts(docs: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``bucket, n``: features of all texts. Each task sends at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for grams in _slices(b.column(0)):
                for n in range(1, max_n + 1):
                    total += np.bincount(grams.crcs(n)[0] % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths. The driver gets ``buckets`` rows, whatever the input's size."""
    s = bucket_counts(docs, text, max_n, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    t = bucket_counts(target, text, max_n, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = s.unionByName(t).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    held = np.zeros((2, buckets))
    for r in both:
        held[:, r["bucket"]] = r["s"], r["t"]
    (s_all, t_all), (s_of, t_of) = held.sum(axis=1), held
    ratio = ((t_of + 1.0) * (s_all + buckets)) / ((s_of + 1.0) * (t_all + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", max_n: int = MAX_N) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, without ``text``. No shuffle."""
    buckets = np.uint32(len(gain))

    def run(b: pa.RecordBatch) -> list:
        n_words, n_features, weights = ([np.zeros(0, np.int64)] for _ in range(3))
        for grams in _slices(column(b, text)):
            rows = len(grams.n_words)
            n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for size in range(1, max_n + 1):
                crcs, doc = grams.crcs(size)
                n += np.bincount(doc, minlength=rows)
                # Sums of whole numbers below 2**53 are exact in doubles.
                total += np.bincount(doc, gain[crcs % buckets], rows).astype(np.int64)
            n_words.append(grams.n_words)
            n_features.append(n)
            weights.append(np.where(n > 0, total // np.maximum(n, 1), 0))
        return [pa.array(np.concatenate(x), pa.int64()) for x in (n_words, n_features, weights)]

    return with_columns(docs, "n_words long, n_features long, weight long", run, drop=(text,))


def noise(doc_id: str, seed: int = SEED):
    """Gumbel noise in thousandths, the same in every run: 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def rank(rows: DataFrame, doc_id: str, least_words: int, percent: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... by falling score and rising id among those with enough words, null beyond
    the drawn share. ``rows`` must be a written table: it is read several times.

    Places before a score and before a range of ids are counted first; scores are whole numbers within a range
    that the noise's 32 bits and the gains' logarithms bound, so their table has at most some 100 000 rows. Numbers within
    a range of ids of one score then need one window over at most ``ID_RANGE`` ids.
    """
    enough = rows.filter(F.col("n_words") >= least_words)
    n = enough.count()
    drawn = percent * n // 100
    by_score = enough.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__above"))
    by_score = by_score.filter(F.col("__above") < drawn)
    id_range = F.coalesce(F.floor(F.col(doc_id) / ID_RANGE), F.lit(2**62)).cast("long")
    top = enough.join(F.broadcast(by_score), "score").withColumn("__range", id_range)
    earlier = Window.partitionBy("score").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = top.groupBy("score", "__range").agg(F.count(F.lit(1)).alias("n")).select(
        "score", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("score", "__range").orderBy(F.col(doc_id).asc_nulls_last(), "n_features", "__row")
    place = F.col("__above") + F.col("__before") + F.row_number().over(inside)
    ranked = top.join(offsets, ["score", "__range"]).select("__row", place.alias("rank")).filter(F.col("rank") <= drawn)
    return rows.join(ranked, "__row", "left")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_n: int = MAX_N,
    buckets: int = BUCKETS, least_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every document's id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    ``doc_id`` must be a whole number; ``target`` holds its texts in a column of the same name.
    """
    gain = gains(docs, target, text, max_n, buckets)
    scored = weigh(docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")), gain, "text", max_n)
    scored = scored.withColumn("score", F.col("weight") + noise("__id", seed))
    rows = materialize(scored.withColumn("__row", F.monotonically_increasing_id()), "weights")
    ranked = rank(rows, "__id", least_words, percent)
    out = ["n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(F.col("__id").alias(doc_id), *[F.col(c).cast("long").alias(c) for c in out])


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]))"
#: CRC-32 is spelled out byte by byte over the distinct words.
ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
w AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
spelled AS (
  SELECT word, list_transform(range(1, octet_length(encode(word)) + 1),
    lambda i: ('0x' || substr(hex(encode(word)), CAST(2*i-1 AS INTEGER), 2))::BIGINT) AS bytes FROM (SELECT DISTINCT word FROM w)),
bucket AS (SELECT word, xor({_CRC}, 4294967295::BIGINT) % {BUCKETS} AS bucket FROM spelled, crc_table),
f AS (SELECT side, id, bucket FROM w JOIN bucket USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
gain AS (
  SELECT bucket, CAST(floor(1000e0 * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE)
    / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM n, total),
weights AS (
  SELECT id AS doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS g FROM f JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (g - ((g % n_features) + n_features) % n_features) // n_features END AS weight,
    CAST(floor(-1000e0 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5e0)
      / 4294967296e0))) AS BIGINT) AS noise
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, n_features, weight + noise AS score, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place
  FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, s.n_features, weight, weight + noise AS score,
  CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored s LEFT JOIN (SELECT doc_id, place FROM placed) USING (doc_id)
"""


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
