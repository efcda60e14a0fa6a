"""URL filters by a bit-parallel wildcard automaton.

All globs are packed, one after the other, into the bits of as many 64-bit words as they need; one
Shift-And step per character moves all of them at once, and numpy takes that step for a whole Arrow
batch of URLs. In a glob ``*`` matches any run without ``/``, ``?`` and ``#``, and ``**`` any run.

The canonical URL is ``.host/path?query#fragment`` without scheme, host in lower case. A rule
(host, path) becomes ``*.host`` + path + ``**``: the leading dot makes it fit the host itself and its
subdomains. The longest fitting rule decides; without one, a URL that a glob of ``BLOCKED`` fits is
blocked and any other allowed.

Results in special cases: a null URL, or one without ``://``, has empty host and path and no rule and
is allowed; repeated rows are judged alike; an empty table gives an empty table; of two rules of
one length the first wins. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: What is blocked where no rule fits: adverts, sessions and binaries.
BLOCKED = ("**/ads/**", "**/adserver/**", "**/login**", "**sessionid=**", "**.exe", "**.zip", "**.apk")
_BREAKS = b"/?#"


class Automaton:
    """Shift-And over all globs. ``step``: bits reached by reading a byte; ``stay``: bits kept by it."""

    def __init__(self, globs: list[str]):
        tokens: list[tuple[list[int], list[str]]] = []
        for g in globs:
            chars: list[int] = []
            loops = [""]
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[-1], i = "any", i + 2
                elif raw[i : i + 1] == b"*":
                    loops[-1], i = loops[-1] or "part", i + 1
                else:
                    chars.append(raw[i])
                    loops.append("")
                    i += 1
            tokens.append((chars, loops))
        bits = sum(len(loops) for _, loops in tokens)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        part = np.array([c not in _BREAKS for c in range(256)])
        at = 0
        for chars, loops in tokens:
            self.begin[at // 64] |= np.uint64(1 << at % 64)
            for j, loop in enumerate(loops):
                w, bit = (at + j) // 64, np.uint64(1 << (at + j) % 64)
                if j:
                    self.step[chars[j - 1], w] |= bit
                if loop:
                    self.stay[part if loop == "part" else slice(None), w] |= bit
            last = at + len(loops) - 1
            self.accept.append((last // 64, np.uint64(1 << last % 64)))
            at += len(loops)

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Which glob fits which URL: booleans, URLs by globs."""
        n = np.array([len(u) for u in urls])
        order = np.argsort(-n, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        start = (np.cumsum(n) - n)[order]
        length = n[order]
        state = np.tile(self.begin, (len(urls), 1))
        active = len(urls)
        for t in range(int(n.max(initial=0))):
            while length[active - 1] <= t:  # the longest come first, so those still running are a prefix
                active -= 1
            c, s = flat[start[:active] + t], state[:active]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[c]) | (s & self.stay[c])
        out = np.zeros((len(urls), len(self.accept)), bool)
        for k, (w, bit) in enumerate(self.accept):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def parts(url):
    """Columns host, path and canonical text of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")
    return host, F.regexp_extract(tail, r"^[^?#]*", 0), F.concat(F.lit("."), host, tail)


def filter_urls(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``. No shuffle."""
    by_length = sorted(rules, key=lambda r: -len(r.host + r.path))
    names = [r.host + r.path for r in by_length] + [None, None]
    verdicts = [r.verdict for r in by_length] + ["block", "allow"]
    automaton = Automaton([f"*.{r.host}{r.path}**" for r in by_length] + list(blocked))
    n_rules = len(by_length)
    host, path, canonical = parts(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("__canonical", canonical)
    rows = rows.drop("rule", "verdict")
    out = T.StructType(
        [f for f in rows.schema if f.name != "__canonical"]
        + [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__canonical")
            fits = automaton.run([x.encode() for x in b.column(at).to_pylist()])
            hit = np.concatenate(
                [fits[:, :n_rules], fits[:, n_rules:].any(axis=1, keepdims=True), np.ones((len(fits), 1), bool)], 1
            )
            k = hit.argmax(axis=1)
            columns = [c for i, c in enumerate(b.columns) if i != at]
            columns += [pa.array([names[i] for i in k], pa.string()), pa.array([verdicts[i] for i in k], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return rows.mapInArrow(judge, out)


ORACLE = """
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path,
    regexp_replace(rest, '^[^/?#]*', '') AS tail FROM r),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    '.' || host || tail AS c FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(c, '/ads/') OR contains(c, '/adserver/') OR contains(c, '/login') OR contains(c, 'sessionid=')
    OR ends_with(c, '.exe') OR ends_with(c, '.zip') OR ends_with(c, '.apk') THEN 'block'
  ELSE 'allow' END AS verdict
FROM j
"""


def query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
