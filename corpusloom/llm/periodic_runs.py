"""Periodic runs of words found by bit-parallel lags.

The words of a text become numbers, and each bit of those numbers a plane: one
big integer with a bit per word. For a lag q, a plane XOR itself shifted by q
marks where words q apart differ in that bit; the OR over all planes marks where
they differ at all. Shift-doubling AND of the complement leaves the starts of
zero stretches that are long enough, in as many steps as the length has bits.

Lags from FILTER_LAG on first pass a necessary condition on one plane of random
bits per word: only every s-th place is compared, s growing with q, so that a
stretch of 3 q zeros still covers about SAMPLES places. That bounds the work by n
log n bits a text; what passes is decided by all planes. A stretch of length 4 q
that also has a smaller period p has a p that divides q, and is then the very
stretch found at p, which is how larger periods are told from smallest ones.

Nulls and odd rows: null and empty texts have no words, no runs and the digests of
nothing; rows without an id are taken as they are, without the rewriting by id;
repeated rows get equal results; extra columns pass through `keep`; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Repeats and words that a run has at least.
LEAST_REPEATS = 4
LEAST_WORDS = 6
#: Lag from which places are sampled first, and about how many places of a long enough stretch are.
FILTER_LAG = 16
SAMPLES = 40
#: Bytes of a text whose words are lists at one time.
BLOCK = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
DIGESTS = ("runs_sha256", "collapsed_sha256")
FIELDS = T.StructType([*[T.StructField(c, T.LongType()) for c in NUMBERS], *[T.StructField(c, T.StringType()) for c in DIGESTS]])


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the word of each number; words are cut at \\x20 and \\x09-\\x0D."""
    ids: dict[bytes, int] = {}
    parts, at = [np.zeros(0, dtype=np.int32)], 0
    while at < len(text):
        cut = BLANK.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in text[at:end].split()], dtype=np.int32))
        at = end
    return np.concatenate(parts), list(ids)


def plane(bits: np.ndarray) -> int:
    """A big integer whose bit i is bits[i]."""
    return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")


def places(mask: int) -> np.ndarray:
    """The places of the set bits in rising order."""
    data = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.nonzero(np.unpackbits(data, bitorder="little"))[0]


def starts_of(ones: int, length: int) -> int:
    """Bits at which a stretch of so many set bits begins, by shift-doubling AND."""
    have = 1
    while have < length and ones:
        step = min(have, length - have)
        ones &= ones >> step
        have += step
    return ones


def least_zeros(q: int) -> int:
    """Words equal to the word q further on that a run of period q begins with, at least."""
    return max(LEAST_WORDS, LEAST_REPEATS * q) - q


class Sampled:
    """One plane of random bits per word, thinned to every s-th place from each of s first places."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.stride, self.thin = bits, 0, []

    def may_hold(self, q: int, known: list[tuple[int, int, int]]) -> bool:
        """False only if no run of period q, but for those implied by known ones, can be there."""
        s = 1
        while 2 * s * SAMPLES <= least_zeros(q):
            s *= 2
        if s != self.stride:
            self.stride, self.thin = s, [plane(self.bits[r::s]) for r in range(s)]
        size = (len(self.bits) - q - 1) // s + 1
        every = (1 << size) - 1
        same = ((self.thin[0] ^ (self.thin[q % s] >> (q // s))) & every) ^ every
        if not starts_of(same, least_zeros(q) // s):
            return False
        implied = [r for r in known if q % r[2] == 0]
        if not implied:
            return True
        # What a known run of a period that divides q explains says nothing about q.
        keep = np.ones(size, dtype=np.uint8)
        for start, length, _ in implied:
            keep[-(-start // s) : -(-(start + length - q) // s)] = 0
        return bool(starts_of(same & plane(keep), least_zeros(q) // s))


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in rising order of start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    planes = [plane(words >> j & 1) for j in range(max(1, int(words.max()).bit_length()))]
    sampled = Sampled(np.random.default_rng(0).integers(0, 2, int(words.max()) + 1, dtype=np.uint8)[words])
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    long: list[tuple[int, int, int]] = []
    for q in range(1, n // LEAST_REPEATS + 1):
        long = [r for r in long if r[1] >= LEAST_REPEATS * q] if len(long) else long
        if q >= FILTER_LAG and not sampled.may_hold(q, long):
            continue
        differ = 0
        for p in planes:
            differ |= p ^ (p >> q)
        every = (1 << (n - q)) - 1
        starts = starts_of((differ & every) ^ every, least_zeros(q))
        if not starts:
            continue
        at = places(starts)
        first = np.nonzero(np.diff(at, prepend=-2) > 1)[0]
        last = np.append(first[1:], len(at)) - 1
        for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True):
            length = b - a + least_zeros(q) + q
            if (a, length) not in seen:
                seen.add((a, length))
                found.append((a, length, q))
                long.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def looped(words: np.ndarray, doc_id: int | str | None) -> np.ndarray:
    """The words with the rewriting by id: one text in ten repeats a stretch of its own to its end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def digest_of(words: np.ndarray, texts: list[bytes], keep: np.ndarray) -> str:
    """SHA-256 of the kept words, joined by one space, without joining them all at once."""
    out, rest = hashlib.sha256(), words[keep]
    for at in range(0, len(rest), BLOCK // 8):
        out.update((b" " if at else b"") + b" ".join([texts[i] for i in rest[at : at + BLOCK // 8].tolist()]))
    return out.hexdigest()


def describe(text: bytes | None, doc_id: int | str | None) -> tuple:
    """FIELDS of one text."""
    words, texts = word_numbers(text or b"")
    words = looped(words, doc_id)
    runs = find_runs(words)
    best = strongest(runs)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *top, listed, digest_of(words, texts, kept_words(len(words), runs))


@F.pandas_udf(FIELDS)
def _described(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ids, texts in batches:
        rows = [describe(t, i) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=[*NUMBERS, *DIGESTS])
        yield out.astype({c: "Int64" for c in NUMBERS})


def runs_of(doc_id: Column, text: Column) -> Column:
    """struct of FIELDS. doc_id rewrites one text in ten as the contract says; F.lit(None) leaves texts as they are."""
    return _described(doc_id.cast("string"), text.cast("binary"))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, FIELDS..., keep...: one row per document."""
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = docs.select(F.col(id_col).alias("_id"), runs_of(F.col(id_col), F.col(text)).alias("_r"), *kept)
    return rows.select(F.col("_id").alias(id_col), "_r.*", *[F.col(f"_keep_{c}").alias(c) for c in keep])


#: Words that are equal and q apart, gathered into stretches without gaps.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) END AS h
  FROM documents),
e AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
o AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM f),
p AS (SELECT k, n, unnest(range(n)) AS i, unnest(w) AS x FROM o),
m AS (SELECT a.k, a.i, b.i - a.i AS q FROM p a JOIN p b ON a.k = b.k AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 4),
s AS (SELECT k, q, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS b, i FROM m),
z AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM s GROUP BY k, q, b HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT k, s, l, min(q) AS q FROM z GROUP BY k, s, l),
c AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY k),
t AS (SELECT k, s, l, q FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT p.k, string_agg(p.x, ' ' ORDER BY p.i) AS left_over FROM p ANTI JOIN gone ON p.k = gone.k AND p.i = gone.i GROUP BY p.k)
SELECT o.doc_id, coalesce(c.n_runs, 0) AS n_runs, t.s AS start, t.l AS length, t.q AS period, 1000 * t.l // t.q AS exponent_milli,
       sha256(coalesce(c.listed, '')) AS runs_sha256, sha256(coalesce(kept.left_over, '')) AS collapsed_sha256
FROM o LEFT JOIN c USING (k) LEFT JOIN t USING (k) LEFT JOIN kept USING (k)
"""
