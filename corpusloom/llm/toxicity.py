"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words of letters and their prefixes, hashed. On a
bounded sample of labelled rows, every term whose documents lean to one class by
more than chance becomes an input of the machine, and so do both terms of every
pair whose common documents do, whether or not either leans alone. There is no
limit on their number: all other terms have weight and factors zero, as nothing
in the sample tells them from chance. Pairs of frequent terms are counted in blocks
of a matrix, all others from the rows of the rarer term. The machine learns a weight
per input and a factor vector per input, whose products score pairs that stand
together; a text's inputs have unit length together. Scores
are calibrated on a part of the sample that the fit leaves out, and whole texts
are scored in Arrow batches.

Nulls and odd rows: null and empty texts have no terms and get the score of the
bias; repeated rows get equal results; of several texts under one labelled id the
one of smallest hash is learned from; labels null or not 0 or 1 are ignored;
without labels of both classes every score is the smoothed share of label 1;
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.labelled import labelled_sample
from corpusloom.session import stored

#: Bound on the labelled rows that the fit reads.
SAMPLE_ROWS = 8000
TERM_BITS = 22
PREFIXES = (4, 5, 6, 7)
#: Standard errors beyond which a term, or a pair, leans to a class by more than chance; pairs are many more.
TERM_LEAN = 3.5
PAIR_LEAN = 6.0
#: For pairs also the least surprise in natural logarithms: a chance of 1e-13, as standard errors say too much of few documents.
PAIR_SURPRISE = 30.0
#: Least documents of a term and of a pair.
LEAST_DOCS = 3
#: Share of the sample's documents from which terms are frequent; their pairs are counted in a matrix, all others by rows.
FREQUENT_SHARE = 0.02
#: Terms whose pairs are counted at a time, and rows in which.
PAIR_BLOCK = 512
ROW_BLOCK = 1024
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE = 0.02
L2 = 2e-4
THRESHOLD = 0.3
TABLE_SIZE = 1 << 18

WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashed terms of one lower-case word."""
    parts = [word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << TERM_BITS) - 1) for p in parts]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def terms_of(text: str | None) -> list[int]:
    return sorted({t for w in words_of(text) for t in word_terms(w)})


@F.pandas_udf(T.BinaryType())
def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Terms of whole texts as 32-bit integers in bytes, so that the sample is small on its way to the driver."""
    for texts in batches:
        yield pd.Series([np.array(terms_of(t), dtype="<i4").tobytes() for t in texts])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of calibrated log odds, by Newton steps with a light prior towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        h = p * (1 - p)
        g = np.array([((y - p) * margin).sum() - (a - 1.0), (y - p).sum() - 0.1 * b])
        hess = np.array([[(h * margin * margin).sum() + 1.0, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Machine:
    """bias + sum of weights + products of factors over the inputs that a text has, scaled to unit length."""

    slots: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, at: list[int]) -> float:
        if not len(at):
            return self.bias
        # A row of unit length, so that long texts weigh no more than short ones.
        each = 1 / np.sqrt(len(at))
        v = self.factor[at] * each
        total = v.sum(axis=0)
        return float(self.bias + self.weight[at].sum() * each + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, at: list[int]) -> float:
        return float(sigmoid(self.slope * self.margin(at) + self.offset))


def lean(every, yes, all_rows: int, all_yes: float):
    """Distance of the class shares in standard errors, smoothed for rare terms; for numbers and arrays alike."""
    no, all_no = every - yes, all_rows - all_yes
    spread = np.sqrt((every + 1.0) / (all_rows + 2.0) * (1.0 / (all_yes + 1.0) + 1.0 / (all_no + 1.0)))
    return np.abs(yes / max(all_yes, 1) - no / max(all_no, 1)) / spread


def surprise(every, yes, share: float):
    """Bound on minus the logarithm of the chance that so many of `every` documents are of a class that has this share."""
    part = yes / np.maximum(every, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(part > 0, part * np.log(part / share), 0.0) + np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - share)), 0.0)
    return every * np.nan_to_num(gain, posinf=np.inf)


def leaning_pairs(every, yes, all_rows: int, all_yes: float):
    """Whether pairs in `every` documents, `yes` of them of label 1, tell the classes apart by more than chance among all pairs."""
    hit = (lean(every, yes, all_rows, all_yes) >= PAIR_LEAN) & (every >= LEAST_DOCS)
    # Few are left to look at, so that little memory is needed.
    hit[hit] = surprise(every[hit].astype(np.float64), yes[hit].astype(np.float64), all_yes / all_rows) >= PAIR_SURPRISE
    return hit


def least_of_one_class(rows: int, in_class: float) -> int:
    """Documents, all of one class, that a leaning pair has at least."""
    at = np.arange(rows + 1, dtype=np.float64)
    return int(np.append(at[leaning_pairs(at, at, rows, in_class)], rows + 1)[0])


def frequent_pairs(rows: Sequence[np.ndarray], y: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each of n terms, by its place, whether a pair of two of them leans; counted in square blocks of a matrix held as bits."""
    x = np.zeros((len(rows), -(-n // PAIR_BLOCK) * PAIR_BLOCK // 8), dtype=np.uint8)
    for i, r in enumerate(rows):
        at = place[r]
        at = at[at >= 0]
        np.bitwise_or.at(x[i], at >> 3, (128 >> (at & 7)).astype(np.uint8))
    paired = np.zeros(n, dtype=bool)

    def block(at: int, first: int) -> np.ndarray:
        return np.unpackbits(x[at : at + ROW_BLOCK, first // 8 : (first + PAIR_BLOCK) // 8], axis=1).astype(np.float32)

    for first in range(0, n, PAIR_BLOCK):
        for other in range(first, n, PAIR_BLOCK):
            both = both_yes = 0.0
            for at in range(0, len(rows), ROW_BLOCK):
                # Counts are whole numbers below 2^24, exact in single precision.
                left, right = block(at, first), block(at, other)
                own = y[at : at + ROW_BLOCK] == 1
                both, both_yes = both + left.T @ right, both_yes + left[own].T @ right[own]
            hit = leaning_pairs(both, both_yes, len(y), y.sum())[: n - first, : n - other]
            if first == other:
                np.fill_diagonal(hit, False)
            paired[first : first + PAIR_BLOCK] |= hit.any(axis=1)
            paired[other : other + PAIR_BLOCK] |= hit.any(axis=0)
    return paired


def rare_pairs(rows: Sequence[np.ndarray], y: np.ndarray, rare: np.ndarray, count: np.ndarray, count_yes: np.ndarray) -> np.ndarray:
    """For every term whether a pair with one of the rare terms leans, by the rows that hold the rare one.

    count and count_yes: rows of each term, and those of label 1. A pair that leans
    to a class stands in as many rows of it as least_of_one_class(); terms and
    partners of fewer are passed over before the rows of the other class are looked at.
    """
    size, all_yes = len(count), float(y.sum())
    paired = np.zeros(size, dtype=bool)
    least = {1: least_of_one_class(len(y), all_yes), 0: least_of_one_class(len(y), len(y) - all_yes)}
    rare = rare[(count_yes[rare] >= least[1]) | (count[rare] - count_yes[rare] >= least[0])]
    # Rows of each rare term: one sorted list of (term, row).
    wanted = np.zeros(size, dtype=bool)
    wanted[rare] = True
    held = [r[wanted[r]] for r in rows]
    term = np.concatenate(held)
    order = np.argsort(term, kind="stable")
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h in held])[order]
    starts = np.searchsorted(term[order], [rare, rare + 1])
    del held, term, order
    number = np.full(size, -1, dtype=np.int32)
    for t, a, b in zip(rare.tolist(), *starts.tolist(), strict=True):
        own = row[a:b]
        for label, need in least.items():
            inside = own[y[own] == label]
            if len(inside) < need:
                continue
            partner, most = np.unique(np.concatenate([rows[i] for i in inside]), return_counts=True)
            partner, most = partner[(most >= need) & (partner != t)], most[(most >= need) & (partner != t)]
            if not len(partner):
                continue
            number[partner] = np.arange(len(partner))
            others = own[y[own] != label]
            at = number[np.concatenate([rows[i] for i in others])] if len(others) else np.zeros(0, dtype=np.int32)
            less = np.bincount(at[at >= 0], minlength=len(partner))
            number[partner] = -1
            yes = (most if label else less).astype(np.float64)
            hit = leaning_pairs((most + less).astype(np.float64), yes, len(y), all_yes)
            if hit.any():
                paired[partner[hit]] = paired[t] = True
    return paired


def inputs(rows: Sequence[np.ndarray], y: np.ndarray) -> list[int]:
    """The terms that lean to a class, alone or in a pair, in rising order."""
    if not len(y) or not any(map(len, rows)):
        return []
    size = 1 + max(int(r.max()) for r in rows if len(r))
    count, yes = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.float32)
    for r, label in zip(rows, y, strict=True):
        # A row names a term once.
        count[r] += 1
        yes[r] += label
    terms = np.nonzero(count >= LEAST_DOCS)[0]
    chosen = np.zeros(size, dtype=bool)
    chosen[terms] = lean(count[terms], yes[terms].astype(np.float64), len(y), y.sum()) >= TERM_LEAN
    often = terms[count[terms] >= FREQUENT_SHARE * len(y)]
    place = np.full(size, -1, dtype=np.int32)
    place[often] = np.arange(len(often))
    chosen[often[frequent_pairs(rows, y, place, len(often))]] = True
    # Every pair of another kind has a term that is not frequent.
    chosen |= rare_pairs(rows, y, np.setdiff1d(terms, often), count, yes)
    return np.nonzero(chosen)[0].tolist()


def fit_machine(x: np.ndarray, y: np.ndarray, slots: dict[int, int], seed: int = 0) -> Machine:
    """fit_rows() of a 0/1 matrix."""
    return fit_rows([np.nonzero(r)[0] for r in x], x.shape[1], y, slots, seed)


def fit_rows(rows: Sequence[np.ndarray], n: int, y: np.ndarray, slots: dict[int, int], seed: int = 0) -> Machine:
    """Adam on the logistic loss of rows that name their inputs, of n; every fifth row is kept for calibration."""
    share = float((y.sum() + 0.5) / (len(y) + 1.0))
    prior = float(np.log(share / (1 - share)))
    if not n or y.min(initial=1) == y.max(initial=0):
        return Machine(slots, prior, np.zeros(n), np.zeros((n, FACTORS)))
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    fit = np.nonzero(~held)[0]
    size = np.array([len(r) for r in rows])
    params = [np.array([prior]), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            part = fit[at : at + BATCH]
            # The inputs of the batch's rows one after another, summed in this order: memory does not grow with n, and reruns agree to the last digit.
            named, k = np.concatenate([rows[i] for i in part]), size[part]
            some, x = k > 0, np.repeat(1 / np.sqrt(np.maximum(k, 1)), k)
            begins = (np.cumsum(k) - k)[some]
            v = params[2][named] * x[:, None]
            s, alone = np.zeros((len(part), FACTORS)), np.zeros(len(part))
            if some.any():
                s[some] = np.add.reduceat(v, begins, axis=0)
                alone[some] = np.add.reduceat(params[1][named] * x - 0.5 * (v * v).sum(axis=1), begins)
            e = (sigmoid(params[0][0] + alone + 0.5 * (s * s).sum(axis=1)) - y[part]) / len(part)
            pull = x * np.repeat(e, k)
            own = np.bincount(named, x * pull, n)
            grads = [
                np.array([e.sum()]),
                np.bincount(named, pull, n) + L2 * params[1],
                np.stack([np.bincount(named, pull * np.repeat(f, k), n) for f in s.T], axis=1) + (L2 - own[:, None]) * params[2],
            ]
            t += 1
            for p, g, m, q in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    out = Machine(slots, float(params[0][0]), params[1], params[2])
    if held.any() and 0 < y[held].sum() < held.sum():
        margin = np.array([out.margin(rows[i]) for i in np.nonzero(held)[0]])
        out.slope, out.offset = platt(margin, y[held])
    return out


def train(docs: DataFrame, labels: DataFrame, trainable: Column, *, label: str = "toxic", id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `rows` labelled documents for which trainable holds."""
    sample = labelled_sample(docs, labels, label, trainable, rows, id_col=id_col, text=text)
    sample = sample.select(id_col, "y", F.xxhash64("text").alias("h"), terms(F.col("text")).alias("terms"))
    # Documents that share an id: the one of smallest hash, so that reruns agree.
    sample = sample.groupBy(id_col, "y").agg(F.min_by("terms", "h").alias("terms"))
    got = stored(sample.select(F.xxhash64(id_col).alias("at"), "y", "terms"), "toxicity-sample").orderBy("at").collect()
    found, y = [np.frombuffer(r.terms, dtype="<i4") for r in got], np.array([r.y for r in got], dtype=np.float64)
    slots = {t: i for i, t in enumerate(inputs(found, y))}
    del got
    rows = [np.array([slots[t] for t in ts.tolist() if t in slots], dtype=np.int32) for ts in found]
    return fit_rows(rows, len(slots), y, slots)


def score(text: Column, machine: Machine) -> Column:
    """Calibrated probability of label 1 of whole texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        slots = machine.slots
        for texts in batches:
            out = []
            for text in texts:
                at: set[int] = set()
                for w in words_of(text):
                    found = known.get(w)
                    if found is None:
                        found = tuple(slots[t] for t in word_terms(w) if t in slots)
                        if len(known) >= TABLE_SIZE:
                            known.clear()
                        known[w] = found
                    if found:
                        at.update(found)
                out.append(machine.score(sorted(at)))
            yield pd.Series(out, dtype="float64")

    return run(text)
