"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words are runs of letters, runs of digits and single marks, as they are written.
A word's index vector has a few entries of +1 and -1 that its hash names. Its
word vector is its index vector beside the sum of the index vectors of the words
found around it, each turned by its distance so that order counts, gathered by
Spark over a bounded sample of labelled rows. Words of fewer than MIN_DOCS sampled
documents have their index vector alone. A document is pooled from its word
vectors in four ways: their mean, their second moment, the second moment of the
sums of SPAN words in a row, and the second moment of the sum of all, which differ
where words come back nearby or far apart. A network of one hidden layer in numpy
scores it, and a temperature fitted on rows left out calibrates the probability.
Nothing but word vectors enters the network.

Nulls and odd rows: null and empty texts pool to zeros and are scored like any
other; repeated rows get equal results; of several texts under one labelled id
the one of smallest hash is learned from; labels null or not 0 or 1 are ignored;
without labels of both classes every score is the smoothed share of label 1;
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.labelled import labelled_sample
from corpusloom.session import stored

#: Bound on the labelled rows that the fit reads.
SAMPLE_ROWS = 8000
#: Letters are ASCII letters and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[0-9]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")
RARE = ""
MIN_DOCS = 3
DIM = 64
NONZERO = 8
POOLS = 4
INPUTS = POOLS * DIM
WINDOW = 2
#: Words in a row that are summed.
SPAN = 8
HIDDEN = 32
EPOCHS = 60
BATCH = 128
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.3
#: Characters whose words are handled at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 18
#: Words whose contexts are added up at a time.
TOKENS = 1 << 17
#: Words whose sums travel as one row.
ROWS = 1024


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text in blocks that end at blanks."""
    at, size = 0, len(text or "")
    while at < size:
        end = text.find(" ", at + BLOCK)
        end = size if end < 0 else end
        yield WORD.findall(text, at, end)
        at = end


def index_vectors(words: list[str]) -> np.ndarray:
    """NONZERO entries +1 or -1 a word: six bits of its hash name the place, one the sign; entries on one place add up."""
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    out, rows = np.zeros((len(words), DIM), dtype=np.int8), np.arange(len(words))
    for k in range(NONZERO):
        place = (hashes >> np.uint64(7 * k)) & np.uint64(DIM - 1)
        sign = (hashes >> np.uint64(7 * k + 6)) & np.uint64(1)
        np.add.at(out, (rows, place.astype(np.int64)), 1 - 2 * sign.astype(np.int8))
    return out


def word_vectors(words: list[str], around: np.ndarray) -> np.ndarray:
    """Context beside the word's own index, each of about unit length."""
    context = around.astype(np.float32)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    context[0] = 0
    context += index_vectors(words) / np.float32(np.sqrt(NONZERO))
    context /= np.float32(np.sqrt(2))
    return context


def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of each batch: documents that hold the word."""
    for rows in batches:
        n = Counter()
        for text in rows["text"]:
            n.update({w for block in words_of(text) for w in block})
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})


def context_sums(words: list[str]):
    """A function from texts to (part, sums): index vectors found within WINDOW words of each word, turned by their distance, ROWS words a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, ids = index_vectors(words), {w: i for i, w in enumerate(words)}
        turned = {d: np.roll(index, d, axis=1) for d in range(-WINDOW, WINDOW + 1) if d}
        total = np.zeros((len(words), DIM), dtype=np.int32)
        waiting: list[np.ndarray] = []
        gap = np.full(WINDOW, -1, dtype=np.int64)

        def add() -> None:
            # Texts one after another, apart by gaps of -1 that no window bridges.
            at = np.concatenate(waiting)
            waiting.clear()
            for d, rows in turned.items():
                to, by = (at[d:], at[:-d]) if d > 0 else (at[:d], at[-d:])
                both = (to >= 0) & (by >= 0)
                to, by = to[both], by[both]
                order = np.argsort(to, kind="stable")
                to, by = to[order], by[order]
                for i in range(0, len(to), TOKENS):
                    part = to[i : i + TOKENS]
                    first = np.nonzero(np.diff(part, prepend=-1))[0]
                    total[part[first]] += np.add.reduceat(rows[by[i : i + TOKENS]], first, axis=0, dtype=np.int32)

        for rows in batches:
            for text in rows["text"]:
                # Numbers of words, a few bytes each: the whole text at once, so that no window is cut.
                waiting += [np.fromiter((ids.get(w, 0) for w in block), dtype=np.int64, count=len(block)) for block in words_of(text)]
                waiting.append(gap)
                if sum(map(len, waiting)) >= TOKENS:
                    add()
        if waiting:
            add()
        parts = [(k // ROWS, total[k : k + ROWS].tobytes()) for k in range(0, len(words), ROWS)]
        yield pd.DataFrame(parts, columns=["part", "sums"])

    return run


def add_sums(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.int32) for x in rows["sums"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "sums": [total.tobytes()]})


def pooled(text: str | None, vectors: np.ndarray, ids: dict[str, int]) -> np.ndarray:
    """Mean of a text's word vectors, and on a log scale the second moments of the vectors, of sums of SPAN in a row and of the sum of all.

    A sum of m vectors counts by its square over m, so that it is the larger the
    more words come back among them.
    """
    total, square, spans, size, n_spans = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM), 0, 0
    held = np.zeros((0, DIM), dtype=np.float32)
    for block in words_of(text):
        at = np.fromiter((ids.get(w, 0) for w in block), dtype=np.int64, count=len(block))
        v, rare = vectors[at], np.nonzero(at == 0)[0]
        if len(rare):
            names: dict[str, int] = {}
            own = [names.setdefault(block[i], len(names)) for i in rare.tolist()]
            v[rare] = index_vectors(list(names))[own] / np.sqrt(2 * NONZERO)
        size += len(v)
        total += v.sum(axis=0, dtype=np.float64)
        square += (v * v).sum(axis=0, dtype=np.float64)
        held = np.concatenate([held, v])
        whole = len(held) // SPAN
        sums = held[: whole * SPAN].reshape(whole, SPAN, DIM).sum(axis=1)
        spans += (sums * sums).sum(axis=0, dtype=np.float64) / SPAN
        n_spans, held = n_spans + whole, held[whole * SPAN :]
    if len(held):
        last = held.sum(axis=0)
        spans, n_spans = spans + last * last / len(held), n_spans + 1
    n = max(size, 1)
    return np.concatenate([total / n, np.log(square / n + 1e-4), np.log(spans / max(n_spans, 1) + 1e-4), np.log(total * total / n + 1e-4)])


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a temperature."""

    words: list[str]
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, words: list[str], vectors: np.ndarray, seed: int = 0) -> Network:
    """Adam on the logistic loss; every fifth row is kept for the temperature."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    prior = float(np.log(share / (1 - share)))
    n = INPUTS
    if not len(y) or y.min() == y.max():
        return Network(words, vectors, np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    fit = np.nonzero(~held)[0]
    centre, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x - centre) / scale
    params = [rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array([prior])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH]
            a = z[rows] @ params[0] + params[1]
            h = np.maximum(a, 0)
            e = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -50, 50))) - y[rows]) / len(rows)
            back = e[:, None] * params[2] * (a > 0)
            grads = [z[rows].T @ back + DECAY * params[0], back.sum(axis=0), h.T @ e + DECAY * params[2], np.array([e.sum()])]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = Network(words, vectors, centre, scale, params[0], params[1], params[2], float(params[3][0]))
    if held.any():
        margin, target = out.margin(x[held]), y[held]

        def loss(temperature: float) -> float:
            return float(np.mean(np.logaddexp(0, margin / temperature) - target * margin / temperature))

        out.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))
    return out


def train(docs: DataFrame, labels: DataFrame, trainable: Column, *, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Network:
    """Fit vectors and network on at most `rows` labelled documents for which trainable holds."""
    sample = labelled_sample(docs, labels, label, trainable, rows, id_col=id_col, text=text)
    # Documents that share an id: the one of smallest hash, so that reruns agree.
    sample = stored(sample.groupBy(id_col, "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "quality-sample")
    texts = sample.select("text")
    counts = texts.mapInPandas(document_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    # Words of a bounded sample: as many as its texts share.
    words = [RARE, *sorted(r.word for r in counts.select("word").collect())]
    sums = texts.mapInPandas(context_sums(words), "part int, sums binary").groupBy("part").applyInPandas(add_sums, "part int, sums binary")
    around = np.zeros((len(words), DIM), dtype=np.int32)
    for r in sums.collect():
        part = np.frombuffer(r.sums, dtype=np.int32).reshape(-1, DIM)
        around[r.part * ROWS : r.part * ROWS + len(part)] = part
    vectors = word_vectors(words, around)

    @F.pandas_udf("binary")
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = {w: i for i, w in enumerate(words)}
        for texts in batches:
            yield pd.Series([pooled(t, vectors, ids).astype(np.float32).tobytes() for t in texts])

    got = sample.select(F.xxhash64(id_col).alias("h"), "y", pool("text").alias("x")).orderBy("h").collect()
    x = np.frombuffer(b"".join(r.x for r in got), dtype=np.float32).astype(np.float64).reshape(len(got), INPUTS)
    return fit_network(x, np.array([r.y for r in got], dtype=np.float64), words, vectors)


def score(text: Column, network: Network) -> Column:
    """Calibrated probability of label 1 of whole texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = {w: i for i, w in enumerate(network.words)}
        for texts in batches:
            x = np.array([pooled(t, network.vectors, ids) for t in texts], dtype=np.float64).reshape(len(texts), INPUTS)
            yield pd.Series(network.score(x), dtype="float64")

    return run(text)
