"""Classifiers by held-out accuracy, kNN by brute force, WARC by round trip, BPE by the library, the pipeline by rules."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, knn_join, quality_model, registry, toxicity, warc
from corpusloom.llm.labelled import fold, labelled_sample

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(scores, y):
    scores, y = np.asarray(scores), np.asarray(y)
    pairs = scores[y == 1][:, None] - scores[y == 0][None, :]
    return float((pairs > 0).mean() + 0.5 * (pairs == 0).mean())


@pytest.mark.parametrize(("name", "label", "floor"), [("op6_toxicity", "toxic", 0.85), ("op10_quality_model", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, floor):
    rows = registry.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [r[label] for r in held]) > floor
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_scores_ignore_other_columns_and_unlabelled_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        bad = i % 2
        rows.append((i, " ".join(rng.choice(["tree", "house", "river", *(["awful", "scum"] if bad else [])]) for _ in range(30)), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "x", "y", 0), (902, "scum " * 30_000, "en", "s", 0), (None, "awful scum", "en", "s", 0), (3, "scum awful scum", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(5, 1, 1), (900, None, None), (None, 1, 1), (901, 7, 7)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_model):
        model = module.train(docs, labels, fold(F.col("doc_id"), 4) != 2, label="toxic")
        got = docs.select("doc_id", "text", module.score(F.col("text"), model).alias("s")).collect()
        other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None), "doc_id": F.col("doc_id") + 5000}).select("text", module.score(F.col("text"), model).alias("s")).collect()
        assert sorted((r.text or "", r.s) for r in got) == sorted((r.text or "", r.s) for r in other)
        assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
        by_id = {r.doc_id: r.s for r in got if r.doc_id is not None and r.doc_id < 200 and r.text != "scum awful scum"}
        assert auc(list(by_id.values()), [i % 2 for i in by_id]) > 0.95
        nothing = module.train(docs, labels.limit(0), F.lit(True), label="toxic")
        assert docs.limit(3).select(module.score(F.col("text"), nothing).alias("s")).distinct().first().s == pytest.approx(0.5, abs=0.01)
        assert docs.limit(0).select(module.score(F.col("text"), model)).count() == 0


def test_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, y0 int")
    take = lambda d: sorted(r.doc_id for r in labelled_sample(d, labels, "y0", F.lit(True), 10).collect())
    assert len(take(docs)) == 10 and take(docs) == take(docs.repartition(7))


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(1)
    x = (rng.random((1500, 12)) < 0.4).astype(np.uint8)
    y = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(np.float64)
    m = toxicity.fit_machine(x, y, {})
    score = np.array([m.score(list(np.nonzero(r)[0])) for r in x])
    both, one = score[y == 1].mean(), score[(y == 0) & (x[:, 0] == 1)].mean()
    assert both > 0.8 and one < 0.2


def test_pairs_become_inputs_where_neither_term_leans_alone():
    """Labels are the exclusive or of two terms among many: shares of either term alone are those of chance."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(2000):
        a, b = bool(i & 1), bool(i & 2)
        texts.append(" ".join([*rng.choice(words, 20), *(["you"] if a else []), *(["group"] if b else [])]))
        y.append(float(a == b))
    rows, y = [np.array(toxicity.terms_of(t), dtype=np.int64) for t in texts], np.array(y)
    own = {w: toxicity.word_terms(w)[0] for w in ("you", "group")}
    for t in own.values():
        has = np.array([t in r for r in rows])
        assert toxicity.lean(has.sum(), y[has].sum(), len(y), y.sum()) < 1
    found = toxicity.inputs(rows, y)
    assert set(own.values()) <= set(found) and found == sorted(found)
    slots = {t: i for i, t in enumerate(found)}
    x = np.zeros((len(rows), len(slots)), dtype=np.uint8)
    for i, r in enumerate(rows):
        x[i, [slots[t] for t in r.tolist() if t in slots]] = 1
    machine = toxicity.fit_machine(x, y, slots)
    score = np.array([machine.score(list(np.nonzero(r)[0])) for r in x])
    assert auc(score, y) > 0.99


def leaning(rows, y, size):
    """Inputs by trying every term and every pair over all rows."""
    has = np.zeros((len(rows), size), dtype=bool)
    for i, r in enumerate(rows):
        has[i, r] = True
    total, share, want = len(y), y.mean(), set()
    for a in range(size):
        for b in range(a, size):
            both = has[:, a] & has[:, b]
            n, yes = both.sum(), y[both].sum()
            if n < toxicity.LEAST_DOCS:
                continue
            spread = ((n + 1) / (total + 2) * (1 / (y.sum() + 1) + 1 / (total - y.sum() + 1))) ** 0.5
            z = abs(yes / y.sum() - (n - yes) / (total - y.sum())) / spread
            nats = sum(k * math.log(k / n / p) for k, p in ((yes, share), (n - yes, 1 - share)) if k)
            if z >= toxicity.TERM_LEAN if a == b else z >= toxicity.PAIR_LEAN and nats >= toxicity.PAIR_SURPRISE:
                want |= {a, b}
    return sorted(want)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.2, 2.0])
def test_inputs_match_brute_force(share, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT_SHARE", share)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.choice(40, rng.integers(0, 14), p=np.r_[np.full(10, 0.08), np.full(30, 0.2 / 30)])) for _ in range(900)]
    y = np.array([float(3 in r and 4 in r or 7 in r or 11 in r and 2 in r) for r in rows])
    want = leaning(rows, y, 40)
    assert len(want) > 3 and toxicity.inputs(rows, y) == want
    assert toxicity.inputs(rows, 1 - y) == leaning(rows, 1 - y, 40)
    assert toxicity.inputs([], np.zeros(0)) == [] and toxicity.inputs([np.zeros(0, dtype=np.int64)], np.ones(1)) == []


def test_memory_of_a_fit_does_not_grow_with_terms_times_rows(monkeypatch):
    """What the driver holds while it counts pairs of frequent terms and while it fits: a few bytes an input, no dense rows."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = np.random.default_rng(4)
    y = (np.arange(600) % 5 == 0).astype(float)
    rows = [np.unique(rng.integers(0, 6000, 100)) for _ in y]

    def peak(run):
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(lambda: toxicity.frequent_pairs(rows, y, np.arange(6000), 6000)) < 40
    assert peak(lambda: toxicity.fit_rows(rows, 6000, y, {})) < 12


def test_a_rare_pair_is_an_input_where_neither_term_is():
    rows = [np.zeros(0, dtype=np.int64) for _ in range(8000)]
    y = (np.arange(8000) % 10 == 0).astype(float)
    toxic, clean = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    for term, at in ((1, 0), (2, 130)):
        for i in [*toxic[:20], *clean[at : at + 130]]:
            rows[i] = np.union1d(rows[i], [term])
    for term in (1, 2):
        has = np.array([term in r for r in rows])
        assert has.sum() == 150 < toxicity.FREQUENT_SHARE * 8000 and toxicity.lean(has.sum(), y[has].sum(), 8000, y.sum()) < toxicity.TERM_LEAN
    assert toxicity.inputs(rows, y) == [1, 2]


def pooled_by_hand(words, vectors, ids):
    """The four poolings of one text, word by word."""
    dim = quality_model.DIM
    each = [vectors[ids[w]].astype(float) if w in ids else quality_model.index_vectors([w])[0] / math.sqrt(2 * quality_model.NONZERO) for w in words]
    spans = [each[i : i + quality_model.SPAN] for i in range(0, len(each), quality_model.SPAN)]
    moment = lambda groups: sum((sum(g) ** 2 / len(g) for g in groups), np.zeros(dim)) / max(len(groups), 1)
    total = sum(each, np.zeros(dim))
    return np.concatenate([total / max(len(each), 1), *[np.log(m + 1e-4) for m in (moment([[v] for v in each]), moment(spans), total**2 / max(len(each), 1))]])


def test_pooling_is_the_same_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice("one two three four five six".split()) for _ in range(700)] + ["rare", "!"]
    vectors = np.random.default_rng(1).normal(size=(7, quality_model.DIM)).astype(np.float32)
    ids = {w: i for i, w in enumerate(["", *"one two three four five six".split()])}
    want = pooled_by_hand(words, vectors, ids)
    for block in (1 << 18, 50, 7):
        monkeypatch.setattr(quality_model, "BLOCK", block)
        assert np.allclose(quality_model.pooled(" ".join(words), vectors, ids), want, atol=1e-4)
    assert quality_model.pooled(None, vectors, ids).shape == (quality_model.INPUTS,)


def test_words_that_come_back_change_the_vectors_alone():
    """Texts of the same words in other numbers and orders differ in what is pooled."""
    words = [f"w{i}" for i in range(64)]
    vectors, ids = quality_model.index_vectors(["", *words]).astype(np.float32), {w: i + 1 for i, w in enumerate(words)}
    once, twice = " ".join(words), " ".join(w for w in words[:32] for _ in range(2))
    far = " ".join(words[:32] * 2)
    a, b, c = (quality_model.pooled(t, vectors, ids).reshape(quality_model.POOLS, -1).mean(axis=1) for t in (once, twice, far))
    assert b[2] > a[2] + 0.4 and c[2] < b[2] - 0.4 and b[3] > a[3] + 0.3 and c[3] > a[3] + 0.3


def test_scores_match_brute_force(spark):
    """Query scores against the models' formulas, written out for one text at a time."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = docs.select("doc_id", "text").where("doc_id % 40 = 0").collect()
    machine = toxicity.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r.score for r in registry.op6_toxicity(spark, SF).collect()}
    for r in texts:
        terms = {zlib.crc32(p.encode()) % 2**22 for w in set(re.findall(r"[^\W\d_]+", r.text.lower())) for p in [w, *("^" + w[:n] for n in (4, 5, 6, 7) if len(w) >= n)]}
        at = [machine.slots[t] for t in terms if t in machine.slots]
        margin = machine.bias + sum(float(machine.weight[i]) for i in at) / max(len(at), 1) ** 0.5
        margin += sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(at) for j in at[:k]) / max(len(at), 1)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(machine.slope * margin + machine.offset))), abs=1e-6)
    network = quality_model.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in registry.op10_quality_model(spark, SF).collect()}
    ids = {w: i for i, w in enumerate(network.words)}
    for r in texts:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[0-9]+|[!-/:-@\[-`{-~]", r.text)
        z = (pooled_by_hand(words, network.vectors, ids) - network.centre) / network.scale
        margin = np.maximum(z @ network.w1 + network.b1, 0) @ network.w2 + network.b2
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-margin / network.temperature)), abs=1e-3)


def test_word_vectors_are_sums_of_index_vectors_of_neighbours(spark):
    """Vectors gathered by Spark against a loop over neighbours, words in the order of the model."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["red", "Red", "tree!", "7", "house"] + [f"once{i}"]) for _ in range(20))) for i in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    network = quality_model.train(docs, labels, F.lit(True))
    assert network.words[0] == "" and {"!", "7", "Red", "house", "red", "tree"} <= set(network.words)
    index, ids = quality_model.index_vectors(network.words), {w: i for i, w in enumerate(network.words)}
    assert (np.abs(index).sum(axis=1) <= quality_model.NONZERO).all() and len({tuple(v) for v in index}) == len(index)
    sums = np.zeros(index.shape)
    for _, text in rows:
        at = [ids.get(w, 0) for block in quality_model.words_of(text) for w in block]
        for i, w in enumerate(at):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(at):
                    sums[w] += np.roll(index[at[j]], i - j)
    sums[0] = 0
    want = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + index / math.sqrt(quality_model.NONZERO)) / math.sqrt(2)
    assert np.allclose(network.vectors, want, atol=1e-5)


def test_words_in_blocks_are_the_words_of_the_text(monkeypatch):
    text = "Ab1 c\u00e9d, " * 50 + "end!"
    whole = quality_model.WORD.findall(text)
    monkeypatch.setattr(quality_model, "BLOCK", 7)
    blocks = list(quality_model.words_of(text))
    assert [w for b in blocks for w in b] == whole and len(blocks) > 10
    assert list(quality_model.words_of(None)) == [] and list(quality_model.words_of("")) == []


def test_extra_columns_with_clashing_names_change_nothing(spark, tmp_path):
    plain, clash = f"file://{tmp_path}/plain", f"file://{tmp_path}/clash"
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["score", "labels", "n_tokens", "d", "h", "y", "terms", "kept", "fingerprint", "fp", "component_id", "size", "target", "base", "added", "hash", "spans", "_id", "_key", "_text", "_copies", "r"]
    for folder, rows in ((plain, docs), (clash, docs.withColumns({n: F.lit("clash") for n in names}))):
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").withColumns({n: F.lit("clash") for n in ("score", "y", "h", "text", "terms")} if folder == clash else {}).write.parquet(f"{folder}/labels.parquet")
    for name in ("op3_license_scan", "op6_toxicity", "op9_bpe", "op10_quality_model"):
        want, got = (sorted(map(str, registry.QUERIES[name](spark, folder).collect())) for folder in (plain, clash))
        assert got == want, name
    want, got = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for folder in (plain, clash))
    assert got == want and got


def test_a_labelled_id_with_two_texts_is_learned_alike_on_every_run(spark):
    rows = [(i, f"word{i % 7} {'awful scum' if i % 2 else 'tree house'}", i) for i in range(80)] + [(i, f"other text {i}", 0) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    for module in (toxicity, quality_model):
        scores = []
        for parts in (1, 7):
            docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts, "n")
            model = module.train(docs, labels, F.lit(True), label="toxic")
            scores.append(sorted(docs.select("doc_id", "text", module.score(F.col("text"), model)).collect()))
        assert scores[0] == scores[1]


def brute_top(rows, k):
    best = []
    usable = [(i, np.floor(np.array(v, dtype=np.float64) * 64).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in usable if i % 20 == 0}.items():
        scores = sorted(((-int(v @ w), i) for i, w in usable if i != q))
        best += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(best)


@pytest.mark.parametrize("blocks", [(4096, 4096), (3, 7)])
def test_top_k_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(160)]
    rows += [(i, [0.5] * 8) for i in range(200, 260)] + [(300, [0.0] * 8), (301, None), (302, [None] + [0.1] * 7), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [0.1] * 8), (45, [0.3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = knn_join.top_k(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), pivots=5, query_block=blocks[0], data_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)


def test_bounds_prune_clustered_rows(spark):
    """Far apart clusters: a group of queries needs its own cluster's rows and few others; results stay exact."""
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 6
    rows = [(i, (centres[i // 20 % 8] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 20 == 0
    p = knn_join.plan(df, asks, query_block=20)
    assert len(p.groups) >= 8 and p.queries == 160 and p.pruned() > 0.8
    got = knn_join.top_k(df, asks, query_block=20, data_block=100)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)


def test_cells_are_packed_and_split():
    groups, place = knn_join.pack([(0, 3), (1, 4), (2, 25), (3, 9), (4, 1)], 10)
    assert groups == [[0, 1], [2], [2], [2], [3, 4]]
    assert place == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (4, 1)}


def test_top_k_of_few_rows_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (20, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    want = brute_top([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (20, [-1.0, 0.5])], 20)
    assert sorted(map(tuple, knn_join.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
    assert knn_join.top_k(df.limit(0), F.lit(True)).count() == 0


PAGES = [
    (5, "http://a/5", "y" * 150), (2, "http://a/ b\r\nc", "y" * 150), (3, None, "y" * 150), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "n", "y" * 150),
    (9, "u", "é😀" * 60), (9, "u", "é😀" * 60), (10, "u", "WARC/1.1\r\n\r\n" * 40), (11, "u", "z" * 300_000),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    smallest = {}
    for i, _, h in PAGES:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            smallest[h] = min(i, smallest.get(h, i))
    want = []
    for i, _, h in PAGES:
        h = (h or "").encode()
        first = smallest.get(h)
        again = first is not None and i != first
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdefghij") for _ in range(20_000))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    warc.write_archives(warc.with_roles(pages), f"file://{path}", row_bytes=50_000, rows_per_file=2)
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")]
    assert len(sizes) > 3 and max(sizes) < 150_000
    assert sorted(r.page_id for r in warc.read_archives(spark, f"file://{path}").collect()) == list(range(60))


def archive(n=6, zipped=True):
    records = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 40, "0" * 64, None) for i in range(n)]
    return [warc.gzip_member(r) for r in records] if zipped else records


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_what_stands_after_damage(zipped):
    parts = archive(zipped=zipped)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    data = bytearray(b"".join(parts))
    at = starts[2] + (len(parts[2]) // 2 if zipped else 3)
    data[at : at + 4] = b"\x00\xff\x00\xff"
    found = list(warc.salvage(bytes(data)))
    assert [warc._page(h["warc-record-id"]) for _, _, h, _ in found if h] == [0, 1, 3, 4, 5]
    assert [(o, n) for o, n, h, _ in found if h is None] == [(starts[2], len(parts[2]))]
    cut = bytes(b"".join(parts))[: starts[5] + 20]
    found = list(warc.salvage(cut))
    assert len([1 for x in found if x[2]]) == 5 and found[-1][:2] == (starts[5], 20)
    assert list(warc.salvage(b"noise" + b"".join(parts)))[0][:3] == (0, 5, None)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk"))[0][2] is None


def ids_of(found):
    return [headers["warc-record-id"] for _, _, headers, _ in found if headers is not None]


def urns(*ids):
    return [f"<{warc.RECORD_URN}{i}>" for i in ids]


def test_salvage_of_plain_records_with_compressed_payloads():
    packed = [warc.record(i, f"http://x/{i}", warc.gzip_member(b"<html>page %d</html>" % i * 30) if i % 2 == 0 else b"x\x1f\x8b\x08y" * 9, "0" * 64, None) for i in range(4)]
    data = b"".join(packed)
    assert ids_of(warc.salvage(data)) == urns(0, 1, 2, 3)
    hurt = b"?" + data[1:]
    found = list(warc.salvage(hurt))
    assert ids_of(found) == urns(1, 2, 3) and [f[:3] for f in found if f[2] is None] == [(0, len(packed[0]), None)]
    # Sound members between plain records that are not.
    at = len(packed[0]) + len(packed[1])
    torn = data[:at] + b"#" + data[at + 1 :]
    found = list(warc.salvage(torn))
    assert ids_of(found) == urns(0, 1, 3) and (at, len(packed[2]), None) in [f[:3] for f in found]


def test_salvage_of_members_and_plain_records_in_one_file():
    records = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 40, "0" * 64, None) for i in range(6)]
    zipped = [warc.gzip_member(r) for r in records]
    mixed = zipped[0] + zipped[1] + records[2] + records[3] + zipped[4] + records[5]
    assert ids_of(warc.salvage(mixed)) == urns(*range(6))
    assert [f[2] for f in warc.salvage(mixed)].count(None) == 0
    for hurt in range(6):
        places = [zipped[0], zipped[1], records[2], records[3], zipped[4], records[5]]
        begin = sum(map(len, places[:hurt]))
        data = bytearray(mixed)
        data[begin] ^= 0xFF
        found = list(warc.salvage(bytes(data)))
        assert ids_of(found) == urns(*(i for i in range(6) if i != hurt))
        assert [f[:3] for f in found if f[2] is None] == [(begin, len(places[hurt]), None)]


def test_salvage_takes_time_in_proportion_to_the_file():
    lines = b"WARC/1.1\r\nno colon here\r\n" * 40_000
    began = time.time()
    assert ids_of(warc.salvage(lines + warc.record(1, "u", b"p" * 200, "0" * 64, None))) == urns(1)
    assert time.time() - began < 30


def test_salvage_recovers_records_inside_a_member():
    records = archive(zipped=False)
    ids = lambda found: [warc._page(h["warc-record-id"]) for _, _, h, _ in found if h]
    wrong = list(records)
    wrong[2] = wrong[2].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    member = warc.gzip_member(b"".join(wrong))
    found = list(warc.salvage(member))
    assert ids(found) == [0, 1, 3, 4, 5]
    assert [x[:2] for x in found if x[2] is None] == [(0, len(member))]
    rng = random.Random(4)
    noise = [warc.record(i, "u", rng.randbytes(3000), "0" * 64, None) for i in range(60)]
    whole, after = warc.gzip_member(b"".join(noise)), warc.gzip_member(records[0])
    cut = list(warc.salvage(whole[: len(whole) // 2]))
    assert ids(cut)[:25] == list(range(25)) and cut[-1][:3] == (0, len(whole) // 2, None)
    flipped = bytearray(whole)
    flipped[-8] ^= 1
    found = list(warc.salvage(bytes(flipped) + after))
    assert ids(found) == [*range(60), 0]
    assert found[-1][:2] == (len(whole), len(after)) and found[-2][:3] == (0, len(whole), None)


def test_read_archives_gives_payloads_and_gaps(spark, tmp_path):
    parts = archive(3)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"garbage" + parts[1] + parts[2])
    rows = warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [r.record_type for r in rows] == ["response", "gap", "response", "response"]
    assert bytes(rows[2].payload) == b"page 1 " * 40 and rows[1].length == 7


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    library = Tokenizer.from_file(PATH)
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    odd = ["", "  ", "it's we'll ''s 's'", "a<|endoftext|>b <|startoftext|><|endoftext|", "ΑΣ ΟΔΟΣ İ K", "x" * 5000, "ab" * 9000, "\x1c!\x1d \x85a\xa0b​c　d", "123 4５ ²³ ⅷ", "😀😃 ❤️", "\r\n\t", "ﬁ ǅ ß ẞ"]
    for _ in range(400):
        odd.append("".join(rng.choice("abcABC 12'!<|>\né́ΣσİẞK你\x1f\x00 stvedlm") for _ in range(rng.randint(0, 40))))
    for text, want in zip(odd, library.encode_batch(odd, add_special_tokens=False), strict=True):
        ids, tokens = bpe.encode(vocabulary, text)
        assert ids == " ".join(map(str, want.ids)), text
        assert tokens == library.decode(want.ids, skip_special_tokens=False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*odd[:20], None])], "i long, text string")
    ids = bpe.token_ids(spark, F.col("text"), PATH)
    rows = df.select("i", ids.alias("ids"), bpe.digests(spark, F.col("text"), PATH).alias("d")).withColumn("back", bpe.decoded(spark, F.col("ids"), PATH)).collect()
    for r in rows:
        want = library.encode(odd[r.i] if r.i < 20 else "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.d.n_tokens == len(want)
        assert r.back == library.decode(want, skip_special_tokens=False)
        assert r.d.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(r.back.encode()).hexdigest()
    assert df.limit(0).select(bpe.digests(spark, F.col("text"), PATH)).count() == 0


def test_words_outgrow_the_tables(monkeypatch):
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    vocabulary.words.size = vocabulary.pieces.size = 8
    text = " ".join(f"w{i}x" for i in range(40)) + " w3x w3x"
    assert bpe.encode(vocabulary, text) == bpe.encode(bpe.Vocabulary(open(PATH, encoding="utf-8").read()), text)


def test_pipeline_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (5001, "", "en", "s", 0), (None, "no id here at all", "en", None, 17), (5002, "mail me a.b@c.de now", "en", "s", 20)], DOCS)
    docs.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/{name}")
        before, rows = rows, spark.read.parquet(f"{folder}/{name}")
        counts.append(rows.count())
        if name == "near_duplicates":
            from corpusloom.llm import simhash_neardup

            groups = simhash_neardup.near_duplicates(before.where("doc_id is not null")).select("doc_id", "component_id").collect()
            assert sorted(r.doc_id for r in rows.where("doc_id is not null").collect()) == sorted({r.component_id for r in groups})
            assert rows.where("doc_id is null").count() == 1
        if name == "personal_data":
            assert rows.where("doc_id = 5002").first().text == "mail me [email] now"
            assert rows.where(F.col("text").rlike("[a-z0-9]@[a-z]+[.][a-z]")).count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == counts[4]


def test_pipeline_keeps_one_row_of_every_component(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    texts = [(1, a), (2, a), (1, b), (3, b), (1, b), (None, c), (None, c), (None, a), (4, None), (None, "")]
    rows = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS)
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left) == [(False, 1, a), (False, 1, b), (False, 4, ""), (True, 0, c)]


def test_pipeline_mixes_documents_without_words(spark):
    rows = spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in enumerate([("w " * 9, "a"), ("", "a"), (None, "a"), ("w " * 900, "b")])], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.mix(spark, rows, "").collect() if r.doc_id < 3) == [0, 0, 1, 1, 2, 2]


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
