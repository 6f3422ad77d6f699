"""Source divergence, periodic runs and MinHash near-duplicates against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import minhash_neardup, periodic_runs, source_divergence

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \t\n", "a", "a b", "A b c", "x " * 300, "ab cd\r\n" * 40 + "é", "word" * 5000]


# --- source divergence ---------------------------------------------------------------


def divergence(rows, least):
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        docs = Counter(t for w, _ in own for t in set(w))
        kept = {t for t, n in docs.items() if n >= least}
        count = {s: Counter() for _, s in own}
        for w, s in own:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in count.items():
            pairs = [(-sum(abs(share(c, t) - share(count[o], t)) for t in kept), o.encode()) for o in count if o != s]
            over = [(share(whole, t) - share(c, t), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:50])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audit_rows(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Élan", "ABC", "ß", "\U0001f600x"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "S2", "é", None, ""])
        own = words[: 30 + 20 * len(source or "")] if rng.random() < 0.6 else words
        rows.append((i, " ".join(rng.choices(own, k=rng.randint(0, 30))), rng.choice(["en", "en", "fr", None]), source))
    return rows + [(None, None, "en", "silent"), (1, "1 2 3", "xx", "lone"), (1, "", None, "s9"), (2, "seldom here", "xx", "s1")]


@pytest.mark.parametrize(("seed", "least"), [(1, 30), (2, 3)])
def test_divergence_matches_brute_force(spark, seed, least):
    rows = audit_rows(seed)
    got = source_divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(3), least_docs=least)
    assert sorted(map(tuple, got.collect())) == divergence(rows, least)


def test_divergence_of_empty_and_widened_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert source_divergence.divergence(empty).count() == 0
    rows = audit_rows(3, 120)
    wide = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("item", "value", "term", "n", "p", "q", "z", "salt", "total")})
    assert sorted(map(tuple, source_divergence.divergence(wide, least_docs=2).collect())) == divergence(rows, 2)


def test_shares_do_not_overflow(spark):
    big = 10**15
    row = spark.range(1).select(source_divergence.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 5) // (3 * big + 35)


def test_terms_in_blocks(monkeypatch):
    text = ("Ab c-d été " * 500).encode()
    whole = source_divergence.terms_of(text)
    monkeypatch.setattr(source_divergence, "BLOCK", 7)
    assert source_divergence.terms_of(text) == whole == Counter({b"ab": 500, b"c": 500, b"d": 500, "été".encode(): 500})


def test_sums_are_sent_on_when_many_terms_are_held(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(source_divergence, "TABLE_SIZE", 4)
    batch = pd.DataFrame({"lang": ["en"] * 3, "source": ["s"] * 3, "text": [b"a b c", b"d e a", b"a"]})
    parts = list(source_divergence.count_terms(iter([batch])))
    assert len(parts) == 2
    assert pd.concat(parts).groupby("term")[["n", "docs"]].sum().loc["a"].tolist() == [3, 3]


# --- periodic runs -------------------------------------------------------------------


def runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size, part = j - i + q, words[i : j + q]
            if j > i and size >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(found), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def planted(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        q, a = rng.randint(1, max(1, n // 8)), rng.randrange(n)
        for i in range(a + q, min(n, a + rng.randint(4, max(4, n)))):
            words[i] = words[i - q]
    return words


@pytest.mark.parametrize("size", [12, 40, 250, 700])
def test_runs_match_brute_force(size):
    rng = random.Random(size)
    for _ in range(60):
        words = planted(rng, size)
        assert periodic_runs.find_runs(np.array(words, dtype=np.int32)) == runs(words)


def test_multiples_of_a_period_are_not_runs():
    words = np.array(list(range(5)) * 400, dtype=np.int32)
    assert periodic_runs.find_runs(words) == [(0, 2000, 5)]


def test_sampling_loses_no_long_period():
    rng = random.Random(5)
    for q in (100, 333, 500, 777):
        words = rng.choices(range(1000), k=90) + rng.choices(range(9), k=q) * 4 + [-1 % 9, *rng.choices(range(1000), k=41)]
        found = periodic_runs.find_runs(np.array(words, dtype=np.int32))
        assert any(r[2] == q and r[1] >= 4 * q for r in found)


def test_runs_of_a_very_long_text_take_little_more_than_its_length():
    words = np.random.default_rng(1).integers(0, 50_000, 400_000).astype(np.int32)
    words[100_000:300_000] = words[100_000 + np.arange(200_000) % 41_000]
    assert periodic_runs.find_runs(words) == [(100_000, 200_000, 41_000)]


def test_periodic_runs_per_document(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, planted(rng, rng.randint(1, 120))))) for i in range(150)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), *[(1000 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, start string")
    got = periodic_runs.periodic_runs(docs.repartition(3), keep=["start"]).collect()
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted((described(*r) for r in rows), key=repr)
    assert {r[8] for r in got} == {"k"}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_words_in_blocks(monkeypatch):
    text = b"ab  cd\tab\x0bxyz " * 50
    monkeypatch.setattr(periodic_runs, "BLOCK", 5)
    ids, words = periodic_runs.word_numbers(text)
    assert [words[i] for i in ids] == text.split()


# --- MinHash near-duplicates -----------------------------------------------------------


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def near(rows, percent=85):
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def changed(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=25, copies=14, words=160):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(words))
        rows += [changed(rng, base, rng.randrange(9)) for _ in range(copies)]
    rows += [r.upper() for r in rows[:5]] + ODD + ODD
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(3, rows[9]), (3, rows[9])]


def found(docs, **how):
    got = minhash_neardup.near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == near(rows)


def test_large_keys_in_blocks_match_brute_force(spark, monkeypatch):
    # Copies that link to their origin but mostly not to each other, in keys far over the limit.
    rng = random.Random(4)
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, *[changed(rng, base, rng.choice([4, 5, 6, 7])) for _ in range(160)]]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900 + i, t) for i, t in enumerate(t for _, t in corpus(6, 4, 6))]
    monkeypatch.setattr(minhash_neardup, "SMALL_KEY", 3)
    monkeypatch.setattr(minhash_neardup, "BLOCK_NODES", 20)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=1) == near(rows)


def test_signatures_estimate_similarity():
    a = minhash_neardup.shingles(" ".join(f"w{i}" for i in range(4000)).encode())
    b = minhash_neardup.shingles(" ".join(f"w{i}" for i in range(400, 4400)).encode())
    differ = np.count_nonzero(minhash_neardup.signature(a).view("<u2") != minhash_neardup.signature(b).view("<u2"))
    assert len(a) == 3998 and 1 <= differ <= minhash_neardup.MAX_DIFFER


def test_every_pair_under_the_threshold_shares_a_key(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lanes = [rng.randrange(1 << 16) for _ in range(32)]
        other = list(lanes)
        for at in rng.sample(range(32), minhash_neardup.MAX_DIFFER):
            other[at] ^= rng.randrange(1, 1 << 16)
        pack = lambda v: np.array(v, dtype="<u2").view("<i8").tolist()
        rows += [(2 * i, 100, *pack(lanes)), (2 * i + 1, 100, *pack(other))]
    nodes = spark.createDataFrame(rows, "nid long, n long, " + ", ".join(f"{c} long" for c in minhash_neardup.CHUNK_NAMES))
    keyed = nodes.select((F.col("nid") / 2).cast("long").alias("pair"), "nid", minhash_neardup.keys().alias("k"))
    met = keyed.alias("x").join(keyed.alias("y"), "pair").where("x.nid < y.nid")
    assert met.where(F.arrays_overlap("x.k", "y.k")).count() == 300
    x, y = nodes.alias("x"), nodes.alias("y")
    both = x.join(y, F.col("x.nid") + 1 == F.col("y.nid")).where("x.nid % 2 = 0").select(minhash_neardup.differing().alias("d"))
    assert {r.d for r in both.collect()} == {minhash_neardup.MAX_DIFFER}


def test_near_duplicates_of_empty_and_widened_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b  c d", "y"), (None, None, "z")], "doc_id long, text string, n string")
    got = minhash_neardup.near_duplicates(docs.withColumnRenamed("n", "component"), keep=["component"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 2, 1, True, "x"), (2, 2, 1, False, "y"), (None, 0, None, True, "z")], key=repr)
    assert minhash_neardup.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_in_blocks(monkeypatch):
    text = ("Ab cd\tef gh " * 40 + "ij").encode()
    whole = minhash_neardup.shingles(text)
    monkeypatch.setattr(minhash_neardup, "BLOCK", 6)
    assert minhash_neardup.shingles(text).tolist() == whole.tolist() and len(whole) == len(grams(text.decode()))
