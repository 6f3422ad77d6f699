"""Tokens, normalisation, language and hashes against plain Python."""

import hashlib
import html
import random
import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import hashing, text
from corpusloom.operators import normalize


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


ODD = [
    "", "   ", "a b\x1fc d", "  café&nbsp;Policy \r\n Leave  ", "é ＡＢ", "x​y﻿", "İstanbul K don't ÷×", "line one\rline two\n\n three ", "&amp;lt; &#233;",
    "  indent\n    more  \n\n", "One. Two! three? \"Four\" Éa", "tab\tand\x85next　wide",
]


def test_tokenizers(spark):
    assert column(spark, ODD, text.ws_tokens) == [re.findall(r"\S+", t) for t in ODD]
    assert column(spark, ODD, text.token_count) == [len(t.split()) for t in ODD]
    assert column(spark, ODD, text.latin_tokens) == [[w.lower() for w in re.findall(r"[A-Za-z0-9À-ÿ']+", t)] for t in ODD]
    assert column(spark, ODD, text.query_tokens) == [[w.lower() for w in re.findall(r"[A-Za-z0-9_]+", t)] for t in ODD]


def test_sentences(spark):
    assert column(spark, ["One two. Three! four? Five. \"Six\" Éa. ", ""], text.chunk_sentences) == [["One two.", "Three! four?", "Five.", "\"Six\" Éa."], []]
    assert column(spark, ["A b. c d?  e", " "], text.answer_sentences) == [["A b.", "c d?", "e"], []]


def plain_normal(t):
    t = unicodedata.normalize("NFC", html.unescape(t)).replace("\r\n", "\n").replace("\r", "\n")
    for c in "​‌‍﻿":
        t = t.replace(c, "")
    return t


def test_normalisation(spark):
    assert column(spark, ODD, text.normalize_text) == [" ".join(plain_normal(t).split()) for t in ODD]
    kept = column(spark, ODD, lambda c: text.normalize_text(c, True))
    for t, got in zip(ODD, kept, strict=True):
        assert got == "\n".join(" ".join(x.split()) for x in plain_normal(t).split("\n")).strip("\n")
    code = column(spark, ["  a\n    b  \n\n", "\n\nx &lt; y\r\n"], text.normalize_code)
    assert code == ["  a\n    b", "x < y"]


def test_boilerplate(spark):
    rows = [("Skip to main content", "paragraph", True), ("ALL RIGHTS RESERVED.", "list", True), ("Copyright © 2020 Some One", "paragraph", True), ("copyright ٢٠٢٠ x", "quote", True),
            ("Skip to main content", "heading", False), ("Privacy policy applies", "paragraph", False), ("Home | About | Contact", "paragraph", True), ("cookie notice " + "x" * 120, "paragraph", False), ("", "paragraph", False)]
    df = spark.createDataFrame(rows, "t string, k string, want boolean")
    assert df.where(text.is_boilerplate(F.col("t"), F.col("k")) != F.col("want")).count() == 0


def test_language(spark):
    cases = {
        "The employees must follow the policy and the rules for each of the offices": "en", "Les employés doivent suivre la politique et les règles dans chaque bureau": "fr",
        "the and of to in for is": "und", "the and of to in for is on": "en", "en la que un zz yy xx ww": "fr", "de en que un zz yy xx ww": "fr", "qq ww ee rr tt yy uu ii oo": "und",
    }
    assert column(spark, list(cases), lambda c: text.detect_language(text.latin_tokens(c))) == list(cases.values())


def test_texts_without_latin_words_have_no_language(spark):
    cases = ["", " \n", "中文 文本", "!!! ---", "the and", None]
    detected = lambda c: text.detect_language(text.latin_tokens(c))
    assert column(spark, cases, detected) == ["und"] * 5 + [None]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.language for r in normalize.describe(docs).collect()} == {i: None if t is None else "und" for i, t in enumerate(cases)}


def test_name_based_ids(spark):
    got = column(spark, ["é|x", "", "a"], lambda c: hashing.uuid5(hashing.URL_NAMESPACE, c))
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in ("é|x", "", "a")]
    ids = column(spark, ["s1"], lambda c: hashing.document_id(F.lit("org"), F.lit(" Files "), F.lit("conn"), c))
    assert ids == [str(uuid.uuid5(uuid.UUID(hashing.DOCUMENT_NAMESPACE), "org|files|conn|s1"))]
    assert column(spark, [" //a\\b//c ", "x/y"], hashing.normalize_source_id) == ["a/b/c", "x/y"]


def vote(t, digest):
    tokens = [w.lower() for w in re.findall(r"[A-Za-z0-9À-ÿ']+", t or "")]
    hashes = [digest(w.encode()) for w in tokens]
    value = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(spark):
    rng = random.Random(1)
    values = [*ODD, *[" ".join(rng.choice(["alpha", "beta", "Gamma", "été"]) + str(rng.randrange(30)) for _ in range(50)) for _ in range(20)]]
    blake = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big")
    md5 = lambda b: int(hashlib.md5(b).hexdigest()[:16], 16)
    assert column(spark, values, hashing.simhash64) == [vote(t, blake) for t in values]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {r.i: r.simhash for r in hashing.simhash64_md5(df, "i", "t").collect()}
    assert [got[i] for i in range(len(values))] == [vote(t, md5) for t in values]


def test_white_space_is_what_python_splits_at(spark):
    every = [chr(i) for i in range(1, 0x3100)] + ["﻿", "�", "\U0001f600"]
    rows = spark.createDataFrame([(f"a{c}b",) for c in every], "t string")
    got = rows.select("t", text.token_count(F.col("t")).alias("n"), text.ws_tokens(F.col("t")).alias("w"), text.trim(F.substring("t", 2, 2)).alias("x")).collect()
    assert all((r.n, r.w) == (len(r.t.split()), r.t.split()) and r.x == r.t[1:].strip() for r in got)
