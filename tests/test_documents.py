"""Parsing, cleaning, duplicates and chunks on literal cases."""

import io
import random
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunk, dedup, normalize, parse
from corpusloom.plans import corpus
from corpusloom.session import configure

TEXT = """# Payment guide

First line
second line.

## Steps
- one
- two
1. three

> quoted
> more

    indented code

```python
x = 1

y = 2
```
"""


def sealed(spark, rows, mime):
    docs = spark.createDataFrame([(i, mime, name, title, body) for i, (name, title, body) in enumerate(rows)], "doc_id long, mime string, filename string, title string, text string")
    out = corpus.blocks_of(docs).orderBy("doc_id", "ordinal").collect()
    return [[(b.block_type, b.text, b.heading_level, b.section) for b in out if b.doc_id == i] for i in range(len(rows))]


def test_plain_text_blocks(spark):
    got, bare, nothing = sealed(spark, [("a.txt", None, TEXT), ("notes/report.txt", None, "only a paragraph"), (None, None, "")], "text/plain")
    assert [(k, t) for k, t, *_ in got] == [
        ("title", "Payment guide"), ("paragraph", "First line second line."), ("heading", "Steps"), ("list", "one\ntwo"), ("list", "three"), ("quote", "quoted more"),
        ("code", "indented code"), ("code", "x = 1\n\ny = 2"),
    ]
    assert [s for *_, s in got] == ["Payment guide"] * 2 + ["Steps"] * 6
    assert bare == [("title", "report", None, "report"), ("paragraph", "only a paragraph", None, "report")]
    assert nothing == [("title", "Untitled", None, "Untitled")]


def test_markdown_blocks(spark):
    body = "# Authentication\n\n## Tokens\n\nUse a **bearer** token, see [docs](http://x) `now`.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![diagram](d.png)\n\n```python\nx = '**y**'\n```\n"
    (got,) = sealed(spark, [("a.md", None, body)], "text/markdown")
    assert [(k, t) for k, t, *_ in got] == [
        ("title", "Authentication"), ("heading", "Tokens"), ("paragraph", "Use a bearer token, see docs now."), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("image_caption", "diagram"), ("code", "x = '**y**'"),
    ]
    assert got[1][2] == 2


def test_html_blocks(spark):
    body = """<html><head><title>Runbook</title><style>p{}</style></head><body><script>bad()</script><h1>Top</h1><p>Hello <b>big</b> world</p><ol><li>one</li><li>two <i>x</i></li></ol>
    <pre><code class="language-sql">select 1
from t</code></pre><blockquote>said</blockquote><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><img alt="chart"><div>loose text</div></body></html>"""
    (got,) = sealed(spark, [("a.html", None, body)], "text/html")
    assert [(k, t) for k, t, *_ in got] == [
        ("title", "Runbook"), ("heading", "Top"), ("paragraph", "Hello big world"), ("list", "one\ntwo x"), ("code", "select 1\nfrom t"), ("quote", "said"),
        ("table", "| a | b |\n| --- | --- |\n| 1 |  |"), ("image_caption", "chart"), ("paragraph", "loose text"),
    ]


def test_docx_blocks(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style=None: f'<w:p>{f"<w:pPr><w:pStyle w:val=%s/></w:pPr>" % repr(style) if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'.replace("'", '"')
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = p("Payment Service", "Title") + p("Scope", "Heading2") + p("Text.") + p("one", "ListBullet") + p("two", "ListBullet") + p("said", "Quote") + table
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    docs = spark.createDataFrame([(1, bytearray(data.getvalue()), "p.docx", None), (2, bytearray(b"not a zip"), "q.docx", None)], "doc_id long, data binary, filename string, title string")
    raw = parse.docx_blocks(docs)
    assert [r.doc_id for r in raw.where("block_type = 'error'").collect()] == [2]
    got = parse.seal(raw, docs).where("doc_id = 1").orderBy("ordinal").collect()
    assert [(r.block_type, r.text) for r in got] == [("title", "Payment Service"), ("heading", "Scope"), ("paragraph", "Text."), ("list", "one\ntwo"), ("quote", "said"), ("table", "| a | b |")]


def test_pdf_words_and_ocr(spark):
    words = [(1, 1, 10.0, 10.0, 20.0, "Leave"), (1, 1, 60.0, 10.4, 20.0, "policy"), *[(1, 1, 10.0 + 9 * i, 40.0 + 12 * j, 10.0, f"w{j}{i}") for j in range(3) for i in range(4)]]
    df = spark.createDataFrame(words, "doc_id long, page int, x0 double, top double, size double, text string")
    rows = parse.pdf_word_blocks(df).orderBy("at").collect()
    assert [(r.block_type, r.level, r.text) for r in rows][:2] == [("heading", 1, "Leave policy"), ("paragraph", None, "w00 w01 w02 w03")]
    pages = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, ""), (2, 1, "x" * 50)], "doc_id long, page int, text string")
    assert [r.doc_id for r in parse.needs_ocr(pages).collect()] == [1]


def test_decoding(spark):
    rows = [("é".encode("utf-16"), "é"), ("﻿é".encode(), "é"), ("é".encode(), "é"), ("é".encode("latin-1"), "é"), (b"", "")]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "b binary, want string")
    assert [r.x for r in df.select(parse.decode_bytes(F.col("b")).alias("x")).collect()] == [w for _, w in rows]


def test_json_rows_and_unknown_types(spark):
    docs = spark.createDataFrame([(1, '{"b": 2, "a": "x"}')], "doc_id long, text string")
    assert [r.text for r in parse.json_blocks(docs).orderBy("at").collect()] == ["a: x", "b: 2"]
    kinds = spark.createDataFrame([(1, "text/csv"), (2, "text/html; charset=utf-8")], "doc_id long, mime string")
    assert [r.doc_id for r in corpus.unsupported(kinds).collect()] == [1]


BLOCKS = "doc_id long, ordinal int, block_type string, text string, page int, heading_level int, section string, dropped boolean"


def test_page_furniture(spark):
    rows = [(1, i, "paragraph", t, p, None, None, False) for i, (p, t) in enumerate([(1, "Company"), (1, "alpha"), (1, "Page end"), (2, "Company"), (2, "beta"), (2, "Page end"), (3, "Both"), (4, "Both")])]
    rows += [(1, 8, "paragraph", "  ", 4, None, None, False), (2, 0, "paragraph", "same", 1, None, None, False), (2, 1, "paragraph", "same", 1, None, None, False)]
    got = {(r.doc_id, r.ordinal): r.drop_reason for r in normalize.normalize_blocks(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert [got[1, i] for i in range(9)] == ["header", None, "footer", "header", None, "footer", "footer", "footer", "empty"]
    assert got[2, 0] is None and got[2, 1] is None


def test_fingerprint_text_leaves_titles_out(spark):
    rows = [(1, 0, "title", "T", None, 1, None, False), (1, 1, "paragraph", "b", None, None, None, False), (2, 0, "title", "Only", None, 1, None, False)]
    out = normalize.fingerprint_text(normalize.normalize_blocks(spark.createDataFrame(rows, BLOCKS)))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "b", 2: "Only"}
    assert normalize.describe(out).count() == 2


def test_duplicates(spark):
    rows = [(1, "a", 1, "h1", 5), (1, "b", 2, "h1", 5), (1, "c", 3, "h1", 5), (1, "d", 4, "h2", 7), (1, "e", 5, "h3", 5 ^ 64), (2, "f", 6, "h1", 5), (1, "g", 7, "h4", 0), (1, "i", 8, "h5", 0)]
    df = spark.createDataFrame(rows, "org int, id string, created_at int, content_hash string, simhash long")
    exact = sorted((r.canonical_id, r.duplicate_id, r.score) for r in dedup.exact_duplicates(df).collect())
    assert exact == [("a", "b", 1.0), ("a", "c", 1.0)]
    near = sorted((r.canonical_id, r.duplicate_id, r.score) for r in dedup.near_duplicates(df).collect())
    assert near == [("a", "d", 0.9844), ("a", "e", 0.9844), ("d", "e", 0.9688)]
    near = sorted((r.canonical_id, r.duplicate_id, r.score) for r in dedup.near_duplicates(df, every_pair=True).collect())
    assert near == [(x, y, s) for x, y, s in sorted([(o, "d", 0.9844) for o in "abc"] + [(o, "e", 0.9844) for o in "abc"] + [("d", "e", 0.9688)])]
    edges = dedup.exact_duplicates(df)
    left = dedup.replace_edges(edges, edges.limit(0), spark.createDataFrame([("b",)], "id string"))
    assert [r.duplicate_id for r in left.collect()] == ["c"]
    assert dedup.duplicates_of(edges, "a").count() == 2


def test_banded_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(25)]
    prints = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + [base[0], base[0]]
    df = spark.createDataFrame([(1, i, i, f"h{i}", p) for i, p in enumerate(prints)], "org int, id int, created_at int, content_hash string, simhash long")
    got = {(r.canonical_id, r.duplicate_id) for r in dedup.near_duplicates(df, every_pair=True).collect()}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}
    got = {(r.canonical_id, r.duplicate_id) for r in dedup.near_duplicates(df).collect()}
    firsts = {prints.index(p) for p in prints}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if i in firsts and (prints[i] ^ prints[j]).bit_count() <= 3}


def test_one_fingerprint_of_many_texts_gives_an_edge_each(spark):
    """10,000 texts that differ in hash but not in fingerprint, and one a bit away: n edges, not n squared."""
    n = 10_000
    rows = spark.range(n).select(F.lit(1).alias("org"), "id", F.col("id").alias("created_at"), F.concat(F.lit("h"), "id").alias("content_hash"), F.lit(77).cast("long").alias("simhash"))
    other = spark.createDataFrame([(1, n, n, "other", 77 ^ (1 << 40))], "org int, id long, created_at long, content_hash string, simhash long")
    edges = dedup.near_duplicates(rows.unionByName(other))
    assert edges.count() == n
    assert edges.where("canonical_id = 0").count() == n and edges.where(f"duplicate_id = {n}").first().score == 0.9844


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, ""), (3, "one"), (4, " ".join(["x"] * 8))], "doc_id long, text string")
    rows = chunk.chunk_fixed(df, size=8, overlap=2).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.window_start, r.token_count) for r in rows] == [(1, 0, 8), (1, 6, 8), (1, 12, 8), (3, 0, 1), (4, 0, 8)]
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError, match="chunk size|overlap"):
            chunk.chunk_fixed(df, size=size, overlap=overlap)


def rules(text, size, overlap):
    """The splitting rules as a recursion, with texts and kinds."""
    text = text.strip()
    n = len(text.split())
    if not n:
        return []
    if n <= size:
        return [(text, "whole")]
    for kind, parts in (("paragraph", text.split("\n\n")), ("line", text.split("\n")), ("sentence", re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý\"'])", text))):
        parts = [p.strip() for p in parts if p.strip()]
        if len(parts) > 1:
            groups = []
            for p in parts:
                k = len(p.split())
                if k > size:
                    groups.append(p)
                elif groups and isinstance(groups[-1], list) and sum(len(q.split()) for q in groups[-1]) + k <= size:
                    groups[-1].append(p)
                else:
                    groups.append([p])
            out = []
            for g in groups:
                out += rules(g, size, overlap) if isinstance(g, str) else [(("\n\n" if kind == "paragraph" else " ").join(g), kind)]
            return out
    words, out, start = text.split(), [], 0
    while True:
        out.append((" ".join(words[start : start + size]), "token"))
        if start + size >= n:
            return out
        start += size - overlap


def test_recursive_pieces_follow_the_rules():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", "dé.", "E!", "x"]) + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for _ in range(rng.randrange(0, 120)))
        for size, overlap in ((5, 1), (9, 0), (3, 2)):
            assert [(p[0], p[2]) for p in chunk.recursive_pieces(text, size, overlap)] == rules(text, size, overlap)


def test_sections_and_strategies(spark):
    rows = [
        (1, 0, "paragraph", "before", 1, None, "Named", False), (1, 1, "title", "Handbook", 1, None, None, False), (1, 2, "heading", "Leave", None, 3, None, False),
        (1, 3, "paragraph", "Employees receive 22 days.", 2, None, "Leave", False), (1, 4, "code", " ".join(["c"] * 30), 2, None, "Leave", False),
        (1, 5, "table", " ".join(["t"] * 70), 2, None, "Leave", False), (1, 6, "paragraph", "gone", 2, None, None, True), (1, 7, "paragraph", "  ", 2, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = chunk.sections(blocks).orderBy("section_no").collect()
    assert [(r.title, r.level, r.page, len(r.parts)) for r in got] == [("Named", 0, 1, 1), ("Handbook", 1, 1, 0), ("Leave", 3, 2, 3)]
    aware = chunk.chunk_heading_aware(blocks, size=24, overlap=4).orderBy("ordinal").collect()
    assert [(r.section, r.token_count) for r in aware] == [("Named", 2), ("Handbook", 1), ("Leave", 5), ("Leave", 30), ("Leave", 24), ("Leave", 24), ("Leave", 24), ("Leave", 10)]
    tree = chunk.with_chunk_ids(chunk.chunk_parent_child(blocks, size=24, overlap=4, parent_max=50)).orderBy("ordinal").collect()
    assert [(r.kind, r.sole_section) for r in tree][:3] == [("parent", True), ("parent", True), ("parent", False)]
    assert all(r.parent_chunk_id == tree[2].chunk_id for r in tree[3:]) and tree[2].token_count == 50
    assert len({r.chunk_id for r in tree}) == len(tree)
    with pytest.raises(ValueError, match="unknown"):
        chunk.run_chunker(blocks, "other")
    assert {s: chunk.run_chunker(blocks, s).count() > 0 for s in ("fixed", "recursive", "heading_aware", "parent_child")} == dict.fromkeys(("fixed", "recursive", "heading_aware", "parent_child"), True)
    assert {r.kind for r in chunk.kind_counts(chunk.chunk_parent_child(blocks)).collect()} == {"parent"}


def test_texts_are_split_once(spark):
    rows = [(d, i, "heading" if i % 4 == 0 else "paragraph", f"word{i} " * (60 * i), 2 if i % 4 == 0 else None, None, None, False) for d in range(2) for i in range(9)]
    blocks = spark.createDataFrame(rows, "doc_id long, ordinal int, block_type string, text string, heading_level int, page int, section string, dropped boolean")
    for chunks in (chunk.chunk_heading_aware(blocks), chunk.chunk_parent_child(blocks)):
        assert chunks._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert chunks.count() > 4


def test_batches_of_a_worker_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = configure(spark).range(3000).coalesce(1).select(size(F.repeat(F.lit("x"), 5000)).alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 4 << 20
