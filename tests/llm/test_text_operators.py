"""Quality rules, mixing, licence scans, SimHash and personal data against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, license_scan, pii, quality_rules, registry, simhash_neardup, source_mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    vocabulary = ["a", "bb", "ccc", "Die", "é", "x#y", "$$$", "word", "naïve", "LONG", "1.2.3.4", "|"]
    texts = [None, "", "   ", "\n\n\t", "one", "one two", "One two\nOne two\none two", "x" * 30_000, "ab " * 8_000, "# * $ % & | < >", "emoji 😀 😀 𝕏 text"]
    for _ in range(60):
        n = rng.choice([3, 20, 80, 300])
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n)))
    line = "Shared line that every page of this site repeats below its text."
    texts += [f"{' '.join(f'w{i}q{j}' for j in range(60))}\n{line}\n{line}" for i in range(30)]
    texts += ["\n".join([line] * 9) for _ in range(3)]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (1, "a repeated id", "en", "s1", 3), (*rows[40][:4], 5), (None, "row without an id", "en", None, 1), (None, None, None, None, None)]


def base_rules(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("_key", F.lit(1))
    got = quality_rules.quality_rules(df, max_line_docs=5, max_line_share=0.1).collect()
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip()
    document = lambda i, t: (i, None if i is not None else t)
    pairs = {(s, norm(x), document(i, t)) for i, t, _, s, _ in docs for x in (t or "").split("\n") if words(x)}
    on_host = Counter((s, x) for s, x, _ in pairs)
    hosts = Counter(s for s, _ in {(s, document(i, t)) for i, t, _, s, _ in docs})
    frequent = {k for k, n in on_host.items() if n > 5 and n > 0.1 * hosts[k[0]]}
    assert frequent
    want = []
    for i, t, _, s, _ in docs:
        base = base_rules(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        removed = sum(len(words(x)) for x in (t or "").split("\n") if (s, norm(x)) in frequent)
        want.append((i, *base, failed, not failed and base[0] - removed >= 0.5 * base[0], removed))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r[6] is False and r[7] for r in want)


def test_quality_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_meets_targets_and_is_stable(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA).withColumn("size", F.lit("clash"))
    rows = source_mixing.mix_sources(df, keep=["source"]).collect()
    again = source_mixing.mix_sources(df.repartition(5), keep=["source"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sorted((r.size for r in rows)) == sorted(len(words(t)) for _, t, *_ in docs)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, todo = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        unit = left / sum(weight[s] for s in todo)
        over = {s for s in todo if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in todo}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        todo -= over
    largest = max(len(words(t)) for _, t, *_ in docs)
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert mine[0].source_size == sizes[s]
        assert mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest


def test_mix_on_an_empty_table_and_without_words(spark):
    assert source_mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = source_mixing.mix_sources(spark.createDataFrame([(1, None, "", "s", 0), (2, "", "", None, 0)], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in rows] == [(0, 0), (0, 0)]


def test_mix_meets_the_target_of_a_source_without_ids(spark):
    rows = [(None, f"w{i} " * 10, "en", "a", 0) for i in range(400)] + [(7, f"x{i} " * 10, "en", "b", 0) for i in range(400)]
    got = source_mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), keep=["source"], total_share=0.6).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10


def test_repeated_rows_give_the_rows_of_the_sql(spark, tmp_path, docs):
    duckdb = pytest.importorskip("duckdb")
    folder = f"file://{tmp_path}"
    line = "A line that stands in many pages of this host, again and again, under its text."
    more = [(i % 30, f"{line}\nown words {' '.join(f'v{i}q{j}' for j in range(55))}", "en", "s1", 0) for i in range(45)]
    spark.createDataFrame([*docs, *more], SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_quality_rules", "op2_mix_sources"):
        frame = registry.QUERIES[name](spark, folder)
        want = duckdb.sql(f"SELECT {', '.join(frame.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want)), name


def test_larger_budgets_take_supersets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = [{r.doc_id for r in source_mixing.mix_sources(df, total_share=share).collect() if r.taken} for share in (0.2, 0.5, 0.9)]
    assert taken[0] < taken[1] < taken[2]


def test_license_base_matches_brute_force(spark, docs):
    more = ["Licensed under CC BY 4.0. CC-BY", "GENERAL PUBLIC LICENSE general public license", "All rights reserved. all  rights\nreserved", "cc by" * 3, "all rights all rights reserved"]
    texts = [t for _, t, *_ in docs] + more
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.r for r in df.select("doc_id", license_scan.scan_licenses(F.col("text")).alias("r")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
        at, labels = [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            found = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "accepted"),
    [
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("Permission to use, copy, modify, and distribute this program for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", None),
        ("Released under the MIT License.", "mit"),
        ("Released beneath the MIT License.", None),
        ("Licensed under the GNU General Public License, version 3.", "gpl"),
        ("Copyright 2020 Some Body and others. All rights reserved.", "reserved"),
    ],
)
def test_templates_accept_exact_mandatory_wording(text, accepted):
    automata = [license_scan.compile_template(*t) for t in license_scan.TEMPLATES]
    matches = license_scan.scan(text, automata, [])[-1]
    assert {m[0] for m in matches} == ({accepted} if accepted else set())


def template_regex(template):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for mark in re.findall(r"<<opt>>|<</opt>>|<<var \d+ \d+>>|[^<\s]+", template):
        if mark == "<<opt>>":
            out += "(?:"
        elif mark == "<</opt>>":
            out += ")?"
        elif mark.startswith("<<var"):
            out += r"(?:\S+ ){%s,%s}" % tuple(mark[6:-2].split())
        else:
            out += re.escape(mark) + " "
    return out


def test_templates_match_brute_force():
    """Random wordings of every template, some with a word changed, against regular expressions tried for every end."""
    rng = random.Random(12)
    automata = [license_scan.compile_template(*t) for t in license_scan.TEMPLATES]
    accepted = 0
    for label, worth, template in license_scan.TEMPLATES:
        for turn in range(5):
            words, skip = [], 0
            for mark in re.findall(r"<<opt>>|<</opt>>|<<var \d+ \d+>>|[^<\s]+", template):
                if mark == "<<opt>>":
                    skip += 1 if skip or rng.random() < 0.5 else 0
                elif mark == "<</opt>>":
                    skip -= 1 if skip else 0
                elif not skip:
                    least, most = map(int, mark[6:-2].split()) if mark.startswith("<<var") else (0, 0)
                    words += [f"v{rng.randrange(9)}" for _ in range(rng.randint(least, most + (turn % 5 == 4)))] if most else [mark]
            if turn % 3 == 2:
                words[rng.randrange(len(words))] = rng.choice(["other", "the", "software"])
            words = ["before", "it", *words, "after", "all"]
            got = {(m[0], m[1], m[2]) for m in license_scan.scan(" ".join(words), automata, [])[-1]}
            want = set()
            for name, _, t in license_scan.TEMPLATES:
                whole = re.compile(template_regex(t))
                for i in range(len(words)):
                    ends = [j for j in range(i + 1, len(words) + 1) if whole.fullmatch("".join(w + " " for w in words[i:j]))]
                    want |= {(name, i, max(ends))} if ends else set()
            assert got == want, (label, worth, words)
            accepted += bool(want)
    assert accepted > 30


def test_optional_and_replaceable_regions():
    a = license_scan.compile_template("x", 1.0, "one <<opt>>two <<var 1 2>><</opt>> three")
    run = lambda s: a.longest(s.encode().split(), 0)
    assert run("one three") == 2 and run("one two z three") == 4 and run("one two y z three four") == 5
    assert run("one two three") is None and run("one two x y z three") is None
    for bad in ("<<opt>>open word", "<<var 1 2>> word", "<<opt>>only<</opt>>"):
        with pytest.raises(ValueError, match="template"):
            license_scan.compile_template("x", 1.0, bad)


def brute_fingerprint(text):
    w = words(lower_ascii(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(400)]
    near = []
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(400)] = f"changed{rng.random()}"
        near.append(" ".join(copy))
    rows = docs + [(1000 + i, t, "en", "s", 0) for i, t in enumerate([*near, near[0].upper(), near[0]])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash"))
    got, hot = (simhash_neardup.near_duplicates(df, hot_rows=n).select("doc_id", simhash_neardup.hex16(F.col("fp")).alias("f"), "component_id").collect() for n in (50_000, 1))
    assert sorted(map(str, got)) == sorted(map(str, hot))
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_links_find_every_pair(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for p in list(prints):
        for bits in (1, 2, 2, 3):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash_neardup.links(spark.createDataFrame([(p,) for p in signed], "fp long")).distinct().collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 61)]
    got = dict(map(tuple, simhash_neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(1, 62), 0), 200: 100, 300: 100}
    assert simhash_neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_on_an_empty_table(spark):
    assert simhash_neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def pii_texts():
    rng = random.Random(11)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é😀",
              "_x@y.zz", "a@b.com_x@y.zz", "token = \"0123abcd4567ef890123abcd\"", "12  34", "0", "--", "+49 30 1234567890123", "word", "\n", ".", "mail x.y (at) host [dot] com", "tel 030 123 4567 89", "(555) 123-4567", "Fax: 0171/1234567", "ghp_abcdefgh12345678", "key: correcthorse", "LongMixedCaseIdentifierName"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 25))) for _ in range(160)]
    return [*texts, None, "", "9" * 40_000, "1 " * 20_000, "a" * 50_000, "x@" + "a." * 20_000 + "b", "1." * 20_000, "+" * 5_000, ("+1 " + "5" * 9 + " ") * 500]


def brute_features(kind, core, before, after):
    size = max(len(core), 1)
    count = lambda p: len(re.findall(p, core))
    share = lambda n: math.ceil(4 * n / size)
    d, n, u = count("[0-9]"), count("[A-Za-z]"), count("[A-Z]")
    hit = lambda p, x: int(re.search(p, x) is not None)
    lead = 0 if not before else 1 if before[-1].isspace() else 3 if re.match("[0-9A-Za-z]", before[-1]) else 2
    closed = 0 if not after else 1 if after[0].isspace() else 2 if after[0] in "\"'`" else 3
    words = hit("(?i)mail|contact|write|kontakt|correo", before), hit("(?i)tel|phone|fax|call|mobil|ruf", before)
    return [kind, min(int(math.log2(size)), 9), share(d), share(n), share(u), min(len(core) - d - n, 5),
            hit(r"[:=]\s*[\"']?$", before), hit("[\"']$", before), lead, closed, *words, hit("[0-9]", after)]


def brute_candidates(text):
    """(kind, start, stop, ok, features) of what the generators propose, by a plain reading of their rules."""
    spelt_at, spelt_dot = r"\x20?[(\[{]\x20?[aA][tT]\x20?[)\]}]\x20?", r"\x20?[(\[{]\x20?[dD][oO][tT]\x20?[)\]}]\x20?"
    rules = (
        (0, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|{spelt_at})[A-Za-z0-9-]++(?:(?:\.|{spelt_dot})[A-Za-z0-9-]++)++"),
        (3, r"(?<![0-9A-Za-z+.,:/-])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+[0-9]{2,8}+){1,5}+(?![0-9A-Za-z])"),
        (4, r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}"),
        (4, r"(?<=[=:]\x20?[\"']?)(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{8,}"),
    )
    out = []
    for turn, (kind, pattern) in enumerate(rules):
        if turn == 0 and not regex.search(spelt_at.replace(r"\x20?[(", "[(", 1), text):
            continue
        found = list(regex.finditer(pattern, text))
        ends = [0, *[m.start() for m in found], len(text)]
        for i, m in enumerate(found):
            left = found[i - 1].start() if i else 0
            before = text[left : m.start()]
            if i and len(found[i - 1][0]) > 32:
                before = text[max(left, found[i - 1].end() - 32) : m.start()]
            before, after = before[-32:], text[m.end() : found[i + 1].end() if i + 1 < len(found) else len(text)][:32]
            x, ok = m[0], False
            core = re.sub(spelt_dot, ".", re.sub(spelt_at, "@", x)) if turn == 0 else x
            if kind == 3 and not 9 <= len(re.sub("[^0-9]", "", x)) <= 15:
                continue
            if kind == 4:
                assigned = re.search(r"[:=]\s*[\"']?$", before)
                if not (re.search("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]", x) or assigned):
                    continue
                named = re.search(r"(?i)(token|key|secret|passw(or)?d|pwd|auth|bearer|credential)[A-Za-z_]*[\"']?\s*[:=]\s*[\"']?$", before) is not None
                mixes = len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", x)) >= 3
                issued = re.match(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_](live|test|proj)|AIza|ya29\.|eyJ[A-Za-z0-9]", x) is not None
                ok = True if issued or (named and mixes) else False if not named and not mixes else None
            out.append((kind, m.start(), m.end(), ok, brute_features(kind, core, before, after)))
    return out


def brute_added(text, base, trees):
    def margin(f):
        total = trees.base
        for (i, v), left, right, leaves in trees.trees:
            side = left if f[i] <= v else right
            total += leaves[(0 if f[i] <= v else 2) + (0 if f[side[0]] <= side[1] else 1)]
        return total

    free = [c for c in brute_candidates(text) if not any(c[1] < e and b < c[2] for _, b, e in base)]
    good = sorted({(b, e, k, margin(f)) for k, b, e, _, f in free if k in trees.cuts and 1 / (1 + math.exp(-margin(f))) >= trees.cuts[k]})
    kept, now = [], None
    for s in good:
        if now is None or s[0] >= now[1]:
            kept += [now] if now else []
            now = s
        elif (s[1] - s[0], s[3]) > (now[1] - now[0], now[3]):
            now = s
    return [(pii.KINDS[k], b, e) for b, e, k, _ in [*kept, *([now] if now else [])]]


def test_personal_data_matches_brute_force(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("clash"))
    rows = pii.found_spans(df, "doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["_id"]] or ""
        base = base_spans(t)
        want = [c for c in brute_candidates(t) if not any(c[1] < e and b < c[2] for _, b, e in base)]
        got = [(s.kind, s.start, s.stop, s.ok, list(s.f)) for s in r["_other"]]
        assert sorted(got, key=str) == sorted(want, key=str), t[:200]
    # Accepts secrets by shape, spelt-out addresses, and telephone numbers after a telephone word.
    trees = pii.Trees(-1.0, [((0, 3), (0, 0), (2, 1), [3.0, -0.5, -2.0, 1.7]), ((11, 0), (0, 3), (0, 4), [0.0, 0.0, 2.5, 0.0])], {0: 0.6, 3: 0.6, 4: 0.6})
    got = {r.doc_id: r for r in pii.detect(df, keep=["text"], trees=trees).withColumn("red", pii.redact(F.coalesce("text", F.lit("")), F.concat("base", "added"))).collect()}
    kinds = Counter()
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [(pii.KINDS[s.kind], s.start, s.stop) for s in got[i].base] == want, (i, (t or "")[:80])
        assert [(pii.KINDS[s.kind], s.start, s.stop) for s in got[i].added] == brute_added(t or "", want, trees), (i, (t or "")[:200])
        kinds.update(pii.KINDS[s.kind] for s in got[i].added)
        spans = sorted([(s.start, s.stop, s.kind) for s in [*got[i].base, *got[i].added]])
        out, at = "", 0
        for b, e, k in spans:
            if b >= at:
                out += (t or "")[at:b] + f"[{pii.KINDS[k]}]"
            at = max(at, e)
        assert got[i].red == out + (t or "")[at:]
    assert set(kinds) == {"email", "phone", "secret"}


def test_personal_data_learns_secrets_it_has_no_name_for(spark):
    """The fitted trees accept random-looking assigned tokens under names that no rule knows, and leave words and numbers alone."""
    rng = random.Random(8)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'api token = "{token()}" end' for _ in range(60)] + [f"see Hauptbahnhofstrasse{rng.choice('ABC')}x, release_notes_of_{i:04d}_and_more here" for i in range(200)]
    texts += [f'zugang = "{token()}" end', "zugang: Donaudampfschifffahrt ende", "see Hauptbahnhofstrasse77 and 4111111111111112"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(t.start, t.stop) for t in r.added] for r in pii.detect(df).collect()}
    assert all(len(got[i]) == 1 for i in range(60)) and not any(got[i] for i in range(60, 260))
    assert got[260] == [(10, 50)] and got[261] == [] and got[262] == []


def test_personal_data_time_is_in_proportion_to_the_text(spark):
    """A megabyte of nothing but spans; a walk from the start for each of them would take hours."""
    text = "mail a.b@c.de or 1.2.3.4 or +1 555 123 4567 or token=0a1b2c3d4e5f6a7b8c9d0a1b, tel (555) 123-4567; " * 10_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    trees = pii.Trees(3.0, [], {0: 0.5, 3: 0.5, 4: 0.5})
    began = time.time()
    row = pii.detect(df, keep=["text"], trees=trees).select(F.size("base").alias("b"), F.size("added").alias("a"), pii.redact(F.col("text"), F.concat("base", "added")).alias("red")).first()
    assert (row.b, row.a) == (30_000, 20_000)
    assert row.red == "mail [email] or [ip] or [phone] or token=[secret], tel [phone]; " * 10_000
    assert time.time() - began < 60


def test_personal_data_without_candidates(spark):
    rows = pii.detect(spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")).collect()
    assert all(r.base == [] and r.added == [] for r in rows) and len(rows) == 2
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_query_digests(spark, tmp_path):
    text = "mail a.b@c.de from 1.2.3.4"
    spark.createDataFrame([(7, text, "en", "s", 26)], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    row = registry.op5_pii(spark, f"file://{tmp_path}").first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0)
    assert row.spans == "email:5:13,ip:19:26"
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()


def test_personal_data_is_learned_from_every_candidate(spark):
    n = 250_000
    f = F.array_repeat(F.lit(0), len(pii.FEATURES))
    spans = spark.range(n).select(F.col("id").alias("key"), F.lit(0).alias("kind"), (F.col("id") % 5 == 0).alias("ok"), f.alias("f"))
    half = spans.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)) == 0)
    yes, every = half.where("ok").count(), half.count()
    assert pii.train(spans, rounds=0).base == math.log((yes + 0.5) / (every - yes + 0.5))


def test_short_pieces_merge_as_the_tree_does(monkeypatch):
    vocabulary = bpe.Vocabulary.__new__(bpe.Vocabulary)
    rng = random.Random(5)
    pairs = [(a, b) for a in range(12) for b in range(12)]
    rng.shuffle(pairs)
    vocabulary.merges = {a << bpe.ID_BITS | b: (rank, rng.randrange(12)) for rank, (a, b) in enumerate(pairs[:70])}
    for n in [*range(0, 30), bpe.SHORT]:
        symbols = [rng.randrange(12) for _ in range(n)]
        monkeypatch.setattr(bpe, "SHORT", 0)
        tree = vocabulary.merge(list(symbols))
        assert vocabulary.merge_short(list(symbols)) == tree
