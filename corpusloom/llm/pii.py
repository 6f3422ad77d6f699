"""Personal data: generated candidates, boosted trees, calibrated thresholds.

High-recall generators propose spans that may overlap: the four exact patterns,
e-mail addresses with at and dot spelt out, telephone numbers without a plus sign,
long unbroken tokens, and whatever is assigned. Each candidate of kind email,
phone or secret gets small integer features of its format and of the context on
either side. Depth-two trees are boosted on logistic loss from histograms that
Spark sums by leaf, feature and value; the driver sees only those histograms.
Roots split on format in one round and on context in the next.

Labels for training are weak and come from evidence that is no feature:

- email, phone: the exact rule is right, the spelt-out or unmarked form is not
  known to be. What the rule goes by (the signs, the plus) is taken out before
  features are worked out.
- secret: right with the prefix of a known issuer, or if a credential name stands
  before it and its characters mix like random ones; wrong if nothing of this
  holds; of unknown label, and left out of the fit, where the evidence parts.

A threshold per kind is the lowest score at which the candidates of the held-out
half are right often enough. Spans of the exact rules always stay; a candidate
that reaches its kind's threshold and overlaps none of them is added. Trees and
thresholds become one SQL expression, so that scoring stays in the row, and all
work in a row is in proportion to its text.

Nulls and odd rows: a null text counts as empty; repeated rows get equal
results; extra columns pass through `keep`; an empty table trains no trees and
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import once
from corpusloom.session import stored

#: Patterns of the contract. Possessive repeats and the lookbehind keep one scan
#: linear on long runs and change no match: the classes that follow exclude what
#: is repeated, and a match that starts inside a run also starts at its head.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$"

#: Generators of the method.
AT = r"\x20?[(\[{]\x20?[aA][tT]\x20?[)\]}]\x20?"
DOT = r"\x20?[(\[{]\x20?[dD][oO][tT]\x20?[)\]}]\x20?"
SPELT_EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|{AT})[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)++"
BARE_PHONE = r"(?<![0-9A-Za-z+.,:/-])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+[0-9]{2,8}+){1,5}+(?![0-9A-Za-z])"
TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
ASSIGNED = r"(?<=[=:]\x20?[\"']?)(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{8,}+"

#: Evidence for labels; none of it is a feature.
CREDENTIAL = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential)[A-Za-z_]*[\"']?\s*[:=]\s*[\"']?$"
ISSUER = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_](?:live|test|proj)|AIza|ya29\.|eyJ[A-Za-z0-9])"
MIXES = r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
LEAST_MIXES = 3
CONTEXT_CHARS = 32

KINDS = ("email", "ip", "card", "phone", "secret")
FORMAT = ("chars", "digits", "letters", "upper", "breaks")
CONTEXT = ("assigned", "quoted", "lead", "closed", "mail_word", "phone_word", "digit_after")
FEATURES = ("kind", *FORMAT, *CONTEXT)

#: Training: on all candidates; a caller may bound them to about so many, chosen by hash. The other bounds are those of the trees.
SAMPLE_ROWS = None
ROUNDS = 6
RATE = 0.5
L2 = 1.0
PRECISION = 0.95

#: Items that are folded together.
BLOCK = 64
#: Code points of a piece of text from which spans are cut.
PIECE = 4096

_SPAN = "struct<kind:int,start:long,stop:long>"
_FOUND = "struct<kind:int,start:long,stop:long,ok:boolean,f:array<int>>"


def scanned(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], emitted: str) -> Column:
    """What step(state, item) -> (state, emitted) gives for each item, in order; nulls are left out.

    A fold copies its accumulator at every item, so the array is folded in blocks:
    once for the state, of type `kind`, in which each block begins, and once for what each block emits.
    """
    block_at = lambda x: lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))
    cut = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), block_at(x)))

    def states(blocks: Column) -> Column:
        def move(acc: Column, block: Column) -> Column:
            after = F.aggregate(block, acc["s"], lambda s, x: step(s, x)[0].cast(kind))
            return F.struct(after.alias("s"), F.array_append(acc["all"], acc["s"]).alias("all"))

        return F.aggregate(blocks, F.struct(state.cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("all")), move, lambda acc: acc["all"])

    def emit(block: Column, begin: Column) -> Column:
        def move(acc: Column, x: Column) -> Column:
            after, out = step(acc["s"], x)
            return F.struct(after.cast(kind).alias("s"), F.array_append(acc["out"], out).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("s"), F.array().cast(f"array<{emitted}>").alias("out")), move, lambda acc: F.filter(acc["out"], lambda x: x.isNotNull()))

    all_of = lambda blocks: F.flatten(F.zip_with(blocks, states(blocks), emit))
    return F.coalesce(once(once(items, cut), all_of), F.array().cast(f"array<{emitted}>"))


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return total % 10 == 0


def _only(m: Column, others: str) -> Column:
    return F.length(F.regexp_replace(m, others, ""))


def _share(part: Column, whole: Column) -> Column:
    """0 to 4: quarters of the share of `whole` that `part` takes."""
    return F.ceil(F.lit(4) * part / F.greatest(whole, F.lit(1))).cast("int")


def features(kind: int, core: Column, before: Column, after: Column) -> Column:
    """Small integers in the order of FEATURES; core is the match without what labels go by."""
    size = F.length(core)
    digits, letters = _only(core, "[^0-9]+"), _only(core, "[^A-Za-z]+")
    return F.array(
        F.lit(kind),
        F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))), F.lit(9)).cast("int"),
        _share(digits, size),
        _share(letters, size),
        _share(_only(core, "[^A-Z]+"), size),
        F.least(size - digits - letters, F.lit(5)).cast("int"),
        before.rlike("[:=]\\s*[\"']?$").cast("int"),
        before.rlike("[\"']$").cast("int"),
        F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[0-9A-Za-z]$"), 3).otherwise(2),
        F.when(after == "", 0).when(after.rlike(r"^\s"), 1).when(after.rlike("^[\"'`]"), 2).otherwise(3),
        before.rlike(r"(?i)mail|contact|write|kontakt|correo").cast("int"),
        before.rlike(r"(?i)tel|phone|fax|call|mobil|ruf").cast("int"),
        after.rlike("[0-9]").cast("int"),
    )


def _matches(text: Column, pattern: str, wanted: Column, make: Callable[[Column, Column, Column, Column], Column], out: str) -> Column:
    """make(match, start, before, after) of all leftmost non-overlapping matches.

    Gaps and matches alternate, so running sums of their lengths are the code
    points of each span, and the context of a match is the end of the gap before
    it, after the match before that, and the head of the gap behind it.
    """
    found = F.when(wanted, F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g")))

    def spans(z: Column) -> Column:
        m, g = z["m"], z["g"]
        lengths = F.transform(m, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("len")))
        starts = scanned(lengths, F.lit(0), "long", lambda pos, x: (pos + x["gap"] + x["len"], pos + x["gap"]), "long")

        def one(x: Column, i: Column, at: Column) -> Column:
            before = F.right(F.concat(F.coalesce(F.right(F.get(m, i - 1), F.lit(CONTEXT_CHARS)), F.lit("")), F.get(g, i)), F.lit(CONTEXT_CHARS))
            after = F.left(F.concat(F.get(g, i + 1), F.coalesce(F.left(F.get(m, i + 1), F.lit(CONTEXT_CHARS)), F.lit(""))), F.lit(CONTEXT_CHARS))
            return make(x, F.get(at, i), before, after)

        return once(starts, lambda at: F.transform(m, lambda x, i: one(x, i, at)))

    return F.coalesce(F.filter(F.when(wanted, once(found, spans)), lambda s: s.isNotNull()), F.array().cast(f"array<{out}>"))


def _exact(kind: int, m: Column, start: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("stop"))


def _found(kind: int, m: Column, start: Column, ok: Column, f: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("stop"), ok.cast("boolean").alias("ok"), f.alias("f"))


def _spelt(m: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".")


def _secret(m: Column, start: Column, before: Column, after: Column) -> Column:
    named, mixes = before.rlike(CREDENTIAL), F.regexp_count(m, F.lit(MIXES)) >= LEAST_MIXES
    issued = m.rlike(ISSUER)
    ok = F.when(issued | (named & mixes), True).when(~named & ~mixes, False)
    return F.when(m.rlike("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]") | before.rlike("[:=]\\s*[\"']?$"), _found(4, m, start, ok, features(4, m, before, after)))


def _digits(m: Column) -> Column:
    return _only(m, "[^0-9]+")


def candidates(text: Column) -> dict[str, Column]:
    """Arrays of candidate spans by generator: exact ones, then those with label and features."""
    body = F.coalesce(text, F.lit(""))

    def phone(exact: bool) -> Callable:
        def make(m: Column, start: Column, before: Column, after: Column) -> Column:
            return F.when(_digits(m).between(9, 15), _found(3, m, start, F.lit(exact), features(3, F.ltrim(m, F.lit("+")), before, after)))

        return make

    def card(m: Column, start: Column, before: Column, after: Column) -> Column:
        return F.when(_digits(m).between(13, 19), F.when(luhn(F.regexp_replace(m, "[^0-9]", "")), _exact(2, m, start)))

    return {
        "email": _matches(body, EMAIL, F.contains(body, F.lit("@")), lambda m, s, b, a: _found(0, m, s, F.lit(True), features(0, m, b, a)), _FOUND),
        "ip": _matches(body, IP, body.rlike(r"[0-9]\.[0-9]"), lambda m, s, b, a: F.when(m.rlike(OCTETS), _exact(1, m, s)), _SPAN),
        "card": _matches(body, CARD, body.rlike(r"[0-9][\x20-]?[0-9]"), card, _SPAN),
        "phone": _matches(body, PHONE, F.contains(body, F.lit("+")), phone(True), _FOUND),
        "spelt": _matches(body, SPELT_EMAIL, body.rlike(r"[(\[{]\x20?[aA][tT]\x20?[)\]}]"), lambda m, s, b, a: _found(0, m, s, F.lit(False), features(0, _spelt(m), b, a)), _FOUND),
        "bare": _matches(body, BARE_PHONE, body.rlike(r"[0-9][)\x20./-]{1,3}[0-9]{2}"), phone(False), _FOUND),
        "token": _matches(body, TOKEN, body.rlike(r"[0-9A-Z]"), _secret, _FOUND),
        "assigned": _matches(body, ASSIGNED, body.rlike("[=:]"), _secret, _FOUND),
    }


def _plain(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))


def apart(spans: Column, base: Column, kind: str = _FOUND) -> Column:
    """The spans that overlap none of base: one sweep forward for those that begin before, one back for those behind."""
    mixed = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["stop"].alias("stop"), F.lit(None).cast(kind).alias("x"))),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["stop"].alias("stop"), s.alias("x"))),
        ),
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["own"] - b["own"]),
    )
    item = f"struct<start:long,own:int,stop:long,x:{kind}>"
    ahead = scanned(
        mixed, F.lit(-1), "long",
        lambda reach, s: (F.when(s["own"] == 0, F.greatest(reach, s["stop"])).otherwise(reach), F.when((s["own"] == 0) | (s["start"] >= reach), s)), item,
    )
    back = scanned(
        F.reverse(ahead), F.lit(2**62), "long",
        lambda next_, s: (F.when(s["own"] == 0, s["start"]).otherwise(next_), F.when((s["own"] == 1) & (s["stop"] <= next_), s["x"])), kind,
    )
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(F.reverse(back))


class Trees:
    """Boosted trees over integer features: each a root test and a test in either child."""

    def __init__(self, base: float, trees: list[tuple], cuts: dict[int, float]):
        self.base, self.trees, self.cuts = base, trees, cuts

    @staticmethod
    def leaf(f: Column, tree: tuple) -> Column:
        (i, v), left, right, _ = tree
        return F.when(F.get(f, F.lit(i)) <= v, F.when(F.get(f, F.lit(left[0])) <= left[1], 0).otherwise(1)).otherwise(
            F.when(F.get(f, F.lit(right[0])) <= right[1], 2).otherwise(3)
        )

    def margin(self, f: Column) -> Column:
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + F.get(F.array(*[F.lit(float(x)) for x in tree[3]]), self.leaf(f, tree))
        return total

    def score(self, f: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(f)))

    def accepts(self, f: Column, kind: Column) -> Column:
        """The score reaches its kind's threshold; kinds without one accept nothing."""
        if not self.cuts:
            return F.lit(False)
        cut = F.lit(2.0)
        for k, c in sorted(self.cuts.items()):
            cut = F.when(kind == k, F.lit(c)).otherwise(cut)
        return self.score(f) >= cut


def _best(sums: dict[tuple[int, int], tuple[float, float]], allowed: Sequence[int]) -> tuple[int, int]:
    """The feature and value whose split gains most among the allowed features; ties to the first."""
    best, found = -1.0, (allowed[0], 0)
    total_g = sum(g for (i, _), (g, _) in sums.items() if i == 0)
    total_h = sum(h for (i, _), (_, h) in sums.items() if i == 0)
    for i in allowed:
        g = h = 0.0
        for v in sorted(v for j, v in sums if j == i):
            g, h = g + sums[i, v][0], h + sums[i, v][1]
            gain = g * g / (h + L2) + (total_g - g) ** 2 / (total_h - h + L2)
            if gain > best + 1e-9:
                best, found = gain, (i, v)
    return found


#: Features that the root of a round's tree may test: the kind with those of the format, or with those of the context.
ROOTS = (tuple(range(1 + len(FORMAT))), (0, *range(1 + len(FORMAT), len(FEATURES))))


def train(spans: DataFrame, sample_rows: int | None = SAMPLE_ROWS, rounds: int = ROUNDS) -> Trees:
    """Boost trees on candidates (key, kind, ok, f) whose label ok is known.

    The rows are first summed into cells of equal features, so that a round reads
    one row per cell whatever the size of the corpus.
    """
    spans = spans.where(F.col("ok").isNotNull())
    if sample_rows is not None:
        part = max(1, math.ceil(spans.count() / sample_rows))
        spans = spans.where(F.pmod(F.xxhash64("key"), F.lit(part)) == 0)
    cells = stored(
        spans.groupBy("f", "kind", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)).alias("half"))
        .agg(F.sum(F.col("ok").cast("double")).alias("yes"), F.count("*").cast("double").alias("all")),
        "pii-cells",
    )
    fit = cells.where("half = 0")
    totals = fit.agg(F.sum("yes"), F.sum("all")).first()
    yes, every = (totals[0] or 0.0), (totals[1] or 0.0)
    trees = Trees(math.log((yes + 0.5) / (every - yes + 0.5)), [], {})
    if not 0 < yes < every:
        return trees

    def histogram(root: tuple[int, int] | None) -> list:
        p = trees.score(F.col("f"))
        side = F.lit(0) if root is None else (F.get("f", F.lit(root[0])) > root[1]).cast("int")
        g, h = F.col("yes") - F.col("all") * p, F.col("all") * p * (1 - p)
        rows = fit.select(side.alias("side"), g.alias("g"), h.alias("h"), F.posexplode("f").alias("i", "v"))
        return rows.groupBy("side", "i", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()

    for turn in range(rounds):
        root = _best({(r.i, r.v): (r.g, r.h) for r in histogram(None)}, ROOTS[turn % 2])
        rows = histogram(root)
        sides, leaves = [], []
        for side in (0, 1):
            sums = {(r.i, r.v): (r.g, r.h) for r in rows if r.side == side}
            i, v = _best(sums, range(len(FEATURES))) if sums else (0, 0)
            sides.append((i, v))
            for low in (True, False):
                g = sum(x[0] for (j, w), x in sums.items() if j == i and (w <= v) == low)
                h = sum(x[1] for (j, w), x in sums.items() if j == i and (w <= v) == low)
                leaves.append(RATE * g / (h + L2))
        trees.trees.append((root, sides[0], sides[1], leaves))

    held = cells.where("half = 1").select("kind", "yes", "all", F.round(trees.score(F.col("f")), 6).alias("score"))
    rows = held.groupBy("kind", "score").agg(F.sum("yes").alias("yes"), F.sum("all").alias("all")).collect()
    for kind in {r.kind for r in rows}:
        right = total = 0.0
        for r in sorted((r for r in rows if r.kind == kind), key=lambda r: -r.score):
            right, total = right + r.yes, total + r.all
            if right >= PRECISION * total and r.score >= 0.5:
                trees.cuts[kind] = r.score - 1e-6
    return trees


def found_spans(docs: DataFrame, id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """_id, _base, _marked, _other, keep...: exact spans, those of them with features, and candidates that overlap none."""
    row = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    found = row.withColumns({f"_{k}": v for k, v in candidates(F.col("_text")).items()}).withColumn("_key", F.xxhash64("_id", "_text")).drop("_text")
    plain = lambda c: F.transform(c, _plain)
    found = stored(
        found.select(
            "_id", "_key", F.concat(plain("_email"), "_ip", "_card", plain("_phone")).alias("_base"),
            F.concat("_email", "_phone").alias("_marked"), F.concat("_spelt", "_bare", "_token", "_assigned").alias("_other"), *[f"_keep_{c}" for c in keep],
        ),
        "pii-generated",
    )
    return found.withColumn("_other", apart(F.col("_other"), F.col("_base")))


def detect(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    sample_rows: int | None = SAMPLE_ROWS,
    rounds: int = ROUNDS,
    trees: Trees | None = None,
) -> DataFrame:
    """id, base, added, keep...: arrays of (kind, start, stop) per document.

    Offsets count code points, ends exclusive; base in order of kind and start,
    added by start. Without given trees they are boosted on the documents' own candidates.
    """
    found = found_spans(docs, id_col, text, keep)
    if trees is None:
        spans = found.select("_key", F.explode(F.concat("_marked", "_other")).alias("s")).select(F.xxhash64("_key", "s.start").alias("key"), "s.kind", "s.ok", "s.f")
        trees = train(spans, sample_rows, rounds)
    scored = F.transform(
        F.filter("_other", lambda s: trees.accepts(s["f"], s["kind"])),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), trees.margin(s["f"]).alias("margin")),
    )
    return found.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), once(scored, best_of_overlapping).alias("added"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def best_of_overlapping(scored: Column) -> Column:
    """(kind, start, stop) in order of start: of spans that overlap the wider stays, then the one of higher margin, then the first.

    A sweep by start holds one span back until the next begins at or behind its end.
    """
    held = "struct<start:long,stop:long,kind:int,margin:double>"
    end = F.struct(F.lit(2**62).cast("long").alias("start"), F.lit(2**62).cast("long").alias("stop"), F.lit(-1).alias("kind"), F.lit(0.0).alias("margin"))

    def step(now: Column, s: Column) -> tuple[Column, Column]:
        free = now.isNull() | (s["start"] >= now["stop"])
        rank = lambda x: F.struct(x["stop"] - x["start"], x["margin"])
        return F.when(free | (rank(s) > rank(now)), s).otherwise(now), F.when(free & now.isNotNull(), _plain(now))

    swept = scanned(F.array_append(F.array_sort(scored), end), F.lit(None), held, step, _SPAN)
    return F.when(F.size(scored) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(swept)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one mark.

    Text is cut from pieces of bounded length, so that a span far behind costs no
    walk from the start.
    """
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        kept = F.struct(pos.alias("start"), s["start"].alias("stop"), F.get(name, s["kind"]).alias("mark"))
        return F.greatest(pos, s["stop"]), F.when(s["start"] >= pos, kept)

    marks = scanned(ordered, F.lit(0), "long", step, "struct<start:long,stop:long,mark:string>")

    def cut(pieces: Column, start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE)
        near = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(stop / PIECE) - first + 1).cast("int")), "")
        return F.substring(near, (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))

    def join(pieces: Column) -> Column:
        last = F.aggregate(spans, F.lit(0).cast("long"), lambda most, s: F.greatest(most, s["stop"]))
        parts = F.transform(marks, lambda k: F.concat(cut(pieces, k["start"], k["stop"]), k["mark"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, last, F.length(text).cast("long")))

    return F.when(F.size(spans) == 0, text).otherwise(once(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0), join))
