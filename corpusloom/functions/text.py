"""Tokens, sentences, normalisation, boilerplate and language as columns.

The three tokenizers differ on purpose: white-space words for chunk sizes,
Latin words for fingerprints and language, and [A-Za-z0-9_]+ for queries.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that count as white space, as a Java character class body.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Java tries the parts of a class in turn: ASCII letters are settled first. The same characters, many times as fast.
WS_WORD = f"[!-~[^{SPACE}]]+"
BLANK = f"[[^!-~]&&[{SPACE}]]"
LATIN_WORD = r"[A-Za-z0-9À-ÿ']+"
QUERY_WORD = r"[A-Za-z0-9_]+"
CHUNK_SENTENCE = rf"(?<=[.!?])[{SPACE}]+(?=[A-ZÀ-Ý\"'])"
ANSWER_SENTENCE = rf"(?<=[.!?])[{SPACE}]+"

# Patterns of page furniture, matched on whole trimmed blocks of at most 120 characters.
BOILERPLATE_PATTERNS = (
    r"^skip to (main )?content$",
    r"^all rights reserved\.?$",
    r"^copyright ©?\s?\d{4}.*$",
    r"^cookies? (policy|notice|settings|consent).*$",
    r"^(subscribe|sign up) (to|for) (our )?newsletter.*$",
    r"^this website uses cookies.*$",
    r"^privacy policy$",
    r"^terms of (use|service)$",
    r"^home\s*[|/>•·]\s*about(\s*[|/>•·]\s*contact)?$",
    r"^click here$",
)
BOILERPLATE_CHARS = 120
BOILERPLATE_TYPES = ("paragraph", "list", "quote", "image_caption")

# Function words by language, in the order in which ties are settled.
STOPWORDS = {
    "en": ("the", "and", "of", "to", "in", "for", "is", "on", "that", "with", "as", "are", "this", "be", "by", "an", "or", "from", "at", "which", "not", "have", "it", "was", "each", "must", "should"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "pas", "est", "sur", "par", "plus", "avec", "au", "aux", "ce", "cette"),
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "im", "ist", "auf", "für", "nicht", "ein", "eine", "dem", "des", "sich", "auch", "als"),
    "es": ("el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "del", "se", "por", "con", "para", "no", "es", "al", "lo"),
}
LANGUAGE_MIN_TOKENS = 8
LANGUAGE_MIN_RATIO = 0.06

# Characters of no width that normalisation drops.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"


def ws_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WS_WORD), 0)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WS_WORD)), F.lit(0))


def latin_tokens(text: Column) -> Column:
    """Lower-cased after matching, since lowering may add characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(LATIN_WORD), 0), F.lower)


def query_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(QUERY_WORD), 0), F.lower)


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), trim), lambda s: s != "")


def chunk_sentences(text: Column) -> Column:
    return _pieces(text, CHUNK_SENTENCE)


def answer_sentences(text: Column) -> Column:
    return _pieces(trim(text), ANSWER_SENTENCE)


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(text, f"{BLANK}+", " "))


def fold_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


@F.pandas_udf(T.StringType())
def _unescape_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def _composed(text: Column) -> Column:
    """Entities unescaped and NFC. Texts that neither can change skip the work in Python."""
    needs = text.rlike(r"&|[^\x00-\u02ff]")
    return F.when(needs, _unescape_nfc(F.when(needs, text))).otherwise(text)


def normalize_text(text: Column, preserve_newlines: bool = False) -> Column:
    """Unescape, compose, fold line ends, drop zero-width characters, collapse white space."""
    clean = F.translate(fold_lines(_composed(text)), ZERO_WIDTH, "")
    if not preserve_newlines:
        return collapse(clean)
    lines = F.transform(F.split(clean, "\n"), collapse)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def normalize_code(text: Column) -> Column:
    """Unescape, compose, fold line ends, strip line ends and blank edge lines; keep indents."""
    lines = F.transform(F.split(fold_lines(_composed(text)), "\n"), lambda line: F.regexp_replace(line, f"{BLANK}+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def normalize_block(text: Column, block_type: Column) -> Column:
    """By type: code keeps its layout, lists and tables keep their lines."""
    return (
        F.when(block_type == "code", normalize_code(text))
        .when(block_type.isin("list", "table"), normalize_text(text, preserve_newlines=True))
        .otherwise(normalize_text(text))
    )


def is_boilerplate(text: Column, block_type: Column) -> Column:
    body = trim(text)
    match = F.lit(False)
    for pattern in BOILERPLATE_PATTERNS:
        match = match | body.rlike(f"(?iudU){pattern}")
    return F.coalesce(block_type.isin(*BOILERPLATE_TYPES) & (F.length(body) > 0) & (F.length(body) <= BOILERPLATE_CHARS) & match, F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def language_scores(tokens: Column) -> dict[str, Column]:
    # No tokens give scores of 0, as a division by zero is an error.
    share = lambda known: F.size(F.filter(tokens, lambda t: t.isin(list(known)))) / F.greatest(F.size(tokens), F.lit(1))
    return {lang: share(words) for lang, words in STOPWORDS.items()}


def detect_language(tokens: Column) -> Column:
    """Language of highest stop-word density over Latin tokens; first of en, fr, de, es on ties; `und` below the limits, null for null."""

    def pick(c: Column) -> Column:
        best = F.greatest(*[c[lang] for lang in STOPWORDS])
        found = F.lit(None)
        for lang in reversed(list(STOPWORDS)):
            found = F.when(c[lang] == best, lang).otherwise(found)
        return F.when((c["n"] < LANGUAGE_MIN_TOKENS) | (best < LANGUAGE_MIN_RATIO), "und").otherwise(found)

    return once(once(tokens, lambda t: F.struct(F.size(t).alias("n"), *[score.alias(lang) for lang, score in language_scores(t).items()])), pick)
