"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text is a row of symbols. The leaves of a segment tree hold the rank
and place of every adjacent pair, the root thus the leftmost pair of lowest
rank. A merge changes at most three leaves, each in logarithmic time, until no
leaf holds a known pair: n log n for the longest piece. Pieces repeat, so a
worker keeps bounded tables of what it has encoded; they save time and change
no result.

Spark deals the documents out and the UDF works through Arrow batches; the
vocabulary file, of fixed size, is read on the driver and broadcast.

Nulls and odd rows: a null text counts as empty, without tokens; repeated rows
get equal results; extra columns are untouched; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Entries kept per worker: pieces are dear to encode, words cheap to put together from pieces.
PIECES_KEPT = 1 << 18
WORDS_KEPT = 1 << 17
LONGEST_KEPT = 64
#: White space of Unicode; Python's own class has U+001C to U+001F besides.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACES = regex.compile(SPACE)
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
NO_PAIR = 1 << 62
#: Symbols up to which a piece is searched pair by pair, which is quicker than a tree.
SHORT = 48
_NONE = (NO_PAIR, -1)
ID_BITS = 24


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with end-of-word suffix, NFC, lower case and a splitting pattern."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[self.ids[left] << ID_BITS | self.ids[right]] = (rank, self.ids[left + right])
        steps = data["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split").replace(r"\s", SPACE[1:-2]))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = byte_characters()
        self.pieces = Table(self.encoded_piece, PIECES_KEPT)
        self.words = Table(self.word, WORDS_KEPT)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the leftmost merge of lowest rank until none is left.

        tree[1] is the least key of the tree over pairs; the leaf of place i is
        tree[half + i]. A key is the pair's rank, then its place.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        if n <= SHORT:
            return self.merge_short(symbols)
        merges, shift = self.merges.get, n.bit_length()
        mask, half = (1 << shift) - 1, 1 << (n - 1).bit_length()
        tree = [NO_PAIR] * (2 * half)
        for i in range(n - 1):
            if found := merges(symbols[i] << ID_BITS | symbols[i + 1]):
                tree[half + i] = found[0] << shift | i
        for i in range(half - 1, 0, -1):
            low, high = tree[2 * i], tree[2 * i + 1]
            tree[i] = low if low < high else high
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != NO_PAIR:
            i = best & mask
            j = after[i]
            symbols[i] = mine = merges(symbols[i] << ID_BITS | symbols[j])[1]
            symbols[j] = -1
            after[i] = k = after[j]
            changed = [(j, NO_PAIR)]
            found = None
            if k < n:
                before[k] = i
                found = merges(mine << ID_BITS | symbols[k])
            changed.append((i, found[0] << shift | i if found else NO_PAIR))
            h = before[i]
            if h >= 0:
                found = merges(symbols[h] << ID_BITS | mine)
                changed.append((h, found[0] << shift | h if found else NO_PAIR))
            for place, value in changed:
                at = half + place
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    low, high = tree[at], tree[at ^ 1]
                    at >>= 1
                    least = low if low < high else high
                    if tree[at] == least:
                        break
                    tree[at] = least
        return [s for s in symbols if s >= 0]

    def merge_short(self, symbols: list[int]) -> list[int]:
        """merge() by looking at all pairs each time; of equal ranks, which are equal pairs, the first is found."""
        merges = self.merges.get
        pairs = [merges(a << ID_BITS | b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := min(pairs)) is not _NONE:
            i = pairs.index(best)
            symbols[i] = mine = best[1]
            del symbols[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merges(symbols[i - 1] << ID_BITS | mine, _NONE)
            if i < len(pairs):
                pairs[i] = merges(mine << ID_BITS | symbols[i + 1], _NONE)
        return symbols

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        names = [self.chars[b] for b in piece.encode("utf-8", "surrogatepass")]
        names[-1] += self.suffix
        return self.merge([self.ids[s] for s in names if s in self.ids])

    def encoded_piece(self, piece: str) -> tuple[str, str]:
        ids = self.piece(piece)
        return " ".join(map(str, ids)), self.decode(ids)

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        # Lower case goes by character: a capital sigma is never a final one.
        return unicodedata.normalize("NFC", word).replace("\u03a3", "\u03c3").lower()

    def word(self, word: str) -> tuple[str, str]:
        """(ids, tokens) of text without white space and special tokens."""
        plain = self.normal(word)
        if plain.isascii() and plain.isalpha():
            return self.pieces[plain]
        found = [self.pieces[p] for p in self.pattern.findall(plain)]
        return found[0] if len(found) == 1 else (" ".join([f[0] for f in found]), " ".join([f[1] for f in found]))

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """(ids, tokens) of each part between white space, both joined by spaces."""
        held = self.cut.split(text) if self.cut is not None and "<|" in text else [text]
        for at, part in enumerate(held):
            if at % 2:
                yield str(self.special[part]), part
            else:
                yield from map(self.words.__getitem__, split(part))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


class Table(dict):
    """text -> (ids, tokens), filled on demand. When full, what was used since the last time it was full stays."""

    def __init__(self, make: Callable[[str], tuple[str, str]], size: int):
        super().__init__()
        self.make, self.size = make, size
        self.older: dict[str, tuple[str, str]] = {}

    def __missing__(self, text: str) -> tuple[str, str]:
        found = self.older.get(text) or self.make(text)
        if len(text) <= LONGEST_KEPT:
            if 2 * len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def split(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def encode(vocabulary: Vocabulary, text: str | None) -> tuple[str, str]:
    """Ids and decoded tokens of a text, both joined by one space."""
    parts = list(vocabulary.parts(text or ""))
    ids = " ".join([p[0] for p in parts if p[0]])
    return ids, " ".join([p[1] for p in parts if p[0]])


_LOADED: dict[int, Vocabulary] = {}

DIGEST = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def _loaded(held) -> Vocabulary:
    """The vocabulary of a broadcast file, built once per worker."""
    if held.id not in _LOADED:
        _LOADED.clear()
        _LOADED[held.id] = Vocabulary(held.content.value)
    return _LOADED[held.id]


class _Held:
    """A broadcast vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.id = hash(content)
        self.content = spark.sparkContext.broadcast(content)


def digests(spark: SparkSession, text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of the text's encoding and of its decoding."""
    held = _Held(spark, path)

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = _loaded(held)
        for texts in batches:
            rows = []
            for text in texts:
                ids, tokens = encode(vocabulary, text)
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def token_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int>: the ids of the text."""
    held = _Held(spark, path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _loaded(held)
        for texts in batches:
            yield pd.Series([[int(i) for i in encode(vocabulary, t)[0].split()] for t in texts])

    return run(text)


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """string: the tokens of an array of ids joined by spaces; null for null."""
    held = _Held(spark, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _loaded(held)
        for rows in batches:
            yield pd.Series([None if ids is None else vocabulary.decode(ids) for ids in rows])

    return run(ids)
