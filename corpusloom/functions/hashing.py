"""Content hashes, name-based ids and fingerprints as columns."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import latin_tokens

# Namespaces of name-based ids.
DOCUMENT_NAMESPACE = "6ba7b814-9dad-41d1-80b4-00c04fd430c8"
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

BITS = 64
_LATIN = re.compile(r"[A-Za-z0-9À-ÿ']+")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The version-5 UUID of a name, from SHA-1 and string functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3))]
    return F.concat_ws("-", *parts, F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def document_id(organization: Column, source: Column, connection: Column, source_id: Column) -> Column:
    """The same upstream item has the same id at every discovery."""
    material = F.concat_ws("|", organization.cast("string"), F.lower(F.trim(source)), connection.cast("string"), F.trim(source_id.cast("string")))
    return uuid5(DOCUMENT_NAMESPACE, material)


def point_id(provider: Column, model: Column, version: Column, chunk_id: Column) -> Column:
    """Id of a chunk's vector under one provider, model and version."""
    return uuid5(URL_NAMESPACE, F.concat_ws(":", provider, model, version.cast("string"), chunk_id.cast("string")))


def normalize_source_id(source_id: Column) -> Column:
    """Trimmed, slashes forward and single, none leading."""
    return F.ltrim(F.regexp_replace(F.replace(F.trim(source_id), F.lit("\\"), F.lit("/")), "/{2,}", "/"), F.lit("/"))


@functools.lru_cache(maxsize=1 << 18)
def token_digest(token: str) -> bytes:
    """BLAKE2b of a token; the most recent tokens of a worker are kept."""
    return hashlib.blake2b(token.encode(), digest_size=8).digest()


def simhash_of(text: str | None) -> int:
    """64-bit SimHash of Latin tokens by BLAKE2b, signed; a balanced bit is set; 0 without tokens."""
    tokens = [t.lower() for t in _LATIN.findall(text or "")]
    if not tokens:
        return 0
    digests = b"".join(map(token_digest, tokens))
    ones = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones >= len(tokens)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    return texts.map(simhash_of).astype("int64")


def simhash64_md5(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, simhash: the same vote over the first 64 bits of MD5, by aggregates alone.

    Votes are summed beside the scan before anything is shuffled, so a document
    sends one row of 64 sums per task.
    """
    half = lambda at: F.conv(F.substring(F.md5(F.col("t").cast("binary")), at, 8), 16, 10).cast("long")
    tokens = docs.select(F.col(id_col), F.explode(latin_tokens(F.col(text))).alias("t")).select(id_col, half(1).alias("hi"), half(9).alias("lo"))
    vote = lambda word, bit: F.sum(F.shiftright(word, bit).bitwiseAND(F.lit(1)) * 2 - 1) >= 0
    sums = [vote("lo", b).alias(f"b{b}") for b in range(32)] + [vote("hi", b).alias(f"b{b + 32}") for b in range(32)]
    votes = tokens.groupBy(id_col).agg(*sums)
    bit = lambda b: F.when(F.col(f"b{b}"), F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    value = bit(0)
    for b in range(1, BITS):
        value = value.bitwiseOR(bit(b))
    found = votes.select(F.col(id_col).alias("_sid"), value.alias("simhash"))
    return docs.select(id_col).join(found.hint("merge"), F.col(id_col) == F.col("_sid"), "left").select(id_col, F.coalesce("simhash", F.lit(0)).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1.0 - hamming(a, b) / BITS
