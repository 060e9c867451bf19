"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Setting of the session that names the vocabulary: ranks in base 64, one token a line. Every executor needs the file there.
SETTING = "spark.millrace.vocabulary"
#: Its place where the session does not name one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about this many characters, which bounds the encoder's memory, not the text.
PIECE = 1_000_000


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text; very long texts are encoded in pieces cut before a line's start where there is one."""
    encode = encoder(path).encode_ordinary
    if len(text) <= PIECE:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            line = text.rfind("\n", at + PIECE // 2, end)
            end = line + 1 if line > 0 else end
        total += len(encode(text[at:end]))
        at = end
    return total


def token_sizes(df: DataFrame, ident: str, text: str, keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the kept columns of every row with a text; rows without id or text are left out.

    The text is read once, in Arrow batches, and goes no further than the task that counts it.
    """
    kept = keep or []
    path = path or df.sparkSession.conf.get(SETTING, VOCABULARY)
    source = df.select(F.col(ident).cast("long").alias("doc_id"), *kept, F.col(text).alias("_text")).where("doc_id is not null and _text is not null")
    kinds = source.drop("_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([count_tokens(s, path) for s in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes], names=[*b.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(run, kinds.add("n_tokens", LongType()))
