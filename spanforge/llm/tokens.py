"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: where the vocabulary files lie, and which is used if none is named
VOCABULARIES = os.environ.get("SPANFORGE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(path: str):
    """A tokenizer from a ranks, tokenizers or sentencepiece file: text to list of ids."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return e.encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode


def with_tokens(df: DataFrame, text: Column, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``n_tokens`` of ``text``; null and empty texts have none.

    Only what is kept leaves the task: texts go to Python once and are never shuffled.
    """
    path = vocabulary or os.path.join(VOCABULARIES, DEFAULT)
    chosen = df.select(*keep, text.cast("string").alias("_text"))
    schema = chosen.drop("_text").schema.add("n_tokens", "long")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = [len(encode(t)) if t else 0 for t in texts.to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(run, schema)
