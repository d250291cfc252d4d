"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def split_pattern(path: str = VOCABULARY) -> str:
    """The pattern that cuts texts before merging; it is named beside the vocabulary."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_init", Path(path).parent / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(_encoding(path, split_pattern(path)).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """The frame with a column ``tokens``; null and empty texts have none.

    Only the driver needs the vocabulary: the session sends it to the workers.
    """
    df.sparkSession.sparkContext.addFile(path)
    name, pattern = Path(path).name, split_pattern(path)

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(SparkFiles.get(name), pattern)
        for values in batches:
            yield pd.Series([len(x) for x in encoding.encode_ordinary_batch([v or "" for v in values], num_threads=1)], dtype="int64")

    return df.withColumn("tokens", counted(F.col(text)))
