"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of a byte-level BPE; a parameter everywhere, read on the driver and sent to the executors once.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of that tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[int, object] = {}


def _encoding(data: bytes, pattern: str):
    import tiktoken

    key = hash((data, pattern))
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _LOADED[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def token_counts(df: DataFrame, key: str, text: str, *carried: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(k, n_tokens, *carried): whole texts measured, one row per row. Null and empty texts have 0 tokens. No shuffle."""
    with open(ranks, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("_text"), *carried)
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value, pattern)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n, pa.int64())], names=[*[f.name for f in kept], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, n_tokens long")
