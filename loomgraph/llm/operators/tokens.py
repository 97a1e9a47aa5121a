"""Token counts by a public tokenizer's vocabulary (byte-level BPE ranks, one file, given by path)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def vocabulary_file(path: str = VOCABULARY) -> bytes:
    """The vocabulary as the driver has it, to be sent with a task: executors need no such file. It has a fixed size, under 1 MB."""
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str = VOCABULARY, content: bytes | None = None):
    """``text -> token ids`` of the vocabulary at ``path``, or of its ``content``, made once a worker; special tokens are ordinary text."""
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (content or vocabulary_file(path)).splitlines())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _LOADED[path]


def with_tokens(rows: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``tokens`` (0 for a null text); the text itself goes no further than the counting."""
    kept = rows.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", tokens long"

    content = vocabulary_file(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, content)
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column("_text").to_pylist()], pa.int64())
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, n], names=[*keep, "tokens"])

    return kept.mapInArrow(run, ddl)
