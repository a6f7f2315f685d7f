"""BPE encoding and decoding by speculation and verification.

For each distinct word, greedy longest match proposes tokens.  A sequence of tokens is the BPE
encoding of its text just when each two neighbours are, so one vectorised check of all adjacent
pairs finds the words whose proposal is wrong; only these are merged exactly.  See
:mod:`sqltide.llm.vocabulary`.

A null text counts as empty and has no ids; null ids decode to the empty text; null or unknown
ids inside a list are left out.  The strings of special tokens become their ids, as the
tokenizers library does.  Bytes that are not UTF-8 decode to U+FFFD.  Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltide.llm.vocabulary import encoder, gather, slices, vocabulary


def encode(text: Column, path: str) -> Column:
    """The token ids of a text, by the tokenizer file at ``path``, which every node has."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path)
        for batch in batches:
            parts = []
            for texts in slices(batch):
                flat, start = coder.encode(texts)
                parts.append(pa.ListArray.from_arrays(
                    pa.array(start, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; special tokens are kept."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in batches:
            parts = [decoded(vocab, batch.slice(at, 512)) for at in range(0, len(batch), 512)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return text(ids)


def decoded(vocab, batch: pa.ListArray) -> pa.Array:
    lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = batch.flatten()
    codes = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = (codes >= 0) & (codes < vocab.size)
    if not known.all():
        of = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(of[known], minlength=len(lengths))
        codes = codes[known]
    flat, start = gather(vocab.byte_flat, vocab.byte_start, codes, lengths)
    raw = flat.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        return pa.array([raw[a:b].decode("utf-8", "replace")
                         for a, b in zip(start, start[1:], strict=False)], pa.string())
    return pa.StringArray.from_buffers(
        len(lengths), pa.py_buffer(start.astype(np.int32)), pa.py_buffer(raw))
