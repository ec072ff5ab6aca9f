"""Problem 8: encoding of whole texts with a public tokenizer.

The ``tokenizers`` library runs over Arrow batches in the Python workers. Ids are those of the
byte-level BPE file without special tokens; the strings of special tokens are ordinary text.

Defined results: a null text and an empty text have an empty list of ids; a blank text is encoded
like any other. Offsets are in characters (code points) of the text; a character that is split
over several ids has the same offsets in each of them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import arrow_rows

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Texts, and bytes of texts, that are encoded at once in a worker.
BATCH, BATCH_BYTES = 256, 1 << 23


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once in each process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, count) of slices of few texts and bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and (at - begin >= BATCH or held + size > BATCH_BYTES):
            yield begin, at - begin
            begin, held = at, 0
        held += size
    if len(sizes) > begin:
        yield begin, len(sizes) - begin


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter((x for v in values for x in v), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, offsets: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, the columns ``keep`` and ``ids``, with ``offsets``
    also ``starts`` and ``ends`` of each id in characters. No shuffle: rows stay where they were read."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    arrow_rows(df.sparkSession, 1000)
    held = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        call = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
        for batch in batches:
            for at, count in _slices(batch.column(1)):
                part = batch.slice(at, count)
                found = call([x or "" for x in part.column(1).to_pylist()], add_special_tokens=False)
                columns = [part.column(0), *part.columns[2:], _lists([e.ids for e in found])]
                names = [id_col, *keep, "ids"]
                if offsets:
                    columns += [_lists([[o[k] for o in e.offsets] for e in found]) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return df.select(id_col, F.col(text_col), *keep).mapInArrow(run, f"{held}, ids array<int>{more}")


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[bytes | None, ...]:
    """The bytes of each id. In a byte-level vocabulary each byte stands as one printable character:
    the printable Latin-1 bytes as themselves, the others in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}
    vocabulary = load(path).get_vocab(with_added_tokens=False)
    table: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        if all(c in back for c in token):
            table[number] = bytes(back[c] for c in token)
    return tuple(table)


def decode_ids(ids: list[int] | None, path: str | None = None) -> str | None:
    """The text of ids: their bytes are put together before they are read as UTF-8, so characters
    that are split over ids come out whole. What is no UTF-8 becomes U+FFFD; null stays null."""
    if ids is None:
        return None
    table = byte_table(path or f"{TOKENIZERS}/{BYTE_BPE}")
    return b"".join(table[i] or b"" for i in ids).decode("utf-8", "replace")


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """One row for each row of ``df``: ``id_col`` and the ``text`` of its ids."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``n_tokens`` of each row."""
    return encode(df, id_col, text_col, path, keep=keep).select(id_col, *keep, F.size("ids").alias("n_tokens"))
