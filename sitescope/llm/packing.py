"""Sequence packing by power-of-two decomposition.

A document's tokens, with one end token, are cut into full sequences of
``max_length`` and then into the binary digits of the rest, longest first.
Each piece is a sequence of its own whose length is a power of two, so no
sequence crosses documents and none is padded. ``bucket`` is the exponent:
sequences of equal length batch together.

Token ids are those of the given byte-level BPE file. The vocabulary is read
from that file and run by ``tiktoken``, which yields the same ids several
times faster; strings of special tokens inside a text are ordinary text. Its
pattern engine gives up on very long runs of white space, so texts that hold a run of
``LONG_BLANK`` characters go through ``tokenizers``, which reads the file itself.

Defined results: a null text counts as empty, and an empty document is one
piece holding the end token; rows that repeat are packed once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .common import plain_text

MAX_LENGTH = 2048
END_ID = 1
# Pre-tokenisation pattern of byte_bpe_50k (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}
_SLOW: dict[str, object] = {}
# Runs of white space from here on: the pattern's look-ahead backs up over a run character by character.
LONG_BLANK = 10_000
BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """The BPE of a byte-level tokenizer file, read once per worker."""
    if path not in _ENCODERS:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()
                 if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_ids(path: str, text: str) -> list[int]:
    """The text's ids, without an end token."""
    if not BLANKS.search(text):
        return encoder(path).encode_ordinary(text)
    if path not in _SLOW:
        from tokenizers import Tokenizer
        _SLOW[path] = Tokenizer.from_file(path)
        _SLOW[path].encode_special_tokens = True  # strings of special tokens are ordinary text
    return _SLOW[path].encode(text, add_special_tokens=False).ids


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Full sequences, then the binary digits of what is left, longest first."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID,
                   with_tokens: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, tokens) per piece.

    ``max_length`` is a power of two. ``sequence_id`` numbers pieces within
    their scan partition, so it needs no shuffle and a retried task repeats it.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            ids, starts, lengths, sums, totals, tokens = [], [], [], [], [], []
            for doc_id, text in zip(chunk.column("id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                got = np.array([*token_ids(tokenizer, text), end_id], dtype="<u4")
                at, raw = 0, got.tobytes()
                for n in piece_lengths(len(got), max_length):
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(n)
                    sums.append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                    totals.append(len(got))
                    if with_tokens:
                        tokens.append(got[at:at + n].astype(np.int32))
                    at += n
            out = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_tokens:
                out.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(docs[id_col].cast("long").alias("id"), plain_text(docs, text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", tokens array<int>" * with_tokens
    packed = rows.mapInArrow(pieces, schema)
    return packed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"), *(["tokens"] if with_tokens else []))
