"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before a space that a letter or digit follows: every match of the
pattern starts there anyway, so the pieces' ids joined are the ids of the whole.  Decoding
works on raw bytes, so ids that end inside a character lose nothing.

Long runs of white space overflow the stack of the library's pattern matcher, which keeps a
way back for every character.  What the pattern matches there is known without it: the run
but for its last character, or all of it at the end of the text.  That match goes to the
library as one piece of bytes.

Defined results: a null text counts as empty and has no ids.  Nothing is ever a special
token.  Whole texts are encoded, whatever their length.  Rows come back one for one, repeated
ids and repeated rows included; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import named, rows_of, text_of

#: Texts above this many characters are cut at safe boundaries.
PIECE_CHARS = 20_000
_SAFE = re.compile(r" (?=[^\W_])")
#: Runs of white space from this many characters on are matched here; the fixed last
#: alternatives of the patterns for which that holds; the characters that they mean by \s.
LONG_RUN = 1000
RUNS = r"|\s+(?!\S)|\s+"
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _ordinary(text: str, enc: tiktoken.Encoding) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    if len(text) < LONG_RUN or not enc._pat_str.endswith(RUNS) or not (runs := [m.span() for m in _RUN.finditer(text)]):
        return _ordinary(text, enc)
    out, at = [], 0
    for begin, end in runs:
        end -= end < len(text)  # the last one may belong to the word that follows
        out += _ordinary(text[at:begin], enc)
        out += enc._encode_single_piece(text[begin:end].encode())
        at = end
    return out + _ordinary(text[at:], enc)


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every whole text.  One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in rows_of(batches):
            ids = [encode(t, enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, decoded: the raw bytes of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in rows_of(batches):
            out = [decode(ids or [], enc) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode and digest in one pass,
    so that neither ids nor bytes travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in rows_of(batches):
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text, enc)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
