"""Bulk-synchronous best-fit packing of token sequences.

1. *Cut*: documents become pieces of at most ``max_len`` tokens; only longer ones are cut,
   and what is left over comes first.
2. *Range-sort*: pieces are range-partitioned and sorted by length, longest first.  Their
   rank within a length is a base per partition plus the place in the partition.
3. *Sweep*: all pieces of a length are alike, and so are all gaps of a size, so sorted pieces
   and sorted gaps are run-length coded: at most ``max_len`` runs each, whatever the number
   of documents.  In each round the longest pieces left take the successor of their length
   among the gaps; conflicts go by rank, the k-th piece to the k-th sequence of the run; gaps
   are updated and the round repeats until the length is placed.  This is exactly what
   best-fit decreasing does piece by piece.
4. *Match*: every piece finds its round by length and rank, in parallel, from the rounds'
   bounded list; this needs no shuffle.

The rounds are planned on the driver: they see a row per length, and per partition where a
length spans several, and never a document; the README has the figures.

Defined results: a null or empty text is one piece that holds the end token alone.  Pieces
of equal length are ranked by doc_id (nulls first), then piece; rows that repeat an id are
packed each for itself, in any order.  No documents: no rows.  Columns but the id and the text
are not read, so their names don't matter.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, named, rows_of, text_of, unused

MAX_LEN = 1024
END = 2


#: How the byte-level pre-tokenizer splits; fixed by the file format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte behind each character that byte-level files write tokens with: printable
    Latin-1 stands for itself, the other bytes, in order, for U+0100 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class FileTokenizer:
    """The ids of a tokenizers file.

    A plain byte-level file whose merges stand in the order of their ids is run as a rank
    table, which gives the same ids several times faster.  Any other file, and any text that
    holds an added token, goes through the tokenizers library.
    """

    def __init__(self, file: str):
        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.ranks = self._ranks(spec)

    @functools.cached_property
    def library(self):
        """The library's own tokenizer, which most workers never need in memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _ranks(self, spec: dict) -> tiktoken.Encoding | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"], spec.get("normalizer"), pre.get("type")) == ("BPE", None, "ByteLevel") and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        byte, special = _byte_of(), set(self.added)
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if joined != sorted(set(joined)) or len(joined) + 256 != len(vocab):
            return None
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranks is None or any(a in text for a in self.added):
            return list(self.library.encode(text, add_special_tokens=False).ids)
        return bpe.encode(text, self.ranks)


@functools.lru_cache(maxsize=2)
def tokenizer(file: str) -> FileTokenizer:
    return FileTokenizer(file)


def cuts(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes what is left over."""
    first = n % max_len or max_len
    return [(0, first), *((at, max_len) for at in range(first, n, max_len))]


def token_pieces(docs: DataFrame, file: str, max_len: int = MAX_LEN, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, input_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(file)
        for batch in rows_of(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "input_ids")}
            for doc, ids in zip(batch.column(0).to_pylist(), map(tok.encode, batch.column(1).to_pylist())):
                ids.append(end)
                flat = np.array(ids, "<u4")
                for k, (at, n) in enumerate(cuts(len(ids), max_len)):
                    part = flat[at : at + n]
                    for name, x in zip(out, (doc, k, at, n, zlib.crc32(part.tobytes()), part.view("<i4") if with_ids else None)):
                        out[name].append(x)
            if not with_ids:
                del out["input_ids"]
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "input_ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", input_ids array<int>" * with_ids
    return docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Placed:
    """Pieces of one length with ranks from ``rank`` on go to sequences from ``sequence`` on."""

    rank: int
    count: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> dict[int, list[Placed]]:
    """The rounds of best-fit over run-length coded pieces and gaps."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, how many)
    sizes: list[int] = []  # in order
    opened = 0
    out: dict[int, list[Placed]] = {}

    def leave(size: int, sequence: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
            gaps.setdefault(size, []).append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        rounds = out.setdefault(length, [])

        def place(n: int, sequence: int, offset: int) -> None:
            nonlocal rank, left
            rounds.append(Placed(rank, n, sequence, offset))
            rank, left = rank + n, left - n

        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            size = sizes[at]
            sequence, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            take = min(n, left)
            leave(size, sequence + take, n - take)
            place(take, sequence, max_len - size)
            leave(size - length, sequence, take)
        fit = max_len // length
        if full := left // fit:  # new sequences, each filled before the next is opened
            for k in range(fit):
                place(full, opened, k * length)
            leave(max_len - fit * length, opened, full)
            opened += full
        if left:
            n = left
            for k in range(n):
                place(1, opened, k * length)
            leave(max_len - n * length, opened, 1)
            opened += 1
    return out


def best_fit(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = pieces.columns
    part_col, place_col = unused("_part", pieces), unused("_place", pieces)
    ordered = pieces.repartitionByRange(parts, F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.diff(lengths)) + 1
            if lengths[0] != now:
                starts, seen = np.append(0, starts), 0
            run = np.zeros(len(lengths), np.int64)
            run[starts] = starts
            place = np.arange(len(lengths)) - np.maximum.accumulate(run)
            place[: starts[0] if len(starts) else len(lengths)] += seen
            now, seen = lengths[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(place)], names=[*batch.schema.names, part_col, place_col]
            )

    sorted_ = materialize(ordered.mapInArrow(ranked, f"{fields}, {part_col} int, {place_col} long"), "packing")
    # A row per length and, where a length spans several, per partition: max_len + partitions.
    runs = sorted_.groupBy("length", part_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("length"), part_col).collect()
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in runs:
        base[r.length, r[part_col]] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    rounds = plan(counts, max_len)
    table = {
        length: tuple(np.array([getattr(p, k) for p in placed], np.int64) for k in ("rank", "sequence", "offset")) for length, placed in rounds.items()
    }

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, part, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", part_col, place_col))
            rank = rank.copy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                for p in np.unique(part[own]):
                    at = own[part[own] == p]
                    rank[at] += base[int(length), int(p)]
                ranks, sequences, offsets = table[int(length)]
                k = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own] = sequences[k] + rank[own] - ranks[k]
                offset[own] = offsets[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    return sorted_.mapInArrow(match, f"{fields}, sequence_id long, `offset` long")


def pack(docs: DataFrame, file: str, max_len: int = MAX_LEN, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` with their sequence and place in it."""
    pieces = token_pieces(docs, file, max_len, end, id_col, text_col, with_ids)
    return best_fit(materialize(pieces, "pieces"), max_len)  # the range sort reads its input twice
