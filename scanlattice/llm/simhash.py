"""SimHash near-duplicates by anchor-point covering.

*Anchors* are the words of a covering code on the fingerprint's first 46 bits: the product of
two binary Golay codes [23, 12], whose balls of radius 3 cover every 23-bit word exactly once.
A fingerprint's *home* is the anchor that covers it.  Any fingerprint within ``threshold``
bits of it lies within covering radius + ``threshold`` of that home, where the bits by which
it leaves the radius of each code are added up against the one threshold.  So each fingerprint
is replicated to every anchor within that distance (16.8 million anchors, 302 replicas on
average) and compared, anchor by anchor, with the fingerprints at home there: no link is lost.
``codes=1`` uses the first code alone (4,096 anchors, 72 replicas), which is as exact and only
pays for small inputs; nothing chooses it by size.

Skew: exact copies share one fingerprint and are folded before anything is replicated.
Anchors that are home to more than a bounded share are split into blocks, and every pair of
blocks is a task of its own.  A task keeps the compared fingerprints of one such pair of
blocks and returns a star per local component, never all pairs.  Components are found on the
fingerprints, so that links hold through rows without an id and rows that repeat one.

Defined results: null texts count as empty and have fingerprint zero, which links like any
other.  Rows with a null doc_id have a fingerprint and link like others, but never name a
component; a component without any id has a null component_id.  Two texts under one doc_id
are two rows, each in its own component.  Empty tables give no rows.  Other columns are not
read by ``near_duplicates`` and pass ``keep_one`` whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, materialize, named, rows_of, text_of, unused
from .components import components

SHINGLE = 3
THRESHOLD = 3
RADIUS = 3
SEED = 42
CODES = 2
#: Homes at one anchor above which it is split, and the most anchors that can be above it.
BLOCK = 50_000
HOT_ANCHORS = 20_000
_WORD = re.compile(WORD)
_N = 23
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = _WORD.findall(lower_ascii(text))
    if not words:
        return 0
    if len(words) < shingle:
        runs = [" ".join(words)]
    else:
        runs = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(r, SEED) for r in runs), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


@functools.lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(the 4,096 words of the code, the covering word of each of the 2^23 words)."""
    message = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for i in range(12):
        code ^= np.where(message >> i & 1, _GENERATOR << i, 0)
    bits = 1 << np.arange(_N)
    balls = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    home = np.full(1 << _N, -1, np.int16)
    for e in balls:
        home[code ^ int(e)] = message
    assert (home >= 0).all()
    return code.astype(np.uint32), home


@functools.lru_cache(maxsize=4)
def _reach(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is within ``most`` bits of a word, by the pattern in which it differs from its home.

    (the 2,048 patterns in order, first entry of each and the end, anchors, distances).  The code
    is linear, so the anchors around any word are those around its pattern, moved by its home.
    """
    code, home = golay()
    words = np.flatnonzero(home == 0).astype(np.uint32)
    far = np.bitwise_count(words[:, None] ^ code[None, :])
    row, anchor = np.nonzero(far <= most)
    return words, np.append(np.searchsorted(row, np.arange(len(words))), len(row)), anchor, far[row, anchor].astype(np.int64)


def _near(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, distance) of all anchors within ``most`` bits of 23-bit words, by row."""
    code, home = golay()
    patterns, begin, anchor, far = _reach(most)
    own = home[words].astype(np.int64)
    at = np.searchsorted(patterns, words ^ code[own])
    n = begin[at + 1] - begin[at]
    row = np.repeat(np.arange(len(words)), n)
    entry = np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
    return row, anchor[entry] ^ own[row], far[entry]


def replicas(fps: np.ndarray, codes: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor, whether the row is at home there) for all anchors in reach."""
    mask = np.uint64((1 << _N) - 1)
    _, home = golay()
    first = (fps & mask).astype(np.uint32)
    rows, anchors, excess = _near(first, RADIUS + threshold)
    excess = np.maximum(excess - RADIUS, 0)
    at_home = home[first].astype(np.int64)
    if codes == 1:
        return rows, anchors, anchors == at_home[rows]
    second = (fps >> np.uint64(_N) & mask).astype(np.uint32)
    rows2, anchors2, excess2 = _near(second, RADIUS + threshold)
    excess2 = np.maximum(excess2 - RADIUS, 0)
    at_home = at_home << 12 | home[second].astype(np.int64)
    out = []
    for a in range(threshold + 1):  # bits beyond the first code's radius leave the rest for the second
        left, right = excess == a, excess2 <= threshold - a
        r1, c1, r2, c2 = rows[left], anchors[left], rows2[right], anchors2[right]
        begin, end = np.searchsorted(r2, r1, "left"), np.searchsorted(r2, r1, "right")
        n = end - begin
        take = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((np.repeat(r1, n), np.repeat(c1, n) << 12 | c2[take]))
    r, c = (np.concatenate(x) for x in zip(*out))
    return r, c, c == at_home[r]


def _block_of(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deals fingerprints to blocks evenly, near ones included."""
    h = fps * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) % n.astype(np.uint64)).astype(np.int64)


def _stars(homes: np.ndarray, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its local component) over all links between the two."""
    nodes = np.unique(np.concatenate([homes, others]))
    label = np.arange(len(nodes))
    h, o = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    step = max(1, 2_000_000 // max(1, len(others)))
    for at in range(0, len(homes), step):
        part = slice(at, at + step)
        i, j = np.nonzero(np.bitwise_count(homes[part, None] ^ others[None, :]) <= threshold)
        a, b = h[part][i], o[j]
        a, b = a[a != b], b[a != b]
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            up = np.arange(len(nodes))
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up != up[up]).any():
                up = up[up]
            label = up[label]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def _replicate(codes: int, threshold: int, hot: dict[int, int]):
    """Rows (key, fp).  From the top, the key's bits are the anchor, a pair of blocks of 14 bits
    each, and whether the fingerprint is at home there."""
    anchors = np.array(sorted(hot), np.int64)
    blocks = np.array([hot[a] for a in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1024):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, anchor, is_home = replicas(fps, codes, threshold)
            fp = fps[row]
            keys, out = [anchor << 29 | is_home], [fp]
            if len(anchors):
                at = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
                crowded = np.flatnonzero(anchors[at] == anchor)
                n = blocks[at[crowded]]
                own = _block_of(fp[crowded], n)
                keys, out = [np.delete(keys[0], crowded)], [np.delete(fp, crowded)]
                for home in (True, False):  # a home goes to (own, j), a replica to (i, own), for all j and i
                    sel = np.flatnonzero(is_home[crowded]) if home else np.arange(len(crowded))
                    times = n[sel]
                    sel = np.repeat(sel, times)
                    other = np.arange(len(sel)) - np.repeat(np.cumsum(times) - times, times)
                    i, j = (own[sel], other) if home else (other, own[sel])
                    keys.append(anchor[crowded[sel]] << 29 | i << 15 | j << 1 | home)
                    out.append(fp[crowded[sel]])
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "fp": pa.array(np.concatenate(out).view(np.int64))})

    return run


def _compare(threshold: int):
    """Rows (key, fp), sorted by key, in; stars of local components out."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        group = None
        for batch in batches:
            key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            home, key = (key & 1).astype(bool), key >> 1
            begin = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            end = np.append(begin[1:], len(key))
            # Only groups of two rows or more with a home are of use; the ends may go on in other batches.
            useful = (end - begin > 1) & np.logical_or.reduceat(home, begin)
            useful[[0, -1]] = True
            for a, b in zip(begin[useful].tolist(), end[useful].tolist()):
                if key[a] != group:
                    if kept:
                        yield tuple(map(np.concatenate, zip(*kept)))
                    kept, group = [], key[a]
                kept.append((home[a:b], fp[a:b].view(np.uint64)))
        if kept:
            yield tuple(map(np.concatenate, zip(*kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, fp in groups(batches):
            if home.any() and len(fp) > 1:
                a, b = _stars(fp[home], fp, threshold)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """(a, b): stars that connect exactly what chains of links connect.  ``fps``: distinct fp."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, home = golay()
        mask = np.uint64((1 << _N) - 1)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = home[(fp & mask).astype(np.int64)].astype(np.int32)
            if codes == 2:
                at = at << 12 | home[(fp >> np.uint64(_N) & mask).astype(np.int64)]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(at.astype(np.int32))})

    at_home = fps.mapInArrow(homes, "anchor int").groupBy("anchor").count()
    # At most HOT_ANCHORS anchors can hold a HOT_ANCHORS-th of all, which bounds this list.
    most = max(block, fps.count() // HOT_ANCHORS)
    hot = {r.anchor: min(1 << 14, -(-r["count"] // most)) for r in at_home.where(F.col("count") > most).collect()}
    spread = fps.mapInArrow(_replicate(codes, threshold, hot), "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(n, F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, fp, component_id: one row per row of ``docs``."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    stars = links(nodes.select("fp"), threshold, codes, block).distinct()
    root = components(stars).withColumnRenamed("a", "fp")
    labelled = nodes.join(root, "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root"))
    named_ = labelled.groupBy("root").agg(F.min("node").alias("component_id"))
    labelled = labelled.join(named_, "root").select("fp", "component_id")
    return rows.join(labelled, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` with one document per component: the one with the smallest id.

    Rows that repeat an id and a text count as one document; rows with a null id stay.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **parameters), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_one`` by the components ``found``: doc_id, text_hash, component_id."""
    repeated = found.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Only ids that go or repeat are needed; all others pass the join without a partner.
    own, text_hash, stays = (unused(c, docs) for c in ("_near_id", "_near_hash", "_near_stays"))
    marked = materialize(repeated.where("doc_id <> component_id or n > 1").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), (F.col("doc_id") == F.col("component_id")).alias(stays)), "near-marked")
    met = docs.join(marked, (named(id_col).cast("long") == F.col(own)) & (F.xxhash64(text_of(text_col)) == F.col(text_hash)), "left")
    columns = [named(c) for c in docs.columns]
    one = met.where(F.col(own).isNull()).select(*columns)
    first = met.where(F.col(stays)).dropDuplicates([own, text_hash]).select(*columns)
    return one.unionByName(first) if marked.where(F.col(stays)).limit(1).count() else one
