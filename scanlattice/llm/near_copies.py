"""Near copies by SimHash, checked and completed by exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a Jaccard
similarity of ``LEAST`` (4/5) or more.  Equal sets are folded to one node first.

SimHash comes first: the fingerprints of all texts go through the anchors of ``simhash``, and
what these link is verified by the whole sets (``_by_fingerprint``).  No number of bits holds
all pairs of this similarity, so those still apart get their candidates from prefixes:
if the shingles of all texts are in one order, two sets of that similarity share a shingle
among the first ``size // 5 + 1`` of each.  The order is by hash, with the shingles that are
frequent in a sample of the documents last; the sample decides the cost, never the result.
The places of the first shingle that two sets share bound what they can share in all, so that
most pairs that are not alike are left out by their places and sizes.

Nodes that share a prefix shingle and aren't joined by fingerprint are candidates, verified
in the same way: first each with one node of the shingle, which joins most of a large group,
then those that are still apart (``_linked``).

Defined results: null texts count as empty, all texts without a word are copies of each other,
and a text of fewer words than a shingle is one shingle.  Rows with a null doc_id stay and
link nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, named, release, rows_of, scratch, text_of
from .components import components
from .simhash import SEED, _WORD, fingerprint, links

SHINGLE = 5
#: Least similarity as a fraction: 4/5.
LEAST = (4, 5)
#: Documents sampled for frequent shingles, how many of them make one frequent, how many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 2, 300_000


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, made of the hashes of their words."""
    words = _WORD.findall(lower_ascii(text))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    k = min(shingle, len(own))
    out = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out) + own[i : len(own) - k + 1 + i]
    return np.unique(_mixed(_mixed(out)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def short(own: np.ndarray) -> np.ndarray:
    """A set of 32-bit hashes, which is what is compared: it halves what is written and
    shuffled, and of n shingles n / 4e9 meet a different one by chance."""
    return np.unique((own >> np.uint64(32)).astype(np.uint32))


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which two sets that are ``alike`` share one."""
    n = len(own) - -(-LEAST[0] * len(own) // LEAST[1]) + 1 if len(own) else 0
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[at] == own
        own = np.concatenate([own[~late], own[late]])
    return own[:n]


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Sorted shingles that are frequent in a sample; at most ``MOST_FREQUENT`` reach the driver."""
    share = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.concatenate(sets).view(np.int64))})

    text = docs.select(text_of(text_col).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(share)) == 0)
    counts = text.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow().column("s").to_numpy().view(np.uint64))


def _possible(size: Column, place: Column, other_size: Column, other_place: Column) -> Column:
    """Whether two sets can be ``alike`` if these are the places of the first shingle they share."""
    most = F.least(size - place, other_size - other_place)
    return F.lit(sum(LEAST)) * most >= F.lit(LEAST[0]) * (size + other_size)


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """(a, b): nodes that SimHash links, as stars.  ``rows``: columns fp and node.

    A star's ends are linked by a chain of fingerprints, so each is a candidate to be verified.
    """
    both = materialize(rows.select("fp", "node").distinct(), "fingerprints")
    one = both.groupBy("fp").agg(F.min("node").alias("one"))
    stars = links(one.select("fp")).distinct()
    far = stars.join(one.withColumnsRenamed({"fp": "a", "one": "na"}), "a").join(one.withColumnsRenamed({"fp": "b", "one": "nb"}), "b").select("na", "nb")
    pairs = far.union(both.join(one, "fp").select("node", "one")).toDF("a", "b").where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _linked(members: DataFrame, found: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """(a, root), as ``components``, over the links ``found`` and all pairs of nodes that share a
    key and pass ``verify``.

    ``members``: columns key, node, size and place.  ``verify`` takes distinct pairs (a, b) and
    returns those that are links.  First each key's nodes are compared with its least node only,
    in an order that differs by round; then every pair of a key whose nodes are still apart, and
    possibly alike, is compared, so no link is lost.
    """
    root = components(found)
    for k in range(rounds + 1):
        own = members.join(root.withColumnRenamed("a", "node"), "node", "left").select("key", "node", "size", "place", F.coalesce("root", "node").alias("label"))
        who = F.struct(F.xxhash64("node", F.lit(k)).alias("at"), *own.columns[1:])
        apart = own.groupBy("key").agg(F.min(who).alias("one"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        if k < rounds:
            both = own.join(apart.select("key", *(F.col(f"one.{c}").alias(f"other_{c}") for c in own.columns[1:])), "key")
            pairs = both.where("label <> other_label")
        else:
            left = materialize(own.join(apart.select("key"), "key"), "apart")
            both = left.join(left.select("key", *(F.col(c).alias(f"other_{c}") for c in own.columns[1:])), "key")
            pairs = both.where("node < other_node and label <> other_label")
        pairs = pairs.where(_possible(F.col("size"), F.col("place"), F.col("other_size"), F.col("other_place")))
        pairs = pairs.select(F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b")).distinct()
        passed = materialize(verify(pairs), "links")
        release(members.sparkSession)  # sets travelled with the pairs
        found = found.union(passed)
        root = components(found)
    return root


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id of every row whose doc_id isn't null."""
    with scratch(docs.sparkSession) as last:
        return last(_near_copies(docs, id_col, text_col), "near-copies")


def _near_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    late = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            parts = [prefix(s, late.value).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "text_hash": batch.column(1), "node": pa.array(node), "fp": pa.array(fp), "size": pa.array(np.array([len(s) for s in sets], np.int32)), "prefix": pa.array(parts, pa.list_(pa.int64()))}
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "s": pa.array([short(shingle_set(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            keep = [alike(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text")).where("doc_id is not null")
    spark = docs.sparkSession
    rows = materialize(texts.mapInArrow(prefixes, "doc_id long, text_hash long, node long, fp long, size int, prefix array<long>"), "prefixes")
    near = materialize(_by_fingerprint(rows), "near-fingerprints")
    release(spark)
    postings = rows.select("node", "size", F.posexplode_outer("prefix").alias("place", "key")).where("key is not null")
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    members = materialize(postings.join(shared, "key").select("key", "node", "size", "place").distinct(), "members")
    release(spark)
    one = rows.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("doc")).select("node", "doc.*")
    one = one.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    met = texts.join(one, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # Rows that repeat an id and a text are folded where the join left them, so that sets stay in place.
    met = met.dropDuplicates(["doc_id", "text_hash"]).select("node", "text")
    sets = materialize(met.mapInArrow(whole, "node long, s binary"), "shingle-sets")
    release(spark)

    def verify(pairs: DataFrame) -> DataFrame:
        close = materialize(pairs, "close-pairs")
        both = close.join(sets.withColumnsRenamed({"node": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "s": "sb"}), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(compared, "a long, b long")

    close = materialize(verify(near), "links")
    release(spark)
    root = _linked(members, close, verify).withColumnRenamed("a", "node")
    labelled = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named_ = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(named_, "root").select("node", "component_id")
    return rows.select("doc_id", "text_hash", "node").join(labelled, "node").select("doc_id", "text_hash", "component_id")
