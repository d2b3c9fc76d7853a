"""Nulls, ties, repeated rows, very long texts, empty tables and clashing names, by operator."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanlattice.llm import bpe, classifier, common, exact_dedup, license_scan, line_dedup, packing, quality_rules, simhash, toxicity, url_filter

from .test_llm import FILE, UP, WORD, labelled, letters, plain_counts, plain_fingerprint, prose

DOCS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows_in(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# What they share


def test_batches_are_bounded_by_rows_and_bytes():
    texts = ["x" * n for n in (10, 10, 5000, 10, 10)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": texts, "l": pa.array([[1]] * 6, pa.list_(pa.int32()))})
    got = [b.column("i").to_pylist() for b in common.rows_of(iter([batch, batch.slice(0, 0)]), 3, 100)]
    assert got == [[0, 1], [2], [3, 4, 5]]
    assert [b.num_rows for b in common.rows_of(iter([batch]), 2, 1 << 20)] == [2, 2, 2]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `A_` int")
    assert common.unused("b", df) == "b" and common.unused("A", df) == "A__"


# op1


def test_urls_in_a_table(spark):
    long = "http://example.com/en/" + "a/" * 50_000 + "x.exe"
    rows = [(1, None, "h"), (1, None, "h"), (2, "http://A.example.com/en/7", None), (None, long, "v"), (3, "no scheme", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, `host.name` string").withColumns({"host": F.lit("old"), "verdict": F.lit(1), "_url_filter": F.lit(2)})
    got = url_filter.UrlFilter().apply(df)
    assert rows_in(got, "page_id", "host", "verdict", "rule") == sorted([(1, "", "allow", None)] * 2 + [(2, "a.example.com", "allow", "example.com/en/7"), (None, "example.com", "block", "com/en/"), (3, "", "allow", None)], key=repr)
    assert set(got.columns) == {"page_id", "url", "host.name", "host", "verdict", "_url_filter", "path", "rule", "glob"}
    assert url_filter.UrlFilter().apply(df.where("false")).count() == 0


# op2


def test_exact_dedup_of_null_ids_and_repeats(spark):
    rows = [(None, "a b"), (1, "A B"), (1, "A B"), (None, "alone"), (4, None), (4, ""), (2, "A B")] + [(100 + i, "hot " * 2000) for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(5), salts=3)
    digest = lambda t: hashlib.sha256(t.translate(UP).encode()).hexdigest()
    expected = [(i, k, n, keep, digest(t or "")) for i, t, k, n, keep in [(None, "a b", 2, 4, False), (1, "A B", 2, 4, False), (1, "A B", 2, 4, False), (2, "A B", 2, 4, True), (None, "alone", None, 1, True), (4, None, 4, 2, True), (4, "", 4, 2, True)]]
    expected += [(100 + i, 399, 300, i == 299, digest("hot " * 2000)) for i in range(300)]
    assert rows_in(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)


# op3


def test_two_texts_under_one_id_are_two_rows(spark):
    rng = random.Random(22)
    base = prose(rng, 400).split()
    near = next(" ".join(own) for i in range(400) if (own := [*base[:i], "edit", *base[i + 1 :]]) and 0 < bin(plain_fingerprint(" ".join(own)) ^ plain_fingerprint(" ".join(base))).count("1") <= 3)
    other = prose(rng, 90)
    rows = [(3, " ".join(base)), (5, near), (5, other), (5, other), (6, other + "!")]
    found = {(r.doc_id, r.fp % 2**64): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[3, plain_fingerprint(rows[0][1])] == found[5, plain_fingerprint(near)] == 3
    assert found[5, plain_fingerprint(other)] == 5


def test_hot_anchors_in_blocks(spark):
    # Fingerprints around one anchor, many more than a block holds, against all pairs.
    rng = np.random.default_rng(23)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)], np.uint64))
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i][np.bitwise_count(fps[:i] ^ x) <= 3]:
            a, b = sorted((find(int(x)), find(int(y))))
            root[b] = a
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for codes in (1, 2):
        stars = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, codes=codes, block=7).collect()}
        assert all(find(a) == find(b) for a, b in stars)
        joined = {x: x for x in root}

        def top(x, joined=joined):
            while joined[x] != x:
                x = joined[x]
            return x

        for a, b in stars:
            joined[max(top(a), top(b))] = min(top(a), top(b))
        assert len({top(x) for x in root}) == len({find(x) for x in root})


def test_keep_one_with_names_of_its_own(spark):
    long = prose(random.Random(9), 200)
    d = spark.createDataFrame([(5, long, 1, 2, 3, "x"), (2, long, 1, 2, 3, "y"), (2, long, 1, 2, 3, "y")], "doc_id long, text string, _near_id int, _near_hash int, _near_stays int, `a.b` string")
    got = simhash.keep_one(d)
    assert got.columns == d.columns and rows_in(got, "doc_id", "a.b") == [(2, "y")]


# op4


def test_quality_of_long_texts_and_repeats(spark):
    rng = random.Random(14)
    long = "\n".join(prose(rng, 40) for _ in range(3000))
    rows = [(1, long), (1, long), (None, long + " # # #"), (2, "same line here\n" * 9000), (3, None)]
    got = quality_rules.quality(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in quality_rules.COUNTS)) for r in got) == sorted((str(i), *plain_counts(t)) for i, t in rows)
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS + ", n_words int, `kept.x` string")
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and {r.n_words for r in kept.collect()} <= {1}


def test_posterior_against_a_plain_em(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r.asDict() for r in quality_rules.judge(*(lambda c: (c, quality_rules.fit_counts(c)))(quality_rules.counts(docs).cache())).collect()]
    n, rules = len(got), quality_rules.RULES
    python = lambda rule: compile(re.sub(r"(?<![<>])=(?!=)", "==", rule.replace("<=", "≤").replace(">=", "≥")).replace("≤", "<=").replace("≥", ">="), "rule", "eval")
    bad, good = [python(b) for _, b, _ in rules], [python(g) for _, _, g in rules]
    vote = np.array([[0 if not r["n_words"] else 2 if eval(b, {}, r) else 1 if eval(g, {}, r) else 0 for b, g in zip(bad, good)] for r in got])  # noqa: S307
    start = np.array(quality_rules._BEFORE[1])
    prior, table = quality_rules._BEFORE[0], np.repeat(start[:, None, :], len(rules), axis=1)
    weight = np.array(quality_rules._WEIGHT)
    of = lambda prior, table: np.array([1 - prior, prior])[:, None] * table[:, np.arange(len(rules))[None, :], vote].prod(axis=2)
    for _ in range(60):
        both = of(prior, table)
        z = both / both.sum(axis=0)
        mass = np.array([[[(z[c] * (vote[:, k] == v)).sum() for v in range(3)] for k in range(len(rules))] for c in (0, 1)])
        mass += (weight[:, None] * n * start)[:, None, :]
        prior, table = (z[1].sum() + quality_rules._BEFORE[0] * 0.1 * n) / (1.1 * n), mass / mass.sum(axis=2, keepdims=True)
    both = of(prior, table)
    expected = both[1] / both.sum(axis=0)
    assert np.allclose([r["posterior"] for r in got], expected, atol=1e-9)
    assert [r["kept"] for r in got] == [bool(not r["base_failed"] and p >= 0.5) for r, p in zip(got, expected)]


# op5


def plain_places(words, templates):
    """Every (label, start, share) by trying every template at every place."""
    out = []
    for t in templates:
        for start in range(-len(t.words) + 1, len(words)):
            at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: B023, E731
            if all(at(start + t.key_at + j) == w for j, w in enumerate(t.key)):
                share = sum(at(start + i) == w for i, w in enumerate(t.words)) / len(t.words)
                if share >= t.least:
                    out.append((t.label, start, len(t.words), share))
    return out


def license_texts():
    rng = random.Random(33)
    every = license_scan.TEMPLATES + tuple(license_scan.Template.of(label, p, p, 1.0) for label, p in license_scan.BASE)
    out = ["", None, "cc by", "by nc 4 0", "Licensed under the Apache licence, version 2.0", "word " * 30_000 + "All rights reserved."]
    for t in every:
        for _ in range(3):
            words = list(t.words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["license", "the", "other", "copyright"])
            cut = rng.randrange(3)
            out.append(" ".join([*(prose(rng, rng.randrange(6)).split()), *(words[cut:] if rng.random() < 0.3 else words), *rng.choice(every).words]).title())
    return out


def test_license_places_against_every_template_at_every_place(spark):
    texts = license_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, "", "y", 2), (2, "cc by", "y", 2)]
    docs = spark.createDataFrame(rows, DOCS + ", labels string, `n.words` int")
    base = [license_scan.Template.of(label, p, p, 1.0) for label, p in license_scan.BASE]
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words = license_scan.words_of(texts[r.doc_id] or "")
        own, more = plain_places(words, base), plain_places(words, license_scan.TEMPLATES)
        assert (r.n_words, r.n_base) == (len(words), len(own))
        assert sorted(map(tuple, r.spans)) == sorted(own + more)
        assert r.labels == ",".join(sorted({x[0] for x in own + more})) and r.base_labels == ",".join(sorted({x[0] for x in own}))
        assert math.isclose(r.score, max((x[3] for x in own + more), default=0.0))
    assert "apache-2.0" in next(r.labels for r in got if r.doc_id == 4)


def test_other_documents_change_no_label(spark):
    texts = license_texts()
    alone = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    rng = random.Random(34)
    words = sorted({w for t in license_scan.TEMPLATES for w in t.words})
    crowd = [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame([*enumerate(texts), *crowd], DOCS)).collect()}
    assert all(got[i] == alone[i] for i in alone)


# op6, op7


def long_runs():
    return [" " * 1_000_000, "\n" * 300_000 + "word", "a" + "\t \n" * 90_000 + " b", " " * 999 + "x", " " * 1000 + "x", "　" * 2500 + "é  ", "\x1c" * 3000, "a" * 200_000, "中" * 100_000]


def test_long_runs_have_the_libraries_ids(spark):
    texts = long_runs()
    library = packing.FileTokenizer(FILE).library
    rows = list(enumerate(texts))
    pieces = collections.defaultdict(dict)
    for r in packing.pack(spark.createDataFrame(rows, DOCS), FILE).collect():
        pieces[r.doc_id][r.piece] = r
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    digests = {r.doc_id: r for r in bpe.digest_documents(spark.createDataFrame(rows, DOCS), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert digests[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if len(t) < 200_000:  # what the library itself can split
            whole = enc.encode_ordinary(t)
            assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, whole)).encode()).hexdigest()


def test_repeated_rows_are_packed_and_encoded_each(spark, ):
    rows = [(7, "one two three"), (7, "one two three"), (7, "other"), (None, None), (None, "")]
    d = spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", length int")
    got = packing.pack(d, FILE).collect()
    assert collections.Counter(r.doc_id for r in got) == {7: 3, None: 2}
    assert sorted((r.sequence_id, r.offset) for r in got)[0] == (got[0].sequence_id, 0) and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert sum(r.length for r in got) == 4 + 4 + 2 + 1 + 1
    digests = bpe.digest_documents(d, RANKS, public_tokenizers.PATTERN)
    assert collections.Counter(r.doc_id for r in digests.collect()) == {7: 3, None: 2}
    assert bpe.digest_documents(d.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


# op8, op9


def test_classifiers_with_repeated_ids_and_long_texts(spark):
    docs, labels = labelled(spark)
    again = docs.union(docs.where("doc_id < 40")).union(spark.createDataFrame([(1, "other text"), (5000, "word " * 400_000)], DOCS))
    from scanlattice.llm.sample import labelled as sample

    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = sample(rows, labels, "quality", F.lit(True), 10).collect()
    assert [(r.doc_id, r.text) for r in got] in ([], [(1, "t0")])
    own = sample(rows, labels.where("doc_id = 1"), "quality", F.lit(True), 10).collect()
    assert [(r.doc_id, r.text) for r in own] == [(1, "t0")]
    for found in (classifier.classify(again, classifier.fit(again, labels)), toxicity.classify(again, toxicity.fit(again, labels))):
        assert found.count() == again.count() and found.where("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_accuracy_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for found, name, least in ((classifier.classify(docs, classifier.fit(docs, labels)), "quality", 0.97), (toxicity.classify(docs, toxicity.fit(docs, labels)), "toxic", 0.97)):
        met = found.where("held_out").join(labels.where(f"{name} is not null"), "doc_id")
        r = met.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col(name)).cast("double")).alias("right"), F.avg(F.when(F.col(name) == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("predicted") == 1, F.col(name))).alias("precision")).first()
        assert r.n > 300 and r.right >= least and r.recall >= 0.85 and r.precision >= 0.85, r


# op10


def plain_mask(line):
    space = r"[\x20\x09-\x0D]+"
    words = [w for w in re.split(space, line) if w]
    masked = ["<*>" if re.search(r"[0-9@]|://", w) else w for w in words]
    return "\n" + " ".join(words) if words and all(set(w) <= set("<*>") for w in masked) else " ".join(masked)


def plain_drops(rows, similar=line_dedup.SIMILAR):
    """(row, place) of the lines that go: the tree, its variants and the counts, line by line."""
    parsed = [[plain_mask(x) for x in (t or "").split("\n")] for _, t in rows]
    count = collections.Counter(m for own in parsed for m in set(own) if m)
    leaves = collections.defaultdict(list)
    for m in count:
        if m[0] != "\n":
            w = m.split(" ")
            leaves[len(w), tuple(w[:3])].append(w)
    order = lambda m: (count[m], xx(m))
    parent = {}
    for (n, _), own in leaves.items():
        differ, rest = n - math.ceil(similar * n), n - 3
        cut = lambda i: math.floor(rest * i / (differ + 1)) + 3  # noqa: B023, E731
        blocks = collections.defaultdict(list)
        for w in own:
            for k in [None] if differ >= rest else [(i, tuple(w[cut(i) : cut(i + 1)])) for i in range(differ + 1)]:
                blocks[k].append(w)
        for members in blocks.values():
            first = max(members, key=lambda w: order(" ".join(w)))
            for w in members:
                a, b = " ".join(w), " ".join(first)
                if a != b and sum(x == y for x, y in zip(w, first)) >= similar * n:
                    parent[a] = max(parent.get(a, b), b, key=order)

    def top(m):
        while m in parent:
            m = parent[m]
        return m

    held = collections.defaultdict(set)
    for i, own in enumerate(parsed):
        for m in own:
            held[top(m)].add(i)
    out = set()
    for i, own in enumerate(parsed):
        for at, m in enumerate(own):
            ids = [rows[j][0] for j in held[top(m)] if rows[j][0] is not None]
            least = 2 if len(m.split(" ")) > 50 else 10
            if m and len(held[top(m)]) >= least and ids and rows[i][0] != min(ids):
                out.add((i, at))
    return out


_HASH = {}


def xx(m):
    return _HASH[m]


def test_line_dedup_against_plain_python(spark):
    rng = random.Random(51)
    bases = [[letters(rng) for _ in range(n)] for n in (4, 5, 7, 12, 20, 60)]
    rows = []
    for i in range(60):
        lines = []
        for base in bases:
            if rng.random() < 0.4:
                own = list(base)
                for _ in range(rng.choice([0, 0, 1, 2])):
                    own[rng.randrange(len(own))] = rng.choice([letters(rng), "x7", "swap"])
                lines.append(rng.choice([" ", "  "]).join(own))
        lines += [prose(rng, rng.randrange(1, 9)), "", f"{i} {i}", "Page 1 of 2"]
        rng.shuffle(lines)
        rows.append((i // 2 if i % 7 else None, "\n".join(lines)))
    rows += [(3, rows[6][1]), (100, None), (101, "")]
    masks = sorted({plain_mask(x) for _, t in rows for x in (t or "").split("\n")})
    _HASH.update((r.m, r.h) for r in spark.createDataFrame([(m,) for m in masks], "m string").select("m", F.xxhash64("m").alias("h")).collect())
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], DOCS + ", k int")
    gone = plain_drops(rows)
    got = {r.k: r for r in line_dedup.dedup_lines(d).collect()}
    assert len(got) == len(rows) and len(gone) > 40
    for k, (_, t) in enumerate(rows):
        lost = {at for i, at in gone if i == k}
        assert got[k].n_dropped_lines == len(lost)
        assert got[k].text == ("\n".join(x for at, x in enumerate(t.split("\n")) if at not in lost) if lost else t)


@pytest.mark.parametrize("place", range(3, 12))
def test_a_field_at_any_place_is_found(spark, place):
    rng = random.Random(60 + place)
    base = [letters(rng) for _ in range(12)]
    rows = [(i, " ".join([*base[:place], letters(rng), *base[place + 1 :]])) for i in range(11)]
    rows += [(100 + i, " ".join([*base[:3], *(letters(rng) for _ in range(9))])) for i in range(200)]
    got = {r.doc_id: r.n_dropped_lines for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(11)] == [0] + [1] * 10 and not any(got[100 + i] for i in range(200))


def test_line_dedup_with_names_of_its_own(spark):
    line = prose(random.Random(61), 60)
    names = "_lost_id int, _lost_hash int, _lost_places int, `a.b` string, masked string, N_dropped_lines int"
    d = spark.createDataFrame([(i, line, 1, 2, 3, "x", "y", 9) for i in (1, 1, 2, 3)], f"{DOCS}, {names}")
    got = line_dedup.dedup_lines(d)
    assert got.columns == [*d.columns[:-1], "n_dropped_lines"]
    assert rows_in(got, "doc_id", "text", "n_dropped_lines", "a.b") == sorted([(1, line, 0, "x")] * 2 + [(2, "", 1, "x"), (3, "", 1, "x")], key=repr)


# The pipeline


def test_every_stage_on_awkward_tables(spark):
    sf = "/root/testdata/sf0.001"
    rng = random.Random(71)
    good = ["\n".join(prose(rng, 14) for _ in range(8)) for _ in range(6)]
    shared = prose(rng, 55)
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (3, good[1] + "\n" + shared), (4, good[2] + "\n" + shared), (None, good[3]), (None, good[3]), (5, None), (6, ""), (7, good[4] * 40)]
    names = "n_chars long, `a.b` string, row int, n_dropped_lines int, _near_id int, kept boolean, score double, `two words` string"
    docs = spark.createDataFrame([(i, t, 11, "x", 1, 2, 3, True, 0.5, "z") for i, t in rows], f"{DOCS}, {names}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert got.where("`a.b` <> 'x' or row <> 1 or n_dropped_lines <> 2 or `two words` <> 'z'").count() == 0, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    rules = corpus_pipeline.good_by_rules(spark, docs, sf)
    assert {r.doc_id for r in rules.collect()} & {5, 6} == set()
    lines = {(r.doc_id, r.text): r.n_chars for r in corpus_pipeline.without_boilerplate(spark, docs, sf).collect()}
    assert lines[3, rows[3][1]] == 11 and lines[4, good[2]] == len(good[2])
    near = corpus_pipeline.one_of_near_copies(spark, docs, sf)
    assert collections.Counter(r.doc_id for r in near.collect()) == {1: 1, 3: 1, 4: 1, None: 2, 5: 1, 7: 1}
    packed = corpus_pipeline.packed(spark, docs, sf)
    assert collections.Counter(r.doc_id for r in packed.where("piece = 0").collect()) == collections.Counter(i for i, _ in rows)
