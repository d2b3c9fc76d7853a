"""The training-data operators against brute force on small tables."""

import collections
import fnmatch
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scanlattice.llm import bpe, classifier, exact_dedup, license_scan, line_dedup, packing, quality_rules, simhash, toxicity, url_filter
from scanlattice.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the of and scan beam frame lattice phase vector détecteur größe niño position image".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "s", "ing", str(rng.randrange(9))]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    out += [out[0], out[0].upper(), out[1] + "\n" + out[2] + "\n" + out[2], None, "", "", " \n\t ", "É É É " * 30, "word", "a\x0bb\x0cc", prose(rng, 6000)]
    near = prose(rng, 400).split()
    for i in range(8):
        own = list(near)
        own[i * 7] = f"edit{i}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # An extra column with the name of an output, and one with a dot.
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, fingerprint string, `a.b` double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_url_automaton_against_plain_matching():
    rng = random.Random(3)
    hosts = ["example.com", "a.example.com", "xexample.com", "casino-x.net", "EXAMPLE.net", "com", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/de/8?x=/en/', '/a/login', '#/en/', '?/en/'])}" for _ in range(300)] + [None, "", "no scheme/en/", "x://y://z/en/", "http://é.com/en/é"]
    own = url_filter.UrlFilter()
    got = own.judge(urls)
    for url, host, path, rule, verdict in zip(urls, got.host, got.path, got.rule, got.verdict):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h = re.match(r"[^/?#]*", rest)[0].translate(UP)
        p = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        assert (host, path) == (h, p)
        fits = [(len(r), v, r) for v, r in url_filter.RULES if ("." + h).endswith("." + r.split("/", 1)[0]) and p.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=None)
        assert rule == (best[2] if best else None)
        if best:
            assert verdict == best[1]


def test_url_globs_cross_words():
    patterns = ["a" * 70 + "*b", "*" + "x?y" * 30, "ab*", "*"]
    own = url_filter.WildcardAutomaton.build([url_filter._tokens(p, "/", True) for p in patterns])
    hosts = ["a" * 70 + "zb", "xzy" * 30, "abc", "q", "a" * 69 + "b"]
    got = own.match([b"." + h.encode() + b"\xff/" for h in hosts])
    for h, row in zip(hosts, got):
        labels = ["." + h]
        assert list(row) == [any(fnmatch.fnmatchcase(x, "*." + p) for x in labels) for p in patterns]


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    got = by_id(exact_dedup.exact_dedup(docs))
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[(t or "").translate(UP)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), i == max(own))
        assert r.text_sha256 == hashlib.sha256((t or "").translate(UP).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(UP))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("codes,block", [(1, simhash.BLOCK), (2, simhash.BLOCK), (1, 2)])
def test_simhash_against_all_pairs(docs, rows, codes, block):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(simhash.near_duplicates(docs, codes=codes, block=block))
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in fps}
    assert len({find(i) for i in fps}) < len(fps)


@pytest.mark.parametrize("codes", [1, 2])
def test_anchors_cover_every_link(codes):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    ra, ca, home = simhash.replicas(a, codes)
    rb, cb, _ = simhash.replicas(b, codes)
    at = {int(r): int(c) for r, c, h in zip(ra, ca, home) if h}
    near = collections.defaultdict(set)
    for r, c in zip(rb, cb):
        near[int(r)].add(int(c))
    assert len(at) == 60 and all(at[i] in near[i] for i in range(60))


def test_simhash_keeps_one(spark, empty):
    long = prose(random.Random(9), 200)
    d = spark.createDataFrame([(5, long, "k"), (5, long, "k"), (2, long + "", "k"), (7, None, "k"), (None, "alone here", "k"), (9, "", "k")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(d).collect()) == [0, 2, 7]
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_pipeline_stage_finds_every_near_copy(spark):
    import corpus_pipeline

    rng = random.Random(31)
    made = []
    for n in (60, 90, 150, 400):
        base = [f"{rng.choice(WORDS)}{rng.randrange(300)}" for _ in range(n)]
        for edits in range(0, n // 25 + 3):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = f"edit{rng.randrange(10**6)}"
            made.append(" ".join(own))
    made += ["", None, "two words", "Two Words", "other"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").translate(UP))) else set() for t in made]
    root = list(range(len(made)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                close += bin(plain_fingerprint(made[i]) ^ plain_fingerprint(made[j])).count("1") > 3
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert close
    d = spark.createDataFrame([*enumerate(made), (None, made[0])], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.one_of_near_copies(spark, d, "")
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, *sorted({find(i) for i in range(len(made))})]
    assert corpus_pipeline.one_of_near_copies(spark, d.where("false"), "").count() == 0


def test_pipeline_stage_takes_fingerprints_through_the_anchors(spark, monkeypatch):
    import corpus_pipeline
    from scanlattice.llm import near_copies

    rng = random.Random(37)
    base = prose(rng, 400).split()
    made = [" ".join(base), " ".join([*base[:200], "edit", *base[201:]]), " ".join([*base, "end"]), prose(rng, 300), "", "two words"]
    prints = [plain_fingerprint(t) for t in made]
    assert any(a != b and bin(a ^ b).count("1") <= 3 for a in prints[:3] for b in prints[:3])
    d = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    seen, given = [], []
    by_anchor, linked = simhash.links, near_copies._linked
    monkeypatch.setattr(near_copies, "links", lambda fps: seen.extend(r.fp % 2**64 for r in fps.collect()) or by_anchor(fps), raising=False)
    monkeypatch.setattr(near_copies, "_linked", lambda members, *rest: (len(rest) > 1 and given.extend(map(tuple, rest[0].collect()))) or linked(members, *rest))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, d, "").collect()) == [0, 3, 4, 5]
    assert sorted(seen) == sorted(set(prints))
    # What the fingerprints link has passed the check before any shared shingle is looked at.
    nodes = {xxhash.xxh64_intdigest(near_copies.shingle_set(t).tobytes(), 42) for t in made[:3]}
    assert given and {node % 2**64 for pair in given for node in pair} <= nodes


def test_simhash_links_through_null_ids(spark):
    # The text without an id has the least fingerprint of a chain; the two others link to it.
    rng = random.Random(21)
    base = prose(rng, 400).split()
    made = [" ".join(base)]
    for i in range(60):
        own = list(base)
        own[i * 6] = f"edit{i}"
        made.append(" ".join(own))
    fps = {t: plain_fingerprint(t) for t in made}
    signed = lambda x: x - 2**64 if x >> 63 else x
    links = lambda t: [u for u in made if fps[u] != fps[t] and bin(fps[u] ^ fps[t]).count("1") <= 3]
    least, others = next((t, o) for t in made if len(o := [u for u in links(t) if signed(fps[u]) > signed(fps[t]) and fps[u] > fps[t]]) >= 2 and len({fps[u] for u in o}) >= 2)
    first = others[0]
    second = next(u for u in others if fps[u] != fps[first])
    d = spark.createDataFrame([(None, least), (1, first), (2, second)], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(d).collect()] == [1, 1, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.a: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def plain_counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + j for own in windows.values() if len(own) > 1 for i in own for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, empty):
    got = by_id(quality_rules.quality(docs))
    for i, t in rows:
        r = got[i]
        n = plain_counts(t)
        assert tuple(r[c] for c in quality_rules.COUNTS) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_weak_supervision_tells_rules_apart():
    one, bad = sum(3**k for k in range(8)), 2 + 2 * 3
    model = quality_rules.fit({one: 900, one + bad - 4: 100})
    assert model.posterior(one) > 0.9 > 0.5 > model.posterior(one + bad - 4)
    assert all(0.5 < model.accuracy(k) <= 1 for k in range(8))
    assert quality_rules.fit({}).prior == 0.85


def test_license_scan(spark, empty):
    ts = ["All rights reserved. ALL RIGHTS RESERVED", "cc by cc-by, licensed under CC BY-NC 4.0", "GNU General Public License, version 3.", "generalpublic license", None, "", "über all rights reservedß", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "no licence here " * 50 + "cc by"]
    word, phrases = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")))
    for i, t in enumerate(ts):
        w = word.findall((t or "").translate(UP))
        at = sorted((k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[7].labels == "apache-2.0" and got[8].labels == "mit" and got[1].labels == "cc-by,cc-by-nc"
    assert license_scan.scan(empty).count() == 0


def test_license_scan_without_a_word_that_no_document_holds(spark):
    ts = ["Permission is hereby granted, free of charge, to any person receiving a copy", "free of charge to any person obtaining a copy"]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(ts[:1])), "doc_id long, text string")))
    assert got[0].labels == "mit" and abs(got[0].score - 12 / 13) < 1e-9
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")))
    assert (got[0].labels, got[1].labels) == ("mit", "")


FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    got = packing.pack(docs, FILE).collect()
    pieces, room = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        room[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in room.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 1024
    assert packing.pack(empty, FILE).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    lengths = sorted((rng.choice([rng.randrange(1, 1025), rng.randrange(1, 200)]) for _ in range(3000)), reverse=True)
    gaps = []
    for n in lengths:
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(1024 - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    plan = packing.plan(collections.Counter(lengths))
    used = collections.Counter()
    for n, rounds in plan.items():
        for p in rounds:
            for k in range(p.count):
                used[p.sequence + k] += n
    assert len(used) == len(gaps) and max(used.values()) <= 1024 and sum(used.values()) == sum(lengths)


def test_tokenizer_file_as_ranks():
    tok = packing.tokenizer(FILE)
    assert tok.ranks is not None
    for t in [*filter(None, texts(7)), "a  b \n\n c", "it's <|endoftext|> x", "𝔘 ٣ é\u00a0x  ", "x" * 3000, "  lead", "trail  "]:
        assert tok.encode(t) == list(tok.library.encode(t, add_special_tokens=False).ids)


def test_bpe_round_trip(docs, rows):
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(file, pattern)
    assert isinstance(enc, tiktoken.Encoding)
    got = by_id(bpe.digest_documents(docs, file, pattern))
    ids = by_id(bpe.encode_documents(docs, file, pattern))
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs, file, pattern), file, pattern))
    for i, t in rows:
        whole = enc.encode_ordinary(t or "")
        assert ids[i].ids == whole and bytes(back[i].decoded) == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(whole), hashlib.sha256(",".join(map(str, whole)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_pieces_change_nothing():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    t = "it's  a b\n c\t d 1 2.x é ñ " * 500
    for size in (1, 7, 100, 5000):
        assert [i for p in bpe.pieces(t, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randrange(40, 90)).split()
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "grubface", "nastyling"]))
        rows.append((i, " ".join(w + "%%" if bad else w for w in words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, empty):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    for found, name, folds, rest in (
        (classifier.classify(docs, classifier.fit(docs, labels)), "quality", 5, 0),
        (toxicity.classify(docs, toxicity.fit(docs, labels)), "toxic", 3, 1),
    ):
        got = by_id(found)
        assert len(got) == 1201 and all(0 <= r.score <= 1 for r in got.values())
        held = [i for i in got if i is not None and zlib.crc32(str(i).encode()) % folds == rest]
        assert {i for i in got if i is not None and got[i].held_out} == set(held)
        assert np.mean([got[i].predicted == truth[i][name] for i in held]) > 0.93
    assert toxicity.passages(docs, toxicity.fit(docs, labels)).count() > 100
    assert classifier.classify(empty, classifier.fit(empty, labels)).count() == 0
    assert toxicity.classify(docs, toxicity.fit(empty, labels)).count() == 1201


def test_sum_of_squares_identity():
    model = classifier.FactorisationMachine.empty()
    rng = np.random.default_rng(0)
    model.w, model.v = rng.normal(size=model.w.shape), rng.normal(size=model.v.shape)
    index, value, begin = model.rows([classifier.features("some words, and more words!"), classifier.features("")])
    got, _, _ = model.raw(index, value, begin)
    for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(index)])):
        i, x = index[a:b], value[a:b]
        pairs = sum(model.v[i[p]] @ model.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert np.isclose(got[k], model.w[i] @ x + pairs, rtol=1e-4)


def test_maximal_segments_against_recursion():
    def plain(scores, lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*plain(scores, lo, i), (i, j - 1, best[0]), *plain(scores, j, hi)]

    rng = random.Random(6)
    for _ in range(60):
        scores = [rng.choice([-0.3] * 4 + [rng.random()]) for _ in range(14)]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(hits, 0.3)
        expected = plain(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]


def test_line_dedup(spark, empty):
    rng = random.Random(11)
    rows = []
    for i in range(14):
        lines = [prose(rng, 12), f"Page {i} of 99, printed {2000 + i}", "  shared   footer line here ", prose(rng, 9), ""]
        rows.append((i, "\n".join(lines), "x"))
    rows += [(20, None, "x"), (21, "", "x"), (22, "only\nhere", "x"), (None, "  shared   footer line here ", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_dropped_lines string")
    got = line_dedup.dedup_lines(d).collect()
    assert len(got) == len(rows)
    for r in got:
        before = dict((i, t) for i, t, _ in rows)[r.doc_id]
        if r.doc_id is None:
            assert r.text == "" and r.n_dropped_lines == 1
        elif 0 < r.doc_id < 14:
            lines = before.split("\n")
            assert r.text == "\n".join([lines[0], lines[3], ""]) and r.n_dropped_lines == 2
        else:
            assert r.text == before and r.n_dropped_lines == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_templates_generalise(spark):
    rows = [(i, f"Contact the night shift supervisor named {n} about broken beam shutters today") for i, n in enumerate("ann bob cyd dee eva fay gus hal ida jon kim".split())]
    rows += [(100 + i, f"Contact the night shift {prose(random.Random(i), 8)}") for i in range(11)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0].n_dropped_lines == 0 and all(got[i].n_dropped_lines == 1 for i in range(1, 11))
    assert all(got[100 + i].n_dropped_lines == 0 for i in range(11))


def test_long_lines_recur_from_two_documents(spark):
    long, short = prose(random.Random(41), 60), prose(random.Random(42), 40)
    rows = [(i, f"{long}\n{short}\nown line of {w}") for i, w in enumerate(["ann", "bob"])]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[0].n_dropped_lines, got[1].n_dropped_lines) == (0, 1)
    assert got[1].text == f"{short}\nown line of bob"


def letters(rng, n=6):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_line_templates_are_compared_by_word(spark):
    # Three of thirty words vary, each in an eighth of its own.
    rng = random.Random(43)
    base = [letters(rng) for _ in range(30)]
    rows = []
    for i in range(12):
        own = list(base)
        for at in (9, 17, 25):
            own[at] = letters(rng)
        rows.append((i, " ".join(own)))
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_dropped_lines for i in range(12)] == [0] + [1] * 11


def test_line_variants_meet_among_other_templates(spark):
    # Variants differ in the fourth eighth, and many unrelated templates share their leaf.
    rng = random.Random(44)
    base = [letters(rng) for _ in range(16)]
    rows = [(i, " ".join(base[:6] + [letters(rng), letters(rng)] + base[8:])) for i in range(12)]
    rows += [(100 + i, " ".join(base[:3] + [letters(rng) for _ in range(13)])) for i in range(200)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_dropped_lines for i in range(12)] == [0] + [1] * 11
    assert all(got[100 + i].n_dropped_lines == 0 for i in range(200))


def test_line_groups_count_documents(spark):
    line = "Contact the night shift supervisor named {} about broken beam shutters today"
    names = "ann bob cyd dee eva fay gus hal ida jon".split()
    rows = [(i, "\n".join(line.format(n) for n in names[5 * i : 5 * i + 5])) for i in range(2)]
    rows += [(10 + i, f"{i} {i + 1} {i * 7}") for i in range(12)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(r.n_dropped_lines == 0 for r in got.values())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
    assert 0 < got.select("doc_id").distinct().count() < 200
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where(F.lit(False)), sf).columns == docs.columns, name
