"""License scan by a positional rare-token index, in DataFrame functions only.

*IDF*: a first pass counts, over all documents, in how many each license word occurs.

*Postings*: a key phrase must stand in full, so each file that a template fits holds all its
words.  The template is posted under the two of them with the highest inverse document
frequency, each with its place in the template: the words by which such a file looks it up,
rarest first.  No place is lost by that, so the counts decide the cost and never a label.

*Lookup*: every license word of a file proposes (template, start) from the postings of the
rarest words, then from those of the second; only what both propose, by relative position,
is a candidate.  The cost of a file grows with its license words, not with the templates.

*Verify*: the key phrase must stand in full, and the share of the template's words found in
place must reach the template's least.  Only documents that hold a rarest word at all build
a list of words.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.

Defined results: a null or empty text has no words.  Without a place, first_word and last_word
are null, labels are empty strings and the score is 0.  Rows come back one for one, repeated
ids and rows included; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, named, text_of
from .license_texts import SENTENCES

#: A word, in text whose A-Z still stand.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, lower_ascii(text)))


@dataclass(frozen=True)
class Template:
    """``key``: the phrase that must stand in full; ``least``: share of the words in place."""

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    least: float = 0.8

    @classmethod
    def of(cls, label: str, text: str, key: str, least: float = 0.8) -> Template:
        return cls(label, words_of(text), words_of(key), least)

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)

    @property
    def places(self) -> list[int]:
        """Places of the key phrase's words that the template can be posted under."""
        at = self.key_at
        own = [i for i in range(at, at + len(self.key)) if self.words[i] not in STOP and not self.words[i].isdigit()]
        return own or [at]


#: Words too common in any prose to look up.
STOP = frozenset("a all and any are at be by can for in into is it may not of on one or the this to under use used version was with without you".split())
#: Short notices as their words, then the sentences of whole ones.
TEMPLATES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "under the apache"),
    Template.of("mit", "released under the mit license", "mit license", 0.6),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    Template.of("gpl-3.0", "gnu general public license version 3", "general public license version 3", 0.9),
    Template.of("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", 0.5),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.5),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template.of("mpl-2.0", "mozilla public license version 2 0", "mozilla public license", 0.6),
    Template.of("public-domain", "released into the public domain", "public domain", 0.8),
    *(Template.of(label, sentence, key) for label, key, sentence in SENTENCES),
)


def candidates(templates) -> list[str]:
    """The words that templates can be posted under."""
    return sorted({t.words[i] for t in templates for i in t.places})


def _any_of(words: list[str]) -> str:
    return f"(?i)(?<!{_IN_WORD})(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})(?!{_IN_WORD})"


def document_frequency(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each of ``words`` stands, and the number of documents.

    At most a row per word reaches the driver.
    """
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.transform(F.regexp_extract_all(text_of(text_col), F.lit(_any_of(words)), F.lit(0)), F.lower)))).alias("w"))
    n = {r.w: r.n for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n, n.pop("", 0)


def postings(templates, n: dict[str, int], documents: int) -> tuple[dict[str, list[tuple[int, int]]], ...]:
    """(word -> (template, place)) of the templates' rarest words, and of their second rarest."""
    idf = lambda w: math.log((1 + documents) / (1 + n.get(w, 0)))
    out: tuple[dict[str, list[tuple[int, int]]], ...] = ({}, {})
    for k, t in enumerate(templates):
        rarest = sorted(t.places, key=lambda i: (-idf(t.words[i]), i))
        for own, place in zip(out, (rarest[0], rarest[min(1, len(rarest) - 1)])):
            own.setdefault(t.words[place], []).append((k, place))
    return out


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ints(**values: int) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))


def _proposed(hits: Column, posted: dict[str, list[tuple[int, int]]]) -> Column:
    """(template, start) of every posting of every hit, of which none is repeated."""
    table = F.create_map(*(x for w, own in sorted(posted.items()) for x in (F.lit(w), F.array(*(_ints(t=t, at=at) for t, at in own)))))
    looked_up = F.transform(hits, lambda h: F.transform(F.coalesce(F.try_element_at(table, h["w"]), F.array().cast("array<struct<t:int,at:int>>")), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start"))))
    return F.array_distinct(F.flatten(looked_up))


def _places(words: Column, found: Column, templates) -> Column:
    """(t, label, start, words, share) of the candidates ``found`` that hold."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*(F.struct(F.lit(t.label).alias("label"), strings(t.words).alias("words"), strings(t.key).alias("key"), F.lit(t.key_at).alias("key_at"), F.lit(float(t.least)).alias("least")) for t in templates))
    stands = lambda own, start: F.transform(own, lambda x, i: F.get(words, start + i).eqNullSafe(x))

    def measured(c: Column) -> Column:
        def of(t: Column) -> Column:
            whole = F.forall(stands(t["key"], c["start"] + t["key_at"]), lambda same: same)
            share = F.size(F.filter(stands(t["words"], c["start"]), lambda same: same)) / F.size(t["words"]).cast("double")
            return F.struct(c["t"].alias("t"), t["label"].alias("label"), c["start"].cast("long").alias("start"), F.size(t["words"]).alias("words"), F.when(whole & (share >= t["least"]), share).alias("share"))

        return _let(F.get(table, c["t"]), of)

    return F.filter(F.transform(found, measured), lambda x: x["share"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans``: (label, start, words, share) of every place, base phrases included.
    """
    every = [Template.of(label, p, p, 1.0) for label, p in base] + list(templates)
    n, documents = document_frequency(docs, candidates(every), text_col)
    first, second = postings(every, n, documents)
    entries = sorted(first)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    rows = rows.withColumn("all", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    rows = rows.select(
        "doc_id",
        F.size("all").cast("long").alias("n_words"),
        F.when(F.col("t").rlike(_any_of(entries)), F.transform("all", lambda w: F.translate(w, UPPER, LOWER))).alias("w"),
    )
    looked_up = sorted({*first, *second})
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(looked_up))
    found = _let(hits, lambda h: F.array_intersect(_proposed(h, first), _proposed(h, second)))
    rows = rows.select("doc_id", "n_words", "w", found.alias("found"))
    none = F.array().cast("array<struct<t:int,label:string,start:bigint,words:int,share:double>>")
    rows = rows.select("doc_id", "n_words", F.coalesce(F.when(F.size("found") > 0, _places(F.col("w"), F.col("found"), every)), none).alias("places"))
    own = F.transform(F.filter("places", lambda x: x["t"] < len(base)), lambda x: F.struct(x["label"], x["start"]))
    rows = rows.withColumn("base", own)
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))))
    starts = F.transform("base", lambda x: x["start"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda x: F.struct(x["label"], x["start"], x["words"], x["share"])).alias("spans"),
    )
