"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

*Parse*: a line's words are masked (numbers, addresses, hexadecimal and mixed identifiers
become one variable mark) and the line descends the tree by its number of words and its
first ``DEPTH`` words; below stands its template, the whole masked line.

*Generalise*: a line that agrees with a template of its leaf in at least ``SIMILAR`` of the
words, in place, is a variant of it; the words that differ are its variable fields.  The words
are cut into one block more than may differ, so variants share a whole block: under each block
stands the template that most documents hold, all others with that block are compared with it
word by word, and each joins the most frequent one that it is a variant of.  Lines without a
constant word are their own template, words as they are, and are never generalised.

*Drop*: a template that stands in ``MIN_DOCUMENTS`` documents or more is boilerplate, and so is
one of over ``LONG`` words that stands in two.  Documents of a generalised template are counted
once, whatever number of variants they hold.  Its lines stay in the document with the smallest
doc_id and are dropped from all others.

Skew: copies of a line are combined map-side before templates are dealt to leaves; each
document counts once per template by a distinct within its own row, so no second shuffle
counts documents.  Lines meet the recurring templates in an equi-join, whose hot keys can be
split.  Only templates that share their leaf are read with their words; each is compared with
one template per block, so that the work grows with the words and never with the pairs of a leaf
or block.  What a document loses is gathered per document and so bounded by its own lines.

Defined results: null texts count as empty; lines without a word are kept and never
counted.  If all documents of a template have null ids, it is dropped from none.  Documents
that lose nothing keep their text as it is, null included.  Rows come back one for one; every
row counts as a document, repeated ids and rows included, and rows that repeat the smallest id
all keep the line.  An empty table gives no rows.  Other columns pass whatever their names, but
for the one named as the count, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, release, scratch, text_of, unused
from .components import components

DEPTH = 3
SIMILAR = 0.7
#: Documents in which a template must stand to count as recurring, and words over which two do.
MIN_DOCUMENTS = 10
LONG = 50
_SPACE = r"[\x20\x09-\x0D]+"
#: Variable fields: words with a digit, mail and web addresses; from the start of a word and
#: without backtracking.
VARIABLE = r"(?<![^\x20\x09-\x0D])(?:(?!://)[^\x20\x09-\x0D0-9@])*+(?:[0-9@]|://)[^\x20\x09-\x0D]*+"
#: Lines without any of these characters hold no variable field and no white space but spaces.
_MARKS = r"[0-9@:\x09\x0B-\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spaced(line: Column) -> Column:
    """``line`` without white space at its ends and with single spaces between words."""
    return F.when(F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")), F.trim(F.regexp_replace(line, " +", " "))).otherwise(line)


def _masked(line: Column) -> Column:
    """The line's words, variable fields masked, with single spaces between; empty without words.

    If all words are variable they stay as they are, after a line feed, which no other line holds.
    """
    masked = _let(F.regexp_replace(F.regexp_replace(line, VARIABLE, "<*>"), _SPACE, " "), lambda m: F.when(m.rlike(r"^ *<\*>[<*> ]*$"), F.concat(F.lit("\n"), F.trim(F.regexp_replace(line, _SPACE, " ")))).otherwise(m))
    return _let(F.when(line.rlike(_MARKS), masked).otherwise(line), _spaced)


def _words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, row, templates: the template of every line of a document, null for lines
    without a word; and own_*, arrays side by side of what each different line of it is."""
    text = text_of(text_col)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.transform(F.split(text, "\n"), _masked).alias("masked"))
    rows = rows.withColumn("own_line", F.array_distinct(F.filter("masked", lambda m: m != "")))
    # Lines of variable fields alone start with a line feed and stand in no leaf.
    leaf = lambda m: F.when(~F.startswith(m, F.lit("\n")), F.xxhash64(_words_in(m), F.substring_index(m, " ", DEPTH)))
    return rows.select(
        "doc_id",
        "text_hash",
        "row",
        F.transform("masked", lambda m: F.when(m != "", F.xxhash64(m))).alias("templates"),
        F.transform("own_line", lambda m: F.xxhash64(m)).alias("own_template"),
        F.transform("own_line", leaf).alias("own_leaf"),
        F.transform("own_line", lambda m: _words_in(m)).alias("own_words"),
        "own_line",
    )


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialize(parsed(docs, id_col, text_col), "lines", "zstd")  # holds the texts, masked


def _own(table: DataFrame, *fields: str) -> DataFrame:
    """A row per different line of a document: doc_id, row and some of what ``parsed`` says of it.

    The outer form, because the optimizer guards the other one by computing its input twice.
    """
    each = table.select("doc_id", "row", F.explode_outer(F.arrays_zip(*(f"own_{f}" for f in fields))).alias("own"))
    return each.where("own is not null").select("doc_id", "row", *(F.col(f"own.own_{f}").alias(f) for f in fields))


def _blocks(words: Column, leaf: Column, similar: float) -> Column:
    """Keys of which two lines of a leaf share one if at least ``similar`` of their words agree in place."""
    n = F.size(words)
    rest, differ = n - DEPTH, n - F.ceil(F.lit(similar) * n).cast("int")
    cut = lambda i: F.floor(rest * i / (differ + 1)).cast("int") + DEPTH
    block = lambda i: F.xxhash64(leaf, i, F.concat_ws(" ", F.slice(words, cut(i) + 1, cut(i + 1) - cut(i))))
    return F.when(differ >= rest, F.array(leaf)).otherwise(F.transform(F.sequence(F.lit(0), differ), block))


def _variants(shared: DataFrame, similar: float) -> DataFrame:
    """(a, root) of the templates of ``shared`` (template, leaf, n, line) that are variants of one."""
    split = shared.select("template", "n", "leaf", F.split("line", " ").alias("words"))
    blocks = split.select("template", "n", F.explode_outer(_blocks(F.col("words"), F.col("leaf"), similar)).alias("block"))
    most = F.struct("n", "template")
    first = blocks.groupBy("block").agg(F.max(most).alias("first"), F.min("template").alias("lo"), F.max("template").alias("hi")).where("lo <> hi").select("block", "first")
    pairs = blocks.join(first, "block").where(most < F.col("first")).select("template", "first").distinct()
    of = shared.select(F.col("template").alias("other"), F.col("line").alias("other_line"))
    both = materialize(pairs, "line-pairs").join(shared.select("template", "line"), "template").join(of, F.col("first.template") == F.col("other"))
    own = F.split("line", " ")
    agree = F.size(F.filter(F.zip_with(own, F.split("other_line", " "), lambda x, y: x == y), lambda same: same))
    parent = both.where(agree >= F.lit(similar) * F.size(own)).groupBy("template").agg(F.max("first").alias("first"))
    return components(parent.select(F.col("template").alias("a"), F.col("first.template").alias("b")))


def _recurring(table: DataFrame, min_documents: int, similar: float) -> DataFrame:
    lines = _own(table, "template", "leaf", "words")
    templates = materialize(lines.groupBy("leaf", "words", "template").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")), "line-templates")
    crowded = templates.where("leaf is not null").groupBy("leaf").agg(F.min("template").alias("lo"), F.max("template").alias("hi")).where("lo <> hi").select("leaf")
    shared = materialize(templates.join(crowded, "leaf").select("template", "leaf", "n"), "line-crowded")
    # Hints, so that the joins against all lines are the same at every size of the other side.
    text = _own(table, "template", "line").join(shared.select("template").hint("merge"), "template").select("template", "line").distinct()
    with_text = materialize(shared.join(text, "template"), "line-shared")
    release(table.sparkSession)  # the texts of all lines were shuffled
    root = _variants(with_text, similar)
    groups = materialize(root.select(F.col("a").alias("template"), "root").union(root.select("root", "root")).distinct(), "line-groups")
    counted = _own(table, "template").join(groups.hint("merge"), "template").select("root", "doc_id", "row").distinct()
    counted = counted.groupBy("root").agg(F.count(F.lit(1)).alias("group_n"), F.min("doc_id").alias("group_doc"))
    found = templates.join(groups.join(counted, "root"), "template", "left").select(
        "template",
        F.when(F.col("root").isNull(), F.col("first_doc")).otherwise(F.col("group_doc")).alias("keep_doc"),
        F.coalesce("group_n", "n").alias("n_documents"),
        F.when(F.col("words") > LONG, min(2, min_documents)).otherwise(min_documents).alias("least"),
    )
    return found.where((F.col("n_documents") >= F.col("least")) & F.col("keep_doc").isNotNull()).drop("least")


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, similar: float = SIMILAR) -> DataFrame:
    """template, keep_doc, n_documents of every template that recurs."""
    with scratch(docs.sparkSession) as last:
        return last(_recurring(_table(docs, id_col, text_col), min_documents, similar), "recurring")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_hash, drop: the places (from 0) of the lines that each document loses."""
    with scratch(docs.sparkSession) as last:
        table = _table(docs, id_col, text_col)
        lines = table.select("doc_id", "text_hash", F.posexplode_outer("templates").alias("at", "template")).where("template is not null")
        lost = lines.join(_recurring(table, min_documents, similar).hint("merge"), "template").where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
        return last(lost.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop")), "lost-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, similar: float = SIMILAR, count_col: str = "n_dropped_lines") -> DataFrame:
    """``docs`` with the text that is left and ``count_col``; no row is dropped.

    Columns of the input named ``count_col`` are replaced.
    """
    columns = [c for c in docs.columns if c.lower() != count_col.lower()]
    lost_id, lost_hash, drop = (unused(c, docs) for c in ("_lost_id", "_lost_hash", "_lost_places"))
    lost = dropped_lines(docs, id_col, text_col, min_documents, similar).toDF(lost_id, lost_hash, drop)
    met = docs.join(lost, named(id_col).cast("long").eqNullSafe(F.col(lost_id)) & (F.xxhash64(text_of(text_col)) == F.col(lost_hash)), "left")
    lines = F.split(text_of(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    text = _let(lines, lambda ls: F.concat_ws("\n", F.transform(left, lambda i: F.get(ls, i))))
    kept = F.when(F.col(drop).isNull(), named(text_col)).otherwise(text)
    return met.select(*(kept.alias(c) if c == text_col else named(c) for c in columns), F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).alias(count_col))
