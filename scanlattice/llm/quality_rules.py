"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains.  A two-class latent model with a vote
distribution per rule and class is fitted by expectation-maximisation on the counts of vote
patterns (at most 3 ** len(RULES) rows reach the driver, whatever the corpus).  A document is
kept by its posterior probability of being good, not by passing every rule.

Pseudo-counts are fractions of the corpus, so the fit behaves alike at every size.

Defined results: a null or empty text has no words and every rule abstains.  Documents that
fail the base rules are not kept, whatever the posterior.  Rows come back one for one, repeated
ids and rows included, each with its own vote in the fit.  An empty table gives the prior's
model and no rows.  ``keep_good`` carries all other columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Posterior probability of good at or above which a document is kept.
KEEP = 0.5
_SPACE = r"[\x20\x09-\x0D]+"
_NO_SPACE = r"[^\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that the rules read.
MORE = ("n_chars_all", "n_upper", "n_marks", "n_lines", "n_distinct_words", "n_bars")

#: (name, votes bad if, votes good if) over the counts; neither: abstains.
RULES = (
    ("symbols", "n_symbols > 0.3 * n_words", "n_symbols <= 0.05 * n_words"),
    ("symbol_chars", "n_symbols > 0.08 * word_chars", "n_symbols <= 0.01 * word_chars"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    ("variety", "n_words >= 40 and n_distinct_words < 0.25 * n_words and n_repeat_words > 0.2 * n_words", "n_distinct_words > 0.3 * n_words"),
    ("shouting", "n_upper > 0.4 * word_chars", "n_upper <= 0.15 * word_chars"),
    ("marks", "n_marks > 0.3 * n_words", "n_marks <= 0.05 * n_words"),
    ("bars", "n_bars > 0.15 * n_words", "n_bars = 0"),
    ("lines", "n_dup_lines > 0.5 * n_lines and n_lines >= 4", "n_dup_lines = 0"),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more.

    Texts whose windows all differ by hash have none.  In the others, windows are sorted with
    their place appended; equal neighbours are the repeats.  Words hold no space, so a
    window's text is unambiguous and the comparison is exact.
    """
    n = F.size(words) - 2
    firsts = F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))
    hashes = F.transform(firsts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(firsts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))

    def places(ordered: Column) -> Column:
        keys = F.transform(ordered, lambda x: F.substr(x, F.lit(1), F.length(x) - 10))
        return _let(
            keys,
            lambda k: F.sort_array(
                F.transform(
                    F.filter(F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.get(k, s["i"] - 1).eqNullSafe(F.get(k, s["i"])) | F.get(k, s["i"] + 1).eqNullSafe(F.get(k, s["i"]))),
                    lambda s: F.right(s["x"], F.lit(9)).cast("int"),
                )
            ),
        )

    def count(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda x, i: F.concat(x, F.lit(" "), F.lpad(i.cast("string"), 9, "0"))))
        return _let(ordered, lambda o: _let(places(o), covered))

    none = F.lit(0).cast("long")
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(windows, count)).otherwise(none)
    return F.when(n > 0, _let(hashes, found)).otherwise(none)


def _counted(rows: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` and the counts of every whole text ``t``.  One narrow pass.

    The row number, which is not deterministic, keeps filters on verdicts above the counts;
    pushed below, they would repeat each count wherever a rule reads it.
    """
    rows = rows.withColumns(
        {"w": F.array_remove(F.split("t", _SPACE), ""), "l": F.filter(F.split("t", "\n"), lambda line: line.rlike(_NO_SPACE))}
    )
    without = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    return rows.select(
        *kept,
        F.monotonically_increasing_id().alias("_row"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w")).alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars_all"),
        without(r"\p{Lu}+").alias("n_upper"),
        without("[!?]+").alias("n_marks"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        without(r"\|+").alias("n_bars"),
    )


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text."""
    return _counted(docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")), F.col("doc_id"))


def votes() -> Column:
    """The rules' votes as one number in base 3: digit 0 abstains, 1 good, 2 bad."""
    out = F.lit(0)
    for k, (_, bad, good) in enumerate(RULES):
        out = out + F.when(F.col("n_words") == 0, 0).when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0) * F.lit(3**k)
    return out.cast("int")


@dataclass(frozen=True)
class Model:
    """``prior`` of good; ``table[c][k][v]``: probability of vote v of rule k in class c (1 good)."""

    prior: float
    table: tuple

    def posterior(self, pattern: int) -> float:
        weight = [1 - self.prior, self.prior]
        for k in range(len(RULES)):
            v, pattern = pattern % 3, pattern // 3
            for c in (0, 1):
                weight[c] *= self.table[c][k][v]
        return weight[1] / sum(weight)

    def accuracy(self, k: int) -> float:
        """Probability that rule ``k`` is right when it votes."""
        right = self.prior * self.table[1][k][1] + (1 - self.prior) * self.table[0][k][2]
        wrong = self.prior * self.table[1][k][2] + (1 - self.prior) * self.table[0][k][1]
        return right / (right + wrong)


#: Before any data: good documents rarely draw a bad vote; a bad one draws some.
_BEFORE = (0.85, ((0.1, 0.55, 0.35), (0.1, 0.88, 0.02)))
_WEIGHT = (0.02, 0.2)  # pseudo-counts of a class, as a fraction of the corpus


def fit(patterns: dict[int, int], rounds: int = 60) -> Model:
    """Expectation-maximisation over the counts of vote patterns."""
    prior, start = _BEFORE
    model = Model(prior, tuple(tuple(start[c] for _ in RULES) for c in (0, 1)))
    total = sum(patterns.values())
    if not total:
        return model
    for _ in range(rounds):
        good = {p: model.posterior(p) for p in patterns}
        mass = [[[_WEIGHT[c] * total * x for x in start[c]] for _ in RULES] for c in (0, 1)]
        n_good = 0.0
        for pattern, n in patterns.items():
            n_good += n * good[pattern]
            rest = pattern
            for k in range(len(RULES)):
                v, rest = rest % 3, rest // 3
                mass[1][k][v] += n * good[pattern]
                mass[0][k][v] += n * (1 - good[pattern])
        model = Model(
            (n_good + prior * 0.1 * total) / (1.1 * total), tuple(tuple(tuple(x / sum(row) for x in row) for row in mass[c]) for c in (0, 1))
        )
    return model


def fit_counts(counted: DataFrame) -> Model:
    """The model of a table of counts; only the counts of vote patterns are collected."""
    found = counted.groupBy(votes().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return fit({r.p: r.n for r in found.collect()})


def posterior(model: Model) -> Column:
    """The posterior of good from the counts, as a sum of log odds."""
    import math

    out = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (_, bad, good) in enumerate(RULES):
        odds = [math.log(model.table[1][k][v] / model.table[0][k][v]) for v in range(3)]
        out = out + F.when(F.col("n_words") == 0, odds[0]).when(F.expr(bad), odds[2]).when(F.expr(good), odds[1]).otherwise(odds[0])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(counted: DataFrame, model: Model) -> DataFrame:
    """``counted`` with base_failed, posterior and kept."""
    return counted.withColumns({"base_failed": base_failed(), "posterior": posterior(model)}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, posterior, kept: one row per row of ``docs``."""
    counted = materialize(counts(docs, id_col, text_col), "quality")
    return judge(counted, fit_counts(counted))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns and no others.

    The texts are counted twice, for the fit and for the verdicts; nothing is shuffled or
    written, where counting once would write the whole corpus.
    """
    rows = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), text_of(text_col).alias("t"))
    model = fit_counts(_counted(rows))
    return judge(_counted(rows, F.col("row")), model).where("kept and _row >= 0").select("row.*")
