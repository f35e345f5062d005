"""Learned decision lists over text statistics, as Spark conditional expressions.

Statistics come from DataFrame functions alone. The list is learned by sequential covering from labelled rows:
a rule is grown on two thirds of them by adding the threshold that gains most, cut back on the other third, and
kept if it is precise there; the rows that it covers go, and the next rule is learned from the rest.

At most SAMPLE labels, those with the smallest hashes, and all rows with their ids are used for learning; the driver gets
counts by cells of thresholds alone. Null texts have no words. Null labels and labels without a document take no part;
without labels there are no rules and all rows that pass the base are kept. Repeated rows are judged each. Of rules that
gain alike the one that covers more goes first, then the later statistic. A text of any length is one array of words. An
empty table gives no rows. Further columns are kept; those of docs that are named like a result (STATISTICS,
base_failed, kept) are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
CUTS = 24
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def covered(starts: Column) -> Column:
    """How many places the windows of three at the given sorted places cover."""
    return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))


def repeated_words(words: Column, n: Column) -> Column:
    """Words in windows of three words that occur twice or more.

    If the windows' hashes are all different, no window repeats. Otherwise they are sorted with their places, and
    neighbours with equal hashes are compared by their words.
    """
    code = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    word = lambda x, k: F.get(words, x["i"] + k)
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))
    near = lambda s, x, i: same(F.get(s, i + 1), x) | same(F.get(s, i - 1), x)
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: near(s, x, i)), lambda x: x["i"]))
    placed = lambda c: F.sort_array(F.transform(c, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = let(F.transform(F.sequence(F.lit(0), n - 3), code), lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), F.lit(0).cast("long")).otherwise(let(placed(c), lambda s: covered(places(s)))))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    row = lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words, F.size(words)).alias("n_repeat_words"),
    )
    # generated, so that filters and later columns read the results and don't repeat the work
    found = docs.drop(*STATISTICS, "base_failed").select("*", F.inline(F.array(let(words_of(text), row))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, from the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """feature >= cut, or < cut where at_least is false, for all conditions."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.expr(FEATURES[f]) >= c if up else F.expr(FEATURES[f]) < c for f, up, c in self.conditions])


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; rules are tried in order."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, most_rules: int = 8, precision: float = 0.97) -> list[Rule]:
    """Rules that reject rows of quality 0."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).where("not base_failed")
    rows = rows.select(*[F.expr(e).alias(f) for f, e in FEATURES.items()], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) > 0).alias("grow")).cache()
    names = [*FEATURES]
    steps = [(i + 0.5) / CUTS for i in range(CUTS)] + [0.99, 0.995, 0.998]
    cuts = {f: sorted({*q}) for f, q in zip(names, rows.approxQuantile(names, steps, 0.001), strict=True)}
    lows = rows.where("bad").approxQuantile(names, [0.001, 0.01, 0.05, 0.25, 0.5], 0.001)
    cuts = {f: sorted({*c, *q}) for (f, c), q in zip(cuts.items(), lows, strict=True)}
    bins = [reduce(lambda a, b: a + b, [(F.col(f) >= c).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in names]
    cells = rows.select(*bins, "bad", "grow").groupBy(*names, "bad", "grow").count().collect()
    rows.unpersist()
    if not cells:
        return []
    at = np.array([[r[f] for f in names] for r in cells])
    bad, grow, count = (np.array([r[c] for r in cells]) for c in ("bad", "grow", "count"))
    return cover(at, bad.astype(bool), grow.astype(bool), count, names, cuts, most_rules, precision)


def cover(at: np.ndarray, bad: np.ndarray, grow: np.ndarray, count: np.ndarray, names: list[str], cuts: dict[str, list[float]], most_rules: int, precision: float) -> list[Rule]:
    """Sequential covering over cells: at holds each cell's bin for each feature."""
    left, rules = np.ones(len(count), bool), []
    test = lambda f, up, k: at[:, f] >= k if up else at[:, f] < k
    weigh = lambda m: (int(count[m & bad].sum()), int(count[m & ~bad].sum()))
    while len(rules) < most_rules:
        here, conditions = left & grow, []
        while True:
            p0, n0 = weigh(here)
            if not p0 or not n0:
                break
            options = []
            for f, name in enumerate(names):
                for k in range(1, len(cuts[name]) + 1):
                    for up in (True, False):
                        p, n = weigh(here & test(f, up, k))
                        if p:
                            options.append((p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), p, f, up, k))
            gain, _, f, up, k = max(options, default=(0, 0, 0, True, 1))
            if gain <= 1e-9 or len(conditions) == 4:
                break
            conditions.append((f, up, k))
            here = here & test(f, up, k)

        def share(some: list) -> tuple[float, int]:
            p, n = weigh(reduce(lambda a, c: a & test(*c), some, left & ~grow))
            return (p / (p + n) if p + n else 0.0, p)

        if not conditions:
            break
        best = max(range(1, len(conditions) + 1), key=lambda i: (round(share(conditions[:i])[0], 3), share(conditions[:i])[1], -i))
        conditions = conditions[:best]
        good, p = share(conditions)
        if good < precision or p < 5:
            break
        rules.append(Rule(tuple((names[f], up, cuts[names[f]][k - 1]) for f, up, k in conditions)))
        left &= ~reduce(lambda a, c: a & test(*c), conditions, left)
    return rules


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(learn(docs, labels)))
