"""Quality rules: a learned decision list over native text statistics.

Sequential covering grows conjunctions of threshold conditions that reject
low-quality texts, prunes each on held-back rows, and emits the list as one
ordered Spark conditional expression. Statistics, labels and verdicts stay in
DataFrame expressions; the learner sees one contingency table, whose size is
bounded by (cuts + 1) ** features, never rows of the corpus.

Defined results: a null or empty text has 0 words, so every count is 0 and it
fails the base rule. Rows are judged one by one, so repeated rows and ties
each get their own row. Labels that are null, or without a document, are not
learned from; without usable labels of both classes the list is empty and
only the base rule rejects. Extra columns pass through `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_RE, settle, text_or_empty, word_array

FEATURES = ("symbols", "dup_lines", "repeats", "upper", "distinct", "marks")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Cut points come from these quantiles of the rows labelled good and bad, and from the bad rows beyond the good ones.
GOOD_QUANTILES, BAD_QUANTILES = (0.005, 0.995), (0.25, 0.5, 0.75)
P = "__qr_"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= cut, else feature < cut
    cut: float

    def column(self) -> Column:
        c = F.col(P + self.feature)
        return c >= F.lit(self.cut) if self.above else c < F.lit(self.cut)


Rule = tuple[Condition, ...]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and feature columns, all under a private prefix."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_RE))
    one = docs.select("*", t.alias(P + "text"), word_array(t).alias(P + "words"), lines.alias(P + "lines"))
    words, n = F.col(P + "words"), F.size(P + "words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    two = one.select("*", grams.alias(P + "grams"))
    # Repeated windows: in sorted (window, position) pairs they stand beside an equal window.
    g = F.col(P + "grams")
    pairs = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.select("*", pairs.alias(P + "pairs"))
    s = F.col(P + "pairs")
    beside = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
    four = three.select("*", F.sort_array(F.transform(beside, lambda x: x["i"])).alias(P + "at"))
    # Each repeated window covers three words, less what the next one covers again.
    at = F.col(P + "at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    t, per = F.col(P + "text"), lambda c: F.when(n > 0, c / n).otherwise(0.0)
    counts = four.select(
        "*",
        n.cast("long").alias(P + "n_words"),
        F.length(F.array_join(words, "")).cast("long").alias(P + "word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias(P + "n_symbols"),
        (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long").alias(P + "n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias(P + "n_repeat_words"),
        F.size(F.array_distinct(words)).alias(P + "n_distinct"),
        F.regexp_count(t, F.lit("\\p{Lu}")).alias(P + "n_upper"),
        F.regexp_count(t, F.lit("[!?]")).alias(P + "n_marks"),
        F.size(P + "lines").alias(P + "n_lines"),
    )
    both = counts.select(
        "*",
        per(F.col(P + "n_symbols")).alias(P + "symbols"),
        F.when(F.col(P + "n_lines") > 0, F.col(P + "n_dup_lines") / F.col(P + "n_lines")).otherwise(0.0).alias(P + "dup_lines"),
        per(F.col(P + "n_repeat_words")).alias(P + "repeats"),
        F.when(F.col(P + "word_chars") > 0, F.col(P + "n_upper") / F.col(P + "word_chars")).otherwise(0.0).alias(P + "upper"),
        per(F.col(P + "n_distinct")).alias(P + "distinct"),
        per(F.col(P + "n_marks")).alias(P + "marks"),
        ((n < 50) | (F.lit(100) * F.col(P + "n_repeat_words") > F.lit(50) * n)).alias(P + "base_failed"),
    )
    # A one-row explode() holds filters on the verdict above these projections: pushed below, they would put whole
    # arrays into the lambdas that look up their elements.
    names = [*STATS, "base_failed", *FEATURES]
    held = both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(F.struct(*[F.col(P + k).alias(k) for k in names]))).alias(P + "s"))
    return held.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(P + "s")[k].alias(P + k) for k in names])


#: Up to so many labelled ids (16 MB as longs) are broadcast. The rows learned from are the same beyond.
FEW_LABELS = 2_000_000


def cut_points(rows: DataFrame) -> dict[str, list[float]]:
    """At most 12 cuts a feature: the good range and its quantiles, bad quantiles, and where bad rows lie beyond both.

    A bad kind out of the good range gets a cut there, however few of the bad rows it has.
    """
    of = lambda f, good: F.when(F.col(P + "good") == good, F.col(P + f))
    quantiles = lambda c, q: F.percentile_approx(c, F.array(*map(F.lit, q)), 1000)
    inner = rows.agg(*[F.struct(quantiles(of(f, 1), GOOD_QUANTILES).alias("good"), F.min(of(f, 1)).alias("least"), F.max(of(f, 1)).alias("most"), quantiles(of(f, 0), BAD_QUANTILES).alias("bad")).alias(f) for f in FEATURES]).first()
    outer = []
    for f in FEATURES:
        low, high = (F.lit(x).cast("double") for x in inner[f]["good"] or (None, None))
        least, most = (F.lit(inner[f][k]).cast("double") for k in ("least", "most"))
        under, over = (lambda x: F.when(of(f, 0) < x, of(f, 0))), (lambda x: F.when(of(f, 0) > x, of(f, 0)))
        outer.append(F.array(F.max(under(low)), F.percentile_approx(under(low), 0.5, 1000), F.max(under(least)), F.min(over(high)), F.percentile_approx(over(high), 0.5, 1000), F.min(over(most))).alias(f))
    beyond = rows.agg(*outer).first()
    cuts = {}
    for f in FEATURES:
        x = inner[f]
        # Between the classes rather than on either: a cut on a good row's value would reject it.
        ends = sorted({v for v in (*(x["good"] or []), x["least"], x["most"], *(x["bad"] or []), *beyond[f]) if v is not None})
        cuts[f] = [(a + b) / 2 for a, b in zip(ends, ends[1:])]
    return cuts


def contingency(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, dict[str, list[float]]]:
    """Good and bad labelled rows per cell of binned features, by grow and prune side; and the cuts.

    All labelled rows that pass the base rule count: nothing is sampled.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias(P + "id")).agg(F.min("quality").alias(P + "good"))
    every = docs.select(F.col(id_col).alias(P + "id"), "text")
    if known.count() <= FEW_LABELS:
        # Only labelled texts are read for statistics; of many labels, ids would cost a shuffle of whole texts.
        every = every.join(F.broadcast(known.select(P + "id")), P + "id", "left_semi")
    stats = with_stats(every)
    rows = stats.join(known, P + "id").where(~F.col(P + "base_failed")).select(P + "id", P + "good", *[P + f for f in FEATURES])
    rows = settle(rows, "rules")
    cuts = cut_points(rows)
    bins = [sum((F.when(F.col(P + f) >= F.lit(c), 1).otherwise(0) for c in cuts[f]), F.lit(0)).cast("tinyint").alias(f) for f in FEATURES]
    grow = F.pmod(F.crc32(F.col(P + "id").cast("string")), F.lit(3)) > 0
    one = lambda good, g: F.sum(F.when((F.col(P + "good") == good) & (grow if g else ~grow), 1).otherwise(0))
    cells = rows.select("*", *bins).groupBy(*FEATURES).agg(one(0, True).alias("gb"), one(1, True).alias("gg"), one(0, False).alias("pb"), one(1, False).alias("pg"))
    return cells, cuts


def learn(cells: pa.Table, cuts: dict[str, list[float]], min_precision: float = 0.98, max_rules: int = 24, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering (grow, then prune) over the table of cells.

    Where no prefix of a grown rule is pure enough, no further rule begins with its first condition.
    """
    if not cells.num_rows:
        return []
    binned = [cells.column(f).to_numpy() for f in FEATURES]
    gb, gg, pb, pg = (cells.column(k).to_numpy().astype(float) for k in ("gb", "gg", "pb", "pg"))
    left, rules, barred = np.ones(len(gb), bool), [], set()
    while len(rules) < max_rules and gb[left].sum() > 0:
        held, rule, masks = left.copy(), [], []
        while len(rule) < max_conditions and gg[held].sum() > 0:
            p0, n0 = gb[held].sum(), gg[held].sum()
            best = (0.0, None)
            for j, f in enumerate(FEATURES):
                below = [np.cumsum(np.bincount(binned[j][held], w[held], len(cuts[f]) + 1)) for w in (gb, gg)]
                for k in range(len(cuts[f])):
                    for above in (True, False):
                        p, n = (p0 - below[0][k], n0 - below[1][k]) if above else (below[0][k], below[1][k])
                        if p > 0 and (rule or (j, k, above) not in barred) and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0] + 1e-12:
                            best = (gain, (j, k, above))
            if best[1] is None:
                break
            j, k, above = best[1]
            rule.append(best[1])
            masks.append((binned[j] > k) == above)
            held &= masks[-1]
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            m = left & np.logical_and.reduce(masks[:k])
            p, n = pb[m].sum(), pg[m].sum()
            bad, good = gb[m].sum() + p, gg[m].sum() + n
            if bad >= 2 and bad >= min_precision * (bad + good):
                worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if not worth:
            barred.add(rule[0])
            continue
        k = -max(worth)[1]
        rules.append(tuple(Condition(FEATURES[j], above, cuts[FEATURES[j]][c]) for j, c, above in rule[:k]))
        left &= ~np.logical_and.reduce(masks[:k])
    return rules


def fit(docs: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    cells, cuts = contingency(docs, labels)
    return learn(cells.toArrow(), cuts, **options)  # at most (cuts + 1) ** features rows, whatever the corpus


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one expression: the first rule that holds rejects."""
    out = F.when(F.col(P + "base_failed"), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for cond in rule[1:]:
            test = test & cond.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept."""
    stats = with_stats(docs.select("doc_id", "text"))
    return stats.select("doc_id", *[F.col(P + k).alias(k) for k in (*STATS, "base_failed")], verdict(rules).alias("kept"))


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the list keeps, with their own columns."""
    return with_stats(docs).where(verdict(rules)).select(*[F.col(f"`{c}`") for c in docs.columns])
