"""Learned decision lists over document statistics. DataFrame operations only.

Rules for unwanted documents are grown one threshold at a time on statistics of labelled documents, pruned on a third of
them that growing doesn't see, and the documents that a rule covers are set aside before the next rule (sequential
covering). The result is an ordered Spark conditional expression. Each growing step is one aggregation to a table of
counts per feature and bin, the only thing that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, saved, texts

#: Quantiles per class at which thresholds are tried: steps of 1/16, finer in the tails, minimum and maximum; most rules; most
#: conditions of a rule.
STEPS = 16
TAILS = (0.0, 0.001, 0.003, 0.01, 0.02, 0.03)
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Growing a rule ends at this precision; a rule needs this one on the pruning third, and so many documents there.
FULL_PRECISION = 0.995
LEAST_PRECISION = 0.9
LEAST_SUPPORT = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more: windows are sorted by hash, equal neighbours give the
    positions, and each position adds the words that the one before it hasn't covered."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    again = lambda s: F.filter(s, lambda x, k: x["w"].eqNullSafe(F.get(s, k - 1)["w"]) | x["w"].eqNullSafe(F.get(s, k + 1)["w"]))
    places = F.sort_array(F.transform(let(F.sort_array(windows), again), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("before"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("before"), (a["n"] + F.least(F.lit(3), p - a["before"])).alias("n"))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(F.aggregate(places, start, step, lambda a: a["n"]))


def without(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, letters, ""))).cast("long")


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a struct of counts of the whole text, saved in the shared folder; a null text is empty."""
    text = F.col("text")
    words = F.array_remove(F.split(text, NOT_WORD), "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return saved(
        texts(docs, id_col, text_col).select(
            "doc_id",
            let(words, of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            without(text, r"[#*$%&|<>]").alias("n_symbols"),
            without(text, r"\p{Lu}").alias("n_upper"),
            without(text, r"[!?]").alias("n_exclaim"),
        ),
        "quality-stats",
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_exclaim")


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


#: Features of the rules, as expressions over document_stats.
FEATURES: dict[str, Column | None] = dict.fromkeys(("symbols_per_word", "symbols_per_char", "repeated_share", "dup_line_share", "mean_word_chars", "upper_share", "exclaims_per_word", "distinct_share", "words_per_line"))


def features() -> dict[str, Column]:
    parts = (("n_symbols", "n_words"), ("n_symbols", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("word_chars", "n_words"), ("n_upper", "word_chars"), ("n_exclaim", "n_words"), ("n_distinct", "n_words"), ("n_words", "n_lines"))
    return {name: share(*x) for name, x in zip(FEATURES, parts, strict=True)}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    edge: int  # place of the threshold among the feature's edges
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def bins(self, names: list[str]) -> Column:
        at = F.col("bins")[names.index(self.feature)]
        return at > self.edge if self.above else at <= self.edge


def all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Label (bad), pruning third and features of all labelled documents that the base keeps, saved.

    A document with several labels counts as unwanted if one of them says so; rows with a null label or id are left out.
    """
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of = features()
    table = stats.filter(~base_failed()).join(own, "doc_id").select((F.col("quality") == 0).alias("bad"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 2).alias("pruning"), *[c.alias(n) for n, c in of.items()])
    return saved(table, "quality-labelled")


def feature_edges(table: DataFrame) -> dict[str, list[float]]:
    """Each feature's thresholds, from both classes of these documents. One lies just below each class's minimum, so that
    "at most" can leave a class out as "above" its maximum does."""
    steps = sorted({*(i / STEPS for i in range(1, STEPS)), *TAILS, *(1 - t for t in TAILS)})
    quantiles = table.groupBy("bad").agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in FEATURES]).collect()  # two rows
    return {n: sorted({v for row in quantiles for v in (math.nextafter(row[n][0], -math.inf), *row[n])}) for n in FEATURES}


def binned(table: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Counts of (pruning third, label, bins)."""
    place = lambda n: F.size(F.filter(F.lit(edges[n]), lambda v: v < F.col(n)))
    counts = table.groupBy("pruning", "bad", F.array(*[place(n) for n in edges]).alias("bins")).agg(F.count("*").alias("n"))
    return saved(counts, "quality-bins")


def histogram(rows: DataFrame) -> dict[tuple[bool, bool], dict[int, dict[int, int]]]:
    """Counts by (pruning third, label), feature and bin: a table whose size the features and edges bound."""
    table = rows.select("pruning", "bad", "n", F.posexplode("bins").alias("f", "bin")).groupBy("pruning", "bad", "f", "bin").agg(F.sum("n").alias("n"))
    out: dict = {(p, b): {} for p in (False, True) for b in (False, True)}
    for r in table.collect():
        out[r["pruning"], r["bad"]].setdefault(r["f"], {})[r["bin"]] = r["n"]
    return out


def covered(counts: dict[int, dict[int, int]], f: int, edge: int, above: bool) -> int:
    return sum(n for b, n in counts.get(f, {}).items() if (b > edge) == above)


def total(counts: dict[int, dict[int, int]]) -> int:
    return sum(counts.get(0, {}).values())


def conditions(edges: dict[str, list[float]]) -> list[tuple[int, Condition]]:
    """All tests of one threshold, with their feature's place."""
    return [(f, Condition(name, above, edge, threshold)) for f, name in enumerate(edges) for edge, threshold in enumerate(edges[name]) for above in (True, False)]


def supported(p: int, n: int) -> bool:
    return p >= LEAST_SUPPORT and p / (p + n) >= LEAST_PRECISION


def grow(rows: DataFrame, edges: dict[str, list[float]], start: dict, barred: set[tuple[str, bool]]) -> tuple[list[Condition], list[tuple[int, int]]]:
    """A rule whose first condition isn't barred; bad and good documents of the pruning third that each prefix covers."""
    rule: list[Condition] = []
    judged: list[tuple[int, int]] = []
    now = start
    while len(rule) < MAX_CONDITIONS:
        bad, good = total(now[False, True]), total(now[False, False])
        if bad == 0 or bad / (bad + good) >= FULL_PRECISION:
            break
        best = (0.0, None)
        for f, c in conditions(edges):
            if not rule and (c.feature, c.above) in barred:
                continue
            p, n = covered(now[False, True], f, c.edge, c.above), covered(now[False, False], f, c.edge, c.above)
            if p and (gain := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > best[0] + 1e-9:
                best = (gain, c)
        if best[1] is None:
            break
        rule.append(best[1])
        now = histogram(rows.filter(all_of([c.bins(list(edges)) for c in rule])))
        judged.append((total(now[True, True]), total(now[True, False])))
    return rule, judged


def single(edges: dict[str, list[float]], start: dict) -> list[Condition]:
    """The one condition that covers most unwanted documents of those that both parts support, if there is one."""
    best = (0, None)
    for f, c in conditions(edges):
        p, n = covered(start[False, True], f, c.edge, c.above), covered(start[False, False], f, c.edge, c.above)
        if p > best[0] and supported(p, n) and supported(*(covered(start[True, b], f, c.edge, c.above) for b in (True, False))):
            best = (p, c)
    return [best[1]] if best[1] else []


def next_rule(rows: DataFrame, edges: dict[str, list[float]]) -> list[Condition]:
    """The rule grown by gain; if it is weak, a single condition, else rules that begin otherwise, else none."""
    start, barred = histogram(rows), set()
    while True:
        rule, judged = grow(rows, edges, start, barred)
        if not rule:
            return []
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in judged]
        keep = worth.index(max(worth)) + 1
        if supported(*judged[keep - 1]):
            return rule[:keep]
        if not barred and (one := single(edges, start)):
            return one
        barred.add((rule[0].feature, rule[0].above))


def learn_rules(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Ordered rules for unwanted documents; none if the labels don't support one. Each rule's thresholds come from the
    documents that no rule before it covers, so the tails of what is left show."""
    table, rules = labelled_stats(stats, labels), []
    of = {n: F.col(n) for n in FEATURES}
    while len(rules) < MAX_RULES:
        edges = feature_edges(table)
        rule = next_rule(binned(table, edges), edges) if all(edges.values()) else []
        if not rule:
            break
        rules.append(rule)
        table = table.filter(~all_of([c.column(of) for c in rule]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression: false at the first rule that holds, else true."""
    of, out = features(), None
    for rule in rules:
        test = all_of([c.column(of) for c in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    A null or empty text has no words and so fails the base. With no usable label the base alone decides. Repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.
    """
    stats = document_stats(docs, id_col, text_col)
    rules = learn_rules(stats, labels)
    failed = base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
