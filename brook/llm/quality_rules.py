"""Quality rules: a decision list learned from labelled text statistics, emitted as an ordered Spark conditional.

The statistics are DataFrame expressions over one row each (no shuffle, no Python on the executors).
Sequential covering on the driver sees at most ``sample`` labelled rows of a dozen numbers, outside the
held-out third.  For each next rule it grows, for either class, a conjunction of thresholds by FOIL gain
on two thirds of the rows that no rule has covered, prunes it on the rest, and takes the one of better
worth; the rows that it covers leave.  So a rule is only good behind those before it, and later ones may
keep what an earlier rule of the other class would have rejected.  What no rule covers is kept, unless the
rows left are bad by the same measure as a rule must be.  The list becomes ``CASE WHEN rule 1 THEN .. WHEN rule 2 THEN .. ELSE ..``.

Null text: no words, so the base rule fails it.  Without labels of both kinds the list is empty and
only the base rule decides.  Repeated rows get equal results; null ids are allowed; other columns of
the input are not looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"

#: Inputs of the rules, all made of the statistics of a row.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "distinct_share", "words_a_line"]


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


class Rule(NamedTuple):
    conditions: list[Condition]
    good: bool


class DecisionList(NamedTuple):
    rules: list[Rule]
    otherwise: bool = True


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_long: bool = True) -> DataFrame:
    """doc_id, the counts of the contract and the inputs of the rules, one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(F.col("t"), F.lit(WS))
    own = F.col(id_col).cast("long") if as_long else F.col(id_col)
    df = docs.select(own.alias("doc_id"), text.alias("t"))
    df = df.select("*", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT)).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("lines"))
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select("*", F.when(F.size("w") >= 3, three).otherwise(F.array().cast("array<bigint>")).alias("grams"))
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.when(some, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select("doc_id", "t", "w", "lines", placed.alias("s"))
    at = lambda j: F.get("s", j)["h"]
    again = F.filter(F.transform("s", lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False))).alias("r"))), lambda x: x["r"])
    df = df.select("doc_id", "t", "w", "lines", F.array_sort(F.transform(again, lambda x: x["i"])).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(F.lit(3), b - a))
    count = lambda pattern: F.char_length("t") - F.char_length(F.regexp_replace("t", pattern, ""))
    df = df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("p") > 0, F.aggregate(steps, F.lit(3), lambda a, x: a + x)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.char_length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("n_upper"),
        count(r"[!?]+").alias("n_bangs"),
        count(r"[0-9]+").alias("n_digits"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbol_share"), (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("n_upper") / chars).alias("upper_share"), (F.col("n_bangs") / words).alias("bang_share"),
        (F.col("n_digits") / chars).alias("digit_share"), (F.col("n_distinct") / words).alias("distinct_share"), (F.col("n_words") / lines).alias("words_a_line"),
    )


# ---------------------------------------------------------------- learning


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), dtype=bool)
    for c in rule:
        v = x[:, FEATURES.index(c.feature)]
        inside &= v > c.threshold if c.above else v <= c.threshold
    return inside


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most FOIL gain among rows that a rule covers so far."""
    best, found = 1e-9, None
    prior = np.log2(max(y.mean(), 1e-12))
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        v, hit = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        for above in (False, True):
            p = hit[-1] - hit[cut] if above else hit[cut]
            n = len(v) - cut - 1 if above else cut + 1
            gain = p * (np.log2(np.maximum(p, 1e-12) / n) - prior)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < most and y[inside].any() and not y[inside].all():
        _, c = _best_condition(x[inside], y[inside])
        if c is None:
            break
        rule.append(c)
        inside &= _covers([c], x)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> float:
    """How much more often a rule is right than wrong, small coverage discounted."""
    c = _covers(rule, x)
    return (2 * int(y[c].sum()) - int(c.sum()) - 1) / (int(c.sum()) + 1)


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> list[Condition]:
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x, y))


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Sequential covering of both classes (x: one column for each of FEATURES).  A rule must be right in ``precision`` of
    what it covers, in the rows that it was grown on and in the others."""
    bad = bad.astype(bool)
    if len(np.unique(bad)) < 2:
        return DecisionList([])
    rules: list[Rule] = []
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)

    def next_rule(y: np.ndarray) -> tuple[float, list[Condition]]:
        grow, prune = left & ~held, left & held
        rule = _grow(x[grow], y[grow], most_conditions)
        if not rule:
            return -1.0, []
        rule = _prune(rule, x[prune], y[prune])
        inside = _covers(rule, x) & left
        right = [y[part].mean() for part in (inside, inside & held) if part.any()]
        return (-1.0, []) if y[inside].sum() < least or min(right) < precision else (_worth(rule, x[prune], y[prune]), rule)

    while len(rules) < most_rules and len(np.unique(bad[left])) == 2:
        (w_bad, of_bad), (w_good, of_good) = next_rule(bad), next_rule(~bad)
        if not of_bad and not of_good:
            break
        rule = Rule(of_bad, False) if of_bad and (w_bad >= w_good or not of_good) else Rule(of_good, True)
        rules.append(rule)
        left &= ~_covers(rule.conditions, x)
    return DecisionList(rules, not (bad[left].sum() >= least and bad[left].mean() >= precision))


def decide(found: DecisionList, x: np.ndarray) -> np.ndarray:
    """Which rows are good, as the emitted conditional says."""
    good, left = np.full(len(x), found.otherwise), np.ones(len(x), dtype=bool)
    for rule in found.rules:
        inside = _covers(rule.conditions, x) & left
        good[inside] = rule.good
        left &= ~inside
    return good


def held_out(c: Column) -> Column:
    """The third of the rows whose labels are never learned."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, **options) -> DecisionList:
    """A list from at most ``sample`` labelled rows that aren't held out, those of least hashed id; label 0 is bad.

    Their ids are bounded by ``sample`` and broadcast, so texts are read where they lie and only the numbers of the sample
    move.  Where an id stands in many rows, those of least text hash count, at most ``sample`` in all."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.min(label_col).alias("y"))
    chosen = chosen.where(~held_out(F.col("k"))).orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    known = rows.join(F.broadcast(chosen), "k").select(F.struct("k", "y", F.xxhash64("t").alias("h")).alias("id"), "t")
    table = statistics(known, "id", "t", as_long=False).select("doc_id.*", *FEATURES)
    got = table.orderBy(F.xxhash64("k"), "k", "h").limit(sample).toPandas()
    return learn(got[FEATURES].to_numpy(float), got["y"].to_numpy() == 0, **options) if len(got) else DecisionList([])


# ---------------------------------------------------------------- the operator


def verdict(found: DecisionList) -> tuple[Column, Column]:
    """The number of the first rule that covers a row, from 1 (0: none does), and whether the list keeps the row."""
    number, good = F.lit(0), F.lit(found.otherwise)
    for k, rule in reversed(list(enumerate(found.rules, 1))):
        inside = F.lit(True)
        for c in rule.conditions:
            inside &= F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold
        number, good = F.when(inside, k).otherwise(number), F.when(inside, rule.good).otherwise(good)
    return number, good


def apply_rules(docs: DataFrame, found: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the counts, base_failed, kept, the rule that decided (0: none), and the rules' inputs."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    number, good = verdict(found)
    df = statistics(docs, id_col, text_col).select("*", failed.alias("base_failed"), number.cast("int").alias("rule"), good.alias("good"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(*first, (~F.col("base_failed") & F.col("good")).alias("kept"), "rule", *[f for f in FEATURES if f not in first])
