"""Quality rules: a decision list learned from labelled text statistics, applied as one Spark expression.

Statistics and verdicts are DataFrame functions. The list is fitted on a bounded sample of labelled documents by
sequential covering: a conjunction of thresholds grows on one part of the sample while that raises its
information gain, is pruned on the other part, and the documents that it covers leave before the next one grows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?|=_~^]"

#: Ratios that the rules look at, from the columns of text_statistics().
FEATURES: dict[str, str] = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, characters: str) -> Column:
    """Code points that are left when a Java character class is taken out."""
    return F.char_length(F.regexp_replace(text, characters + "+", ""))


def _joined(hashes: Column, step: int) -> Column:
    """From hashes of runs of `step` elements those of runs twice as long; runs over the end are cut short."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def _repeated(tokens: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text.

    Hashes of two, four and eight words are built from each other; a text that repeats no four words repeats no eight.
    """

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(
            ordered,
            lambda s: F.array_sort(
                F.filter(
                    F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])),
                    lambda x: x.isNotNull(),
                )
            ),
        )
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    def of_eight(fours: Column) -> Column:
        windows = let(_joined(fours, 4), lambda w: F.slice(w, 1, F.size(w) - (WINDOW - 1)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    fours = let(tokens, lambda t: let(_joined(t, 1), lambda h: _joined(h, 2)))
    return let(fours, lambda f: F.when((F.size(f) < WINDOW) | (F.size(F.array_distinct(f)) == F.size(f)), F.lit(0)).otherwise(of_eight(f)))


def text_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with the statistics of every whole text, all long.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words, n_distinct_words,
    n_upper (A-Z) and n_marks. A null text counts as empty: all are 0. Columns of df with these names are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_marks")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    plain = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__words", words(F.col("__text")))
    t = F.col("__text")
    lines = let(
        F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(SPACE_CLASS.replace("[", "[^")))),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    found = plain.withColumns({"__lines": lines, "__repeated": _repeated(F.col("__words"))})
    columns = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.array_join("__words", "")),
        "n_symbols": F.char_length(t) - _without(t, SYMBOLS),
        "n_lines": F.col("__lines.n"),
        "n_dup_lines": F.col("__lines.dup"),
        "n_repeat_words": F.col("__repeated"),
        "n_distinct_words": F.size(F.array_distinct("__words")),
        "n_upper": F.char_length(t) - _without(t, "[A-Z]"),
        "n_marks": F.char_length(t) - _without(t, MARKS),
    }
    return found.select(*(F.col(f"`{c}`") for c in keep), *(v.cast("long").alias(k) for k, v in columns.items()))


@dataclass(frozen=True)
class Rule:
    """Rejects documents for which every (feature, above, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & ((value >= F.lit(at)) if above else (value < F.lit(at)))
        return out

    def covers(self, row: dict[str, float]) -> bool:
        return all((row[n] >= at) if above else (row[n] < at) for n, above, at in self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if above else '<'} {at:.6g}" for n, above, at in self.conditions)


def by_chance(hits: int, cover: int, rate: float) -> float:
    """The chance that of cover rows hits or more are bad, if each is with chance rate."""
    if not 0 < rate < 1:
        return 1.0 if rate or not hits else 0.0
    ways = lambda k: math.lgamma(cover + 1) - math.lgamma(k + 1) - math.lgamma(cover - k + 1)
    return min(1.0, sum(math.exp(ways(k) + k * math.log(rate) + (cover - k) * math.log(1 - rate)) for k in range(hits, cover + 1)))


def learn_rules(rows: list[tuple[dict[str, float], bool]], min_precision: float = 0.97, max_chance: float = 1e-6, max_conditions: int = 3, max_rules: int = 24, cuts: int = 24) -> list[Rule]:
    """The decision list of labelled rows (features, is it bad?), by sequential covering. No bad rows, no rules.

    A rule's evidence is the chance that as many of the rows it covers are bad if it says nothing about them, times
    the tests it was chosen from: over max_chance it is not believed. So few hits count where bad rows are rare. The bad
    rows of a rule that is not believed are set aside, and covering goes on with the others.
    """
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    tests = []
    for name in FEATURES:
        values = sorted({f[name] for f, _ in grow})
        step = max(1, len(values) // cuts)
        bad = sorted({f[name] for f, b in grow if b})
        chosen = {*values[::step], *bad[:: max(1, len(bad) // cuts)]}
        tests += [(name, above, at) for at in sorted(chosen) for above in (True, False)]
    out: list[Rule] = []
    aside: list = []  # bad rows that only rules not believed cover
    for _ in range(2 * max_rules):
        live, conditions = grow, []
        while len(conditions) < max_conditions:
            p, n = sum(b for _, b in live), sum(not b for _, b in live)
            if not p or not n:
                break
            base = math.log2(p / (p + n))
            best, gain = None, 1e-9
            for name in FEATURES:
                ordered = sorted((f[name], b) for f, b in live)
                bads, total, i = 0, 0, 0
                for at in sorted({t[2] for t in tests if t[0] == name}):
                    while i < len(ordered) and ordered[i][0] < at:
                        bads, total, i = bads + ordered[i][1], total + 1, i + 1
                    for above, pp, tt in ((False, bads, total), (True, p - bads, p + n - total)):
                        if pp and tt < p + n and (g := pp * (math.log2(pp / tt) - base)) > gain:
                            best, gain = (name, above, at), g
            if best is None:
                break
            conditions.append(best)
            live = [r for r in live if Rule((best,)).covers(r[0])]
        if not conditions:
            break

        def worth(rule: Rule, rows_: list) -> tuple[float, int]:
            hit = [b for f, b in rows_ if rule.covers(f)]
            return (sum(hit) / len(hit) if hit else 0.0, len(hit))

        options = [Rule(tuple(conditions[:k])) for k in range(len(conditions), 0, -1)]
        rule = max(options, key=lambda r: ((w := worth(r, prune))[0], w[1]))
        left = grow + aside + prune
        precision, cover = worth(rule, left)
        chance = len(tests) * by_chance(round(precision * cover), cover, sum(b for _, b in left) / len(left))
        if precision < min_precision or chance > max_chance or worth(rule, prune)[0] < min_precision:
            aside += [r for r in grow if r[1] and rule.covers(r[0])]
            grow = [r for r in grow if not (r[1] and rule.covers(r[0]))]
            continue
        out.append(rule)
        grow, aside, prune = ([r for r in part if not rule.covers(r[0])] for part in (grow, aside, prune))
        if len(out) == max_rules:
            break
    return out


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Fewer than min_words words, or more than max_repeat_percent of them in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def fit_rules(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 6000, min_words: int = 20, max_repeat_percent: int = 30, **options) -> list[Rule]:
    """Learn a decision list from at most sample labelled documents (of 0 in the label column: bad), taken by a hash of their key.

    Documents that fail the base rules are left out, as no rule need find them. Null keys and labels are passed over; of
    a key with several labels the least counts, and of one with several documents one that passes the base rules, the
    least by its statistics: the driver gets a row for each key.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(sample)
    )
    # the sample is bounded by its parameter, so it may be sent to every executor
    joined = df.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")
    stats = text_statistics(joined, keep=["__key", "__label"])
    # base failures leave on the driver: Catalyst would push that filter, and the statistics with it, below the join
    row = F.struct(base_failed(min_words, max_repeat_percent).alias("failed"), *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))
    found = stats.select("__key", "__label", row.alias("row")).groupBy("__key", "__label").agg(F.min("row").alias("row")).collect()
    found = [r for r in found if not r["row"]["failed"]]
    found.sort(key=lambda r: (str(r["__key"]), tuple(r["row"])))
    return learn_rules([({n: r["row"][n] for n in FEATURES}, r["__label"] == 0) for r in found], **options)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the first rule that fires from 1, else null) as ordered conditional expressions."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    number = F.when(rules[0].expression(), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        number = number.when(rule.expression(), F.lit(i))
    return number.isNull(), number


def judge(df: DataFrame, rules: list[Rule], text: str = "text", keep: list[str] | None = None, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """df's columns (or those in keep) with the statistics, base_failed, rule and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated windows; kept is
    false for those, else what the decision list says. Nulls and empty texts fail the base.
    """
    names = {"base_failed", "rule", "kept"}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    kept, number = verdict(rules)
    failed = base_failed(min_words, max_repeat_percent)
    return text_statistics(df, text, keep).withColumn("base_failed", failed).withColumn("rule", number).withColumn("kept", ~F.col("base_failed") & kept)
