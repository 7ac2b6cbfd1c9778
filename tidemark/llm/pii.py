"""Personal data: high-recall span generators scored by boosted trees, with DataFrame functions alone.

Base spans (email, ip, card, phone) are exact patterns with checks and always stay. Beside them generators propose
every long run of digits and every long token. Evidence (the words that announce a value, and Luhn's check) labels
proposals; boosted trees learn from format and from the marks around a span, never from the evidence, which of them are
like those that the evidence confirms. A proposal is redacted if evidence confirms it or if the trees put it over a
calibrated threshold. The trees are fitted on counts by feature cell (at most CELLS of them, whatever the corpus size)
and applied as one Spark expression. Positions are running sums over arrays, so that the work grows with a text's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. Quantifiers are possessive where nothing could be given back, so that long runs neither recurse nor
# backtrack; look-behinds start a run only at its first character or where the last match ended. The patterns of cards
# and phones hold their numbers of digits, as runs of more or fewer digits are no matches of theirs.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE: dict[str, str] = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9](?:[\\x20().-]*+[0-9]){7,14}+(?![\\x20().-]*+[0-9])",
}
#: Generators: runs of 7 digits or more with separators, and tokens of 16 characters or more with a digit.
GENERATORS: dict[str, str] = {
    "account": "(?<![0-9A-Za-z])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){6,}+(?![0-9A-Za-z])",
    "secret": "(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
KINDS = (*BASE, *GENERATORS)
#: Code points before a span, back to the last match of its kind at most, in which evidence and marks are looked for.
CONTEXT = 24
#: Evidence: words that announce a secret, an account number, a plain number.
SECRET_WORDS = "(?i)(token|secret|passw|api.?key|bearer|credential|\\bkey)[^\\n]{0,8}$"
ACCOUNT_WORDS = "(?i)(card|visa|account|iban|konto|compte|cuenta|ssn|phone|tel|call)[^\\n]{0,8}$"
NUMBER_WORDS = "(?i)(version|page|item|no\\.|nr|isbn|line|chapter|\\bv)[^\\n]{0,4}$"
#: Feature names and how many values each takes; their product bounds the cells.
SHAPE = {"kind": 2, "length": 6, "digit_share": 4, "groups": 3, "turns": 3, "mark": 4, "case": 3, "hexadecimal": 2, "edge": 2}
CELLS = math.prod(SHAPE.values())
#: Array elements that are folded one by one in a running fold, and code points in a piece of a text that is cut.
_RUN, _PIECE = 128, 4096
_FOUND = "cast(array() as array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>)"

# Expressions over arrays are written as SQL text: a long one is parsed in one call. Names of lambda variables are chosen
# so that no expression put into another one refers to a name that is bound there again.


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def with_value(name: str, value: str, use: str) -> str:
    """SQL for use, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def running(values: str, combine, zero: str) -> str:
    """SQL for the fold of every prefix of an array: of whole runs before an element, then within its own run.

    An element costs a run's length at most, and a run the number of runs before it.
    """
    fold = lambda part: f"aggregate({part}, {zero}, (acc, x) -> {combine('acc', 'x')})"
    runs = f"transform(sequence(0, cast(floor((size(v) - 1) / {_RUN}) as int)), j -> slice(v, j * {_RUN} + 1, {_RUN}))"
    each = f"flatten(transform(runs, (run, j) -> transform(run, (y, i) -> {combine('get(prior, j)', fold('slice(run, 1, i + 1)'))})))"
    prior = with_value("totals", f"transform(runs, run -> {fold('run')})", f"transform(totals, (y, j) -> {fold('slice(totals, 1, j)')})")
    return with_value("v", values, f"case when size(v) = 0 then v else {with_value('runs', runs, with_value('prior', prior, each))} end")


def spans_of(text: str, kind: str, pattern: str) -> str:
    """SQL for leftmost non-overlapping matches as an array of (kind, start, end, value, before, after), in code points from 0.

    before holds the CONTEXT code points before a match, back to the last match at most, after the code point behind it.
    """
    ends = running("transform(found, (m, i) -> char_length(m) + char_length(get(gaps, i)))", "{} + {}".format, "0")
    made = (
        f"transform(found, (m, i) -> named_struct('kind', '{kind}', 'start', get(ends, i) - char_length(m), 'end', get(ends, i), "
        f"'value', m, 'before', right(get(gaps, i), {CONTEXT}), 'after', left(get(gaps, i + 1), 1)))"
    )
    placed = with_value("gaps", f"split({text}, {_raw(pattern)})", with_value("ends", ends, made))
    return with_value("found", f"regexp_extract_all({text}, {_raw(pattern)}, 0)", f"case when size(found) = 0 then {_FOUND} else {placed} end")


def luhn(digits: str) -> str:
    """SQL: does a string of digits pass Luhn's check?"""
    doubled = f"transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> {with_value('d', 'cast(c as int) * (i % 2 + 1)', 'case when d > 9 then d - 9 else d end')})"
    return f"(aggregate({doubled}, 0, (acc, x) -> acc + x) % 10 = 0)"


def _digits(span: str) -> str:
    return f"regexp_replace({span}.value, '[^0-9]', '')"


def valid(span: str) -> str:
    """SQL for the base check of a span of that kind."""
    n = f"char_length({_digits(span)})"
    part = with_value("q", "regexp_replace(part, '^0+', '')", "case when char_length(q) <= 3 then cast('0' || q as int) <= 255 else false end")
    return (
        f"case {span}.kind when 'ip' then forall(split({span}.value, r'\\.'), part -> {part}) "
        f"when 'card' then case when {n} between 16 and 19 then {luhn(_digits(span))} else false end "
        f"when 'phone' then {n} between 8 and 15 else true end"
    )


def clear_of(spans: str, others: str) -> str:
    """SQL for the spans (structs with start and end) that overlap none of others, in order of their starts.

    Of all in one order, those before a span must end, and those behind it begin, outside it.
    """
    top = str(2**31 - 1)
    line = f"array_sort(concat(transform(mine, (s, i) -> struct(s.start as start, s.end as end, i as at)), transform({others}, s -> struct(s.start as start, s.end as end, -1 as at))))"
    ended = running("transform(line, s -> case when s.at < 0 then s.end else -1 end)", "greatest({}, {})".format, "-1")
    begun = f"reverse({running(f'reverse(transform(line, s -> case when s.at < 0 then s.start else {top} end))', 'least({}, {})'.format, top)})"
    free = "filter(transform(line, (s, i) -> case when s.at >= 0 and get(ended, i) <= s.start and get(begun, i) >= s.end then s.at end), at -> at is not null)"
    apart = with_value("line", line, with_value("ended", ended, with_value("begun", begun, f"transform({free}, at -> get(mine, at))")))
    return with_value("mine", spans, f"case when size(mine) = 0 or size({others}) = 0 then mine else {apart} end")


def features(span: str) -> dict[str, str]:
    """SQL for small integers from a span's format and the marks around it; no evidence is among them."""
    value, before = f"{span}.value", f"{span}.before"
    n = f"char_length({value})"
    turns = f"char_length(regexp_replace(regexp_replace(left({value}, 64), '[A-Za-z]+', 'a'), '[0-9]+', '0'))"
    return {
        "kind": f"case {span}.kind when 'secret' then 1 else 0 end",
        "length": f"case when {n} < 12 then 0 when {n} < 16 then 1 when {n} < 20 then 2 when {n} < 32 then 3 when {n} <= 64 then 4 else 5 end",
        "digit_share": f"least(3, floor(4 * char_length({_digits(span)}) / {n}))",
        "groups": f"least(2, size(split({value}, '[ -]')) - 1)",
        "turns": f"case when {turns} < 4 then 0 when {turns} < 10 then 1 else 2 end",
        "mark": f"case when {before} rlike {_raw('[=:] ?[\\x22\\x27]$')} then 3 when {before} rlike '[=:] ?$' then 2 when {before} rlike {_raw('[\\x22\\x27]$')} then 1 else 0 end",
        "case": f"case when {value} rlike '[a-z]' and {value} rlike '[A-Z]' then 2 when {value} rlike '[A-Za-z]' then 1 else 0 end",
        "hexadecimal": f"case when {value} rlike '[^0-9a-fA-F]' then 0 else 1 end",
        "edge": f"case when {span}.after rlike '^[A-Za-z0-9_]' then 1 else 0 end",
    }


def evidence(span: str) -> str:
    """SQL: 1 where words or Luhn's check confirm a proposal's kind, 0 where they speak against it, null where nothing is known."""
    secret, account, number = (f"{span}.before rlike {_raw(w)}" for w in (SECRET_WORDS, ACCOUNT_WORDS, NUMBER_WORDS))
    checked = f"case when {luhn(_digits(span))} then 1 else 0 end"
    return (
        f"case when {span}.kind = 'secret' then case when {secret} then 1 when {number} or {account} then 0 end "
        f"when {account} and not {secret} then 1 when char_length({_digits(span)}) between 16 and 19 then {checked} "
        f"when {secret} or {number} then 0 end"
    )


def _candidates(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns keep with __text, __base and __proposed, names that no table should have."""
    hot = {"email": "contains(__text, '@')", "phone": "contains(__text, '+')"}
    found = df.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in keep)).alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    found = found.withColumn("__digit", F.expr("__text rlike '[0-9]'"))
    found = found.withColumns({f"__{k}": F.expr(f"case when {hot.get(k, '__digit')} then {spans_of('__text', k, p)} else {_FOUND} end") for k, p in {**BASE, **GENERATORS}.items()})
    fields = ", ".join(f"'f_{k}', cast({v} as int)" for k, v in features("s").items())
    made = f"named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'value', s.value, 'label', {evidence('s')}, {fields})"
    proposed = F.expr(f"transform(concat({', '.join(f'__{k}' for k in GENERATORS)}), s -> {made})")
    base = F.expr(f"filter(concat({', '.join(f'__{k}' for k in BASE)}), s -> {valid('s')})")
    return found.select(*(F.col("__row").getField(c).alias(c) for c in keep), "__text", base.alias("__base"), proposed.alias("__proposed"))


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with base (checked base spans) and proposed (generated spans with features and a label).

    label is evidence(). A null text counts as empty and has no spans. Columns of df named base and proposed are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("base", "proposed")]
    return _candidates(df, text, keep).drop("__text").withColumnsRenamed({"__base": "base", "__proposed": "proposed"})


@dataclass(frozen=True)
class Node:
    """A tree: a leaf's value, or left where the feature is at most `at`, else right."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def score(self, row: dict[str, int]) -> float:
        node = self
        while node.feature:
            node = node.left if row[node.feature] <= node.at else node.right
        return node.value

    def expression(self, span: str) -> str:
        if not self.feature:
            return f"{self.value!r}D"
        return f"case when {span}.f_{self.feature} <= {self.at} then {self.left.expression(span)} else {self.right.expression(span)} end"


@dataclass(frozen=True)
class Trees:
    """Boosted trees on the log-odds scale, with the probability over which a span is redacted (above 1: none is)."""

    bias: float
    trees: tuple[Node, ...]
    threshold: float

    def probability(self, row: dict[str, int]) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(t.score(row) for t in self.trees)))

    def accepts(self, span: str) -> str:
        """SQL: is the span's probability over the threshold?"""
        if self.threshold > 1:
            return "false"
        score = " + ".join([f"{self.bias!r}D", *(t.expression(span) for t in self.trees)])
        return f"({score} >= {math.log(self.threshold / (1 - self.threshold))!r}D)"


def _grow(rows: list, depth: int, least: float) -> Node:
    """rows: (features, gradient, hessian, weight). Newton leaves; the split of highest gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Node(value=0.3 * g / (h + 1.0))
    if not depth:
        return leaf
    best = None
    for name, size in SHAPE.items():
        for at in range(size - 1):
            left = [r for r in rows if r[0][name] <= at]
            gl, hl, wl = (sum(r[i] for r in left) for i in (1, 2, 3))
            if wl < least or sum(r[3] for r in rows) - wl < least:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, name, at)
    if best is None:
        return leaf
    _, name, at = best
    return Node(feature=name, at=at, left=_grow([r for r in rows if r[0][name] <= at], depth - 1, least), right=_grow([r for r in rows if r[0][name] > at], depth - 1, least))


def _threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """The lowest probability that may be accepted, from (probability, positives, negatives); 2 if none may.

    Neighbours whose shares of positives go against their probabilities are pooled (isotonic regression). The share in
    the pool must reach precision, so that no group passes on the account of better ones, and the share of all weight
    from there up must reach it less one deviation.
    """
    pools: list[list[float]] = []
    for q, a, b in sorted(scored, key=lambda x: -x[0]):
        if not a + b:
            continue
        pools.append([q, a, b])
        while len(pools) > 1 and (pools[-1][0] == pools[-2][0] or pools[-1][1] * sum(pools[-2][1:]) >= pools[-2][1] * sum(pools[-1][1:])):
            q, a, b = pools.pop()
            pools[-1] = [q, pools[-1][1] + a, pools[-1][2] + b]
    chosen, p, n = 2.0, 0.0, 0.0
    for q, a, b in pools:
        p, n = p + a, n + b
        share = p / (p + n)
        if a / (a + b) >= precision and share - math.sqrt(share * (1 - share) / (p + n)) >= precision:
            chosen = q
    return chosen


def boost(
    cells: list[tuple[dict[str, int], float, float]],
    rounds: int = 20,
    depth: int = 3,
    precision: float = 0.9,
    least: float = 2.0,
    held_out: list[tuple[dict[str, int], float, float]] | None = None,
) -> Trees:
    """Fit on cells (features, positives, negatives). Without both kinds of label nothing is accepted.

    The threshold is calibrated on the cells of held_out, or on those of the fit if it is None.
    """
    positives, negatives = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not positives or not negatives:
        return Trees(0.0, (), 2.0)
    bias, trees = math.log(positives / negatives), []
    score = [bias] * len(cells)
    for _ in range(rounds):
        rows = []
        for (f, p, n), s in zip(cells, score, strict=True):
            q = 1 / (1 + math.exp(-s))
            rows.append((f, p * (1 - q) - n * q, (p + n) * q * (1 - q), p + n))
        tree = _grow(rows, depth, least)
        trees.append(tree)
        score = [s + tree.score(c[0]) for s, c in zip(score, cells, strict=True)]
    model = Trees(bias, tuple(trees), 2.0)
    chosen = _threshold([(model.probability(c[0]), c[1], c[2]) for c in (cells if held_out is None else held_out)], precision)
    return Trees(bias, tuple(trees), min(chosen, 1 - 1e-9) - 1e-9 if chosen <= 1 else 2.0)


def labelled_cells(df: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[list, list]:
    """Counts by feature cell, (features, positives, negatives), of the documents that fit the trees and of those held out.

    A quarter of the documents, by a hash of their key (of the text where df has no key), is held out. Proposals without
    evidence count as negatives, so that a measured precision is at most the true one. Held-out proposals that overlap
    base spans are left out, as only the others are left to the trees. The driver gets 2 * CELLS rows at most.
    """
    span = F.col("c")
    names = [f"f_{k}" for k in SHAPE]
    held = F.coalesce(F.pmod(F.xxhash64(f"`{key}`" if key in df.columns else f"`{text}`"), F.lit(4)) == 0, F.lit(False))
    plain = df.select(F.col(f"`{text}`").alias("text"), held.alias("held"))
    used = F.expr(f"case when held then {clear_of('__proposed', '__base')} else __proposed end")
    cells = (
        _candidates(plain, "text", ["held"])
        .select("held", F.explode(used).alias("c"))
        .groupBy("held", *(span[n].alias(n) for n in names))
        .agg(F.count_if(span["label"] == 1).alias("p"), F.count("*").alias("n"))
        .collect()
    )
    ordered = sorted(cells, key=lambda r: tuple(r[n] for n in names))
    of = lambda held: [({k: r[f"f_{k}"] for k in SHAPE}, float(r["p"]), float(r["n"] - r["p"])) for r in ordered if r["held"] == held]
    return of(False), of(True)


def fit_trees(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> Trees:
    """Trees from the proposals of all rows, with a threshold calibrated on held-out documents."""
    fitted, held_out = labelled_cells(df, text, key)
    return boost(fitted, held_out=held_out, **options)


def accuracy(trees: Trees, cells: list) -> dict[str, float]:
    """Precision and recall of the trees alone, without evidence, on cells (features, positives, negatives)."""
    taken = [(p, n) for f, p, n in cells if trees.probability(f) >= trees.threshold]
    hit, wrong, all_ = sum(p for p, _ in taken), sum(n for _, n in taken), sum(p for _, p, _ in cells)
    return {"precision": hit / (hit + wrong) if hit + wrong else math.nan, "recall": hit / all_ if all_ else math.nan, "positives": all_, "accepted": hit + wrong}


def _ranked(spans: str) -> Column:
    """Spans ordered by kind as listed, then start."""
    rank = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    return F.expr(f"array_sort(transform({spans}, s -> struct(case s.kind {rank} end as rank, s.start as start, s.end as end, s.kind as kind)))")


def _found(df: DataFrame, trees: Trees, text: str, keep: list[str]) -> DataFrame:
    """Columns keep with __base and __spans."""
    plain = "transform({}, s -> struct(s.kind as kind, s.start as start, s.end as end))".format
    # spans of one kind never overlap each other, so a kind need only be clear of those before it
    chosen = _candidates(df, text, keep).withColumn("__all", F.expr(plain("__base")))
    chosen = chosen.withColumn("__taken", F.expr(f"filter(__proposed, s -> coalesce(s.label = 1, false) or {trees.accepts('s')})"))
    for kind in GENERATORS:
        own = plain(f"filter(__taken, s -> s.kind = '{kind}')")
        chosen = chosen.withColumn("__all", F.expr(f"concat(__all, {clear_of(own, '__all')})"))
    return chosen.select(*(F.col(f"`{k}`") for k in keep), _ranked("__base").alias("__base"), _ranked("__all").alias("__spans"))


def find_spans(df: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with base and spans: arrays of (rank, start, end, kind) in code points, end exclusive.

    base holds the checked base spans; spans holds those and the proposals that evidence confirms or the trees accept, if
    they overlap none of them nor one of an earlier kind. Null and empty texts have none; repeated rows each get theirs.
    Columns of df named base and spans are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    return _found(df, trees, text, keep).withColumnsRenamed({"__base": "base", "__spans": "spans"})


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: str) -> str:
    """SQL for spans as (start, end, kind) in order, overlapping ones made one of the first one's kind."""
    ends = running("transform(line, s -> s.end)", "greatest({}, {})".format, "-1")
    heads = "filter(transform(line, (s, i) -> struct(s.start as start, s.kind as kind, coalesce(get(ends, i - 1), -1) as before)), h -> h.start >= h.before)"
    made = "transform(heads, (h, i) -> struct(h.start as start, coalesce(get(heads, i + 1).before, element_at(ends, -1)) as end, h.kind as kind))"
    line = f"array_sort(transform({spans}, s -> struct(s.start as start, s.end as end, s.kind as kind)))"
    return with_value("line", line, f"case when size(line) = 0 then line else {with_value('ends', ends, with_value('heads', heads, made))} end")


def _cut(start: str, end: str) -> str:
    """SQL for the text from start to end out of its pieces of _PIECE code points, of which only those in question are read."""
    first, last = f"cast(floor(a / {_PIECE}) as int)", f"cast(floor((z - 1) / {_PIECE}) as int)"
    head = f"substr(get(pieces, {first}), a - {first} * {_PIECE} + 1, least(z - a, {_PIECE}))"
    tail = f"array_join(slice(pieces, {first} + 2, greatest({last} - {first} - 1, 0)), '') || substr(get(pieces, {last}), 1, z - {last} * {_PIECE})"
    return with_value("a", start, with_value("z", end, f"case when z <= a then '' when {first} = {last} then {head} else {head} || {tail} end"))


def redact(df: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets; overlapping spans become one. Null texts stay null.

    Other columns stay as they are, whatever their names.
    """
    c = _found(df, trees, text, df.columns).withColumn("__spans", F.expr(_merged("__spans")))
    parts = f"transform(__spans, (s, i) -> {_cut('coalesce(get(__spans, i - 1).end, 0)', 's.start')} || '[' || upper(s.kind) || ']')"
    last = _cut("element_at(__spans, -1).end", f"char_length(`{text}`)")
    replaced = with_value("pieces", f"regexp_extract_all(`{text}`, r'(?s).{{1,{_PIECE}}}+', 0)", f"array_join({parts}, '') || {last}")
    redacted = F.expr(f"case when size(__spans) > 0 then {replaced} else `{text}` end")
    return c.select(*((redacted if k == text else F.col(f"`{k}`")).alias(k) for k in df.columns))
