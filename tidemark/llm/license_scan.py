"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates.

A text's lines (long ones in overlapping windows), its short blocks between blank lines and its runs of lines that look
like a licence become sparse vectors of the word n-grams that occur in licence templates. A softmax regression trained on
cut, thinned and mixed templates and on lines of the corpus names the licence family. Its temperature and its threshold
are calibrated on examples, and on families, that models of the same kind did not see: a prediction below the threshold,
or one that shares too few word triples with a template of that family, is reported as unknown.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.license_templates import OTHERS, STATEMENTS, TEXTS

#: Templates by family.
TEMPLATES: dict[str, tuple[str, ...]] = {f: (*STATEMENTS.get(f, ()), *TEXTS.get(f, ())) for f in dict.fromkeys([*STATEMENTS, *TEXTS])}
NONE, UNKNOWN = "none", "unknown"
SMALL = frozenset("a an and any are as at be by for from in is it its of on or that the this to under with".split())
#: Words in the windows of a line of more than 2 * WINDOW words, and how far the next one begins: wide ones for texts,
#: narrow ones for statements.
WINDOW, STEP = 60, 30
NARROW, NARROW_STEP = 16, 8
#: Words up to which a block of lines between blank ones is also read as a whole.
BLOCK_WORDS = 200
#: Share of word triples, of those in either, that confirms a template.
LEAST_SIMILARITY = 0.6
_TOKEN = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")


def _low(line: str) -> str:
    """The line in lower case, with as many characters."""
    low = line.lower()
    return low if len(low) == len(line) else "".join(c.lower() if len(c.lower()) == 1 else c for c in line)


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(_low(line))


def grams(words: list[str]) -> set[str]:
    """Words that are not small ones, and pairs of neighbours."""
    return {w for w in words if w not in SMALL} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def triples(words: list[str]) -> list[tuple]:
    return [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []


@cache
def _references(family: str) -> list[frozenset]:
    """The triples of a family's templates, and of its text as a whole."""
    whole = [" ".join(TEXTS[family])] if len(TEXTS.get(family, ())) > 1 else []
    return [frozenset(triples(tokens(t))) for t in (*TEMPLATES.get(family, ()), *whole)]


def similarity(family: str, words: list[str]) -> float:
    """The largest share of word triples that words and a template of the family have in common, of those in either.

    Of words only the part from the first to the last common triple counts, so that text around a licence is no matter.
    """
    own, best = triples(words), 0.0
    for reference in _references(family):
        at = [i for i, t in enumerate(own) if t in reference]
        if at:
            part = set(own[at[0] : at[-1] + 1])
            best = max(best, len(part & reference) / len(part | reference))
    return best


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: np.ndarray  # one row for each n-gram, then the bias
    temperature: float
    threshold: float

    def tables(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, the n-gram of each word alone (or -1), and the sorted pairs of numbers with their n-grams."""
        words = sorted({w for g in self.vocabulary for w in g.split(" ")})
        number = {w: i for i, w in enumerate(words)}
        single = np.array([self.vocabulary.get(w, -1) for w in words], dtype=np.int64)
        pairs = sorted((number[a] * len(words) + number[b], i) for g, i in self.vocabulary.items() if " " in g for a, b in [g.split(" ")])
        return number, single, np.array([p for p, _ in pairs], dtype=np.int64), np.array([i for _, i in pairs], dtype=np.int64)

    def logits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables) -> np.ndarray:
        """Scores of the runs [start, end) of word numbers (-1: a word of no n-gram), each with two words or one."""
        number, single, keys, of_key = tables
        sizes = ends - starts
        row = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        word = ids[at]
        one = np.where(word >= 0, single[word], -1)
        next_ = np.where((at + 1 < ends[row]) & (word >= 0), ids[np.minimum(at + 1, len(ids) - 1)], -1) if len(at) else word
        key = np.where(next_ >= 0, word * len(number) + next_, -1)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        two = np.where(keys[place] == key, of_key[place], -1)
        feature, row = np.r_[one, two], np.r_[row, row]
        met = feature >= 0
        cell = np.unique(row[met] * np.int64(len(self.vocabulary)) + feature[met])
        row, feature = cell // len(self.vocabulary), cell % len(self.vocabulary)
        out = np.tile(self.weights[-1].astype(np.float64), (len(starts), 1))
        if len(row):
            first = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            out[row[first]] += np.add.reduceat(self.weights[feature].astype(np.float64), first, axis=0) / np.sqrt(np.maximum(sizes[row[first]], 1))[:, None]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class _Rows:
    """Distinct sparse rows of presence over the square root of their words, with weights."""

    def __init__(self, rows: list[tuple[list[str], int]], vocabulary: dict[str, int]):
        seen: dict[tuple, int] = {}
        for words, label in rows:
            row = (tuple(sorted(vocabulary[g] for g in grams(words) if g in vocabulary)), len(words), label)
            row = row if row[0] else ((), 1, label)
            seen[row] = seen.get(row, 0) + 1
        self.label = np.array([k for _, _, k in seen])
        self.weight = np.array(list(seen.values()), dtype=np.float32)
        sizes = np.array([len(r) for r, _, _ in seen])
        self.row = np.repeat(np.arange(len(seen)), sizes)
        self.feature = np.array([f for r, _, _ in seen for f in r], dtype=np.int64)
        self.value = np.repeat(np.array([1 / math.sqrt(n) for _, n, _ in seen], dtype=np.float32), sizes)[:, None]
        self.by_feature = np.argsort(self.feature, kind="stable")

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.tile(weights[-1], (len(self.label), 1))
        if len(self.row):
            first = np.flatnonzero(np.r_[True, np.diff(self.row) > 0])
            out[self.row[first]] += np.add.reduceat(weights[self.feature] * self.value, first, axis=0)
        return out

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, error.shape[1]), dtype=np.float32)
        out[-1] = error.sum(axis=0)
        if len(self.row):
            order = self.by_feature
            sorted_ = self.feature[order]
            first = np.flatnonzero(np.r_[True, np.diff(sorted_) > 0])
            out[sorted_[first]] = np.add.reduceat((error[self.row] * self.value)[order], first, axis=0)
        return out


def _fit(rows: list[tuple[list[str], int]], vocabulary: dict[str, int], classes: int, rounds: int) -> np.ndarray:
    """Weights of a softmax regression, classes with equal weight."""
    x = _Rows(rows, vocabulary)
    one = np.eye(classes, dtype=np.float32)[x.label]
    of_class = np.bincount(x.label, weights=x.weight, minlength=classes)
    balance = (x.weight / of_class[x.label]).astype(np.float32)
    balance = (balance / balance.sum())[:, None]
    weights = np.zeros((len(vocabulary) + 1, classes), dtype=np.float32)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        g = x.gradient((_softmax(x.scores(weights)) - one) * balance, len(weights)) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def _variants(template: str, variants: int, plain: list[list[str]], rnd: np.random.Generator) -> list[list[str]]:
    """A template whole, cut, thinned and after other words."""
    words, out = tokens(template), []
    for v in range(variants):
        cut = words
        if v and len(words) > 10:
            n = int(rnd.integers(8, len(words) + 1))
            at = int(rnd.integers(0, len(words) - n + 1))
            cut = words[at : at + n]
        if v % 3 == 1:
            cut = [w for w in cut if rnd.random() > 0.08] or cut
        if v % 4 == 2 and plain:
            cut = plain[int(rnd.integers(len(plain)))][:12] + cut
        out.append(cut)
    return out


@cache
def _groups() -> list[frozenset[str]]:
    """Families in groups of those with a template that would confirm another's."""
    out: list[set[str]] = []
    for f in TEMPLATES:
        near = [g for g in out if any(similarity(o, tokens(t)) >= LEAST_SIMILARITY for o in g for t in TEMPLATES[f])]
        out = [g for g in out if g not in near] + [{f}.union(*near)]
    return [frozenset(g) for g in out]


def train(background: list[str], variants: int = 12, rounds: int = 120, folds: int = 3, seed: int = 11, precision: float = 0.97) -> Classifier:
    """Fit on variants of the templates, OTHERS and the background lines (at most a few thousand), and calibrate.

    For the calibration as many models as folds are fitted, each without one part of the families and of the variants:
    families that a model does not know must come out as unknown or none. Families whose templates confirm each other's
    are left out together: between a known licence and an unknown variant of it only the threshold stands. It is the
    lowest at which the share of right names among those given, after confirmation, reaches precision.
    """
    rnd = np.random.default_rng(seed)
    families = (NONE, *TEMPLATES)
    vocabulary = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))}))}
    plain = [tokens(x) for x in background if x.strip()]
    named = [(words, k) for k, f in enumerate(families[1:], 1) for t in TEMPLATES[f] for words in _variants(t, variants, plain, rnd)]
    none = [([w for w in tokens(t) if rnd.random() > 0.1], 0) for t in OTHERS for _ in range(variants)]
    none += [(w[: 2 * WINDOW], 0) for w in plain]
    every = sorted(vocabulary)
    none += [([w for g in rnd.choice(every, 3) for w in g.split(" ")] + [f"x{i}" for i in range(12)], 0) for _ in range(4 * variants)]
    fold = rnd.integers(0, folds, len(named) + len(none))
    groups = _groups()
    of_group = rnd.permutation(np.arange(len(groups)) % folds)
    of_family = np.array([-1, *(next(int(of_group[i]) for i, g in enumerate(groups) if f in g) for f in TEMPLATES)])
    scored: list[tuple[np.ndarray, int, list[str]]] = []
    for f in range(folds):
        known = [k for k in range(len(families)) if of_family[k] != f]
        number = {k: i for i, k in enumerate(known)}
        rows = [(w, number[k]) for (w, k), g in zip(named + none, fold, strict=True) if k in number and g != f]
        weights = _fit(rows, vocabulary, len(known), rounds)
        out = [(w, k) for (w, k), g in zip(named + none, fold, strict=True) if k not in number or g == f]
        x = [_Rows([r], vocabulary).scores(weights)[0] for r in [(w, 0) for w, _ in out]]
        for (words, k), score in zip(out, x, strict=True):
            full = np.full(len(families), -np.inf)
            full[known] = score
            scored.append((full, k if k in number else -1, words))

    def loss(temperature: float) -> float:
        seen = [_softmax(s[None] / temperature)[0, k] for s, k, _ in scored if k >= 0]
        return -float(np.log(np.array(seen) + 1e-12).mean())

    temperature = min([0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0], key=loss)
    given = []
    for s, k, words in scored:
        p = _softmax(s[None] / temperature)[0]
        best = 1 + int(np.argmax(p[1:]))
        if p[0] < 0.5 and similarity(families[best], words) >= LEAST_SIMILARITY:
            given.append((p[best], best == k))
    threshold = 0.95
    for t in np.linspace(0.3, 0.95, 14):
        right = [ok for q, ok in given if q >= t]
        if right and sum(right) / len(right) >= precision:
            threshold = float(t)
            break
    return Classifier(families, vocabulary, _fit(named + none, vocabulary, len(families), rounds), float(temperature), threshold)


def fit_classifier(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 300, lines: int = 10, **options) -> Classifier:
    """Train with background lines from at most sample documents, taken by a hash of their key, and lines of each.

    A document's lines are taken by a hash of the line, and of a line of more than 2 * WINDOW words as many words from a
    place that its hash names, so every part of a text has a chance and the driver gets a bounded number of words. Lines
    that hold two words of the statements' own are left out of the background, as they may be licences.
    """
    names = {g for ts in STATEMENTS.values() for t in ts for g in tokens(t)} - SMALL
    split = F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x) != "")
    chosen = F.slice(F.array_sort(F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line")))), 1, lines)

    def window(x: Column) -> Column:
        words = F.split(x["line"], " ")
        start = F.pmod(x["h"], F.greatest(F.size(words) - 2 * WINDOW, F.lit(0)) + 1).cast("int") + 1
        return F.array_join(F.slice(words, start, 2 * WINDOW), " ")

    documents = df.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    taken = documents.select("h").distinct().orderBy("h").limit(sample)
    # whole texts stay in their tasks; of rows that share a key one counts
    short = documents.join(F.broadcast(taken), "h").select("h", F.transform(chosen, window).alias("lines")).groupBy("h").agg(F.min("lines").alias("lines"))
    found = sorted(tuple(r["lines"]) for r in short.collect())
    plain = [x for row in found for x in row if len(names & set(tokens(x))) < 2]
    return train(plain, **options)


@dataclass(frozen=True)
class Part:
    """A line, or a window of a long one: code points [start, end), words [first, last) of the text's, and its block."""

    start: int
    end: int
    first: int
    last: int
    block: int
    window: bool = False


def layout(text: str) -> tuple[list[str], list[Part]]:
    """The words of a text and its lines with a word; long lines in overlapping windows. Other lines part blocks."""
    words: list[str] = []
    parts: list[Part] = []
    at = block = 0
    for line in text.split("\n"):
        found = tokens(line)
        if not found:
            block += 1
        elif len(found) > 2 * WINDOW:
            places = [m.span() for m in _TOKEN.finditer(_low(line))]
            windows = [(i, min(i + size, len(found))) for size, step in ((WINDOW, STEP), (NARROW, NARROW_STEP)) for i in range(0, len(found) - step, step)]
            parts += [Part(at + places[i][0], at + places[j - 1][1], len(words) + i, len(words) + j, block, True) for i, j in sorted(windows)]
        else:
            parts.append(Part(at, at + len(line), len(words), len(words) + len(found), block))
        words += found
        at += len(line) + 1
    return words, parts


def _joined(parts: list[Part]) -> Part:
    return Part(parts[0].start, max(p.end for p in parts), parts[0].first, max(p.last for p in parts), parts[0].block, any(p.window for p in parts))


def blocks(parts: list[Part]) -> list[tuple[int, int]]:
    """The runs [i, j) of two parts or more that are a block of lines short enough to be read as one."""
    cuts = [0, *(i for i in range(1, len(parts)) if parts[i].block != parts[i - 1].block), len(parts)]
    return [(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1 and max(p.last for p in parts[i:j]) - parts[i].first <= BLOCK_WORDS]


def runs(parts: list[Part], alike: list[bool]) -> list[tuple[int, int]]:
    """The runs [i, j) of parts of a block that look like a licence, with at most one other part between two of them."""
    out: list[tuple[int, int]] = []
    for i in (i for i, a in enumerate(alike) if a):
        if out and i - out[-1][1] <= 1 and parts[i].block == parts[out[-1][0]].block:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def scan(df: DataFrame, model: Classifier, text: str = "text", key: str = "doc_id", least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, start, end, family, guess, probability, similarity) of every paragraph that looks like a licence.

    A paragraph is a block of lines between blank ones if that is confirmed as a whole, else a run of lines that look like
    a licence, else those of its lines that are confirmed. Positions are code points of the whole text, end exclusive.
    family is the guess if its calibrated probability reaches the model's threshold and a template confirms it, else
    unknown. Paragraphs that are more likely no licence are left out. Null and empty texts give nothing; repeated rows
    each give theirs; rows with a null id have a null doc_id.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is that of the templates' vocabulary
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = [r for doc in _scanned(own, tables, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), least_similarity) for r in doc]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "family", "guess", "probability", "similarity"])

    return rows.mapInArrow(run, "doc_id long, start long, end long, family string, guess string, probability double, similarity double")


def _scanned(model: Classifier, tables, docs: list, texts: list, least: float) -> Iterator[list[tuple]]:
    """The result rows of each text; all lines and blocks of the texts are scored together."""
    number = tables[0]
    laid = [layout(t or "") for t in texts]
    ids = np.array([number.get(w, -1) for words, _ in laid for w in words], dtype=np.int64)
    base = np.cumsum([0, *(len(words) for words, _ in laid)])

    def scored(ranges: list[tuple[int, Part]]) -> np.ndarray:
        starts = np.array([base[d] + p.first for d, p in ranges], dtype=np.int64)
        ends = np.array([base[d] + p.last for d, p in ranges], dtype=np.int64)
        return model.probabilities(model.logits(ids, starts, ends, tables)) if ranges else np.zeros((0, len(model.families)))

    lines = [(d, p) for d, (_, parts) in enumerate(laid) for p in parts]
    of_lines = scored(lines)
    wide = [(d, ij, _joined(parts[ij[0] : ij[1]])) for d, (_, parts) in enumerate(laid) for ij in blocks(parts)]
    of_wide = scored([(d, p) for d, _, p in wide])
    begin, met = 0, []
    for d, (_, parts) in enumerate(laid):
        p = of_lines[begin : begin + len(parts)]
        begin += len(parts)
        met += [(d, ij, p[ij[0] : ij[1]]) for ij in runs(parts, (p[:, 0] < 0.5).tolist())] if len(parts) else []
    merged = [(d, _joined(laid[d][1][ij[0] : ij[1]])) for d, ij, _ in met]
    of_runs = scored(merged)

    def judged(d: int, part: Part, p: np.ndarray) -> tuple | None:
        """The result row, unless none is more likely."""
        if p[0] >= 0.5:
            return None
        best = 1 + int(np.argmax(p[1:]))
        guess, similar = model.families[best], similarity(model.families[best], laid[d][0][part.first : part.last])
        sure = p[best] >= model.threshold and similar >= least
        return docs[d], part.start, part.end, guess if sure else UNKNOWN, guess, float(p[best]), similar

    found: list[list[tuple]] = [[] for _ in texts]
    covered: list[list[tuple[int, int]]] = [[] for _ in texts]
    for (d, ij, part), p in zip(wide, of_wide, strict=True):
        row = judged(d, part, p)
        if row and row[3] != UNKNOWN:
            found[d].append(row)
            covered[d].append(ij)
    for (d, (i, j), each), (_, part), p in zip(met, merged, of_runs, strict=True):
        if any(a <= i and j <= b for a, b in covered[d]):
            continue
        row = judged(d, part, p)
        if row and row[3] != UNKNOWN:
            found[d].append(row)
            continue
        single = [r for k in range(i, j) if (r := judged(d, laid[d][1][k], each[k - i])) and r[3] != UNKNOWN] if j - i > 1 else []
        # what looked like a licence line by line stays in sight, whatever it looks like as a whole
        lone = [r for k in range(i, j) if (r := judged(d, laid[d][1][k], each[k - i]))]
        found[d] += single or ([row] if row else lone)
    for rows in found:
        # windows overlap: what is unknown about a confirmed paragraph is no news
        sure = sorted((r[1], r[2]) for r in rows if r[3] != UNKNOWN)
        reach = list(accumulate((e for _, e in sure), max))
        before = lambda r: bisect_left(sure, (r[2],)) - 1
        yield sorted((r for r in rows if r[3] != UNKNOWN or before(r) < 0 or reach[before(r)] <= r[1]), key=lambda r: r[1:3])
