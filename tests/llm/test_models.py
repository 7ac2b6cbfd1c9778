"""Operators with trained models: held-out accuracy, brute force and odd inputs."""

import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import documents, texts
from tidemark.llm import decontamination, language_id, license_scan, shingles

SYLLABLES = {"en": ["the", "tion", "ing", "wh", "er", "and"], "de": ["sch", "ung", "keit", "ü", "ein", "ver"], "fr": ["eau", "que", "é", "ment", "oi", "ç"], "es": ["ción", "ñ", "dad", "ll", "os", "rr"]}


def prose(lang, rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_language_of_held_out_texts(spark):
    rnd = random.Random(4)
    rows = [(i, prose(lang, rnd, rnd.randint(4, 60)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    odd = [(1000 + i, t, None) for i, t in enumerate(["", None, "12 34 !!", "\n\t", "日本語", "x", *texts()])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    made = language_id.fit_prototypes(df.where("floor(doc_id / 4) % 5 > 0"))
    out = {r["doc_id"]: r for r in language_id.predict(df, made).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [r for r in rows if r[0] // 4 % 5 == 0]
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.97
    assert [(out[1000 + i]["lang_pred"], out[1000 + i]["score"]) for i in range(4)] == [("und", 0.0)] * 4
    assert out[1004]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.fit_prototypes(df.limit(0)) == {} and language_id.predict(df.limit(3), {}).first()["lang_pred"] == "und"


def test_ngram_vectors_are_bound_letters():
    v = language_id.Vectors(64)
    grams, counts = v.grams("Aab ab!")
    assert counts.sum() == len("_aab_ab_") - 2
    a, b, space = (v.of_letter(ord(c)) if c != " " else v.of_letter(0) for c in "ab ")
    want = {"_aa": (space, a, a), "aab": (a, a, b), "ab_": (a, b, space), "b_a": (b, space, a), "_ab": (space, a, b)}
    total = sum(np.roll(x, 2) * np.roll(y, 1) * z * (2 if k == "ab_" else 1) for k, (x, y, z) in want.items())
    both = v.bundles([(grams, counts), v.grams("zq ab"), (grams[:1], counts[:1])])
    assert (both[0] == total).all() and len(v.bundles([])) == 0


def brute_leaks(docs, items, percent):
    out = {}
    for i, text in items:
        w = (text or "").encode().lower().split()
        if i is None or not w:
            continue
        width = min(5, len(w))
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        for d, t in docs:
            v = (t or "").encode().lower().split()
            n = len(own & {tuple(v[k : k + width]) for k in range(len(v) - width + 1)})
            if d is not None and 100 * n >= percent * len(own):
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(own)))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 9, 12, 20, 33, 60, 120, 300])]
    items += [(50, None), (51, ""), (None, "a b c d e f"), (9, "one more text of that id here")]
    docs = [(100 + i, t) for i, t in enumerate(texts())]
    for i in range(150):
        item = rnd.choice(items[:11])[1].split()
        cut = rnd.choice([1, 0.95, 0.85, 0.8, 0.75, 0.5])
        n = max(1, round(len(item) * cut))
        held = item[:n] if i % 2 else [x if rnd.random() < cut + 0.1 else "edit" for x in item]
        body = [word() for _ in range(rnd.choice([0, 20, 3000]))]
        at = rnd.randint(0, len(body))
        docs.append((1000 + i, " ".join([*body[:at], *held, *body[at:]]).upper()))
    docs += [(None, items[5][1]), (1000, items[6][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    for percent in (80, 100):
        got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.find_leaks(left, right, percent).collect()}
        want = brute_leaks([d for d in docs if d[0] != 1000], items, percent)
        assert {k: v for k, v in got.items() if k[0] != 1000} == want
    clean = decontamination.decontaminated(left, right)
    assert clean.columns == left.columns and not {r["doc_id"] for r in clean.collect()} & {d for d, _ in brute_leaks(docs, items, 80)}
    assert decontamination.find_leaks(left, right.limit(0)).count() == 0 and decontamination.find_leaks(left.limit(0), right).count() == 0


def test_repeated_items_are_texts_of_their_own(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    half = words("a", 12)
    docs = [(1, half + " " + words("x", 9)), (2, words("a", 24)), (3, words("b", 24)), (3, words("c", 24)), (None, words("a", 24))]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    # identical rows, texts of one size under one id, one text under two ids
    items = [(7, words("a", 24)), (7, words("a", 24)), (8, words("a", 12) + " " + words("b", 12)), (8, words("b", 12) + " " + words("a", 12)), (9, words("b", 24)), (9, words("c", 24)), (10, words("c", 24))]
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.find_leaks(left, right).collect()}
    assert got == brute_leaks(docs[:3], items, 80) | {(3, 9): (20, 20), (3, 10): (20, 20)}
    assert (1, 7) not in got and (1, 8) not in got and (2, 7) in got
    assert {r["doc_id"] for r in decontamination.decontaminated(left, right).collect()} == {1, None}


def test_shingles_that_all_items_share(spark):
    template = " ".join(f"t{i}" for i in range(30))
    items = [(i, f"{template} q{i}a q{i}b q{i}c q{i}d q{i}e q{i}f q{i}g") for i in range(300)]
    docs = [(i, template + f" other words here {i} " + " ".join(f"o{i}x{k}" for k in range(20))) for i in range(200)] + [(1000 + i, items[i][1]) for i in range(0, 300, 7)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.find_leaks(left, right).collect()}
    assert got == brute_leaks(docs, items, 80) and len(got) >= 43


def test_partitions_lose_no_more_than_their_sizes():
    for top in (1, 2, 4, 8, 64, 128, 4096):
        k, need = decontamination.partition_plan(top, 80)
        assert k == min(top // 2 + 1, 32) and 1 <= need <= k
        for size in {top // 2 + 1, top}:
            assert need <= decontamination.plan_for(size, 80, k)[1]


def test_sketch_plans_keep_the_chance_to_miss():
    assert decontamination.plan_for(1, 80) == (1, 1)
    for size in (5, 40, 500):
        k, need = decontamination.plan_for(size, 80)
        assert k == min(size, 32) and 1 <= need <= k


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(2)
    return license_scan.train([prose(lang, rnd, 30) for lang in SYLLABLES for _ in range(40)])


def test_licences_of_every_family(spark, model):
    rnd = random.Random(9)
    rows, want = [], {}
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            want[len(rows)] = family
            rows.append(f"{prose('en', rnd, 20)}\n  {t}\n{prose('de', rnd, 300)}")
    plain = [prose("fr", rnd, 50), None, "", *license_scan.OTHERS, "the license of software is free to the public", *texts()]
    out = license_scan.scan(documents(spark, rows + plain), model).collect()
    named = {(r["doc_id"], r["family"]) for r in out if r["family"] != "unknown"}
    found = sum((i, f) in named for i, f in want.items())
    assert found >= 0.95 * len(want) and named <= set(want.items())
    for r in out:
        if r["doc_id"] in want:
            assert rows[r["doc_id"]][r["start"] : r["end"]].strip() in license_scan.TEMPLATES[want[r["doc_id"]]]
    assert license_scan.scan(documents(spark, []), model).count() == 0
    long = "x " * 5000 + license_scan.TEMPLATES["MIT"][2] + " y" * 5000
    assert "MIT" in {r["guess"] for r in license_scan.scan(documents(spark, [long]), model).collect()}


def scanned(model, text):
    return next(iter(license_scan._scanned(model, model.tables(), [1], [text], license_scan.LEAST_SIMILARITY)))


def test_wrapped_notices_are_paragraphs(model):
    gpl = license_scan.TEXTS["GPL-3.0"][0]
    for width in (40, 60, 72):
        text = "before all this\n\n" + textwrap.fill(gpl, width) + "\n\n" + textwrap.fill(license_scan.TEXTS["MIT"][0], width, initial_indent="# ", subsequent_indent="# ") + "\n\nwords after"
        rows = scanned(model, text)
        assert [(r[3], " ".join(text[r[1] : r[2]].split()[:4])) for r in rows] == [("GPL-3.0", "This program is free"), ("MIT", "# Permission is hereby")]
    whole = "\n\n".join(textwrap.fill(t, 70) for t in license_scan.TEXTS["ISC"])
    assert {r[3] for r in scanned(model, whole)} == {"ISC"} and len(scanned(model, whole)) == 2
    buried = "x y " * 400 + "Released under the MIT License. " + "z w " * 400
    assert {r[3] for r in scanned(model, buried)} == {"MIT"}
    # a statement wrapped inside a block of other words, and one that no template has
    inside = "some words of a readme that says a thing\nThis work is licensed under the GNU General\nPublic License, version 2.\nand other words go on here"
    assert [r[3] for r in scanned(model, inside)] == ["GPL-2.0"]
    assert not any(r[3] != "unknown" for r in scanned(model, "Licensed under the terms of the Example Software License, version 9, by the license foundation"))


def test_scores_and_similarities_equal_brute_force(model):
    rnd = random.Random(4)
    every = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    lines = [" ".join(rnd.choice(every).split()[: rnd.randint(1, 40)]) + " " + prose("en", rnd, rnd.randint(0, 30)) for _ in range(60)] + [t for t in texts() if t]
    words, parts = license_scan.layout("\n".join(lines))
    number, *_ = tables = model.tables()
    ids = np.array([number.get(w, -1) for w in words], dtype=np.int64)
    got = model.probabilities(model.logits(ids, np.array([p.first for p in parts]), np.array([p.last for p in parts]), tables))
    for p, q in zip(parts, got, strict=True):
        own = words[p.first : p.last]
        score = model.weights[-1].astype(float) + sum((model.weights[model.vocabulary[g]].astype(float) for g in license_scan.grams(own) if g in model.vocabulary), np.zeros(len(model.families))) / len(own) ** 0.5
        want = np.exp(score / model.temperature)
        assert np.allclose(q, want / want.sum(), atol=1e-5)
    for text in lines[:40]:
        own = license_scan.tokens(text)
        for family in ("MIT", "GPL-3.0", "CC0", "BSD"):
            best = 0.0
            templates = [license_scan.tokens(t) for t in license_scan.TEMPLATES[family]]
            if len(license_scan.TEXTS[family]) > 1:
                templates.append([w for t in license_scan.TEXTS[family] for w in license_scan.tokens(t)])
            for t in templates:
                ref = {tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))}
                mine = [tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
                hits = [i for i, x in enumerate(mine) if x in ref]
                if hits:
                    span = set(mine[min(hits) : max(hits) + 1])
                    best = max(best, len(span & ref) / len(span | ref))
            assert license_scan.similarity(family, own) == best


def test_families_that_were_not_learned_are_unknown(monkeypatch):
    rnd = random.Random(7)
    unknown = ("Zlib", "EPL-2.0", "OFL-1.1")
    texts_ = [t for f in unknown for t in license_scan.TEMPLATES[f]]
    monkeypatch.setattr(license_scan, "TEMPLATES", {f: ts for f, ts in license_scan.TEMPLATES.items() if f not in unknown})
    license_scan._groups.cache_clear()
    made = license_scan.train([prose(lang, rnd, 30) for lang in SYLLABLES for _ in range(20)])
    license_scan._groups.cache_clear()
    assert not [r for t in texts_ for r in scanned(made, t) if r[3] != "unknown"]


def test_licence_columns_and_odd_rows(spark, model):
    df = spark.createDataFrame([(None, "Released under the MIT License.", "x"), (3, None, "y"), (4, "a\n" * 50_000 + "Released under the MIT License.\n" + "word " * 150_000, "z")], "doc_id long, text string, family string")
    rows = license_scan.scan(df, model).collect()
    assert {(r["doc_id"], r["family"], r["start"]) for r in rows} == {(None, "MIT", 0), (4, "MIT", 100_000)}


def test_shared_shingles_of_short_items():
    assert len(shingles.window_hashes(shingles.word_hashes("a b"), 5)) == 1
    assert len(pa.array([1])) == 1
