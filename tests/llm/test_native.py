import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.odd import documents, texts
from tidemark.llm import chat_format, pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_statistics_equal_brute_force(spark):
    rows = texts()
    df = documents(spark, rows).withColumn("n_words", F.lit("clash"))
    out = quality_rules.judge(df, [], keep=["doc_id", "n_words"]).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute_statistics(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_rules_separate_labelled_noise(spark):
    good = "plain words that say something new each time {} and go on for a while until the line has said enough of it all"
    bad = "### $$$ {} %%% &&& *** ||| <<< >>> ### $$$ %%% &&& *** and so on &&& with ### more $$$ symbols %%% than words ***"
    rows = [(good if i % 4 else bad).format(" ".join(f"w{i}x{k}" for k in range(i % 7 + 5))) for i in range(400)]
    df = documents(spark, rows)
    labels = df.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    rules = quality_rules.fit_rules(df, labels)
    assert rules and all(str(r) for r in rules)
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, rules, keep=["doc_id"]).collect()}
    assert all(out[i] == bool(i % 4) for i in range(300, 400))
    empty = df.limit(0)
    assert quality_rules.fit_rules(empty, labels) == []
    assert quality_rules.judge(empty, rules).count() == 0


def test_stuffed_words_without_symbols_are_rejected(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    known = [word() for _ in range(200)]
    rows = [" ".join(rnd.choice(known) for _ in range(rnd.randint(30, 90))) for _ in range(400)]
    stuffed = range(0, 400, 40)
    for i in stuffed:
        rows[i] = " ".join(w for w in rnd.sample(known, 10) for _ in range(5))
    df = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i not in stuffed)) for i in range(320)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(df, labels)
    out = {r["doc_id"]: r for r in quality_rules.judge(df, rules, keep=["doc_id"]).collect()}
    assert not any(out[i]["base_failed"] or out[i]["n_symbols"] for i in range(400))
    assert {i for i in range(400) if not out[i]["kept"]} == {*stuffed}
    assert [out[i]["n_distinct_words"] for i in range(400)] == [len(set(t.split(" "))) for t in rows]


def test_covering_goes_on_after_a_rule_that_is_not_believed():
    rnd = random.Random(2)
    row = lambda **given: {name: given.get(name, rnd.random()) for name in quality_rules.FEATURES}
    rows = [(row(words=rnd.random(), symbol_share=0.0, mark_share=0.0), False) for _ in range(900)]
    # many bad rows in a region that good ones share, few in one of their own
    rows += [(row(words=0.5 + rnd.random() / 20, symbol_share=0.0, mark_share=0.0), True) for _ in range(60)]
    rows += [(row(symbol_share=0.0, mark_share=0.5 + rnd.random()), True) for _ in range(30)]
    rnd.shuffle(rows)
    rules = quality_rules.learn_rules(rows)
    covered = [bad for f, bad in rows if any(r.covers(f) for r in rules)]
    assert sum(covered) >= 28 and sum(covered) >= 0.97 * len(covered)


def test_repeated_keys_count_once(spark, monkeypatch):
    text = "plain words that say number {} and go on for a while until the line has said enough of it all and ends here"
    rows = [(0, text.format(f"n{i}")) for i in range(300)] + [(0, "short")] + [(i, text.format(i)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda rows: seen.extend(rows) or [])
    quality_rules.fit_rules(df, labels, sample=41)
    assert len(seen) == 41 and sum(bad for _, bad in seen) == 21


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(sum(divmod(v * (1 + i % 2), 10)) for i, v in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    rows = texts()
    trees = pii.fit_trees(documents(spark, rows))
    out = pii.find_spans(documents(spark, rows), trees, keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert base == brute_spans(rows[r["doc_id"]])
        assert {tuple(b) for b in base} <= {(s["kind"], s["start"], s["end"]) for s in r["spans"]}


def test_trees_add_secrets_and_redact(spark):
    rows = [f'say token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and version 20 {i} go on' for i in range(60)]
    rows += [f"account 4111 1111 1111 1111 of page 12345678 {i} words" for i in range(60)]
    rows += ["plain words only, nothing here", None, ""]
    df = documents(spark, rows)
    trees = pii.fit_trees(df)
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, trees).collect()}
    assert out[0] == 'say token = "[SECRET]" and version 20 0 go on'
    assert out[60].startswith("account [CARD] of page 12345678")
    assert (out[120], out[121], out[122]) == ("plain words only, nothing here", None, "")
    assert pii.redact(df, trees).columns == df.columns
    assert pii.boost([]).threshold > 1 and pii.fit_trees(df.limit(0)).threshold > 1


def test_numbers_that_fail_luhn_stay(spark):
    def number(i, good):
        digits = [int(c) for c in f"{4000 + i}{(i * 7919 + 13) % 10**11:011d}"]
        total = sum(sum(divmod(v * (2 - k % 2), 10)) for k, v in enumerate(digits))
        return "".join(map(str, digits)) + str((-total + (0 if good else 3)) % 10)

    rows = [f'say token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and go on' for i in range(400)]
    rows += [f"it read {number(i, i % 2)} in the end" for i in range(120)]
    rows += [f"my account {number(i, False)} holds it" for i in range(120, 160)]
    df = documents(spark, rows)
    labels = pii.candidates(df, keep=["doc_id"]).select("doc_id", F.explode("proposed").alias("p")).where("p.kind = 'account'")
    assert {r["doc_id"]: r["label"] for r in labels.select("doc_id", "p.label").collect()} == {400 + i: int(i % 2 or i >= 120) for i in range(160)}
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.fit_trees(df)).collect()}
    assert all(out[400 + i] == ("it read [CARD] in the end" if i % 2 else rows[400 + i]) for i in range(120))
    assert all("[SECRET]" in out[i] for i in range(400)) and all("[ACCOUNT]" in out[i] for i in range(520, 560))


def test_positions_take_time_by_length(spark):
    mixed = [" ".join(f"u{i}@ex.org 10.0.{i % 256}.7 +1 (222) 555-{i % 9000 + 1000} 4111111111111111" for i in range(9000))]
    rows = [",".join(str(10 + i % 90) for i in range(200_000)), " ".join("7" for _ in range(300_000)) + "x", ",".join(str(1_000_000 + i) for i in range(60_000)), *mixed, "😀9" * 100_001]
    assert min(map(len, rows)) > 200_000 and max(map(len, rows)) > 500_000
    df = documents(spark, rows).repartition(5)
    began = time.perf_counter()
    out = {r["doc_id"]: r["base"] for r in pii.find_spans(df, pii.Trees(0.0, (), 2.0), keep=["doc_id"]).collect()}
    text = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.Trees(0.0, (), 2.0)).collect()}
    assert time.perf_counter() - began < 60
    for i, t in enumerate(rows):
        want = brute_spans(t)
        assert [(s["kind"], s["start"], s["end"]) for s in out[i]] == want
        at, cut = 0, []
        for kind, start, end in sorted(want, key=lambda s: s[1]):
            cut += [t[at:start], f"[{kind.upper()}]"]
            at = end
        assert text[i] == "".join([*cut, t[at:]])


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "x", 2.0, "y", "z"), (2, None, None, None, None, None)], "doc_id long, text string, base string, spans double, Proposed string, `a.b` string")
    trees = pii.fit_trees(df)
    assert [tuple(r) for r in pii.redact(df, trees).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", "x", 2.0, "y", "z"), (2, None, None, None, None, None)]
    found = pii.find_spans(df, trees)
    assert found.columns == ["doc_id", "text", "Proposed", "a.b", "base", "spans"] and found.orderBy("doc_id").first()["a.b"] == "z"


def test_running_folds(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.range(1).select(F.expr(pii.running(f"slice(sequence(1, 2000), 1, {n})", "{} + {}".format, "0")).alias("r")).first()["r"]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_held_out_secrets_without_their_announcement(spark):
    rnd = random.Random(3)
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(700)]
    words = ["plain", "words", "2020-report", "chapter-eleven-of-12-in-all", "part_of_the_story_3", "id=8"]
    rows = [" ".join(rnd.choice(words) for _ in range(12)) + f' token = "{h}" ' + rnd.choice(words) for h in hexes[:600]]
    rows += [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(600)]
    df = documents(spark, rows)
    fitted, held_out = pii.labelled_cells(df)
    trees = pii.boost(fitted, held_out=held_out)
    measured = pii.accuracy(trees, held_out)
    assert measured["positives"] > 100 and measured["precision"] > 0.95 and measured["recall"] > 0.95
    unannounced = documents(spark, [f'hash = "{h}" and more' for h in hexes[600:]])
    assert all("[SECRET]" in r["text"] for r in pii.redact(unannounced, trees).collect())
    for name in pii.SHAPE:
        assert name not in ("announced", "luhn")


def test_threshold_lets_no_group_ride_on_others():
    assert pii._threshold([(0.9, 1000, 0), (0.6, 50, 40)], 0.9) == 0.9
    assert pii._threshold([(0.9, 100, 0), (0.8, 0, 1), (0.7, 100, 0)], 0.9) == 0.7
    assert pii._threshold([(0.9, 0, 0), (0.5, 1, 3)], 0.9) == 2.0 and pii._threshold([], 0.9) == 2.0


@pytest.mark.parametrize("spread", [1 << 28, 40])
def test_chat_round_trip(spark, monkeypatch, spread):
    monkeypatch.setattr(chat_format, "SPREAD", spread)
    odd = ["", "\\", "\\\\h", "###", "####", "</turn>", "</turn>\n", "</turn", "\\### Assistant: </turn> ok", "a: b", "é😀\n\n### x", None]
    rows = [(c, t, ("user", "assistant", "sys:tem </turn>", None)[(c + t) % 4], odd[(c * 5 + t) % len(odd)]) for c in range(12) for t in range(c % 6 + 1)]
    rows += [(None, None, "assistant", "lost"), (None, 1, "user", "x"), (3, 0, "assistant", "again"), (3, 0, "assistant", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat_format.expand_turns(df)
    got = examples.select("*", chat_format.trained_text(examples).alias("loss"), chat_format.parsed_turns(F.col("formatted")).alias("turns")).collect()
    key = lambda v: (v is not None, v)
    for conv in {r[0] for r in rows}:
        turns = sorted([(key(r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        mine = sorted([g for g in got if g["conv_id"] == conv], key=lambda g: g["n_turns"])
        assert [tuple(t) for t in mine[-1]["turns"]] == [t[1:] for t in turns] and [g["last"] for g in mine] == [False] * (len(mine) - 1) + [True]
        trained = [g for g in mine if g["target_turn"] is not None]
        assert [g["loss"] for g in trained] == [t[2] for t in turns if t[1] == "assistant"]
        for g in trained:
            assert [tuple(t) for t in g["turns"]] == [t[1:] for t in turns[: g["target_turn"] + 1]]
    assert chat_format.expand_turns(df.limit(0)).count() == 0
