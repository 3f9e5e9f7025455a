"""Toxicity and language models: held-out accuracy, exact code lengths, edge cases."""

from __future__ import annotations

import random
import zlib
from math import exp, log2

import numpy as np
import pytest
from helpers import words
from tessella.llm import language, toxicity

BAD = ["wretchling", "gloomsnark", "filthmonger", "spitebag"]


def corpus(spark, n=700, seed=1, misspell=False):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 300)).split()
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            x = rng.choice(BAD)
            if misspell and i % 4 == 2 or rng.random() < 0.1:
                k = rng.randrange(1, len(x))
                x = x[:k] + rng.choice("aeiou0") + x[k:]
            w.insert(rng.randrange(len(w)), x)
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark, misspell=True)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark, odd, none):
    _, labels = corpus(spark, 50)
    docs, _ = corpus(spark, 50)
    for lab in (labels, labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        rows = toxicity.toxicity(odd, lab).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.fit(docs, labels.filter("toxic = 0")).bias < -10 and toxicity.fit(docs, labels.filter("toxic = 1")).bias > 10


def plain_score(model, text):
    """The score of a text by the definition: its worst window of eight words, over at least FILL subwords."""
    w = (text or "").split()
    worst = None
    for i in range(0, len(w), toxicity.WINDOW):
        own = [g for x in w[i : i + toxicity.WINDOW] for g in toxicity.subwords(x)]
        logit = sum(model.logits[g] for g in own) / max(len(own), toxicity.FILL) + model.bias
        worst = logit if worst is None else max(worst, logit)
    x = model.scale * (model.bias if worst is None else worst) + model.shift
    return 1 / (1 + exp(-max(-30, min(30, x))))


def test_scores_equal_a_plain_scorer(spark, odd):
    docs, labels = corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    model.logits = model.logits.astype(np.float32).astype(np.float64)  # as they are broadcast
    both = docs.filter("doc_id < 60").unionByName(odd.select(docs.columns))
    texts = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.score) for r in toxicity.toxicity(docs.unionByName(odd.select(docs.columns)), labels).filter("doc_id < 60 or doc_id is null").collect()), key=str)
    own = toxicity.fit(docs.unionByName(odd.select(docs.columns)), labels)
    own.logits = own.logits.astype(np.float32).astype(np.float64)
    want = sorted(((i, plain_score(own, t)) for i, t in texts), key=str)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
    assert np.allclose([plain_score(model, "one two"), plain_score(model, None)], [model.scores(np.array([model.word("one"), model.word("two")]), np.array([2]))[0], model.scores(np.empty(0, complex), np.array([0]))[0]])


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 100)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2_000)
    seen = []
    monkeypatch.setattr(toxicity, "fit_texts", lambda texts, labels, share: seen.append((texts, labels)) or toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0))
    docs, labels = corpus(spark, 120)
    toxicity.fit(docs, labels)
    texts, marks = seen[0]
    assert max(len(t) for t in texts) <= 100
    for kind in (0, 1):
        assert 1_500 < sum(len(t) for t, m in zip(texts, marks) if m == kind) <= 2_000


def test_subwords_share_grams():
    a, b = set(toxicity.subwords("Wretchling,")), set(toxicity.subwords("wretchIing"))
    assert len(a & b) >= 5 and toxicity.subwords(" .,") == []


def plain_code_length(texts, text):
    """PPM with escape C by dicts: longest context first, contexts seen fewer than LEAST times unknown."""
    counts = [{} for _ in range(language.ORDER + 1)]
    joined = b"\xff".join(texts)
    for k in range(language.ORDER + 1):
        for i in range(k, len(joined)):
            c, s = joined[i - k : i], joined[i]
            if 255 not in c and s != 255:
                counts[k].setdefault(c, {}).setdefault(s, 0)
                counts[k][c][s] += 1
    # a context counts by all that followed it, a text's end included
    times = [{} for _ in range(language.ORDER + 1)]
    for k in range(language.ORDER + 1):
        for i in range(k, len(joined)):
            c = joined[i - k : i]
            times[k][c] = times[k].get(c, 0) + 1
    total = 0.0
    for i, s in enumerate(text):
        p = 1.0
        for k in range(min(language.ORDER, i), -1, -1):
            c = text[i - k : i]
            seen = counts[k].get(c, {})
            if (k and times[k].get(c, 0) < language.LEAST) or not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if s in seen:
                p *= seen[s] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        total -= log2(p)
    return total


def test_code_lengths_are_exact():
    rng = random.Random(3)
    train = [words(rng, 60).encode() for _ in range(5)]
    trees = language.fit_trees({"a": train})
    tests = [words(rng, 30).encode(), b"zq", b"\xc3\xa9t\xc3\xa9 alpha", b"a", train[0]]
    got = trees.code_lengths(tests)[:, 0]
    want = [plain_code_length(train, t) for t in tests]
    assert np.allclose(got, want, rtol=1e-4)


STOCK = {"en": "the house and every water there thing with", "fr": "les maisons avec toujours eaux entre leurs", "de": "häuser und immer wasser zwischen straße", "es": "casas siempre agua entre niños señor"}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(5, 120), STOCK[lang]), lang, "s", 1) for i in range(400) for lang in [rng.choice(list(STOCK))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_held_out(tongues):
    truth = {r.doc_id: r.lang for r in tongues.collect()}
    rows = language.identify_language(tongues).collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97


def test_language_edges(odd, none, tongues):
    trees = language.fit(tongues)
    rows = language.identify_language(odd, trees=trees).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == by[2] == by[3] == by[8] == "und" and by[4] in STOCK
    assert {r.lang_pred for r in language.identify_language(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert language.identify_language(none).count() == 0
    kept = language.with_language(tongues)
    assert kept.columns == tongues.columns and kept.count() == tongues.count()
    assert language.with_language(none).count() == 0


def test_every_language_is_learned(spark):
    """Seventy languages, one with a single text of 1 MB and one rare; the table keeps its bound."""
    rng = random.Random(12)
    letters = [chr(0x100 + k) for k in range(600)]
    stocks = ["".join(rng.choice(letters) if i % 6 else " " for i in range(80)) for _ in range(70)]
    rows = [(100 * k + i, words(rng, 30, stocks[k]), f"l{k}", "s", 1) for k in range(70) for i in range(1, 9 if k else 99)]
    a, b = [i for i in range(90_000, 90_100) if zlib.crc32(str(i).encode()) % 5][:2]
    rows += [(a, words(rng, 200_000, "zo zu za zy"), "long", "s", 1), (b, words(rng, 4, "qa qe qo"), "rare", "s", 1)]
    assert {r[2] for r in rows} == {f"l{k}" for k in range(70)} | {"long", "rare"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    trees = language.fit(df)
    assert len(trees.languages) == 72 and trees.bits.nbytes <= language.TABLE_BYTES
    tests = [(k, words(rng, 20, stocks[k]), None) for k in range(70)] + [(70, words(rng, 20, "zo zu za zy"), None), (71, "qas qeing qoed", None)]
    got = {r.doc_id: r.lang_pred for r in language.identify_language(spark.createDataFrame(tests, "doc_id long, text string, lang string"), trees=trees).collect()}
    assert got == {k: f"l{k}" for k in range(70)} | {70: "long", 71: "rare"}


def test_a_small_table_is_closed_under_shorter_contexts(monkeypatch):
    rng = random.Random(3)
    texts = {"a": [words(rng, 400).encode()], "b": [words(rng, 400, STOCK["fr"]).encode()]}
    free = language.fit_trees(texts)
    monkeypatch.setattr(language, "TABLE_BYTES", 40_000)
    small = language.fit_trees(texts)
    assert small.bits.nbytes <= 40_000 < free.bits.nbytes
    width = int(small.classes.max()) + 1
    assert np.allclose(np.exp2(-small.bits.astype(np.float64)).reshape(-1, width, 2)[:, 1:].sum(1), 1, atol=0.9)
    assert small.predict([words(rng, 20).encode(), words(rng, 20, STOCK["fr"]).encode()])[0] == ["a", "b"]


def test_unlearned_languages_and_gibberish_go(spark, tongues):
    rng = random.Random(5)
    strange = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, "人人生而自由,在尊严和权利上一律平等。" * 5, *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(300)) for _ in range(20))]
    rows = [(10_000 + i, text, None, "s", 1) for i, text in enumerate(strange)]
    rows += [(20_000 + i, words(rng, 60, STOCK["en"]).upper(), None, "s", 1) for i in range(5)]
    left = {r.doc_id for r in language.with_language(tongues.unionByName(spark.createDataFrame(rows, tongues.schema))).collect()}
    assert left == {r.doc_id for r in tongues.collect()} | {20_000 + i for i in range(5)}
