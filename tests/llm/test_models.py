"""Learned operators: held-out accuracy, odd rows, small samples."""

import random

import numpy as np
import pytest

from tidemark.llm import languages, quality, toxicity

ROWS = "doc_id long, text string, score string, label string"
ODD = [(9001, None), (9002, ""), (9003, "x" * 50_000), (9004, "same"), (9004, "same")]


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for w in ["idiot", "vexatron" + rng.choice("abc")]:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(w.upper() + "!!" if poor else w for w in words)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(random.Random(1))
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows + ODD], ROWS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("score", "drop", "at"), [(toxicity.score_toxicity, toxicity.drop_toxic, 1), (quality.score_quality, quality.drop_poor, 0)])
def test_held_out(tables, score, drop, at):
    docs, labels, truth = tables
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) > 0.95
    assert score(docs, labels.limit(0)).count() == len(rows)
    assert score(docs.limit(0), labels).count() == 0
    kept = drop(docs, labels)
    assert kept.columns == docs.columns
    stay = {r.doc_id for r in kept.collect()}
    good = {i for i, x in truth.items() if x[at] == 1 - at}
    assert len(stay & good) > 0.95 * len(good) and len(stay & (set(truth) - good)) < 0.1 * (len(truth) - len(good))


def test_labels_of_one_kind(tables):
    docs, labels, _ = tables
    assert toxicity.score_toxicity(docs, labels.selectExpr("doc_id", "0 as toxic")).where("predicted is null").count() == 0
    assert quality.score_quality(docs, labels.selectExpr("doc_id", "1 as quality")).where("predicted = 0").count() == 0


def test_isotonic_rises_and_pools():
    at, value = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 1]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()


def test_languages(spark):
    rng = random.Random(2)
    make = lambda lang: " ".join(rng.choice({"aa": ["kata", "kuto", "kari"], "bb": ["zumi", "zole", "zina"]}[lang]) for _ in range(40))
    docs = spark.createDataFrame([(i, make("ab"[i % 2] * 2), "ab"[i % 2] * 2, f"s{i % 2}", "x") for i in range(80)] + [(900, None, None, "s1", "x"), (901, "", None, "s0", "x"), (901, "", None, "s0", "x"), (902, "", None, None, "x")], "doc_id long, text string, lang string, source string, host string")
    page = lambda lang, declared, text: f'<html lang="{declared}"><body><article><p>{text}</p></article></body></html>'
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.site.{'ab'[i % 2] * 2}/x", page("", "ab"[i % 2] * 2, make("ab"[i % 2] * 2))) for i in range(30)] + [(900, "http://h1.site.bb/", page("", "bb", "")), (901, "http://h0.site.aa/", None), (902, None, None)], "page_id long, url string, html string")
    rows = languages.identify_languages(docs, pages).collect()
    assert len(rows) == 84 + 33
    got = {("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id): r.lang for r in rows}
    assert all(got["d", i] == "ab"[i % 2] * 2 for i in range(80)) and all(got["p", i] == "ab"[i % 2] * 2 for i in range(30))
    assert (got["d", 900], got["d", 901], got["p", 900], got["p", 901]) == ("bb", "aa", "bb", "aa")
    assert languages.identify_languages(docs.limit(0), pages).where("lang is null").count() == 33
    assert languages.identify_languages(docs, pages.limit(0)).count() == 84


def test_many_and_rare_languages(spark):
    rng = random.Random(5)
    names = [a + b for a in "abcdefghijkl" for b in "pqrstu"][:70]
    words = {name: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for name in names}
    langs = names[:1] * 200 + [name for name in names[1:] for _ in range(6)]
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, None) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found, table = languages.learn(docs, "lang", 5, 0, 3, "text", "doc_id")
    assert sorted(found) == sorted(names) and (table.max(0) > table.min(0)).all()
    few = docs.where(docs.lang.isin(names[:3]))
    got = {r.doc_id: r.lang for r in languages.identify_languages(few, pages, sample=3).collect()}
    assert got == {i: lang for i, lang in enumerate(langs) if lang in names[:3]}


def test_languages_by_whole_primary_subtags(spark):
    text = {"en": "the cat and the dog went over the hill", "zh": "这是一个测试 文本 我们 在 这里", "english": "ye olde shoppe of yore"}
    labels = ["en", "en-US", "en_GB", "EN", "zh-Hans", "zh-Hant", "english", "", "-", None]
    docs = spark.createDataFrame([(n, text.get((label or "").replace("_", "-").split("-")[0].lower(), "x"), "s", label) for n, label in enumerate(labels * 8)], "doc_id long, text string, source string, lang string")
    names, _ = languages.learn(docs, "lang", 5, 0, 100, "text", "doc_id")
    assert sorted(names) == ["en", "english", "zh"]


def test_salted_tables_give_what_broadcast_ones_do(spark, monkeypatch):
    rows = [(n, ["the cat and the dog", "le chat et le chien"][n % 2], ["a", "b", None][n % 3], ["en", "fr"][n % 2]) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    pages = spark.createDataFrame([(n, f"http://h{n % 3}.fr/x", [None, "<html lang='fr'><p>le chat</p>", "<p>the dog</p>"][n % 3]) for n in range(20)], "page_id long, url string, html string")
    found = lambda: sorted(((r.doc_id, r.page_id, r.lang, round(r.probability, 9)) for r in languages.identify_languages(docs, pages).collect()), key=str)
    want = found()
    monkeypatch.setattr(languages, "BROADCAST_NUMBERS", -1)
    assert found() == want
