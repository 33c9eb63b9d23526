import math
from collections import Counter, defaultdict

import pytest
import regex

from foldloom.llm import language_id as li

WORD = regex.compile(r"\p{L}+")


def grams(word, n):
    word = f" {word} " if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def brute(docs, share, longest):
    """Scoring function of the method, written out plainly."""
    counts = defaultdict(lambda: defaultdict(Counter))
    for text, lang in docs:
        for w in WORD.findall((text or "").lower()) if lang is not None else []:
            counts[0][lang][w] += 1
            for n in range(1, longest + 1):
                for g in grams(w, n):
                    counts[n][lang][g] += 1
    langs = sorted(counts[0], key=lambda k: (-counts[0][k].total(), k))

    def logs(n, term):
        found = [counts[n][k][term] / counts[n][k].total() if counts[n][k] else 0 for k in langs]
        return [math.log(max(f, share / 10)) for f in found] if max(found) >= share else None

    def word(w):
        if row := logs(0, w):
            return row
        for n in range(longest, 0, -1):
            rows = [r for g in grams(w, n) if (r := logs(n, g))]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows, strict=True)]

    def judge(text):
        words = WORD.findall((text or "").lower())
        if not words or not langs:
            return "und", 0.0
        rows = [r for w in words if (r := word(w))] or [[0.0] * len(langs)]
        mean = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        best = max(range(len(langs)), key=lambda i: mean[i])
        return langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)

    return judge


TEXTS = [
    ("the cat and the dog sat on the mat", "en"), ("the house is on the hill and the dog is there", "en"),
    ("der Hund und die Katze sind im Haus", "de"), ("die Straße ist schön und der Hund ist müde", "de"),
    ("le chat et le chien sont à la maison", "fr"), (None, "fr"), ("", "de"), ("words without a language", None),
]
ASKED = ["The Dogs", "Häuser und Straßen", "chats, chiens!", "xqz", "王", "12 34 _", "", None, "der the le", "the " * 100_000]


@pytest.mark.parametrize("share", [1e-5, 0.04, 0.3])
def test_equals_brute_force(spark, share):
    learned = spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(TEXTS)], "text string, lang string, term int")
    model = li.learn(learned, share=share)
    asked = spark.createDataFrame([(i, t, "x", 5.0) for i, t in enumerate(ASKED)], "doc_id long, text string, lang string, score double")
    out = li.identify(asked, model)
    assert out.columns == ["doc_id", "lang", "lang_pred", "score"]
    judge = brute(TEXTS, share, li.LONGEST)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in enumerate(ASKED):
        lang, score = judge(text)
        assert (got[i]["lang_pred"], got[i]["lang"]) == (lang, "x")
        assert got[i]["score"] == pytest.approx(score) and 0 <= got[i]["score"] <= 1


def test_unseen_words_fall_back_to_shorter_grams(spark):
    model = li.learn(spark.createDataFrame(TEXTS, "text string, lang string"))
    assert model.known[0].get("hunde") is None and "hund" in model.known[4]
    own = model.word("hunde")
    assert own[model.languages.index("de")] > own[model.languages.index("en")]
    assert model.word("王") is None


def test_forgetting_changes_nothing(spark, monkeypatch):
    model = li.learn(spark.createDataFrame(TEXTS, "text string, lang string"))
    before = [model.judge(t) for t in ASKED]
    monkeypatch.setattr(li, "REMEMBERED", 1)
    assert [model.judge(t) for t in ASKED] == before


def test_nothing_to_learn_and_empty_tables(spark):
    model = li.learn(spark.createDataFrame([("a", None)], "text string, lang string"))
    asked = spark.createDataFrame([(1, "hello"), (1, "hello")], "doc_id long, text string")
    assert [tuple(r) for r in li.identify(asked, model).collect()] == [(1, "und", 0.0)] * 2
    assert li.identify(asked.limit(0), model).count() == 0


def test_held_out_accuracy(spark, sf):
    from foldloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op13_language_id"](spark, sf).join(docs, "doc_id").collect()
    held_out = [r for r in rows if r["held_out"]]
    assert len(held_out) > 50 and sum(r["lang"] == r["lang_pred"] for r in held_out) > 0.97 * len(held_out)
