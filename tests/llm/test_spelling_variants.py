import random
import time

import pytest

from foldloom.llm import spelling_variants as sv
from foldloom.llm.store import Scratch


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point is between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute(words, ratio=10):
    out = {}
    for w, n in words.items():
        found = [(x, m) for x, m in words.items() if near(w, x)]
        fit = min(((-m, x) for x, m in found if m >= ratio * n), default=None)
        out[w] = [fit and fit[1], None, n, len(found), fit and -fit[0]]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


@pytest.fixture(scope="module")
def vocabulary():
    draw = random.Random(5)
    words = {}
    stems = ["".join(draw.choices("abÿéo", k=draw.randint(7, 10))) for _ in range(60)]
    stems += ["nation" + "".join(draw.choices("ab", k=k)) for k in (1, 2, 3, 4, 5) for _ in range(12)]
    for stem in stems:
        words[stem] = draw.choice([3, 40, 500, 7000])
        for _ in range(draw.randint(0, 6)):
            at, kind = draw.randrange(len(stem)), draw.randrange(3)
            word = stem[:at] + draw.choice("abÿ") * (kind < 2) + stem[at + (kind > 0) :]
            if len(word) >= 7:
                words[word] = draw.choice([2, 3, 40, 500])
    return words


def found(spark, words, **options):
    rows = sv.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **options).collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("heavy", [sv.HEAVY, 4, 0])
def test_equals_brute_force_however_keys_are_split(spark, vocabulary, heavy):
    want = brute(vocabulary)
    assert found(spark, vocabulary, heavy=heavy) == want
    assert any(r[0] and r[1] != r[0] for r in want.values()) and sum(r[3] for r in want.values()) > 300


def test_pairs_are_found_once(spark, vocabulary):
    with Scratch(spark) as scratch:
        words = scratch.save(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
        pairs = [frozenset((r["a"], r["b"])) for r in sv.near_pairs(words, scratch, heavy=2).collect()]
    assert len(pairs) == len(set(pairs)) == sum(r[3] for r in brute(vocabulary).values()) // 2


def test_runs_keep_accents_and_lower_only_ascii(spark):
    docs = [(1, "ABCDEFG ÉABCDEF abcdef_gh ab×÷cdefg x"), (2, None), (3, ""), (None, "ŁABCDEFG")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n")
    rows = {(r["doc_id"], r["word"]) for r in sv.runs(docs).collect()}
    assert rows == {(1, "abcdefg"), (1, "Éabcdef"), (1, "ab×÷cdefg"), (None, "abcdefg")}
    words = sv.counted(sv.runs(docs)).collect()
    assert [(r["word"], r["n"]) for r in words] == [("abcdefg", 2)]


def test_ties_repeats_nulls_and_long_words(spark):
    long = "ab" * 20_000
    words = [("abcdefg", 5), ("abcdefh", 50), ("abcdefi", 50), ("abcdefg", 0), (None, 9), ("abcdefx", None), ("abc", 3)]
    words += [(long, 20), (long[:77] + "x" + long[78:], 2), (long + "b", 1)]
    began = time.time()
    rows = sv.variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert time.time() - began < 60
    rows = {r["word"]: r for r in rows}
    assert len(rows) == 6 and rows["abcdefg"]["form"] == "abcdefh" and rows["abcdefg"]["n_near"] == 2
    assert rows[long + "b"]["root"] == long and rows[long]["n_near"] == 2
    assert rows[long[:77] + "x" + long[78:]]["form"] == long
    empty = sv.variants(spark.createDataFrame([], "word string, n long"))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
