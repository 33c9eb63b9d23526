import random
from collections import defaultdict

import numpy as np
import pytest

from foldloom.llm import overlap_join
from foldloom.llm.components import components, joined

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def brute(rows, words, groups):
    sets = {}
    for doc, text in rows:
        own = words((text or "").encode().translate(bytes.maketrans(UPPER, LOWER)).decode())
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
        sets[doc] = grams
        groups.find(doc)
    holders, shared = defaultdict(list), defaultdict(int)
    for doc, grams in sets.items():
        for gram in grams:
            holders[gram].append(doc)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    smallest = groups.smallest()
    return {doc: (len(grams), smallest[doc]) for doc, grams in sets.items()}


def near_copies(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x"]
    rows = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 90))]
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            own += [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 0, 1, 5]))]
            text = " ".join(own)
            rows.append((len(rows), text.upper().replace("É", "é") if rnd.random() < 0.3 else text))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  B")]


@pytest.mark.parametrize("limits", [{}, {"block_tokens": 150, "block_sets": 3}])
def test_classes_match_brute_force(spark, words, groups, limits):
    rows = near_copies(4)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    found = overlap_join.duplicate_classes(docs, **limits).collect()
    want = brute(rows, words, groups)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert len(found) == len(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_test_documents_match_brute_force(spark, documents, words, groups):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = overlap_join.duplicate_classes(documents).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, words, groups)


def test_defined_cases(spark):
    rows = [(3, "a b"), (None, "A b"), (6, "x y z w v u"), (6, "q r s"), (7, "q r s"), (8, "x y z w v u"), (8, "x y z w v u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["component_id"]) for r in overlap_join.duplicate_classes(docs).collect()))
    assert found == [(0, 3), (3, 3), (6, 6), (6, 6), (7, 6), (8, 6), (8, 6)]
    assert overlap_join.duplicate_classes(docs.limit(0)).count() == 0
    assert overlap_join.duplicate_classes(spark.createDataFrame([(1, None)], docs.schema)).first()[:] == (1, 0, 1)


def test_rows_without_an_id_are_bridges(spark):
    """The middle one links two documents that do not link with each other."""
    base = [f"w{i}" for i in range(60)]
    a, b, c = base[:50], base[3:53], base[6:56]
    for middle, want in ((None, [1, 1, 1]), (9, [1, 1, 1])):
        rows = [(1, " ".join(a)), (middle, " ".join(b)), (2, " ".join(c)), (None, "only nameless ones here now"),
                (None, "Only nameless ones here now")]
        found = overlap_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r["component_id"] for r in found if r["component_id"]) == want
        assert len({r["component"] for r in found}) == 2 and sum(r["component_id"] is None for r in found) == 2


@pytest.mark.parametrize("limits", [{}, {"block_tokens": 150, "block_sets": 3}])
def test_missing_and_repeated_ids_match_brute_force(spark, words, groups, limits):
    rows = near_copies(8)
    rnd = random.Random(2)
    ids = [rnd.choice([None, i, i, i, i // 3]) for i in range(len(rows))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], "doc_id long, text string")
    component = brute([(n, t) for n, (_, t) in enumerate(rows)], words, groups)
    least = {}
    for n, (_, c) in component.items():
        least[c] = min((i for i in (least.get(c), ids[n]) if i is not None), default=None)
    want = sorted(((ids[n], size, least[c]) for n, (size, c) in component.items()), key=repr)
    found = overlap_join.duplicate_classes(docs, **limits).collect()
    assert sorted(map(tuple, found), key=repr) == want


def test_stage_keeps_one_row_of_each_component(spark, words, groups):
    from foldloom.llm import stages

    rows = near_copies(8)
    rnd = random.Random(2)
    ids = [rnd.choice([None, i, i, i, i // 3]) for i in range(len(rows))]
    table = [(i, t, "en", "s", n, 1.5) for n, (i, (_, t)) in enumerate(zip(ids, rows, strict=True))]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, component double")
    component = brute([(n, t) for n, (_, t) in enumerate(rows)], words, groups)
    kept = stages.near_duplicates(spark, docs, "").collect()
    assert docs.columns == list(kept[0].asDict())
    of = lambda n: component[n][1] if component[n][0] else ("alone", n)
    assert sorted(map(str, (of(r["n_chars"]) for r in kept))) == sorted({str(of(n)) for n in component})
    for r in kept:
        own = [ids[n] for n in component if of(n) == of(r["n_chars"]) and ids[n] is not None]
        assert r["doc_id"] == (min(own) if own else None)
    assert stages.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_divide_skip_counts_overlaps():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 80, rnd.integers(1, 60)).astype(np.uint64)) for _ in range(300)]
    lists = overlap_join.InvertedLists(sets, np.arange(len(sets)))
    alive = rnd.random(len(sets)) < 0.8
    for least in (1, 4, 12):
        for i in range(0, 300, 17):
            found, count = lists.candidates(sets[i], least, alive)
            want = {j: n for j in np.flatnonzero(alive).tolist() if (n := len(np.intersect1d(sets[i], sets[j]))) >= least}
            assert dict(zip(found.tolist(), count.tolist(), strict=True)) == want


def test_components(spark, groups):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    for a, b in edges:
        groups.join(a, b)
    want = {x: c for x, c in groups.smallest().items() if any(x in e and e[0] != e[1] for e in edges)}
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r["node"]: r["component"] for r in components(table).collect()} == want
    nodes, root = joined(*(np.array(x) for x in zip(*edges, strict=True)))
    assert {n: r for n, r in zip(nodes.tolist(), root.tolist(), strict=True) if n in want} == want
    assert components(table.limit(0)).count() == 0
