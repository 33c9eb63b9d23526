import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldloom.llm import merkle_manifest as mm


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each node the pairs of siblings before and after it on the way up."""
    paths, at, groups = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        runs = [(at[i : i + 16], groups[i : i + 16]) for i in range(0, len(at), 16)]
        for run, members in runs:
            for slot, own in enumerate(members):
                for i in own:
                    paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at = [digest("".join(run)) for run, _ in runs]
        groups = [sum(members, []) for _, members in runs]
    return at[0], paths


def brute(rows, changed):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {
        s: sorted(
            ((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), i) for i, r in enumerate(rows) if r["source"] == s)
        )
        for s in sources
    }
    trees = {s: tree([x[2] for x in own[s]]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for (_, _, digest_, i), path in zip(own[s], trees[s][1], strict=True):
            row, path = rows[i], path + above
            text = row["text"]
            folded = leaf(row, text.translate(LOWER) if text is not None and changed(row) else text)
            for before, after in path:
                folded = digest(before + folded + after)
            proof = digest("".join(b + a for b, a in path))
            out.append((row["doc_id"], digest_, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree int, digest string"


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    changed = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    return docs.collect(), mm.manifest(docs, changed, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def case(kind):
    draw = random.Random(kind)
    text = lambda: draw.choice([None, "", "a", "Ab é ÀÉ", "WORD " * 50])
    hot = [(i, "hot", "en", 3, text()) for i in draw.sample(range(10_000), 16 * 16 + 40)]
    if kind == "mixed":
        rows = hot + [(i, f"s{i % 20}é", draw.choice(["de", None]), None, text()) for i in range(90)]
        rows += [(5, None, None, None, None), (None, None, "x", 1, "A"), (7, "", "x", 1, "A"), (8, "alone", "x", 1, "A" * 300_000)]
        rows += [(3, "hot", "en", 3, "Same")] * 40 + [(3, "hot", "en", 3, "Other")] * 2
    elif kind == "sources":
        rows = [(i, f"{i % 300}", "en", 1, text()) for i in range(310)]
    elif kind == "one source":
        rows = hot[:16]
    else:
        rows = hot[:1]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["mixed", "sources", "one source", "one row"])
def test_equals_brute_force(spark, kind):
    rows, out = found(spark, case(kind))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = brute(rows, lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0)
    assert got == want
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if kind == "mixed":
        assert {r[-1] for r in got} == {True, False}


def test_empty_table(spark):
    assert found(spark, [])[1].count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    from foldloom.llm.store import Scratch

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', cast(id % 7 as string)) as tree", "id * 7919 % 5000 as key")
    with Scratch(spark) as scratch:
        got = mm.numbered(rows.repartition(9), "tree", ["key"], scratch).collect()
    of = {}
    for r in sorted(got, key=lambda r: r["key"]):
        assert r["pos"] == of.setdefault(r["tree"], 0)
        of[r["tree"]] += 1
    assert all(r["of"] == of[r["tree"]] for r in got)
