import random
import sys
from pathlib import Path

import pytest

from foldloom.llm.quotations import link

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import compare  # noqa: E402
from foldloom.llm.queries import OP3_SQL  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def linked(spark, rows):
    rows = link(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    return [(r["conv_id"], r["turn"], r["text"], r["parent_turn"], r["root_turn"], r["depth"], r["n_quoted"], r["n_linked"]) for r in rows]


def test_nested_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there  world.\nSecond line.\n\nAnother paragraph\nof two lines."),
        (1, 1, "a", "> Hello there world.\n> Second line.\n\nI agree."),
        (1, 2, "u", "On Monday, X wrote:\n> > Second line.\n> I agree.\n\nMe too"),
        (1, 3, "a", ">> I  AGREE.\n>Me too\nfine"),
        (1, 4, "a", "> another paragraph of two lines.\nyes"),
        (1, 5, "a", "> of two lines.\n> never said\nno"),
        (2, 0, "u", "> Hello there world.\nelsewhere"),
    ]
    assert linked(spark, rows) == [
        (1, 0, rows[0][3], None, 0, 0, 0, 0),
        (1, 1, "I agree.", 0, 0, 1, 1, 1),
        (1, 4, "yes", 0, 0, 1, 1, 1),
        (1, 5, "no", 0, 0, 1, 1, 1),
        (1, 2, "Me too", 1, 0, 2, 2, 2),
        (1, 3, "fine", 2, 0, 3, 2, 2),
        (2, 0, "elsewhere", None, 0, 0, 1, 0),
    ]


def test_the_earliest_message_is_the_original(spark):
    rows = [(1, 4, "u", "same"), (1, 2, "u", "same"), (1, 9, "u", "> same\nreply"), (1, 1, "u", "> same\nbefore")]
    found = {r[1]: r[3] for r in linked(spark, rows)}
    assert found == {1: None, 2: None, 4: None, 9: 2}


def test_long_chains_have_their_depth(spark):
    rows = [(7, i, "u", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(40)]
    assert [(r[1], r[4], r[5]) for r in linked(spark, rows)] == [(i, 0, i) for i in range(40)]


def test_defined_cases(spark):
    rows = [
        (None, 1, "u", "> a\nb"), (1, None, "u", "> a\nb"), (1, 0, "u", None), (1, 1, "u", ""), (1, 2, "u", ">"),
        (1, 3, "u", "a"), (1, 3, "u", "a"), (1, 5, "u", "> a"), (1, 5, "u", "> a"),
    ]
    found = linked(spark, rows)
    assert len(found) == len(rows)
    assert [r for r in found if r[1] == 5] == [(1, 5, "", 3, 3, 1, 1, 1)] * 2
    assert (None, 1, "b", None, 1, 0, 0, 0) in found and (1, None, "b", None, None, 0, 0, 0) in found
    assert linked(spark, []) == []


def test_many_quotes_of_one_line(spark):
    rows = [(1, 0, "u", "the very common line")] + [(1, i, "u", f"> The very common line\nreply {i}") for i in range(1, 300)]
    found = linked(spark, rows)
    assert all(r[3] == 0 and r[5] == 1 for r in found[1:]) and len(found) == 300


@pytest.mark.parametrize("mark", ["\r\n", "\n"])
def test_line_ends(spark, mark):
    rows = [(1, 0, "u", f"one{mark}two"), (1, 1, "u", f"> one{mark}> two{mark}three")]
    assert linked(spark, rows)[1][2:5] == ("three", 0, 0)


def threads(seed, conversations):
    """Messages of which over half quote earlier ones, with attribution lines short and long, levels up to four."""
    rnd, rows = random.Random(seed), []
    words = "alpha Beta gamma  delta EPSILON zeta wrote: on > eta".split(" ")
    for conv in range(conversations):
        said = []
        for turn in range(rnd.randint(1, 14)):
            lines = []
            for _ in range(rnd.choice([0, 1, 1, 2, 3]) if said else 0):
                level, of = rnd.randint(1, 4), rnd.choice(said)
                if rnd.random() < 0.5:
                    lines.append(rnd.choice(["On", "ON", "on"]) + " Monday, " + "x" * rnd.choice([3, 250, 5000]) + " wrote:" + rnd.choice(["", " "]))
                mark = rnd.choice(["> ", ">", " > "]) * level
                part = of.split("\n")
                at = rnd.randrange(len(part))
                lines += [mark + rnd.choice([x, x.upper(), x + " "]) for x in part[at : at + rnd.randint(1, 4)]]
                if rnd.random() < 0.5:
                    lines.append("")
            own = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 4))]
            own = [x if not x.lstrip().startswith(">") else "y" + x for x in own]
            if rnd.random() < 0.3:
                own.insert(rnd.randrange(len(own) + 1), "")
            said.append("\n".join(own))
            text = rnd.choice(["\n", "\n", "\r\n"]).join([*lines, *own])
            rows.append((conv, turn, "user", text if rnd.random() > 0.01 else None))
    return rows


def test_generated_threads_equal_the_sql(spark, tmp_path, monkeypatch):
    rows = threads(11, 700)
    quoting = sum(any(x.lstrip().startswith(">") for x in (r[3] or "").split("\n")) for r in rows)
    assert len(rows) >= 5000 and quoting > 0.5 * len(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next(Path(f"{tmp_path}/t").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    monkeypatch.setitem(compare.QUERIES, "threads", lambda s, d: link(s.read.parquet(f"{d}/conversations.parquet")))
    monkeypatch.setitem(compare.SQL, "threads", OP3_SQL)
    assert compare.compare(spark, compare.connect(str(tmp_path)), str(tmp_path), "threads") is None
    linked = link(spark.read.parquet(f"{tmp_path}/conversations.parquet")).selectExpr("sum(n_linked)", "max(depth)").first()
    assert linked[0] > 1000 and linked[1] > 3


def test_long_attribution_lines_go(spark):
    rows = [(1, 0, "u", "first"), (1, 1, "a", "On " + "day " * 100_000 + "wrote:\n> first\nreply")]
    assert linked(spark, rows)[1][2:5] == ("reply", 0, 0)
