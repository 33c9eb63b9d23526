"""Quotation linking: replies are joined to the messages that their quoted passages come from.

A line's quote level is the number of ``>`` it begins with.  Adjacent lines of one level form a
passage.  Passages are normalised (lower case, one space between words), hashed and joined to the
messages of the same conversation that say the same at level 0: as their whole text, a paragraph
(lines between blank ones) or a line.  The original of a passage is the earliest such message, if
it is earlier than the quoting one; a passage of several lines without an original falls back to
its lines.  A message replies to the original of its least quoted level, the latest of them.
Following the replies by pointer doubling gives each message's root and depth, and sorting by
root, depth and turn gives conversations in which every reply follows what it answers.

Only messages with a quoted line are taken apart, and only originals of quoted hashes are kept.

Defined cases: a null text has no lines and stays null; messages with a null conv_id or turn link
with nothing (root is their own turn, depth 0); rows with the same conv_id and turn are one
message to link to and are all returned; an empty table gives an empty result; extra columns are
kept unless an output has their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch, attach

QUOTED = r"(?m)^[ \t]*>"
MARKS = r"^([ \t]*>)+"
#: the line with which mail programs introduce a quote
INTRODUCTION = r"(?im)^on [^\n]* wrote:[ \t]*\n(?=[ \t]*>)"
OUTPUTS = ("text", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked")


def quoted_units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, whole, hash: each quoted passage, and the lines of longer ones."""
    split = F.split(F.regexp_replace("text", INTRODUCTION, ""), "\r?\n")
    parsed = F.transform(
        split,
        lambda raw: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(raw, MARKS, 0), "[^>]", "")).alias("level"),
            raw.alias("raw"),
        ),
    )
    # passages are cut where the level changes, all inside the row
    parsed = messages.filter(F.col("text").rlike(QUOTED)).select("conv_id", "turn", parsed.alias("rows"))
    cuts = parsed.withColumn(
        "cuts",
        F.expr("filter(sequence(0, size(rows) - 1), i -> i = 0 or rows[i].level <> rows[i - 1].level)"),
    )
    spans = cuts.select(
        "conv_id",
        "turn",
        F.posexplode(
            F.expr(
                """transform(cuts, (a, k) -> named_struct(
                     'level', rows[a].level,
                     'lines', transform(
                       slice(rows, a + 1, if(k + 1 < size(cuts), cuts[k + 1], size(rows)) - a),
                       r -> trim(lower(regexp_replace(regexp_replace(r.raw, '^([ \\\\t]*>)+', ''), '\\\\s+', ' '))))))"""
            )
        ).alias("passage", "span"),
    )
    spans = spans.select(
        "conv_id", "turn", "passage", "span.level", F.expr("filter(span.lines, l -> l <> '')").alias("lines")
    ).filter("level > 0 and size(lines) > 0")
    units = spans.select(
        "conv_id",
        "turn",
        "passage",
        "level",
        F.explode(
            F.expr(
                """concat(array(named_struct('whole', true, 'unit', array_join(lines, ' '))),
                     if(size(lines) > 1, transform(lines, l -> named_struct('whole', false, 'unit', l)), array()))"""
            )
        ).alias("u"),
    )
    return units.select("conv_id", "turn", "passage", "level", "u.whole", F.sha2("u.unit", 256).alias("hash")).distinct()


def own_text(text: str = "text") -> F.Column:
    """The message without its quoted lines and their introductions; unchanged if it quotes nothing."""
    cleaned = F.regexp_replace(text, INTRODUCTION, "")
    left = F.filter(F.split(cleaned, "\r?\n"), lambda raw: ~raw.rlike(MARKS))
    return F.when(
        F.col(text).rlike(QUOTED), F.regexp_replace(F.array_join(left, "\n"), r"^\s+|\s+$", "")
    ).otherwise(F.col(text))


def own_units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, hash of what a message itself says: whole, by paragraph and by line."""
    own = messages.select("conv_id", "turn", own_text().alias("own"))
    parts = F.expr(
        """array_distinct(filter(transform(
             concat(array(own), split(own, '\\n[ \\t]*\\n'), split(own, '\\n')),
             p -> trim(lower(regexp_replace(p, '\\\\s+', ' ')))), p -> p <> ''))"""
    )
    return own.filter("own is not null").select("conv_id", "turn", F.explode(parts).alias("unit")).select(
        "conv_id", "turn", F.sha2("unit", 256).alias("hash")
    )


def replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked passages (conv_id, turn, passage, level, origin) and all quoted units, both written."""
    messages = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    units = Scratch.kept(quoted_units(messages))
    quoted = units.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    quoted = Scratch.kept(quoted)
    # messages of conversations that quote nothing drop out before they are taken apart
    quoting = quoted.groupBy("conv_id").agg(F.sum("n").alias("n"))
    possible = attach(messages, Scratch.kept(quoting), ["conv_id"], "n")
    said = attach(own_units(possible), quoted.withColumn("quoted", F.lit(True)), ["conv_id", "hash"], "n")
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"), F.count(F.lit(1)).alias("m"))
    first = first.join(quoted, ["conv_id", "hash"]).select("conv_id", "hash", "origin", "n")
    found = attach(units, Scratch.kept(first), ["conv_id", "hash"], "n").filter("origin < turn")
    # a passage as a whole is preferred to its lines, then the latest original
    linked = found.groupBy("conv_id", "turn", "passage", "level").agg(
        F.max(F.struct("whole", "origin")).getField("origin").alias("origin")
    )
    return Scratch.kept(linked), units


def roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of every message that has a parent, by pointer doubling."""
    state = Scratch.kept(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")))
    while True:
        asked = state.groupBy("conv_id", F.col("up").alias("turn")).agg(F.count(F.lit(1)).alias("n"))
        steps = state.join(asked, ["conv_id", "turn"]).select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "n"
        )
        steps = Scratch.kept(steps)
        if steps.isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")
        moved = attach(state, steps, ["conv_id", "up"], "n", "left")
        state = Scratch.kept(
            moved.select(
                "conv_id",
                "turn",
                F.coalesce("next", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )


def link(messages: DataFrame) -> DataFrame:
    """All messages without quotes, with parent_turn, root_turn, depth, n_quoted and n_linked, in reply order."""
    linked, units = replies(messages)
    own = linked.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "origin")).getField("origin").alias("parent_turn"),
        F.count(F.lit(1)).alias("n_linked"),
    )
    own = Scratch.kept(own)
    quoted = units.filter("whole").groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_quoted"))
    facts = quoted.join(own, ["conv_id", "turn"], "left").join(roots(own), ["conv_id", "turn"], "left")
    facts = Scratch.kept(facts.withColumn("n", F.lit(1)))
    extra = [c for c in messages.columns if c not in ("conv_id", "turn", *OUTPUTS)]
    base = messages.select("conv_id", "turn", *extra, own_text().alias("text"))
    out = attach(base, facts, ["conv_id", "turn"], "n", "left")
    return out.select(
        "conv_id",
        "turn",
        *extra,
        "text",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    ).orderBy("conv_id", "root_turn", "depth", "turn")
