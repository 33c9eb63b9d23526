"""One registered query per operator, over its whole table, with the SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm.store import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    return importlib.import_module("public_tokenizers").path(name)


@query()
def op1_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.robust_outliers import judge

    return judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.token_prefix import count_prefixes

    counted = count_prefixes(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), limits=[1024])
    return counted.selectExpr(
        "doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 as over_limit", "longest_1024 as chars_within_limit"
    )


@query()
def op10_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.lexicon_bpe import encode

    encoded = encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return encoded.selectExpr(
        "doc_id", "n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256"
    )


def _normal(text: str) -> str:
    return f"trim(lower(regexp_replace({text}, '\\s+', ' ', 'g')))"


OP3_SQL = f"""
with recursive
cleaned as (
  select conv_id, turn, role, text,
         regexp_matches(text, '(^|\n)[ \t]*>') as quotes,
         string_split(replace(regexp_replace(
           text, '(?im)^on [^\n]* wrote:[ \t]*\n([ \t]*>)', '\\1', 'g'), chr(13) || chr(10), chr(10)), chr(10)) as ls
  from conversations),
lines as (
  select conv_id, turn, pos, length(regexp_replace(regexp_extract(raw, '^([ \t]*>)+'), '[^>]', '', 'g')) as level,
         {_normal("regexp_replace(raw, '^([ \t]*>)+', '')")} as line
  from (select distinct conv_id, turn, unnest(ls) as raw, generate_subscripts(ls, 1) as pos
        from cleaned where quotes and conv_id is not null and turn is not null)),
cut as (
  select *, case when level = lag(level) over (partition by conv_id, turn order by pos) then 0 else 1 end as new from lines),
spans as (select *, sum(new) over (partition by conv_id, turn order by pos) as passage from cut),
passages as (
  select conv_id, turn, passage, level, string_agg(line, ' ' order by pos) as unit, count(*) as n
  from spans where level > 0 and line <> '' group by all),
units as (
  select conv_id, turn, passage, level, true as whole, unit from passages
  union
  select s.conv_id, s.turn, s.passage, s.level, false, s.line
  from spans s join passages p using (conv_id, turn, passage) where s.line <> '' and p.n > 1),
own as (
  select conv_id, turn, role,
         case when quotes then regexp_replace(array_to_string(
           [x for x in ls if not regexp_matches(x, '^([ \t]*>)+')], chr(10)), '^\\s+|\\s+$', '', 'g') else text end as text
  from cleaned),
said as (
  select conv_id, turn, {_normal("p")} as unit
  from (select conv_id, turn, unnest(list_concat([text], regexp_split_to_array(text, '\n[ \t]*\n'),
                                                 string_split(text, chr(10)))) as p
        from own where text is not null and conv_id is not null and turn is not null)),
first as (select conv_id, unit, min(turn) as origin from said where unit <> '' group by all),
found as (
  select u.conv_id, u.turn, u.passage, u.level, whole, origin
  from units u join first f on f.conv_id = u.conv_id and f.unit = u.unit and f.origin < u.turn),
linked as (
  select conv_id, turn, passage, level, origin from found
  qualify row_number() over (partition by conv_id, turn, passage order by whole desc, origin desc) = 1),
parents as (
  select conv_id, turn, max(n_linked) as n_linked, max(origin) filter (level = near) as parent_turn
  from (select *, min(level) over (partition by conv_id, turn) as near,
               count(*) over (partition by conv_id, turn) as n_linked from linked) group by all),
up as (
  select conv_id, turn, parent_turn as root_turn, 1 as depth from parents
  union all
  select up.conv_id, up.turn, p.parent_turn, up.depth + 1
  from up join parents p on p.conv_id = up.conv_id and p.turn = up.root_turn),
roots as (select conv_id, turn, arg_max(root_turn, depth) as root_turn, max(depth) as depth from up group by all),
quoted as (select conv_id, turn, count(distinct passage) as n_quoted from passages group by all)
select o.conv_id, o.turn, o.role, o.text, p.parent_turn, coalesce(r.root_turn, o.turn) as root_turn,
       cast(coalesce(r.depth, 0) as integer) as depth, coalesce(n_quoted, 0) as n_quoted,
       coalesce(n_linked, 0) as n_linked
from own o left join parents p using (conv_id, turn) left join roots r using (conv_id, turn)
left join quoted q using (conv_id, turn)
"""


@query(OP3_SQL)
def op3_quotations(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.quotations import link

    return link(table(spark, folder, "conversations"))


OP6_SQL = """
with sizes as (select source, sum(coalesce(length(text), 0)) as size from documents group by source having size > 0),
rates as (
  select source, sum(size) over () * (sqrt(size) / sum(sqrt(size)) over ()) / size as rate from sizes),
parts as (select source, greatest(ceil(rate / 200), 1)::int as parts, rate / greatest(ceil(rate / 200), 1) as r from rates),
terms as (
  select source, parts, k, exp(-r + k * ln(r) - lgamma(k + 1)) as term
  from parts, unnest(range(0, ceil(r + 12 * sqrt(r) + 26)::bigint)) as t(k)),
cdf as (select source, parts, sum(term) over (partition by source order by k) as c from terms),
drawn as (
  select d.*, i, ('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, '') || ':' || i), 1, 13))::bigint / 4503599627370496 as u
  from (select row_number() over () as n, * from documents) d
  join parts p on d.source is not distinct from p.source, unnest(range(1, parts + 1)) as t(i)),
counted as (
  select d.n, count(*) as copies from drawn d join cdf c on d.source is not distinct from c.source and c.c <= d.u
  group by d.n)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, copies + 1))::int as copy
from (select row_number() over () as n, * from documents) d join counted using (n)
"""


@query()
def op5_hash_index(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.hash_index import fit, search

    vectors = table(spark, folder, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), fit(vectors))


@query(OP6_SQL)
def op6_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.poisson_mix import replicate

    return replicate(table(spark, folder, "documents"))


OP9_SQL = """
with facts as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (
  select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from facts),
firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from sized)
select page_id, payload_bytes, payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id is not distinct from first then null else first end as refers_to
from firsts
"""


@query(OP9_SQL)
def op9_seekable_bundles(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm import bundles

    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        written = scratch.save(bundles.bundles(pages))
        records = bundles.read(written, payloads=False)
        return scratch.kept(
            records.selectExpr(
                f"cast(page_id as {kind}) as page_id",
                "payload_bytes",
                "payload_digest",
                "record_type",
                f"cast(refers_to as {kind}) as refers_to",
            )
        )


@query()
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.overlap_join import duplicate_classes

    return duplicate_classes(table(spark, folder, "documents"))


@query()
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.passages import repeated_passages

    found = repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op4_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.cotraining import judge

    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: crc32 in SQL: its 256 remainders, and the value of a string
CRCS = """crc_table as (
  select list(c order by b) as crcs from (
    select b, list_reduce(list_concat([b], range(8)),
                          lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) t(b)))"""


def _crc(text: str) -> str:
    octets = f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint"
    return f"""xor(4294967295, list_reduce(
      list_concat([4294967295::bigint], list_transform(range(octet_length(encode({text}))), {octets})),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
with recursive {CRCS},
runs as (
  select coalesce(doc_id::varchar, '') as doc_id,
         unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run
  from documents),
hashed as (select run, {_crc("doc_id || ':' || run")} as h from runs, crc_table where length(run) >= 7),
typed as (
  select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
  from hashed),
words as (select word, count(*) as n from typed where length(word) >= 7 group by word having count(*) >= 2),
holes as (
  select word, i, left(word, i - 1) || substr(word, i + 1) as hole
  from words, unnest(range(1, length(word) + 1)) as t(i)),
pairs as (
  select a.word as word, b.word as near from holes a join holes b on a.hole = b.hole and a.i = b.i and a.word <> b.word
  union select h.word, w.word from holes h join words w on h.hole = w.word
  union select w.word, h.word from holes h join words w on h.hole = w.word),
near as (
  select p.word, count(*) as n_near, arg_min(p.near, (-x.n, p.near)) filter (x.n >= 10 * w.n) as form
  from pairs p join words w on w.word = p.word join words x on x.word = p.near group by p.word),
forms as (select word, form from near where form is not null),
up as (
  select word, form as root, 1 as depth from forms
  union all select up.word, f.form, up.depth + 1 from up join forms f on f.word = up.root),
roots as (select word, arg_max(root, depth) as root from up group by word)
select w.word, near.form, coalesce(r.root, w.word) as root, w.n, coalesce(n_near, 0) as n_near, f.n as form_n
from words w left join near using (word) left join roots r using (word) left join words f on f.word = near.form
"""


@query(OP11_SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of document and word plants typing errors, so that rare variants of common words are there."""
    from foldloom.llm import spelling_variants

    runs = spelling_variants.runs(table(spark, folder, "documents"))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word")))
    typed = F.expr(
        """if(h % 31 = 0, concat(left(word, cast(h % length(word) as int)), substr(word, cast(h % length(word) as int) + 2)),
              word)"""
    )
    return spelling_variants.variants(spelling_variants.counted(hashed.select(typed.alias("word"))))


def _fold(digest: str, tops: int) -> str:
    """``digest`` carried up levels 0 to ``tops`` - 1 of the tables of siblings b0, a0, b1, …"""
    for k in range(tops):
        digest = f"case when b{k} is null then {digest} else sha256(b{k} || {digest} || a{k}) end"
    return digest


#: levels in the SQL below the sources and above them: enough for 16^4 rows of a source, 16^2 sources
BELOW, ABOVE = 4, 2


def _merkle_level(name: str, k: int) -> str:
    """From nodes (tree, pos, digest, n of its tree) their siblings and the next level; a lone node stays."""
    beside = "list_aggregate(list_transform(list_filter(run, lambda x: x.pos {} pos), lambda x: x.digest), 'string_agg', '')"
    return f"""
{name}{k}_runs as (
  select tree, pos // 16 as up, list({{'pos': pos, 'digest': digest}} order by pos) as run,
         sha256(string_agg(digest, '' order by pos)) as parent
  from {name}{k} where n > 1 group by all),
{name}{k}_beside as (
  select c.tree, c.pos, case when c.n > 1 then coalesce({beside.format("<")}, '') end as b,
         case when c.n > 1 then coalesce({beside.format(">")}, '') end as a
  from {name}{k} c left join {name}{k}_runs r on r.tree = c.tree and r.up = c.pos // 16),
{name}{k + 1} as (
  select tree, up as pos, parent as digest, count(*) over (partition by tree) as n from {name}{k}_runs
  union all select tree, pos, digest, n from {name}{k} where n = 1)"""


def _merkle_sql() -> str:
    framed = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(framed.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    joins = "".join(f"\n  left join low{k}_beside l{k} on l{k}.tree = x.tree and l{k}.pos = x.pos // {16**k}" for k in range(BELOW))
    joins += "\n  join high0 h on h.source = x.tree"
    joins += "".join(f"\n  left join high{k}_beside h{k} on h{k}.pos = h.pos // {16**k}" for k in range(ABOVE))
    names = [f"l{k}" for k in range(BELOW)] + [f"h{k}" for k in range(ABOVE)]
    beside = ", ".join(f"{n}.b as b{i}, {n}.a as a{i}" for i, n in enumerate(names))
    proof = " || ".join(f"coalesce(b{i} || a{i}, '')" for i in range(len(names)))
    return f"""
with {CRCS},
leaves as (
  select doc_id, case when source is null then '' else '=' || source end as tree, {leaf("text")} as digest,
         case when doc_id is not null and {_crc("coalesce(doc_id::varchar, '')")} % 5 = 0 then {leaf(lower)} end as other
  from documents, crc_table),
low0 as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos,
         count(*) over (partition by tree) as n from leaves),
{",".join(_merkle_level("low", k) for k in range(BELOW))},
high0 as (
  select '' as tree, tree as source, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n
  from low{BELOW}),
{",".join(_merkle_level("high", k) for k in range(ABOVE))},
paths as (
  select x.doc_id, x.digest as leaf, x.other, h.digest as subroot, {beside}
  from low0 x{joins}),
folded as (
  select *, (select digest from high{ABOVE}) as root, {_fold("coalesce(other, leaf)", len(names))} as folded_root from paths)
select doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, folded_root, folded_root = root as verified
from folded
"""


OP12_SQL = _merkle_sql()


@query(OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents; lower-casing the text of every fifth by hash shows what verification finds."""
    from foldloom.llm.merkle_manifest import manifest

    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest(table(spark, folder, "documents"), chosen, F.translate("text", UPPER, LOWER))


@query()
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from foldloom.llm.language_id import identify, learn

    docs = table(spark, folder, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    model = learn(docs.filter(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", held_out, "text"), model)
