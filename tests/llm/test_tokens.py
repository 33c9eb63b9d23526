import hashlib
import random
import time

import numpy as np
import pytest

from foldloom.llm import lexicon_bpe, token_prefix
from foldloom.llm.pieces import Merger, vocabulary
from foldloom.llm.queries import tokenizer

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ALPHABET = "abs'' re ve lld  tm\n\t  İΣςé é ñ12½²٣ ,.!#中文字​ 😀=="
FIXED = [
    "", "<|endoftext|>", "a <|endoftext|>b'S  <|endoftext|><|endoftext|> x", "Don'T 'S's''s !'s", "   ",
    " 's 're'rex 'd I'll we've", "ΑΣ ΑΣ.", "\n\n\n x\n\ny \n z", "=" * 300 + "ab" * 100, None,
]


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + FIXED


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer(name))


def test_every_prefix_has_the_count_of_its_encoding():
    some = texts(1, 150)
    counter, own = token_prefix.PrefixCounter(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for text, counts in zip(some, counter.texts(some), strict=True):
        text = text or ""
        assert counts.tolist() == [len(e.ids) for e in own.encode_batch([text[: i + 1] for i in range(len(text))])]


def test_a_long_piece_alone_has_the_counts_of_the_joint_sweep():
    rnd = random.Random(5)
    counter = token_prefix.PrefixCounter(tokenizer("byte_bpe_50k.json"))
    pieces = [
        b"a" * 700, b"ab" * 300, b"=" * 500, "é中😀".encode() * 60, b"internationalisation" * 30, b"xyz",
        bytes(rnd.choice(b"abcdeghilmnorstu") for _ in range(900)), bytes(range(128, 256)) * 3,
    ]
    data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    want = counter._sweep(data, starts, sizes)
    assert counter.sweep(data, starts, sizes).tolist() == want.tolist()
    assert np.concatenate([counter.lone.counts(p) for p in pieces]).tolist() == want.tolist()


@pytest.mark.parametrize("alphabet", ["a", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_a_word_of_a_megabyte_takes_seconds(alphabet):
    rnd = random.Random(7)
    counter = token_prefix.PrefixCounter(tokenizer("byte_bpe_50k.json"))
    text = "".join(rnd.choices(alphabet, k=1 << 20))
    began = time.monotonic()
    counts = counter.texts([text])[0]
    assert time.monotonic() - began < 60
    pieces = np.array([0, len(text)])
    ids, _ = counter.merger.merge(np.frombuffer(text.encode(), np.uint8), pieces[:1], pieces[1:])
    assert counts[-1] == len(ids)
    assert counts[9_999] == len(library("byte_bpe_50k.json").encode(text[:10_000]).ids)


def test_many_special_strings_in_one_text():
    counter, own = token_prefix.PrefixCounter(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    text = "<|endoftext|>a b<|endoftext|>" * 20_000
    counts = counter.texts([text, "<|endoftext|>", "x<|endoftext|"])
    assert [c[-1] for c in counts] == [len(own.encode(t).ids) for t in (text, "<|endoftext|>", "x<|endoftext|")]


def test_steps_of_over_16_bits_are_packed_wide():
    counts = np.array([1, 2, 70_000, 69_999, 70_001])
    packed = token_prefix.pack(counts)
    assert token_prefix.unpack(packed).tolist() == counts.tolist()
    assert token_prefix.count_at(packed, 3) == 70_000 and token_prefix.longest_within(packed, 69_999) == 4
    assert token_prefix.unpack(token_prefix.pack(counts[:2])).tolist() == [1, 2]


def test_packed_counts_answer_questions():
    text = "Counting tokens, word for word: internationalisation!"
    counter, own = token_prefix.PrefixCounter(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    packed = token_prefix.pack(counter.texts([text])[0])
    assert token_prefix.count_at(packed, 0) == 0
    for n in (1, 7, len(text)):
        assert token_prefix.count_at(packed, n) == len(own.encode(text[:n]).ids)
    for limit in (0, 3, 5, 100):
        want = max((n for n in range(len(text) + 1) if len(own.encode(text[:n]).ids) <= limit), default=0)
        assert token_prefix.longest_within(packed, limit) == want


def test_count_prefixes_on_documents(spark, documents):
    docs = documents.selectExpr("doc_id", "text", "'x' as n_tokens")
    rows = token_prefix.count_prefixes(docs, tokenizer("byte_bpe_50k.json"), limits=[20]).collect()
    own = library("byte_bpe_50k.json")
    for r, e in zip(rows, own.encode_batch([r["text"] for r in rows]), strict=True):
        assert (r["n_bytes"], r["n_tokens"]) == (len(r["text"].encode()), len(e.ids))
        assert len(own.encode(r["text"][: r["longest_20"]]).ids) <= 20
    nothing = token_prefix.count_prefixes(spark.createDataFrame([(1, None)], "doc_id int, text string"), tokenizer("byte_bpe_50k.json"))
    assert nothing.first()[2:] == (0, 0, bytearray(b""))
    assert token_prefix.count_prefixes(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_merges_of_long_and_short_pieces_agree():
    vocab = vocabulary(tokenizer("byte_bpe_50k.json"))
    own = library("byte_bpe_50k.json").model
    pieces = [b"a", b"hello", b"=" * 500, b"internationalisation" * 9, "é中".encode() * 40]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    ids, counts = Merger(vocab).merge(data, ends - [len(p) for p in pieces], ends)
    from foldloom.llm.pieces import byte_chars

    for piece, found in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert found.tolist() == [t.id for t in own.tokenize("".join(byte_chars()[b] for b in piece))]


def test_transducer_knows_its_words_only():
    entries = {w: np.array([i, len(w)]) for i, w in enumerate([b"a", b"ab", b"abc", b"xbc", b"bc", "é".encode()])}
    flat = lexicon_bpe.Transducer.compile(entries)
    machine = lexicon_bpe.Transducer(flat)
    asked = [*sorted(entries), b"abcd", b"x", b"", b"zz"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    found = machine.find(data, ends - [len(w) for w in asked], ends)
    assert found.tolist() == [*range(len(entries)), -1, -1, -1, -1]
    assert len(machine.keys) < sum(map(len, entries))  # endings are shared
    for word, i in zip(sorted(entries), found, strict=False):
        assert machine.outputs[machine.offsets[i] : machine.offsets[i + 1]].tolist() == entries[word].tolist()
    empty = lexicon_bpe.Transducer(lexicon_bpe.Transducer.compile({}))
    assert empty.find(data, ends[:1] - 1, ends[:1]).tolist() == [-1]


def test_encoding_and_decoding_are_the_library_s(spark, documents):
    path = tokenizer("word_bpe_49k.json")
    own = library("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts(2, 300))] + [(r["doc_id"] + 1000, r["text"]) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "ids2")
    for row in lexicon_bpe.encode(docs, path, lexicon=None).collect():
        want = own.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == want and row["n_tokens"] == len(want)
        assert bytes(row["decoded"]).decode() == own.decode(want, skip_special_tokens=False)
        assert lexicon_bpe.decode_ids(bytes(row["ids"]), path) == own.decode(want, skip_special_tokens=False)


def test_encoding_of_nothing(spark):
    path = tokenizer("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert lexicon_bpe.encode(empty, path).count() == 0
    one = lexicon_bpe.encode(spark.createDataFrame([(1, None)], "doc_id long, text string"), path).first()
    assert (one["n_tokens"], bytes(one["ids"]), bytes(one["decoded"])) == (0, b"", b"")
    assert hashlib.sha256(bytes(one["ids"])).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_readable_words(spark):
    path = tokenizer("word_bpe_49k.json")
    row = lexicon_bpe.encode(spark.createDataFrame([(1, "Hello  wörld again")], "doc_id long, text string"), path).first()
    assert lexicon_bpe.words_of_ids(bytes(row["ids"]), path) == "hello wörld again"
