import random
from collections import Counter

import numpy as np
import pyarrow as pa

from foldloom.llm import text_stats
from foldloom.llm import words as words_module
from foldloom.llm.words import HASHED_BYTES, KEPT_POWERS, gram_hashes, released, slices, word_hashes, word_list, words_of


def texts(seed, n=400, alphabet="ab  \n\n\t\r\x0b\x0c#é中| "):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)] + [None, "", " ", "\n"]


def test_words_are_the_matches_of_the_pattern(words):
    some = texts(1)
    found = words_of(pa.array(some))
    assert [word_list(found, i) for i in range(len(some))] == [words(t) for t in some]
    assert found.counts.tolist() == [len(words(t)) for t in some]


def test_slices_cover_a_sliced_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in range(40)] + [None])], ["text"]).slice(3)
    parts = list(slices(batch, "text", most=50))
    assert [t for p in parts for t in p["text"].to_pylist()] == batch["text"].to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 50 for p in parts)


def test_hashes_depend_on_the_words_alone():
    a = words_of(pa.array(["one two three four", "two three four"]))
    b = words_of(pa.array(["zero two\nthree\tfour"]))
    ha, hb = word_hashes(a), word_hashes(b)
    assert ha[1:4].tolist() == hb[1:4].tolist() == ha[4:7].tolist()
    grams = gram_hashes(ha, 3)
    assert grams[1] == grams[4] == gram_hashes(hb, 3)[1]
    assert len(np.unique(ha)) == 4


def test_hashing_a_small_slice_keeps_small_tables(monkeypatch):
    kept = {}
    monkeypatch.setattr(words_module, "_POWERS", kept)
    small, large = pa.array(["one two three " * 9000]), pa.array(["one two three " * 90000])
    first = word_hashes(words_of(small))
    assert kept and all(len(t) <= 2 * HASHED_BYTES < KEPT_POWERS for pair in kept.values() for t in pair)
    sizes = {base: len(pair[0]) for base, pair in kept.items()}
    assert word_hashes(words_of(large))[: len(first)].tolist() == first.tolist()
    assert {base: len(pair[0]) for base, pair in kept.items()} == sizes  # longer than any kept table
    assert word_hashes(words_of(small)).tolist() == first.tolist()


def test_released_gives_memory_back_after_the_last_batch(monkeypatch):
    called = []

    class Pool:
        def release_unused(self):
            called.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batches = released(iter([1, 2]))
    assert [next(batches), next(batches), called] == [1, 2, []]
    assert list(batches) == [] and called == [1]


def test_statistics_match_a_plain_count(words):
    some = texts(2) + ["a b c d e a b c d e", "l\nl\nl\n\nm l", "x " * 500]
    found = text_stats.stats_of(pa.array(some))
    for i, text in enumerate(some):
        own, seen, again = words(text), set(), 0
        lines = [x for x in (text or "").split("\n") if words(x)]
        for line in lines:
            again += line in seen
            seen.add(line)
        grams = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
        counts = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        want = (len(own), sum(len(w.decode()) for w in own), symbols, len(lines), again, len(covered))
        assert tuple(int(found[c][i]) for c in text_stats.STATS) == want
