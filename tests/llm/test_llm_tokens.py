import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnmesh.llm import tokens
from cairnmesh.llm.packing import SIZE, pack, places, shortest_pack_first
from cairnmesh.llm.queries import vocabulary


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def counter_of(path):
    return tokens.counter_of(path, lambda: tokens.proven(tokens.library(path)))


def test_counts_are_the_librarys(spark, docs, none):
    path = vocabulary("byte_bpe_50k.json")
    source = docs.collect()
    got = tokens.count_tokens(spark, docs, path).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((key(r.doc_id), len((r.text or "").encode()), n := len(ids(path, r.text)), n > 512) for r in source)
    assert tokens.count_tokens(spark, none, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeThß É'sl12.,!?%\n\t\xa0\x85\x1c中🙂Σİ́<|endoftext|>")), max_size=60))
def test_any_text(text):
    counter = counter_of(vocabulary("byte_bpe_50k.json"))
    assert counter.of_texts([text]) == [len(ids(vocabulary("byte_bpe_50k.json"), text))]
    table = tokens.chunk_table(vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(table.of_texts([text.encode()])[0], "<u4").tolist() == ids(vocabulary("word_bpe_49k.json"), text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|endoftext", "|>", " ", "\n", "Word", "é,", "A.B", "1"]), max_size=12).map("".join))
def test_special_strings_in_any_case(text):
    table = tokens.chunk_table(vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(table.of_texts([text.encode()])[0], "<u4").tolist() == ids(vocabulary("word_bpe_49k.json"), text)
    assert counter_of(vocabulary("byte_bpe_50k.json")).of_texts([text]) == [len(ids(vocabulary("byte_bpe_50k.json"), text))]


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "ROOM", 5)
    monkeypatch.setattr(tokens, "PART", 40)
    path = vocabulary("byte_bpe_50k.json")
    c, table = tokens.Counter(path, tokens.proven(tokens.library(path))), tokens.Chunks(vocabulary("word_bpe_49k.json"))
    for i in range(5):
        text = f"some{i} zzqx{i} and more words, more{i}! words again zzqx{i - 1} and " * 4
        assert c.of_texts([text, "x y"]) == [len(ids(path, text)), 2]
        assert np.frombuffer(table.of_texts([text.encode()])[0], "<u4").tolist() == ids(vocabulary("word_bpe_49k.json"), text)


def test_proven_strings_are_single_tokens():
    t = tokens.library(vocabulary("byte_bpe_50k.json"))
    some = sorted(tokens.proven(t))[::500]
    assert all(len(x) == 1 for x in tokens.ids_of(t, some))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_every_piece_has_one_place(histogram):
    patterns = shortest_pack_first(histogram, 64)
    assert all(sum(a * b for a, b in c) <= 64 for _, c in patterns)
    seen, used = {}, set()
    for length, rows in places(patterns).items():
        ends = [*rows[1:, 0], histogram[length]]
        for (first, sequence, offset, times), end in zip(rows.tolist(), ends, strict=True):
            for rank in range(first, int(end)):
                n = rank - first
                start = (sequence + n // times, offset + n % times * length)
                span = {(start[0], start[1] + k) for k in range(length)}
                assert not span & used
                used |= span
                seen[length] = seen.get(length, 0) + 1
    assert seen == histogram


def test_pack(spark, docs, none, monkeypatch):
    monkeypatch.setattr("cairnmesh.llm.packing.BUCKET", 5)
    path = vocabulary("word_bpe_49k.json")
    got = pack(spark, docs, path).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array([*ids(path, r.text), 1], "<u4")[a : a + SIZE].tobytes())) for r in docs.collect() for a in range(0, len(ids(path, r.text)) + 1, SIZE))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= SIZE
    assert pack(spark, none, path).count() == 0


@pytest.mark.parametrize("text", ["", "a"])
def test_short_texts_end(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pack(spark, df, vocabulary("word_bpe_49k.json")).first()
    assert (r.start, r.offset, r.doc_tokens) == (0, 0, 1 + len(text))


def test_a_worker_keeps_one_table_and_lets_it_go_for_other_operators():
    from cairnmesh.llm import workers

    built = []
    make = lambda key: workers.keep(key, lambda: built.append(key) or [key])
    assert make("a") is make("a") and built == ["a"]
    make("b"), make("a")
    assert built == ["a", "b", "a"]
    same = lambda batches: (b + 1 for b in batches)
    assert list(workers.lean(same, keeps=True)([1, 2])) == [2, 3] and make("a") and built == ["a", "b", "a"]
    assert list(workers.lean(same)([1, 2])) == [2, 3]
    make("a")
    assert built == ["a", "b", "a", "a"]
    workers.forget()
