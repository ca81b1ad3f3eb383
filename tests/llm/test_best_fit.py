"""Best-fit packing: ids of odd texts, one sweep against a plain one, and whole packings against best-fit decreasing."""

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacelake.llm import best_fit as B
from pacelake.llm.byte_words import CUT, ByteWords
from pacelake.llm.common import Scratch
from test_llm import DOC, prose

PATH = P.path("byte_bpe_50k.json")


def test_ids_of_made_up_texts_are_the_tokenizer_s():
    words = ByteWords.of(PATH)
    rng = np.random.default_rng(5)
    parts = ["a", "b", "Th", "ing", "é", "É", "Σ", "ж", "́", "'s", "'", "'ll", "don't", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\xa0", "　", "\x1c", "\x85", "​", " ", "\x0b", CUT]
    parts += ["1", "42", ".", "!", "?", "-", "漢字", "ß", "İ", "ﬁ", "😀", "ͅ", "ŉ", "x" * 120, "", "\x00", "²", "½", "ª", "ʰ", "×", "÷"]
    for _ in range(15):
        texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(500)]
        ids, at = words.encode(pa.array(texts), 0)
        for k, (t, e) in enumerate(zip(texts, words.tokenizer.encode_batch(texts, add_special_tokens=False))):
            assert ids[at[k] : at[k + 1]].tolist() == [*e.ids, 0], t
    assert [x.tolist() for x in words.encode(pa.array([None, ""], pa.string()), 7)] == [[7, 7], [0, 1, 2]]


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr("pacelake.llm.byte_words.REMEMBERED", 50)
    words = ByteWords(PATH)
    for k in range(20):
        text = prose(k, 400)
        assert words.encode(pa.array([text]), 0)[0].tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert len(words.known) <= 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=40))
def test_a_sweep_gives_each_document_the_last_gap_that_is_left(rows):
    rows.sort(key=lambda r: (-r[0], not r[1]))
    stack, want = [], {}
    for i, (_, gap) in enumerate(rows):
        if gap:
            stack.append(i)
        elif stack:
            want[i] = stack.pop()
    docs, gaps = B.pair_up(np.array([n for n, _ in rows], np.int64), np.array([g for _, g in rows], bool))
    assert dict(zip(docs.tolist(), gaps.tolist())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=8))
def test_what_tasks_leave_over_meets_as_in_one_sweep(left):
    parts = [{"part": p, "docs": d, "gaps": g} for p, (d, g) in enumerate(left)]
    stack, want = [], {}
    for p in parts:
        for r in range(p["docs"]):
            if stack:
                want[p["part"], r] = stack.pop()
        stack += [(p["part"], r) for r in range(p["gaps"])]
    met, got = B._meet(parts)
    assert {(p, first + i): (q, top - i) for p, first, n, q, top in met for i in range(n)} == want
    assert got == {p["part"]: sum(k[0] == p["part"] for k in want) for p in parts}


def plain_count(lengths, window):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, length)
        if i < len(gaps):
            free = gaps.pop(i)
        else:
            free, n = window, n + 1
        if free > length:
            bisect.insort(gaps, free - length)
    return n


def sequences(rows, window):
    out = defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in out.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return out


@pytest.mark.parametrize("name", ["uniform", "short", "one length", "halves", "hot", "ones", "few"])
def test_as_few_sequences_as_best_fit_decreasing(spark, name):
    rng = np.random.default_rng(3)
    lengths = {
        "uniform": rng.integers(1, 256, 3_000),
        "short": rng.integers(1, 12, 3_000),
        "one length": np.full(2_000, 87),
        "halves": np.r_[np.full(500, 129), np.full(400, 128), np.full(300, 127)],
        "hot": np.r_[np.full(1_000, 60), rng.integers(1, 255, 2_000)],
        "ones": np.ones(1_000, np.int64),
        "few": np.array([255, 1, 200]),
    }[name].tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, key long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that pairs meet across tasks
    try:
        got = B.place_pieces(rows, 256, Scratch(spark, "test")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter(enumerate(lengths))
    assert len(sequences(got, 256)) <= 1.01 * plain_count(lengths, 256) + 1


def test_packing_of_odd_rows(spark):
    long = prose(77, 60_000)
    rows = [(1, long), (2, None), (2, None), (None, "no id"), (3, ""), (4, long), (4, "other text of a repeated id"), (5, prose(1, 300)), (6, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    for c in ("key", "seq", "piece", "length", "ids", "size", "gap", "part", "rank", "round", "sequence_id"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = B.pack(docs.repartition(3), PATH).collect()
    sequences(got, 2048)
    tok = ByteWords.of(PATH).tokenizer
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    made = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        made[r["doc_id"]].append((r["piece"], r["start"], ids))
    want = defaultdict(list)
    for i, whole in texts.items():
        for ids in whole:
            first = (len(ids) - 1) % 2048 + 1
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            want[i] += [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in want.items()}


def test_an_empty_table_and_whole_windows_only(spark):
    assert B.pack(spark.createDataFrame([], DOC), PATH).collect() == []
    one = " a" * 2_047
    assert len(ByteWords.of(PATH).tokenizer.encode(one).ids) == 2_047
    got = B.pack(spark.createDataFrame([(i, one, None, None, None) for i in range(3)], DOC), PATH, with_ids=False).collect()
    assert sorted((r["doc_id"], r["length"], r["offset"]) for r in got) == [(i, 2_048, 0) for i in range(3)] and len({r["sequence_id"] for r in got}) == 3
