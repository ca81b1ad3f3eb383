"""Merges of many words at once against the tokenizer, one word at a time."""

import random

import public_tokenizers as P
import pyarrow as pa

from pacelake.llm import packing


def test_merges_of_random_words_are_the_tokenizers():
    tok = packing.WordTokenizer.of(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    kinds = [packing.plain_letters(), "abcdefghijklmnopqrstuvwxyz", "aab", "etaoinshr"]
    words = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(1, rng.choice([3, 12, 40])))) for _ in range(20_000)]
    words = pa.array([*words, "a", "a" * 128, "ä" * 64], pa.large_string())
    assert tok.merged(words).all() and not tok.merged(pa.array(["a" * 129, "", "a1", "a b", "A", "it's"], pa.large_string())).any()
    ids, at, n = tok.merges.encode(words.slice(7))
    for a, k, e in zip(at, n, tok.tokenizer.encode_batch_fast(words.slice(7).to_pylist(), add_special_tokens=False), strict=True):
        assert ids[a : a + k].tolist() == e.ids


def test_words_of_plain_letters_never_become_objects(monkeypatch):
    tok = packing.WordTokenizer.of(P.path("word_bpe_49k.json"))
    seen, remembered = [], packing.WordTokenizer.remembered
    monkeypatch.setattr(packing.WordTokenizer, "remembered", lambda self, words: seen.extend(words) or remembered(self, words))
    text = "Packing windows, größer than these; packing <|ENDOFTEXT|> x86 " + "a" * 200
    ids, at = tok.encode(pa.array([text, None]))
    assert ids[: at[1]].tolist() == [*tok.tokenizer.encode(text, add_special_tokens=False).ids, packing.CLOSING_ID]
    assert not {"packing", "windows", "größer", "than", "these"} & set(seen)
