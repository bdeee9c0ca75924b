import random

import public_tokenizers
import pytest
import tiktoken

from quern.llm import tokens

WORDS = ["the", " cat", "\n\n", "  ", "\t", "　", "don't", "we'll", "x" * 300, "日本語の", "é", "é", "🙂", "<|endoftext|>", "12345", "...", "--", "\r\n", "\x1c", "\x85", "\xa0", " ", "_a", "'", "ſ", "\x00", "​", "ñandú", "=>", " "]


@pytest.fixture(scope="module")
def plain():
    ranks = tokens.read_vocabulary(tokens.default_vocabulary())
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_fragments_give_the_same_ids(plain):
    rng = random.Random(1)
    encoder = tokens.Encoder.of(tokens.default_vocabulary())
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    ids, ends = encoder.flat(texts)
    at = 0
    for text, end in zip(texts, ends):
        assert list(ids[at:end]) == plain(text), repr(text)
        at = end


def test_long_text_without_white_space(plain):
    rng = random.Random(3)
    encoder = tokens.Encoder.of(tokens.default_vocabulary())
    for letters in ("abcdefghij", "etaoinsé日", "a1-_/.Z\u00e0", "\u00e0 \u00a0x"):
        text = "".join(rng.choice(letters) for _ in range(80_000))
        ids, _ = encoder.flat([text])
        assert list(ids) == plain(text)


def test_fragments_are_cut_at_forced_pairs_only():
    encoder = tokens.Encoder.of(tokens.default_vocabulary())
    got = list(encoder.fragments("x" * 40 + "\u00e9\U0001f642q"))
    assert b"".join(got) == ("x" * 40 + "\u00e9\U0001f642q").encode() and len(got) > 1
    for word in ("2024-05-18T11:17:44.610Z", "snake_case.name", "日本語の文字列"):
        parts = list(encoder.fragments(word))
        ends = [(a[-1], b[0]) for a, b in zip(parts, parts[1:])]
        words = encoder.words(word)
        borders = {(a.encode()[-1], b.encode()[0]) for a, b in zip(words, words[1:])}
        assert all(encoder.forced[p] or p in borders for p in ends)


def test_forced_pairs_are_in_no_token():
    ranks = tokens.read_vocabulary(tokens.default_vocabulary())
    forced = tokens.forced_pairs(ranks)
    assert not forced[ord("t"), ord("h")] and forced[ord("a"), ord(" ")]
    assert all(not forced[a, b] for t in list(ranks)[:5000] for a, b in zip(t, t[1:]))


def test_rows(spark, plain):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (1, "a b", "x"), (5, "<|endoftext|>" * 3, "x"), (6, "ab " * 60_000, "x"), (7, "z" * 50_000, "x"), (None, "q", "x")], "doc_id long, text string, ids string")
    got = tokens.encoded(df).collect()
    assert len(got) == 9
    by = {r.doc_id: r.ids for r in got}
    assert by[2] == by[3] == []
    for r in df.collect():
        assert by[r.doc_id] == plain(r.text or "")
        assert tokens.decoded(by[r.doc_id]) == (r.text or "")
    assert tokens.encoded(df.limit(0)).count() == 0


def test_a_vocabulary_without_forced_white_space():
    ranks = {bytes([i]): i for i in range(256)} | {b"a ": 256, b"a\n": 257, b"a\t": 258, b"a\r": 259, b"a\f": 260, b"a\x0b": 261}
    assert tokens.fragment_pattern(ranks).findall("a b\nc") == ["a b\nc"]
