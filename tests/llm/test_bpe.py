import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from plumeline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello world, it's 2024!!\n\n  x", "Ünïcödé 字 🙂 <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "the the the", "the the the", "\t\t\r\n é́"]


@pytest.fixture(scope="module")
def tk():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_words_equal_tiktoken(tk):
    words = ["the", "zqxj", "aaaaaaa", "ababababab", "x" * 3000, "éèüß", "9" * 50, " hello"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_words([w.encode() for w in words], PATH)] == [tk._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_round_trip(spark, tk):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    found = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = tk.encode_ordinary(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).isEmpty()


def test_encode_and_decode_keep_columns(spark, tk):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    coded = bpe.encode(docs.withColumnRenamed("ids", "other"), PATH, P.PATTERN)
    back = bpe.decode(coded, PATH)
    assert back.columns == ["doc_id", "text", "other", "ids", "decoded"]
    assert all((r.decoded or b"").decode() == (r.text or "") for r in back.collect())
    assert "ids" in bpe.encode(docs, PATH, P.PATTERN).columns


def test_long_match(tk):
    """One match whose rounds do not fit into memory together."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("acgt"), 14_000)).encode(), b"the", b"acgtacgt"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_words(words, PATH)] == [tk._core_bpe.encode_single_piece(w) for w in words]


def test_rounds_restart(tk, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 40)
    monkeypatch.setattr(bpe, "WORD_BYTES", 30)
    words = ["the", "zqxj", "aaaaaaa", "ababababab", "x" * 90, "éèüß", "9" * 50, " hello", "字" * 20, "qzqzqz"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_words([w.encode() for w in words], PATH)] == [tk._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_long_matches_equal_the_library():
    """Single matches of the pattern of up to 100,000 bytes, random and periodic."""
    rng = random.Random(9)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(30_000))
    long = [letters, "-" * 100_000, han, "\u4e2d" * 30_000, "ab" * 30_000, "abcde" * 9_000, " " * 70_000 + "x", "\U0001f600" * 5_000, "\u043f\u0440" * 9_000, "a" * 383, "b" * 385, letters[:20_000] + "a" * 20_000]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    encoder = bpe.Encoder(PATH, P.PATTERN)
    for text, ids in zip(long, encoder.ids(long), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
    assert bpe.decode_ids(encoder.ids(long), PATH) == [t.encode() for t in long]
    assert max(map(len, encoder.words)) <= bpe.KEPT_LONGEST


def test_tiles_without_a_common_token(monkeypatch):
    """Tiles too small to agree are made larger; the result is that of the whole match."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdet -\n", k=n)) for n in (5, 30, 200, 900)] + ["abc" * 200, "-" * 333]
    whole = bpe.encode_words([t.encode() for t in texts], PATH)
    monkeypatch.setattr(bpe, "TILES", (2, 5, 11))
    assert bpe.encode_words([t.encode() for t in texts], PATH) == whole
    monkeypatch.setattr(bpe, "TILES", ())
    assert bpe.encode_words([t.encode() for t in texts], PATH) == whole


def test_null_keys_and_bounded_caches(spark, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHARS", 10)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 20)
    rows = [(2**60 + 1, "some words here", 1), (None, "some words here", 2), (3, None, 3), (3, "", 4), (2**60 + 1, "some words here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").coalesce(1)
    found = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0 for r in found)) == [0, 3, 3, 2**60 + 1, 2**60 + 1]
    assert len({r.ids_sha256 for r in found}) == 2 and {r.n_tokens for r in found if r.doc_id == 3} == {0}
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).isEmpty()


def test_two_generations_of_words(monkeypatch):
    """However few words are remembered, the ids are the same, and memory is bounded."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randrange(1, 6))) for _ in range(40)) for _ in range(30)]
    whole = bpe.Encoder(PATH, P.PATTERN).ids(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    monkeypatch.setattr(bpe, "ENCODED", {})
    encoder = bpe.Encoder(PATH, P.PATTERN)
    assert [encoder.ids([t])[0] for t in texts] == whole
    assert len(encoder.words) <= 60 and len(encoder.before) <= 60
    assert bpe.ENCODED[PATH] == (encoder.words, encoder.before)


def test_words_of_one_tile_are_not_joined(tk, monkeypatch):
    """Joining takes several array operations for each word: only long matches need it."""
    joined, real = [], bpe.joined_tiles
    monkeypatch.setattr(bpe, "joined_tiles", lambda tiles, *rest: (joined.append(len(tiles)), real(tiles, *rest))[1])
    words = ["zqxj", "ababababab", "qv" * 190, "x" * 384, "xy" * 200]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_words([w.encode() for w in words], PATH)] == [tk._core_bpe.encode_single_piece(w.encode()) for w in words]
    assert joined and min(joined) > 1


def test_words_wait_squeezed_between_tasks(monkeypatch):
    monkeypatch.setattr(bpe, "ENCODED", {})
    encoder = bpe.Encoder(PATH, P.PATTERN)
    ids, words = encoder.ids(["some words, zwölf 字"]), dict(encoder.words)
    bpe.forget(PATH)
    assert words and PATH not in bpe.ENCODED
    again = bpe.Encoder(PATH, P.PATTERN)
    assert again.words == words and again.ids(["some words, zwölf 字"]) == ids
