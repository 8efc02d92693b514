"""The chunk table against the library itself, on whole texts."""

import hashlib
import random

import public_tokenizers
import sentencepiece

from tallyscope.llm import sentencepiece_codec as codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")

CASES = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "  lead and  trail  ", "tab\tand\nline \n two", "▁a▁ b",
    "<s> </s> <unk>", "日本 \U00020bb7 <0x41>", "é Ａ 　x", "\x00 nul", "a  b", "x" * 5000, "word " * 3000,
]


def random_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "é", "▁", "1", ".", "\U0001f600", "ß", "S", "\t"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def expected(text):
    sp = expected.sp
    ids = sp.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


expected.sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(spark):
    texts = CASES + random_texts(400)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.digests(df, MODEL).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == expected(t), repr(t)
    full = {r.doc_id: (r.ids, r.decoded) for r in codec.encode(df, MODEL).collect()}
    assert full[9] == (expected.sp.encode(texts[9]), expected.sp.decode(expected.sp.encode(texts[9])))


def test_table_that_is_started_anew():
    t = codec.ChunkTable(MODEL, max_chunks=3)
    for text in ["one two three four", "five six one", "", "one one two"]:
        (ids, back), = t.encode_block([text])
        assert ids == ",".join(map(str, expected.sp.encode(text))) and back == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert codec.digests(df, MODEL).count() == 0
