"""Packing against the tokenizer on whole texts, and the curve's own properties."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyscope.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts_by_id, seq_len):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert docs.keys() == texts_by_id.keys()
    for i, texts in texts_by_id.items():
        want = sorted(map(tuple, map(whole, texts)))
        got = sorted(docs[i], key=lambda r: (r.sequence_id, r.offset))
        assert sum(r.length for r in got) == sum(map(len, want))
        for r in got:
            assert any(r.doc_tokens == len(w) and r.ids_crc32 == zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) for w in want)
    for k, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == seq_len if k != max(seqs) else at <= seq_len
    assert set(seqs) == set(range(len(seqs)))


def test_texts_of_any_shape(spark):
    rng = random.Random(5)
    bits = ["a", "word", " ", "  ", "\n", "é", "'s", "12", "...", "\U0001f600", "\t", "\x1c", "\xa0", "<|endoftext|>"]
    texts = [None, "", " ", "x " * 3000, "<|endoftext|> a<|endoftext|>b <|endoftext|>", "日本 語"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(7, texts[7], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    by_id = {i: [t] for i, t in enumerate(texts)}
    by_id[7].append(texts[7])
    check(P.pack_documents(df, PATH, seq_len=64).collect(), by_id, 64)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(df, PATH).count() == 0


def test_hilbert_index_steps_to_neighbours():
    side = 1 << 3
    cells = np.array(np.meshgrid(*[range(side)] * 3)).reshape(3, -1).T
    index = P.hilbert_index(cells, 3)
    assert sorted(index) == list(range(side**3))
    along = cells[np.argsort(index)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_padding_only_in_the_last_sequence(spark):
    df = spark.createDataFrame([(i, "some words here " * (i % 50)) for i in range(400)], "doc_id long, text string")
    s = P.sequences(P.pack_documents(df, PATH, seq_len=256), 256).orderBy("sequence_id").collect()
    assert all(r.padding == 0 for r in s[:-1]) and s[-1].used + s[-1].padding <= 256


def test_copies_of_one_text_are_neighbours(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres cuatro") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(P.pack_documents(df, PATH, seq_len=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [r.doc_id % 2 for r in out if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_words_signs_and_lines_need_no_splitting_and_tables_end_with_the_task():
    ids, split = P.ChunkIds(PATH, max_chunks=50), []

    class Counting:
        pre_tokenizer = type("Split", (), {"pre_tokenize_str": staticmethod(lambda t: split.append(t) or TOK.pre_tokenizer.pre_tokenize_str(t))})

        @staticmethod
        def encode(*a, **k):
            split.append(a[0])
            return TOK.encode(*a, **k)

    ids.tokenizer = Counting
    rng = random.Random(9)
    words = ["It", "été", "der.", "so,", "Ünder***", "x", "Ǆa", "end.\nNext", "a\nb!\nc", "no.\nÇa"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["one\ntwo three"]
    assert [np.frombuffer(x, ids.width).tolist() for x in ids.encode_block(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    assert split == []
    odd = ["a\n\nb c\n", "\nx y", "it's 12.\n13 c", "日本\n語 x\ny", "a <|endoftext|>\nb d"]
    assert [np.frombuffer(x, ids.width).tolist() for x in ids.encode_block(odd)] == [TOK.encode(t, add_special_tokens=False).ids for t in odd]
    many = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k, k + 90)) for k in range(0, 300, 30)]
    for t in many:
        assert [np.frombuffer(x, ids.width).tolist() for x in ids.encode_block([t])] == [TOK.encode(t, add_special_tokens=False).ids]
    ids.forget()
    assert not any(len(v) for v in vars(ids).values() if isinstance(v, dict) and v is not ids.written)


def test_only_tasks_load_the_tokenizer(spark, monkeypatch):
    def loaded(*_):
        raise AssertionError("loaded on the driver")

    monkeypatch.setattr(P, "_TABLES", {})
    monkeypatch.setattr(P, "ChunkIds", loaded)
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    check(P.pack_documents(df, PATH, seq_len=64).collect(), {1: ["some words"], 2: [None]}, 64)


def test_ids_of_either_width(spark):
    ids = [[5, 6, 1], [1], [7] * 9 + [1]]
    want = None
    for width in ("<u2", "<u4"):
        tokens = spark.createDataFrame([(i, len(x), bytearray(np.array(x, width).tobytes()), i) for i, x in enumerate(ids)], "doc_id long, n_tokens long, ids binary, ord long")
        got = sorted(map(tuple, P.pack(tokens, seq_len=4).collect()))
        assert sum(r[2] for r in got) == 14 and got == (want or got)
        want = got
