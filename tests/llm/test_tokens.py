"""Piece encoding against the library, token files by exact round trip."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from rowtide.llm import pieces, token_store

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "Hello world.", "Hello  world", "\t tab\nline\r\n", "▁mark ▁▁", "ñandú Ünïcödé Straße", "日本語のテキスト", "emoji 👩‍👩‍👧 🏳️‍🌈", "\x00 nul", "a" * 300, "<s> </s> <unk> <|endoftext|>", "don't you'll it's 'quoted'",
    "mixed123numbers 3.14159 1,000,000", "ﬁ ligature ① ½", "é combining", "İstanbul", "x" * 5000 + " y", "​ 　 spaces", "ABC def GHI", "http://a.b/c?d=e&f=g#h",
]


def random_texts(n):
    rng = random.Random(2)
    alphabet = "aabcdeeéfghiijklmnoopqrsttuvwxyz  .,'-ABCßж日👩0123456789\n\t"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_pieces_are_the_library_s(documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*TEXTS, *random_texts(150)]
    out = {r.doc_id: r for r in pieces.encode_texts(documents(list(enumerate(texts))), PIECES, ids=True).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_eos=True)
        assert out[i].ids == ids, repr(text)
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest(), repr(text)


def test_pieces_over_the_small_table(spark, small):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids_sha256 for r in pieces.encode_texts(rows, PIECES).collect()}
    assert got == {r.doc_id: hashlib.sha256(" ".join(map(str, lib.encode(r.text or "", add_eos=True))).encode()).hexdigest() for r in rows.collect()}


def test_full_tables_are_dropped():
    encoder = pieces.PieceEncoder(PIECES, most=20)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(40):
        assert encoder.digest(text)[1] == hashlib.sha256(" ".join(map(str, lib.encode(text, add_eos=True))).encode()).hexdigest()


def expected(rows):
    from tokenizers import Tokenizer

    lib, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tables_keep_decoded_bytes_of_odd_words_alone():
    encoder = pieces.PieceEncoder(PIECES)
    tracemalloc.start()
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(1000))
        assert encoder.digest(text)[2] == hashlib.sha256(text.encode()).hexdigest()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encoder) == 20_000
    assert not encoder.shown
    assert held < 260 * len(encoder)
    assert encoder.most <= 250_000
    odd = pieces.PieceEncoder(PIECES)
    odd.model.bytes = {}  # what is no piece becomes unknown, which decodes to other bytes
    for text in ("日本語の龘 word", "word 龘龘 word", "plain words"):
        ids = odd.encode(text)
        assert odd.digest(text)[2] == hashlib.sha256(odd.decode(ids).encode()).hexdigest()
    assert odd.shown
    assert "word" not in odd.shown


def test_token_store(documents):
    rows = list(enumerate([*TEXTS, *random_texts(120)]))
    random.Random(1).shuffle(rows)
    got = token_store.store_tokens(documents(rows), WORDS).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_small_files_and_word_tables(documents, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 50)
    rows = list(enumerate(random_texts(60)))
    got = token_store.store_tokens(documents(rows), WORDS, folder=str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)
    assert len(list(tmp_path.glob("*.tok"))) > 4
    words = token_store.WordEncoder(WORDS, most=10)
    assert [np.frombuffer(x, "<u4").tolist() for _, t in rows for x in words.encode([t.encode()])] == [np.frombuffer(x, "<u4").tolist() for x in token_store.WordEncoder(WORDS).encode([t.encode() for _, t in rows])]


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**31, 2**32 - 1, 0, 1], list(range(0, 200_000, 37))])
def test_random_access(ids):
    raw = token_store.pack([1, None], np.array([len(ids), 0]), np.array(ids, "<u4"))
    file = token_store.TokenFile(raw)
    assert file.tokens == len(ids)
    assert file.slice(0, len(ids)).tolist() == ids
    rng = random.Random(1)
    for _ in range(50 if ids else 0):
        i = rng.randrange(len(ids))
        j = rng.randint(i, len(ids))
        assert file.token(i) == ids[i]
        assert file.slice(i, j).tolist() == ids[i:j]


def test_null_and_repeated_ids_and_empty_table(documents):
    rows = [(None, "one"), (None, "two words"), (4, "b"), (4, "a longer text"), (2, None)]
    got = sorted(token_store.store_tokens(documents(rows), WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 4, 4]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert token_store.store_tokens(documents([]), WORDS).collect() == []
    assert pieces.encode_texts(documents([]), PIECES).collect() == []
