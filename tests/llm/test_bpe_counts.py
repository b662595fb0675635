"""BPE and token counts against the libraries themselves."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import bpe, counts, queries

from .cases import SF, awkward, smallest, table

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


ALPHABET = "abzZqx019 '\"\t\n\r!|<>.,-_=%&;:()é日́  😀"
PIECES = ["'s", "'re", "'ll", "n't", "  ", " '", "!'s", "''re", "<|endoftext|>", "<|endof", "text|>", "hello", " World", "q9", "\n\n", "xq", "|e"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(ALPHABET, max_size=6)), max_size=12))
def test_fragments_give_the_librarys_ids(parts):
    text = "".join(parts)
    own = bpe.codec(BYTE)
    ids = own.encode(text)
    want = Tokenizer.from_file(BYTE) if not hasattr(test_fragments_give_the_librarys_ids, "lib") else test_fragments_give_the_librarys_ids.lib
    test_fragments_give_the_librarys_ids.lib = want
    assert np.frombuffer(ids, "<u4").tolist() == want.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_random_ascii(library):
    rnd = random.Random(1)
    own = bpe.codec(BYTE)
    for _ in range(400):
        text = "".join(chr(rnd.choice([rnd.randrange(0, 128), rnd.randrange(32, 127)])) for _ in range(rnd.randrange(200)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_used_and_never_inside_a_token():
    own = bpe.codec(BYTE)
    assert own.cut[ord("d") * 256 + ord(" ")] and not own.cut[ord(" ") * 256 + ord("d")]
    for piece in own.pieces[:50256]:
        for a, b in zip(piece, piece[1:]):
            assert not own.cut[a * 256 + b]


def test_broken_bytes_decode_like_the_library(library):
    ids = library.encode("日本語 é", add_special_tokens=False).ids
    for cut in range(len(ids)):
        part = ids[cut:] + ids[:1]
        assert bpe.codec(BYTE).decode(np.array(part, "<u4").tobytes()) == library.decode(part, skip_special_tokens=False)


def test_codec_on_awkward_rows(spark, library):
    rows = awkward([(9, "a<|endoftext|>b")])
    coded = bpe.decode(bpe.encode(table(spark, rows), BYTE), BYTE)
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in coded.collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    once = bpe.round_trip(table(spark, rows), BYTE)
    assert sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in once.collect()) == got
    assert bpe.encode(table(spark, []), BYTE).count() == 0


def test_op4_whole_table(spark, library):
    docs = smallest()
    got = {r.doc_id: r for r in queries.op4(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts(spark):
    library = Tokenizer.from_file(WORD)
    rows = awkward([(9, "a<|endoftext|>b <|startoftext|>"), (10, "word " * 20_000), (11, "é ́x ÅΣΣ " * 9000)])
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(table(spark, rows), WORD, 2048).collect())
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert counts.count_tokens(table(spark, []), WORD).count() == 0


def test_counts_with_other_libraries(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in awkward()]
    assert counts.lengths(texts, path).tolist() == [len(model.encode(t)) for t in texts]
    library = Tokenizer.from_file(BYTE)
    assert counts.lengths(texts, BYTE).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_keep_every_word():
    text = "ab cd\tef\n" * 5000
    parts = list(counts.pieces(text, 100))
    assert len(parts) > 100 and " ".join(parts).split() == text.split()
    assert list(counts.pieces("x" * 1000, 100)) == ["x" * 1000]


def test_op5_whole_table(spark):
    library = Tokenizer.from_file(WORD)
    docs = smallest()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5(spark, SF).collect()}
    want = {}
    for i, t in zip(docs.doc_id, docs.text):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert got == want
