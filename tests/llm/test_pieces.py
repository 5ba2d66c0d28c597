"""SentencePiece encoding and decoding against the library, on planted and generated texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from weft.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "▁", "  two  spaces  ", "a\nb\tc", "<s> </s> <0x41> <unk>", "漢字 and 😀́", "\x00�", " " * 300 + "x", "x" * 5000, ("long " * 3000).strip(), "naïve Äußerung", "a▁b ▁ c"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_model(PATH)


def generated(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdehinst  ▁\n\té漢😀\x00<s>") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encode_decode_and_digests_equal_the_library(spark, library, vocabulary):
    texts = TEXTS + generated(300, 1)
    rows = [(i, t, "x", b"clash") for i, t in enumerate(texts)] + [(None, "null id", "x", b""), (3, "repeated id", "x", b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids binary")
    expected = sorted((i if i is not None else -1, tuple(library.encode(t or ""))) for i, t, *_ in rows)
    encoded = pieces.encode(docs, vocabulary)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in encoded.collect())
    assert got == expected
    back = pieces.decode(encoded, vocabulary).collect()
    assert sorted(r["decoded"] for r in back) == sorted(library.decode(list(ids)) for _, ids in expected)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(docs, vocabulary).collect())
    assert digests == sorted((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(list(ids)))) for i, ids in expected)
    assert pieces.digests(docs.limit(0), vocabulary).count() == 0


def test_any_ids_decode_as_the_library_does(library, vocabulary):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), rng.randrange(3), 259, 260]) for _ in range(rng.randint(0, 12))]
        assert pieces.decoded(ids, vocabulary) == library.decode(ids)


def test_heap_and_list_merge_alike_and_tables_turn_over(library, vocabulary, monkeypatch):
    for text in generated(500, 3):
        for word in pieces.words_of(vocabulary)(text):
            assert pieces.merged_long(word, vocabulary.order) == pieces.merged_short(word, vocabulary.order)
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    monkeypatch.setattr(pieces, "WORDS_AT_ONCE", 5)
    table = pieces.WordTable(vocabulary)
    texts = generated(300, 4)
    for text, ids in zip(texts, table.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert len(table.young) < 60 and len(table.older) < 60


def test_words_merged_together_equal_words_by_themselves(vocabulary):
    words = [w for text in TEXTS + generated(800, 6) for w in pieces.words_of(vocabulary)(text or "")]
    words += ["x" * n for n in range(1, 80)] + [pieces.MARK * n for n in range(1, 70)]
    together = pieces.Merges(vocabulary).of_words(words)
    assert [np.frombuffer(b, "<u4").tolist() for b in together] == [pieces.segmented(w, vocabulary) for w in words]


def test_words_are_segmented_whole_where_pieces_cross_markers(library, vocabulary):
    from dataclasses import replace

    whole = replace(vocabulary, separable=False)
    table = pieces.WordTable(whole)
    for text in generated(100, 5):
        assert len(pieces.words_of(whole)(text)) <= 1
        assert np.frombuffer(next(table.ids([text])), "<u4").tolist() == library.encode(text)
