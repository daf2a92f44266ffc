import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm.samples import long_text
from tokenizers import Tokenizer

from reclutark.llm import bpe, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aAbB  \t\n\x0b\x0c\r\x1c\x1f\x85  éÉßİΣσςǅⅷ²½٣日本語😀👍🏽́' ''s'LL0123.,!?#$%_-ñ​　ﬁÅ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def awkward_texts():
    rnd = random.Random(1)
    fuzz = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return fuzz + [
        "", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|> b", "<|EndOfText|>", "x" * 3000, "ab" * 2000 + " " + "é" * 900, "ΑΣ ΑΣ.", "ΟΔΥΣΣΕΥΣ",
        long_text(5000),
    ]


def test_identifiers_decoding_and_counts_equal_the_library(library):
    encoder, counter = library
    own, words = bpe.Codec(BYTES), token_counts.Counter(WORDS)
    for text in awkward_texts():
        ids = encoder.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == packed(ids)
        assert own.decode(packed(ids)) == encoder.decode(ids, skip_special_tokens=False)
        assert words.count(text) == len(counter.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=40))
def test_any_text(text):
    own = bpe.codec(BYTES)
    assert own.decode(own.encode(text)) == text


def test_rank_array_and_heap_merge_alike():
    own = bpe.codec(BYTES)
    rnd = random.Random(2)
    for _ in range(500):
        raw = bytes(rnd.choice(b"aeinrsth ") for _ in range(rnd.randint(1, 60)))
        assert own.word(raw) == token_counts.merge_with_heap([own.first[b] for b in raw], own.merges)


def test_words_leave_the_cache_in_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    own, fresh = bpe.Codec(BYTES), bpe.codec(BYTES)
    text = " ".join(f"word{i % 7}" for i in range(50))
    assert own.encode(text) == fresh.encode(text) and len(own.words) <= 3 and len(own.words.older) <= 3


def test_queries_equal_the_library_on_the_tables(spark, table, library):
    import __spark_entry__ as entry

    texts = {r.doc_id: r.text or "" for r in table("documents").collect()}
    for r in entry.queries()["op7_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library[0].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in entry.queries()["op8_token_counts"](spark, "/root/testdata/sf0.001").collect():
        n = len(library[1].encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_round_trip_through_spark(documents):
    docs = documents((1, "a <|endoftext|> b"), (2, None), (3, ""))
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTES), BYTES).collect()
    assert [(r.doc_id, r.text) for r in back] == [(1, "a <|endoftext|> b"), (2, ""), (3, "")]
