"""Byte-pair encoding and decoding with a contiguous rank array per short word."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from reclutark.llm.token_counts import LONG_WORD, NO_RANK, WordCache, byte_letters, merge_with_heap

#: Splits text before the merges: the pattern of byte-level vocabularies, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words kept with their identifiers by one Python worker, in two generations; bounds the memory of the cache.
CACHED_WORDS = 150_000

#: Rows that leave a worker at once.
OUT_ROWS = 256


class Codec:
    """A byte-level vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        back = {letter: byte for byte, letter in letters.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in added.items()}
        self.added = {token: _packed([i]) for token, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PIECES).findall
        self.words = WordCache(lambda piece: _packed(self.word(piece.encode())), CACHED_WORDS)

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers."""
        parts = self.split.split(text) if self.split else [text]
        return b"".join(self.added.get(p) or self._ordinary(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def word(self, raw: bytes) -> list[int]:
        """Identifiers of one word: its boundaries and the ranks of neighbours lie in two contiguous arrays."""
        parts = [self.first[b] for b in raw]
        if len(parts) > LONG_WORD:  # scans would cost the square of the length
            return merge_with_heap(parts, self.merges)
        merges = self.merges
        ranks = [merges.get(pair, NO_RANK)[0] for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK[0]:
                break
            at = ranks.index(low)
            parts[at] = merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = merges.get((parts[at - 1], parts[at]), NO_RANK)[0]
            if at < len(ranks):
                ranks[at] = merges.get((parts[at], parts[at + 1]), NO_RANK)[0]
        return parts


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@cache
def codec(path: str) -> Codec:
    """One vocabulary per Python worker."""
    return Codec(path)


def _rows(docs: DataFrame, columns: list[str], schema: str, row: Callable[[tuple], tuple]) -> DataFrame:
    """One row for each row; results leave in small batches, so that a worker never holds those of a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                keys = part.column(0)
                done = [row(x) for x in zip(*(c.to_pylist() for c in part.columns[1:]))]
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*done), types)], names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(field.split()[0] for field in schema.split(", "))]
    types = [{"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[field.split()[1]] for field in schema.split(", ")]
    return docs.select("doc_id", *columns).mapInArrow(run, f"doc_id {key}, {schema}")


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens`` per row of ``docs``; ``token_ids`` are little-endian unsigned 32-bit identifiers.

    Rows are independent: no shuffle, whole texts, nothing kept but a bounded cache of words.  A null or empty text has no
    identifiers.  Special tokens of the vocabulary that stand in a text get their own identifiers.  Null ids and repeated
    rows give a row each; other columns are left out, whatever their names.
    """

    def encode(row: tuple) -> tuple:
        ids = codec(vocabulary).encode(row[0] or "")
        return ids, len(ids) // 4

    return _rows(docs, ["text"], "token_ids binary, n_tokens long", encode)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` per row of ``encoded``; null identifiers give a null text."""
    return _rows(encoded, ["token_ids"], "text string", lambda row: (None if row[0] is None else codec(vocabulary).decode(row[0]),))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the identifiers and of the text decoded from them.

    Encodes and decodes in one pass, so that a task runs one Python worker; else as ``encode_documents``.
    """

    def both(row: tuple) -> tuple:
        c = codec(vocabulary)
        ids = c.encode(row[0] or "")
        return ids, c.decode(ids)

    done = _rows(docs, ["text"], "token_ids binary, decoded string", both)
    return done.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
