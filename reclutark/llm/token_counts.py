"""Token counts by heap-and-linked-list byte-pair merging: initial symbols less merges, no identifiers."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Words above this many symbols are never kept in a cache.
LONG_WORD = 256

#: Words kept with their counts by one Python worker, in two generations; bounds the memory of the cache.
CACHED_WORDS = 150_000

#: Rank of a pair that never merges.
NO_RANK = (1 << 62, -1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    for letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_steps(symbols: list[int], merges: dict) -> tuple[list[int], list[int], int]:
    """Symbols after all merges, the links to the next live symbol, and the number of merges.

    A heap gives the adjacent pair of lowest rank, leftmost first; a doubly linked list joins the neighbours of what was merged.
    An entry is stale, and skipped, when either side has changed since it was pushed.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, found[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := merges.get((a, b)))]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j], k = new, -1, after[j]
        after[i] = k
        done += 1
        if k < n:
            before[k] = i
            if found := merges.get((new, symbols[k])):
                heapq.heappush(heap, (found[0], i, found[1], new, symbols[k]))
        if (h := before[i]) >= 0 and (found := merges.get((symbols[h], new))):
            heapq.heappush(heap, (found[0], h, found[1], symbols[h], new))
    return symbols, after, done


def merge_with_heap(symbols: list[int], merges: dict) -> list[int]:
    """The merged symbols in order, for words too long for scans."""
    merged, after, _ = merge_steps(list(symbols), merges)
    out, at = [], 0
    while at < len(merged):
        out.append(merged[at])
        at = after[at]
    return out

#: Capitals of Unicode 16 that Python's tables may not have yet, and their small letters.
NEW_CAPITALS = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


class WordCache(dict):
    """What ``of`` gives for words, for a bounded number of them: a full generation becomes the older one, and is asked once more
    before it goes.  Long words are never kept."""

    def __init__(self, of, size: int):
        self.of, self.size, self.older = of, size, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.of(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Counter:
    """A vocabulary with word ends, ready to count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = set(added)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(pattern).findall
        self.words = WordCache(lambda piece: self.word(piece.encode()), CACHED_WORDS)

    def count(self, text: str) -> int:
        parts = self.split.split(text) if self.split else [text]
        return sum(1 if p in self.added else self._ordinary(p) for p in parts if p)

    def _ordinary(self, text: str) -> int:
        # A capital sigma is lower-cased without a look at its neighbours, as every other letter is.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(NEW_CAPITALS)
        return sum(map(self.words.__getitem__, self.pieces(text)))

    def word(self, raw: bytes) -> int:
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return len(symbols) - merge_steps(symbols, self.merges)[2]


@cache
def counter(path: str) -> Counter:
    """One vocabulary per Python worker."""
    return Counter(path)


def token_counter(path: str):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in texts:
            yield pd.Series([c.count(t or "") for t in batch], dtype="int64")

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; ``limit`` is the longest sequence that is not over it.

    Rows are independent: no shuffle, whole texts.  Null and empty texts have no bytes and no tokens; null ids and
    repeated rows give a row each; other columns are left out, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counter(vocabulary)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
