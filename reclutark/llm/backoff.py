"""Language model scores from a weighted backoff automaton over all n-grams of the corpus."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import shared_folder, ship, texts_of, word_hashes

#: Bytes of text of which one reducer counts the n-grams, on average, and tokens of one block of documents.
PART_BYTES = 20 << 20
BLOCK_TOKENS = 2_000_000

#: Probability mass that each distinct continuation of a context gives to the shorter context, in occurrences.
DISCOUNT = 0.75

#: Occurrences of a context up to which its continuations are counted in one part; those of more frequent ones are spread over all parts.
HOT = 1 << 16

#: Tokens of the pieces that are walked side by side.
PIECE = 1024

#: Hashes of what no word can be, as words hold no blanks.
START, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" start", b" end"))

Batches = Iterator[pa.RecordBatch]

MESSAGE = "part int, block long, kind string, prefixes binary, words binary, counts binary, n long"
NAMES = ["part", "block", "kind", "prefixes", "words", "counts", "n"]
TYPES = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers without sign as compressed planes of bytes; differences if they rise."""
    values = values.astype("<u8")
    if rising and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width, rising]) + zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    width, rising = packed[0], packed[1]
    planes = np.frombuffer(zstandard.decompress(packed[2:]), dtype=np.uint8)
    out = np.zeros((len(planes) // width, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    values = out.view("<u8").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, mostly small: seven bits a byte, the last byte of a number marked, compressed."""
    sizes = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    rest = values.astype(np.uint32)
    for k in range(int(sizes.max(initial=0))):
        there = sizes > k
        out[(ends - sizes)[there] + k] = (rest[there] & 127) | ((sizes[there] == k + 1) << 7)
        rest = rest >> 7
    return zstandard.compress(out.tobytes(), 3)


def unpack_small(packed: bytes) -> np.ndarray:
    read = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    ends = np.flatnonzero(read & 128) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int((ends - begins).max(initial=0))):
        there = ends - begins > k
        out[there] |= (read[begins[there] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _spread(hashed: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; parts rise with the hash."""
    return ((hashed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _mixed(prefixes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a pair of identifiers."""
    h = prefixes * np.uint64(0x9E3779B97F4A7C15) ^ (words + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


# --- blocks of documents -------------------------------------------------------------------------------------------------


@dataclass
class _Block:
    """Words of some whole documents, by hash; each document begins with the start and ends with the end."""

    ids: list = field(default_factory=list)
    held_out: list[bool] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    total: int = 0

    def add(self, ids: list, held_out: list, sizes: np.ndarray, hashes: np.ndarray) -> None:
        self.ids += ids
        self.held_out += held_out
        self.sizes.append(sizes)
        self.hashes.append(hashes)
        self.total += len(hashes)

    def rows(self, number: int, parts: int) -> Iterator[dict]:
        """The block's texts as numbers of its distinct words, the most frequent first (``places`` has their places by hash), and its questions."""
        hashes, place, times = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        sizes, held_out = np.concatenate(self.sizes), np.array(self.held_out, dtype=bool)
        counts = np.bincount(place[np.repeat(~held_out, sizes)], minlength=len(hashes))
        often = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(often), dtype=np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        yield {
            "part": -1, "block": number, "kind": "texts", "prefixes": pack(sizes), "words": pack_small(rank[place]), "counts": pack(held_out),
            "n": int((sizes - 1)[~held_out].sum()), "ids": self.ids, "places": pack(often),
        }
        of = _spread(hashes, parts)
        for part, a, b in _groups(of):
            yield {
                "part": part, "block": number, "kind": "ask", "prefixes": None, "words": pack(hashes[a:b], True), "counts": pack(counts[a:b]), "n": 0,
                "ids": None, "places": None,
            }


def _between_marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (A-Z in lower case), each text between start and end, and the number of hashes per text."""
    hashes, counts = word_hashes(*texts_of(texts), lower=True)
    sizes = counts + 2
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    words = np.ones(len(out), dtype=bool)
    words[ends - 1], words[ends - sizes] = False, False
    out[words] = hashes
    out[ends - sizes], out[ends - 1] = START, END
    return out, sizes


def _groups(of: np.ndarray) -> list[tuple[int, int, int]]:
    """Value and bounds of each run of equal values."""
    if not len(of):
        return []
    at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    return [(int(of[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


def _encode(docs: DataFrame, held_out: Column, parts: int, block_tokens: int, path: str) -> DataFrame:
    """Blocks of whole documents, and what each asks of the parts about its words, written once to ``path``."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType
    schema = MESSAGE + f", ids array<{id_type.simpleString()}>, places binary"

    def encode(batches: Batches) -> Batches:
        from pyspark import TaskContext

        base, count, block = TaskContext.get().partitionId() << 32, 0, _Block()
        id_arrow = pa.null()

        def out() -> pa.RecordBatch:
            rows = list(block.rows(base + count, parts))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(rows[0], [*TYPES, pa.list_(id_arrow), pa.binary()])], names=list(rows[0]))

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            hashes, sizes = _between_marks(batch.column(1))
            ends, at = np.cumsum(sizes), 0
            while at < len(ids):
                begin = int(ends[at] - sizes[at])
                stop = min(len(ids), 1 + int(np.searchsorted(ends, begin + block_tokens - block.total)))
                block.add(ids[at:stop], held[at:stop], sizes[at:stop], hashes[begin : int(ends[stop - 1])])
                at = stop
                if block.total >= block_tokens:
                    yield out()
                    count, block = count + 1, _Block()
        if block.ids:
            yield out()

    docs.mapInArrow(encode, schema).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


# --- reducers ------------------------------------------------------------------------------------------------------------


def _compact(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Identifiers (part in the upper half, rank in the lower) without the unused bits between, and how many bits are left; in the same order."""
    part, rank = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
    bits = int(rank.max(initial=0)).bit_length()
    return (part << np.uint64(bits)) | rank, bits + int(part.max(initial=0)).bit_length()


def _sorted(prefixes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (prefix, word), and where in it a new pair begins; by one number per pair if 64 bits hold it."""
    (p, p_bits), (w, w_bits) = _compact(prefixes), _compact(words)
    if p_bits + w_bits <= 64:
        key = (p << np.uint64(w_bits)) | w if p_bits else w
        order = np.argsort(key)
        key = key[order]
        return order, np.append(key[:1] == key[:1], key[1:] != key[:-1])
    order = np.lexsort((words, prefixes))
    p, w = prefixes[order], words[order]
    return order, np.append(p[:1] == p[:1], (p[1:] != p[:-1]) | (w[1:] != w[:-1]))


def _distinct(table: pa.Table) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all that is asked of a part: bounds per block, which n-gram each entry is, and the n-grams' prefixes, counts, and askers.

    N-grams are in the order of (prefix, word) whatever the order of the blocks.
    """
    table = table.filter(pc.equal(table.column("kind"), "ask")).sort_by("block")
    words = [unpack(w) for w in table.column("words").to_pylist()]
    prefixes = [np.zeros(len(w), dtype=np.uint64) if p is None else unpack(p) for p, w in zip(table.column("prefixes").to_pylist(), words)]
    none = np.zeros(0, dtype=np.uint64)
    counts = np.concatenate([none, *(unpack(c) for c in table.column("counts").to_pylist())]).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    bounds = [(b, int(e) - len(w), int(e)) for b, e, w in zip(table.column("block").to_pylist(), ends, words)]
    prefixes = np.concatenate([none, *prefixes])
    order, new = _sorted(prefixes, np.concatenate([none, *words]))
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return bounds, which, prefixes[order][new], np.bincount(which, weights=counts).astype(np.int64), np.bincount(which)


def _message(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], names=NAMES)


def _answers(asked: DataFrame, level: int) -> DataFrame:
    """Counts in the whole corpus of all n-grams that blocks ask for, each in the order of the question, and whether other blocks ask as well.

    Identifiers come along for n-grams that a longer question can name: words that occur, the most frequent of a part first, and longer n-grams that
    occur and that other blocks have, too.  ``more`` says how many distinct n-grams begin with a prefix: of those asked here, and of those that blocks
    have alone and told the prefix's part.  ``size`` is the number of n-grams that occur.
    """

    def reduce(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        bounds, which, prefixes, counts, askers = _distinct(table)
        seen, shared = counts > 0, askers > 1
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable") if level == 1 else slice(None)] = np.arange(1, len(counts) + 1)
        ids = ((part << 32) + rank).astype(np.uint64)
        named, told = seen if level == 1 else seen & shared, 2 * counts + shared
        rows = []
        for block, a, b in bounds:
            own = which[a:b]
            rows.append((part, block, f"count{level}", None, None, pack(told[own]), 0))
            rows.append((part, block, f"id{level}", None, pack(ids[own[named[own]]], level > 1), pack(told[:0]), 0))
        rows.append((part, -1, "size", None, None, None, int(seen.sum())))
        if level > 1:
            of = prefixes[seen]
            for to, a, b in _groups(of >> np.uint64(32)):
                first = np.flatnonzero(np.append(of[a : a + 1] == of[a : a + 1], of[a + 1 : b] != of[a : b - 1]))
                rows.append((to, -1, "more", None, pack(of[a:b][first], True), pack(np.diff(first, append=b - a)), 0))
            rest = table.filter(pc.equal(table.column("kind"), "more"))
            rows += [(part, -1, "more", None, w, c, 0) for w, c in zip(rest.column("words").to_pylist(), rest.column("counts").to_pylist())]
        return _message(rows)

    return asked.groupBy("part").applyInArrow(reduce, MESSAGE)


def _fans(named: DataFrame, more: DataFrame, level: int) -> DataFrame:
    """How many distinct n-grams continue each n-gram that blocks were given an identifier of, in that order."""

    def reduce(known: pa.Table, told: pa.Table) -> pa.Table:
        if not known.num_rows:
            return _message([])
        low = np.uint64(0xFFFFFFFF)
        asked = [(unpack(w) & low).astype(np.int64) for w in known.column("words").to_pylist()]
        fans = np.zeros(1 + max(int(ranks.max(initial=0)) for ranks in asked), dtype=np.int64)
        for ids, n in zip(told.column("words").to_pylist(), told.column("counts").to_pylist()):
            ranks = (unpack(ids) & low).astype(np.int64)
            inside = ranks < len(fans)
            fans[ranks[inside]] += unpack(n).astype(np.int64)[inside]
        part = known.column("part")[0].as_py()
        return _message([(part, block, f"fan{level}", None, None, pack(fans[ranks]), 0) for block, ranks in zip(known.column("block").to_pylist(), asked)])

    return named.groupBy("part").cogroup(more.groupBy("part")).applyInArrow(reduce, MESSAGE)


# --- a block's part of the automaton ---------------------------------------------------------------------------------------


class _Grams:
    """A block's n-grams of each order, and which one ends at each token (-1: none that occurs).

    Documents begin with the start and end with the end.  An n-gram's number is its place in the block's question, by part (a word's: by
    identifier); then come those that needn't be asked: if no other block has an n-gram's prefix, or what is left without its first token, no other
    block has the n-gram, and its count is this block's own.
    """

    def __init__(self, texts: dict, told: pa.Table, parts: int, hot: int):
        self.sizes = unpack(texts["prefixes"]).astype(np.int64)
        self.held_out = unpack(texts["counts"]).astype(bool)
        self.told, self.parts, self.hot = _told(told), parts, hot
        self.learnt = np.repeat(~self.held_out, self.sizes)
        self.first = np.zeros(len(self.learnt), dtype=bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.ids, self.counts, self.shared, self.named, self.at, self.example, self.prefix = [], [], [], [], [], [], []
        counts, shared, ids = self._answers(1)
        self.words = np.argsort(np.where(counts > 0, ids, np.uint64((1 << 64) - 1)), kind="stable")
        number = np.empty(len(counts), dtype=np.int32)
        number[self.words] = np.arange(len(counts), dtype=np.int32)
        self.tokens = number[unpack(texts["places"])][unpack_small(texts["words"])]
        self._take(counts[self.words], shared[self.words], ids[self.words], self.tokens, None, None)

    def _answers(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = self._all(f"count{level}", "counts")
        shared, counts = (told & np.uint64(1)).astype(bool), (told >> np.uint64(1)).astype(np.int64)
        ids = np.zeros(len(told), dtype=np.uint64)
        self.named.append((counts > 0) if level == 1 else (counts > 0) & shared)
        named = self._all(f"id{level}", "words")
        if len(named):  # the longest have none
            ids[self.named[-1]] = named
        return counts, shared, ids

    def _take(self, counts: np.ndarray, shared: np.ndarray, ids: np.ndarray, at: np.ndarray, example: np.ndarray | None, prefix: np.ndarray | None) -> None:
        self.ids.append(ids)
        self.counts.append(counts)
        self.shared.append(shared)
        occurs = counts > 0
        self.at.append(np.where((at >= 0) & occurs[at], at, np.int32(-1)) if len(occurs) else np.full(len(at), -1, dtype=np.int32))
        self.example.append(example)
        self.prefix.append(prefix)

    def _all(self, kind: str, column: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *self.told.get(kind, {}).get(column, [])])

    def _next(self) -> tuple[np.ndarray, ...]:
        """The n-grams of the next order in the order of their numbers: parts, prefixes, words, learnt counts, an example's place; which ends where."""
        before, word = self.at[-1], self.at[0]
        where = np.flatnonzero((before[:-1] >= 0) & (word[1:] >= 0) & ~self.first[1:]) + 1
        key = (before[where - 1].astype(np.uint64) << np.uint64(32)) | word[where].astype(np.uint64)
        grams, which = np.unique(key, return_inverse=True)
        counts = np.bincount(which, weights=self.learnt[where], minlength=len(grams)).astype(np.int64)
        example = np.empty(len(grams), dtype=np.int64)
        example[which] = where
        prefix, last = (grams >> np.uint64(32)).astype(np.int64), (grams & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rest = before[example]  # without the first token; -1 if that never occurs, and then the n-gram doesn't, either
        asked = self.shared[-1][prefix] & (rest >= 0) & self.shared[-1][rest]
        of = np.full(len(grams), self.parts, dtype=np.uint16 if self.parts < 1 << 16 else np.uint32)
        hot = self.counts[-1][prefix[asked]] > self.hot
        of[asked] = _spread(_mixed(self.ids[-1][prefix[asked]], np.where(hot, self.ids[0][last[asked]], np.uint64(0))), self.parts)
        order = np.argsort(of, kind="stable")
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        at = np.full(len(self.tokens), -1, dtype=np.int32)
        at[where] = number[which]
        return of[order], prefix[order], last[order], counts[order], example[order], at

    def deepen(self, level: int) -> None:
        of, prefix, _, own, example, at = self._next()
        counts, shared, ids = self._answers(level)
        own = own[of == self.parts]
        self._take(np.concatenate([counts, own]), np.concatenate([shared, np.zeros(len(own), dtype=bool)]), ids, at, example, prefix)

    def question(self) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """Per part: prefixes and words by identifier, and learnt counts, of the n-grams of the next order; and for prefixes that other blocks
        have how many n-grams that occur begin with them here alone."""
        of, prefix, last, counts, *_ = self._next()
        n = int(np.searchsorted(of, self.parts))
        prefixes, words = self.ids[-1][prefix[:n]], self.ids[0][last[:n]]
        for part, a, b in _groups(of[:n]):
            yield part, "ask", prefixes[a:b], words[a:b], counts[a:b]
        alone = prefix[n:][counts[n:] > 0]
        found, more = np.unique(self.ids[-1][alone[self.shared[-1][alone]]], return_counts=True)
        for part, a, b in _groups(found >> np.uint64(32)):
            yield part, "more", found[:0], found[a:b], more[a:b]

    def fans(self, level: int) -> np.ndarray:
        """Distinct continuations of each n-gram of a level: as told if other blocks have it, or else this block's own."""
        follow = self.prefix[level][self.counts[level] > 0]
        fans = np.bincount(follow, minlength=len(self.counts[level - 1]))
        named = self.named[level - 1]
        told = np.zeros(len(named), dtype=np.int64)
        told[named] = self._all(f"fan{level}", "counts").astype(np.int64)
        if level == 1:
            told = told[self.words]
        n, shared = len(told), self.shared[level - 1]
        fans[:n] = np.where(shared[:n], told, fans[:n])
        return fans


def _told(table: pa.Table) -> dict[str, dict[str, list[np.ndarray]]]:
    """Answers by kind, those of the first part first."""
    table = table.sort_by([("kind", "ascending"), ("part", "ascending")])
    out: dict[str, dict[str, list[np.ndarray]]] = {}
    for kind, words, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "words", "counts"))):
        own = out.setdefault(kind, {"words": [], "counts": []})
        own["counts"].append(unpack(counts))
        own["words"].append(unpack(words) if words is not None else np.zeros(len(own["counts"][-1]), dtype=np.uint64))
    return out


def _ask(texts: DataFrame, told: DataFrame, level: int, parts: int, hot: int) -> DataFrame:
    """What blocks ask about their n-grams of an order, given the answers about the shorter ones."""

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _message([])
        row = block.to_pylist()[0]
        grams = _Grams(row, answers, parts, hot)
        for k in range(2, level):
            grams.deepen(k)
        return _message([(part, row["block"], kind, pack(p, True), pack(w, kind == "more"), pack(c), 0) for part, kind, p, w, c in grams.question()])

    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, MESSAGE)


class _Automaton:
    """States, arcs and failure arcs that a block can reach.

    States are n-grams that something continues, and the root.  An arc of order k leads from the state of its first k - 1 tokens and
    weighs the smoothed log10 probability of the last.  A state without an arc for a token fails to the state of its tokens but the
    first, at the weight of the mass that its discounts leave.  The arc's target is the longest state that its tokens end with.
    """

    def __init__(self, grams: _Grams, order: int, total: int, distinct: int):
        self.at = grams.at
        mass = total + 0.1 * (distinct + 1)
        self.unknown = 0.1 / mass
        self.base = (grams.counts[0] + 0.1) / mass
        self.arc, self.fail, self.states = [np.log10(self.base)], [], []
        probability = self.base
        for k in range(2, order + 1):
            where = grams.example[k - 1]
            context = grams.at[k - 2][where - 1]
            shorter = grams.at[k - 2][where]
            fans, count = grams.fans(k - 1), grams.counts[k - 2]
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.where(fans > 0, DISCOUNT * fans / count, 1.0)
                probability = np.maximum(grams.counts[k - 1] - DISCOUNT, 0) / count[context] + left[context] * probability[shorter]
                self.arc.append(np.log10(probability))
                self.fail.append(np.where(fans > 0, np.log10(left), 0.0))
            self.states.append(fans > 0)

    def walk(self, tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """log10 probability of each piece of tokens, read from left to right from the root.

        All pieces take their next token together; each carries its state, as depth and number.  The first ``skip`` tokens of a piece only
        lead to its state and aren't counted.
        """
        by_length = np.argsort(-(stops - starts), kind="stable")
        starts, lengths, skip = starts[by_length], (stops - starts)[by_length], skip[by_length]
        depth = np.zeros(len(starts), dtype=np.int64)
        state = np.zeros(len(starts), dtype=np.int64)
        score = np.zeros(len(starts))
        top = len(self.states)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            place, d, s = starts[:live] + step, depth[:live], state[:live]
            gain = np.zeros(live)
            taken = np.full(live, -1)
            for k in range(top, -1, -1):
                here = (taken < 0) & (d == k)
                arc = np.where(here, self.at[k][place], -1)
                found = arc >= 0
                gain[found] += self.arc[k][arc[found]]
                taken[found] = k
                missed = here & ~found
                if k:  # fail to the state of all tokens but the first, which ends at the token before
                    gain[missed] += self.fail[k - 1][s[missed]]
                    if k > 1:
                        s[missed] = self.at[k - 2][place[missed] - 1]
                    d[missed] = k - 1
                else:
                    gain[missed] += math.log10(self.unknown)
            score[:live] += np.where(skip[:live] > step, 0.0, gain)
            d[:] = 0
            for k in range(1, top + 1):  # the longest state that ends here; its own suffixes are states as well
                gram = self.at[k - 1][place]
                longer = (gram >= 0) & (taken >= k - 1)
                longer[longer] = self.states[k - 1][gram[longer]]
                d[longer], s[longer] = k, gram[longer]
        out = np.empty_like(score)
        out[by_length] = score
        return out


def _pieces(sizes: np.ndarray, order: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of pieces of documents, the tokens before that lead to a piece's first state, and each piece's document."""
    firsts = np.cumsum(sizes) - sizes
    per = np.maximum(1, -(-(sizes - 1) // piece))
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = firsts[doc] + 1 + number * piece
    end = np.minimum(begin + piece, firsts[doc] + sizes[doc])
    skip = np.minimum(begin - firsts[doc], order - 1)
    return begin - skip, end, skip, doc


def scores(
    docs: DataFrame, held_out: Column, order: int = 3, part_bytes: int = PART_BYTES, block_tokens: int = BLOCK_TOKENS, piece: int = PIECE, hot: int = HOT
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    A text's tokens are its words, A-Z in lower case, and one end.  The model is a backoff automaton over all n-grams up to ``order`` of all rows that
    aren't held out: absolute discounting (``DISCOUNT``), each context's missing mass going to the context without its first token, down to the base
    distribution of single tokens.  ``score`` is the log10 probability of the whole text, ``base_score`` that of the base distribution alone.

    Nothing of the model is dropped or held by one machine.  Texts become blocks of documents, written once.  Blocks ask parts, dealt by a hash
    of the context (of the whole n-gram where the context occurs more than ``hot`` times), about their distinct n-grams of each order, with their own counts; a
    part adds up and answers.  What follows a context that no
    other block has needn't be asked.  So a frequent n-gram costs an entry per block, and a block gets just the states and arcs that its texts can
    reach, through which they are then walked from left to right.

    Null and empty texts have one token, the end.  Null ids count as not held out unless ``held_out`` says otherwise (null: not held out); repeated
    rows count and are scored each; other columns are left out.  Without a row to learn from, all tokens are unknown and equally likely.
    """
    spark = ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bytes_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(bytes_of // part_bytes)
    folder = f"{shared_folder(spark)}/backoff-{uuid.uuid4().hex}"
    encoded = _encode(docs, held_out, parts, block_tokens, f"{folder}/blocks")
    texts, asked = encoded.filter("kind = 'texts'"), {1: encoded.filter("kind = 'ask'").drop("ids", "places")}
    _answers(asked[1], 1).write.parquet(f"{folder}/level1")
    first = spark.read.schema(MESSAGE).parquet(f"{folder}/level1")
    total = texts.agg(F.sum("n")).first()[0] or 0
    distinct = (first.filter("kind = 'size'").agg(F.sum("n")).first()[0] or 0) - (1 if total else 0)  # without the start

    told, named, fans = first.filter("block >= 0"), first.filter("kind = 'id1'"), []
    for level in range(2, order + 1):
        asked[level] = _ask(texts, told, level, parts, hot)
        answers = _answers(asked[level], level)
        fans.append(_fans(named, answers.filter("kind = 'more'"), level - 1))
        named = answers.filter(f"kind = 'id{level}'")
        told = told.unionByName(answers.filter("block >= 0" if level < order else f"kind = 'count{level}'"))
    for more in fans:
        told = told.unionByName(more)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.drop_columns(["ids"]).to_pylist()[0]
        grams = _Grams(row, answers, parts, hot)
        for k in range(2, order + 1):
            grams.deepen(k)
        automaton = _Automaton(grams, order, total, distinct)
        starts, stops, skip, doc = _pieces(grams.sizes, order, piece)
        n = len(grams.sizes)
        score = np.bincount(doc, weights=automaton.walk(grams.tokens, starts, stops, skip), minlength=n)
        counted = ~grams.first
        of = np.repeat(np.arange(n), grams.sizes)[counted]
        word = grams.tokens[counted]
        ids = pa.concat_arrays(block.column("ids").chunks).flatten()
        columns = [
            ids, grams.held_out, grams.sizes - 1, np.bincount(of, weights=grams.counts[0][word] > 0, minlength=n).astype(np.int64), np.full(n, total),
            np.bincount(of, weights=np.log10(automaton.base)[word], minlength=n), score,
        ]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)
