"""Repeated passages: shared word seeds, collinear chains through a Fenwick tree, and aligned words between the chain's ends."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from reclutark.llm.common import runs, ship, texts_of, word_hashes, words
from reclutark.session import cut_lineage

#: Words of a seed, and seeds of which the least hash is kept: two texts that share SEED + WINDOW - 1 words in a row share a seed.
SEED, WINDOW = 5, 16

#: Words of the shortest passage: of one of more than fifty words, the first or last few may have been changed.
LEAST_WORDS = 45

#: Least share of equal five-word shingles among those of both sides.
SIMILARITY = 0.8

#: Cost of a word of gap, as a share of a seed's weight, and the widest gap that a chain bridges.
GAP_COST, WIDEST_GAP = 0.01, 40

#: Words beyond a chain's ends that are looked at: seeds of longer equal runs would be in the chain.
MARGIN = 48

#: Documents of a block, about: a seed has no more of them in one task.
BLOCK = 2**20

#: Equal words before or after a seed in SEED + WINDOW - 1 equal words: one side has so many.
BESIDE = WINDOW // 2

#: Lower half of the place of a longer key, which needs nothing beside it: a pair of seeds, or a run of LEAST_WORDS words; and what is added to the latter at the
#: end of a text.  What stands beside a seed is odd or 0 in either half, so it is never one of a run's.
ANY, RUN, AT_END = 1, 2, 4

#: Rows of a seed that all meet each other: three documents with one place each.  A seed of more is crowded.
MET = 3

#: Bits of the table of crowded seeds.  Seeds that share a bit with one are crowded too, which costs keys and loses nothing.
CROWD_BITS = 26

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SEED words, from those of the words, and the least of each window of WINDOW of them."""
    n = len(single) - SEED + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        h = (h ^ single[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h, _over_windows(np.minimum, h)


def _over_windows(of: np.ufunc, x: np.ndarray) -> np.ndarray:
    """Minima or maxima of all windows of WINDOW values."""
    width = 1
    while 2 * width <= WINDOW:  # windows of doubled width
        x = of(x[:-width], x[width:])
        width *= 2
    rest = WINDOW - width
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def _hashes_of(text: str) -> np.ndarray:
    return word_hashes(*texts_of(pa.array([text])))[0]


def seed_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the seeds of a text: in each window of WINDOW runs of SEED words, the one of least hash."""
    return _seeded(_hashes_of(text))[:2]


def _seeded(single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(single) < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    h, least = _hashed(single)
    at = _kept(h, least)
    return h[at].view(np.int64), at.astype(np.int32), _beside(h, at)


def _beside(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sixteen bits of the BESIDE words before each place's seed, and of those after it; 0 where the text has fewer."""
    out = np.zeros(len(at), dtype=np.int64)
    for start, shift in ((-BESIDE, 16), (SEED, 0)):
        there = (at + start >= 0) & (at + start + BESIDE - SEED < len(h))
        k = at[there] + start
        out[there] |= (_mixed([h[k], h[k + BESIDE - SEED]], 1).astype(np.int64) & 0xFFFF) << shift
    return out


def _kept(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    # A place is kept if it is the minimum of a window around it, so the greatest of their minima.
    outside = np.zeros(WINDOW - 1, dtype=np.uint64)
    kept = h == _over_windows(np.maximum, np.concatenate([outside, least, outside]))
    at = np.flatnonzero(kept)
    order = np.lexsort((at, h[at]))
    close = (np.diff(h[at][order]) == 0) & (np.diff(at[order]) < WINDOW)
    if close.any():
        at = np.sort(_spaced(at[order].tolist(), close.tolist()))
    return at


def _mixed(keys: list[np.ndarray], odd: int) -> np.ndarray:
    """One hash of several, whose last bit is ``odd``."""
    h = np.zeros(len(keys[0]), dtype=np.uint64)
    for key in keys:
        h = (h ^ key) * _MIX
        h ^= h >> np.uint64(29)
    return h & ~np.uint64(1) | np.uint64(odd)


def long_places(single: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and their lower halves of the longer keys of a text, given its words' hashes, where its seeds are crowded: every run of LEAST_WORDS words
    whose windows have crowded seeds only (odd), and pairs of crowded seeds that a passage may hold (even).

    A run has its key in each text that holds it, as the key depends on the words of the run alone; so an exact repeat always
    meets the first document that holds it, whatever holds parts of it.
    """
    if len(single) < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    h, least = _hashed(single)
    crowded = lambda x: crowd[(x & np.uint64(2**CROWD_BITS - 1)).astype(np.int64) >> 3] >> (x & np.uint64(7)).astype(np.uint8) & 1
    alone = np.concatenate([[0], np.cumsum(1 - crowded(least).astype(np.int64))])
    width = LEAST_WORDS - SEED - WINDOW + 2  # windows within a run of LEAST_WORDS words
    whole = np.flatnonzero(alone[width:] == alone[:-width])
    keys, places = [_mixed([h[whole + k] for k in (*range(0, LEAST_WORDS - SEED, SEED), LEAST_WORDS - SEED)], 1)], [whole]
    at = _kept(h, least)
    at = at[crowded(h[at]) == 1]
    for k in (1, 2, 4):
        left, right = at[:-k], at[k:]
        near = right - left <= LEAST_WORDS - SEED
        keys.append(_mixed([h[left[near]], h[right[near]]], 0))
        places.append(left[near])
    places = np.concatenate(places)
    lower = np.full(len(places), ANY)
    lower[: len(whole)] = np.where(whole + LEAST_WORDS == len(single), RUN | AT_END, RUN)
    return np.concatenate(keys).view(np.int64), places.astype(np.int32), lower


def _spaced(places: list[int], close: list[bool]) -> list[int]:
    """Of places of one hash that follow each other closely, as words repeated on and on have, so many that every window holds
    one: the last within WINDOW of the one before."""
    out = [places[0]]
    for k in range(1, len(places)):
        if not close[k - 1]:
            out.append(places[k])
        elif k == len(places) - 1 or not close[k] or places[k + 1] - out[-1] > WINDOW:
            out.append(places[k])
    return out


def seeds(docs: DataFrame, crowd: Broadcast | None = None) -> DataFrame:
    """``h, doc_id, pos`` (the place in the upper half, what stands beside in the lower) for the seeds of every whole text, or for the longer keys where seeds are in the table ``crowd``; texts
    shorter than a passage have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if crowd is None else np.frombuffer(crowd.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, texts = (c.slice(at, 1024) for c in batch.columns)
                hashes, words_of = word_hashes(*texts_of(texts))
                ends = np.cumsum(words_of).tolist()
                found = [_seeded(hashes[a:b]) if table is None else long_places(hashes[a:b], table) for a, b in zip([0, *ends], ends)]
                counts = [len(h) for h, *_ in found]
                places = np.concatenate([p for _, p, *_ in found]).astype(np.int64)
                beside = np.concatenate([b for *_, b in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([h for h, *_ in found])), pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), counts)),
                    pa.array(places << 32 | beside)], names=["h", "doc_id", "pos"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return read.mapInArrow(find, "h long, doc_id long, pos long")


def paired(found: DataFrame, bounds: list[int], every: bool) -> DataFrame:
    """``kind, h, block, doc_id, src_id, pos, src_pos, n``: every key beside its first place in the block of ids (kind 0), and beside
    its place in the document before its own that holds it (kind 2; odd keys only if ``every``); and of a key in a block its
    first and last place and number of rows (kind 1), if there are several blocks or it is crowded.

    One shuffle brings the places of a key in a block together, sorted, and they are read as a stream: a key that a third of
    all documents hold is split by blocks and gives two rows for each document, never their pairs.  ``bounds`` are the first
    ids of the blocks after the first.
    """
    several = bool(bounds)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, ["h", "block"]):
            h, block, doc, pos = (table.column(c).to_numpy() for c in ("h", "block", "doc_id", "pos"))
            starts, sizes = cuts[:-1], np.diff(cuts)
            first = np.repeat(starts, sizes)
            # Rows of the first document go on if the first one of all may be in another block.
            row = np.arange(len(doc)) if several else np.flatnonzero(doc != doc[first])
            yield _batch(0, h[row], block[row], doc[row], doc[first[row]], pos[row], pos[first[row]], np.zeros(len(row), np.int64))
            row = np.flatnonzero(doc != doc[first])
            before = row - 1
            row = row[(doc[before] != doc[row]) & (several | (before != first[row])) & (every | (h[row] & 1 == 0))]
            yield _batch(2, h[row], block[row], doc[row], doc[row - 1], pos[row], pos[row - 1], np.zeros(len(row), np.int64))
            again = np.zeros(len(doc), np.int64)
            again[1:] = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])
            n = sizes + np.where(np.add.reduceat(again, starts) > 0, MET, 0)
            of = np.flatnonzero(several | (n > MET))
            last = cuts[1:] - 1
            yield _batch(1, h[starts[of]], block[starts[of]], doc[starts[of]], doc[last[of]], pos[starts[of]], pos[last[of]], n[of])

    names = ["kind", "h", "block", "doc_id", "src_id", "pos", "src_pos", "n"]

    def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(columns[0]), kind, np.int32), *columns)], names=names)

    block = F.lit(0)
    if several:
        block = F.expr("size(filter(transform(array(%s), b -> b <= doc_id), x -> x))" % ", ".join(f"{b}L" for b in bounds))
    keys = ["h", "block"]
    placed = found.withColumn("block", block).repartition(*keys).sortWithinPartitions(*keys, "doc_id", "pos")
    return cut_lineage(placed.mapInArrow(pair, "kind int, h long, block int, doc_id long, src_id long, pos long, src_pos long, n long"))


def matches(pairs: DataFrame, several: bool, every: bool) -> DataFrame:
    """``doc_id, src_id, pos, src_pos``: every key of ``pairs`` beside its first place in any document before, and beside its place in
    the last document before that holds it.  The blocks only split the work: each gets the first place of all blocks,
    and its first place the last one of the blocks before."""
    columns = ["doc_id", "src_id", "pos", "src_pos"]
    if not several:
        return pairs.filter("kind != 1").select(*columns)
    over = Window.partitionBy("h").orderBy("block")  # a row per block
    place, end = F.struct("doc_id", "pos"), F.struct(F.col("src_id").alias("doc_id"), F.col("src_pos").alias("pos"))
    ends = pairs.filter("kind = 1").select("h", "block", "doc_id", "pos", F.first(place).over(over).alias("first"), F.lag(end).over(over).alias("near"))
    to_first = pairs.filter("kind = 0").select("h", "block", "doc_id", "pos").join(ends.select("h", "block", "first"), ["h", "block"])
    first = to_first.select("doc_id", F.col("first.doc_id").alias("src_id"), "pos", F.col("first.pos").alias("src_pos")).filter("doc_id != src_id")
    near = ends.filter(F.col("near").isNotNull() & (F.lit(every) | F.expr("h & 1 = 0"))).select("doc_id", F.col("near.doc_id").alias("src_id"), "pos", F.col("near.pos").alias("src_pos"))
    return first.unionAll(pairs.filter("kind = 2").select(*columns)).unionAll(near)


def crowd_table(pairs: DataFrame) -> bytes | None:
    """Bits of the crowded keys of ``pairs``, whose rows don't all meet each other: of more than MET rows, or with several in a document."""
    crowded = pairs.filter("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > MET)
    slot = F.col("h").bitwiseAND(F.lit(2**CROWD_BITS - 1))
    bits = crowded.select(F.shiftright(slot, 3).alias("at"), F.expr("shiftleft(1, cast(h & 7 as int)) as bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # no more rows than the table has bytes
    if not found.num_rows:
        return None
    table = np.zeros(2**CROWD_BITS // 8, np.uint8)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def block_bounds(docs: DataFrame) -> list[int]:
    """First ids of the blocks of about BLOCK documents after the first, however the ids lie."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    blocks = -(-ids.count() // BLOCK)
    if blocks < 2:
        return []
    return sorted(set(ids.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0]))


def best_chains(pos: np.ndarray, src: np.ndarray) -> list[list[int]]:
    """Chains of matches that ascend on both sides, as indexes; matches come in the order of ``pos``.

    A match is worth one, each word between neighbours of a chain costs GAP_COST; so the best predecessor of a match
    has the highest sum of its worth and the cost of its place, which a Fenwick tree over the places in the source
    keeps as prefix maxima.  Chains are cut at gaps above WIDEST_GAP.
    """
    n = len(pos)
    places = np.unique(src)
    rank = (np.searchsorted(places, src) + 1).tolist()
    p, s, size = pos.tolist(), src.tolist(), len(places)
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    worth, before = [0.0] * n, [-1] * n
    start = 0
    while start < n:
        stop = start
        while stop < n and p[stop] == p[start]:
            best, i, r = (-1.0, -1), stop, rank[stop] - 1
            while r:
                if tree[r] > best:
                    best = tree[r]
                r &= r - 1
            gain = best[0] - GAP_COST * (p[i] + s[i])
            worth[i], before[i] = (1 + gain, best[1]) if best[1] >= 0 and gain > 0 else (1.0, -1)
            stop += 1
        for i in range(start, stop):  # places of one word don't follow each other
            entry, r = (worth[i] + GAP_COST * (p[i] + s[i]), i), rank[i]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        start = stop
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-worth[i], i)):
        chain: list[int] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and max(p[chain[-1]] - p[i], s[chain[-1]] - s[i]) > WIDEST_GAP:
                chains.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def _thinned(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, src: np.ndarray) -> list[np.ndarray]:
    """Sorted matches without equal rows, and of those that go on word by word the ends and every WINDOW-th; whether a match may
    stand alone, as the words on one side of it are the same; and RUN where LEAST_WORDS words from it on are the same, with AT_END if those are the last."""
    equal = pos ^ src
    sure = np.where(np.isin(pos & 0xFFFFFFFF, (RUN, RUN | AT_END)), pos & 0xFFFFFFFF, 0)
    whole = (sure > 0) | ((equal & 0xFFFF == 0) & (pos & 0xFFFF > 0)) | ((equal >> 16 & 0xFFFF == 0) & (pos >> 16 & 0xFFFF > 0))
    pos, src = (c >> 32 for c in (pos, src))
    order = np.lexsort((~whole, -sure, src, pos, source, doc))
    doc, source, pos, src, whole, sure = (c[order] for c in (doc, source, pos, src, whole, sure))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (pos[1:] != pos[:-1]) | (src[1:] != src[:-1])
    doc, source, pos, src, whole, sure = (c[new] for c in (doc, source, pos, src, whole, sure))
    on = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (pos[1:] == pos[:-1] + 1) & (src[1:] == src[:-1] + 1)
    kept = ~(np.append(False, on) & np.append(on, False)) | (pos % WINDOW == 0)
    return [c[kept] for c in (doc, source, pos.astype(np.int32), src.astype(np.int32), whole, sure)]


def _sure_end(pos: list[int], src: list[int], sure: list[int]) -> int:
    """Where the words end that are the same from a chain's first place on, by its runs; beyond all places if the text ends there."""
    if not sure[0]:
        return pos[0]
    end, over = pos[0] + LEAST_WORDS, False
    for p, s, run in zip(pos, src, sure):
        if run and p - s == pos[0] - src[0] and p <= end:
            end, over = p + LEAST_WORDS, over or run & AT_END > 0
    return 1 << 62 if over else end


def needed(spans: list[tuple[int, int, int]]) -> list[bool]:
    """Which chains (first place, last place, :func:`_sure_end`) of a document are verified: the fewest whose sure words are those of all, and each
    that could give a word beyond them.

    The sure words of a chain are in a passage of it, and no passage of a chain goes beyond the words that are looked at; so the others can't
    cover a word that the ones that stay don't cover.  A line that is repeated on and on has a chain for each time, of which few stay.
    """
    need = [False] * len(spans)
    sure = sorted((k for k, (start, _, end) in enumerate(spans) if end > start), key=lambda k: (spans[k][0], -spans[k][2]))
    begins, ends, at = [], [], 0
    while at < len(sure):
        begins.append(spans[sure[at]][0])
        reached, farthest = begins[-1], None
        while at < len(sure) and spans[sure[at]][0] <= reached:
            while at < len(sure) and spans[sure[at]][0] <= reached:  # of all that begin there, the one that reaches farthest
                if farthest is None or spans[sure[at]][2] > spans[farthest][2]:
                    farthest = sure[at]
                at += 1
            if spans[farthest][2] > reached:
                need[farthest], reached = True, spans[farthest][2]
        ends.append(reached)
    for k, (start, last, _) in enumerate(spans):
        held = bisect_right(begins, max(0, start - MARGIN)) - 1
        need[k] |= held < 0 or last + SEED + MARGIN > ends[held]
    return need


def chains(found: DataFrame) -> DataFrame:
    """``chain, doc_id, src_id, pos, src_pos`` (arrays of the chain's places) for documents that share a key or more.

    A group is what one document shares with others, which its own length bounds.  All chains go on to be verified, as one that
    covers another may fail; but not those that :func:`needed` leaves out, nor a lone seed with other words on both sides.  A passage has 24 equal words in a row or more, whose seeds
    have BESIDE equal words on a side at least.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, ["doc_id"]):
            doc, source, pos, src, whole, sure = _thinned(*(table.column(c).to_numpy() for c in ("doc_id", "src_id", "pos", "src_pos")))
            bounds = np.concatenate([[0], 1 + np.flatnonzero(np.diff(doc)), [len(doc)]])
            rows = []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                mine, spans = [], []
                cuts = [start, *(start + 1 + np.flatnonzero(np.diff(source[start:stop]))).tolist(), stop]
                for a, b in zip(cuts, cuts[1:]):
                    own = best_chains(pos[a:b], src[a:b]) if b - a > 1 else [[0]]
                    for c in own:
                        if len(c) > 1 or whole[a + c[0]]:
                            mine.append((doc[start], source[a], pos[a:b][c], src[a:b][c]))
                            p, s = mine[-1][2].tolist(), mine[-1][3].tolist()
                            spans.append((p[0], p[-1], _sure_end(p, s, sure[a:b][c].tolist())))
                rows += [row for row, need in zip(mine, needed(spans)) if need]
            for k in range(0, len(rows), 4096):
                part = list(zip(*rows[k : k + 4096]))
                lists = (pa.array(c, pa.list_(pa.int32())) for c in part[2:])
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), *lists], names=["doc_id", "src_id", "pos", "src_pos"])

    grouped = found.repartition("doc_id").sortWithinPartitions("doc_id", "src_id", "pos", "src_pos")
    linked = grouped.mapInArrow(link, "doc_id long, src_id long, pos array<int>, src_pos array<int>")
    return cut_lineage(linked.withColumn("chain", F.monotonically_increasing_id()))


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the run of equal words from two places on."""
    n = min(len(a) - i, len(b) - j)
    other = a[i : i + n] != b[j : j + n]
    return n if not n or not other[k := int(other.argmax())] else k


def equal_runs(a: np.ndarray, b: np.ndarray, pos: list[int], src: list[int]) -> list[tuple[int, int, int]]:
    """Runs of equal words (start, start in the source, length) along a chain, and as far as changes of a word let them go on
    beyond its ends; the words are given by their hashes."""
    found: list[tuple[int, int, int]] = []
    x, y = 0, 0
    for i, j in zip(pos, src):
        if i < x or j < y:
            if found and i - j == found[-1][0] - found[-1][1]:
                continue  # inside the run before
            if i < x or j < y:
                continue
        if found:
            between = SequenceMatcher(None, a[x:i].tolist(), b[y:j].tolist(), autojunk=False).get_matching_blocks() if i > x and j > y else []
            found += [(x + m.a, y + m.b, m.size) for m in between if m.size]
        n = _run(a, b, i, j)
        if n:
            found.append((i, j, n))
            x, y = i + n, j + n
    if not found:
        return []
    i, j, n = found[0]
    back = _extended(a[:i][::-1], b[:j][::-1])
    ahead = _extended(a[x:], b[y:])
    return [(i - s - m, j - t - m, m) for s, t, m in reversed(back)] + found + [(x + s, y + t, m) for s, t, m in ahead]


def _extended(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal words from the start on, over one changed, added or left-out word at a time that three equal words follow."""
    found, i, j = [], 0, 0
    while True:
        n = _run(a, b, i, j)
        if n:
            found.append((i, j, n))
        i, j = i + n, j + n
        near = a[i : i + 4].tolist(), b[j : j + 4].tolist()
        step = next(((s, t) for s, t in ((1, 1), (1, 0), (0, 1)) if near[0][s : s + 3] == near[1][t : t + 3] and len(near[0][s : s + 3]) == 3), None)
        if step is None:
            return found
        i, j = i + step[0], j + step[1]


def _shingles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every five words in a row of both sides, equal for equal words."""
    words, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    base, a, b = len(words), numbers[: len(a)], numbers[len(a) :]
    counts = [max(0, len(side) - SEED + 1) for side in (a, b)]
    if base**SEED < 1 << 63:
        out = []
        for side, n in zip((a, b), counts):
            h = np.zeros(n, dtype=np.int64)
            for k in range(SEED):
                h = h * base + side[k : k + n]
            out.append(h)
        return out[0], out[1]
    rows = np.concatenate([np.stack([s[k : n + k] for k in range(SEED)], axis=1) for s, n in zip((a, b), counts)])
    which = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    return which[: counts[0]], which[counts[0] :]


def _first_ends(shingles: np.ndarray, start: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles from ``start`` on, and the first of the ends within which each lies whole (as many as there are ends: none)."""
    found, at = np.unique(shingles[start:], return_index=True)
    return found, np.searchsorted(ends, at + start + SEED, side="left")


def similar_spans(a: np.ndarray, b: np.ndarray, aligned: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, start and end in the source, similarity) from a run of equal words to another: from each run on the
    longest that has the words and the similarity, unless one from an earlier run holds it."""
    if len(aligned) == 1:  # equal words throughout
        s, t, n = aligned[0]
        return [(s, s + n, t, t + n, 1.0)] if n >= LEAST_WORDS else []
    out, reached = [], -1
    if not aligned or max(aligned[-1][k] + aligned[-1][2] - aligned[0][k] for k in (0, 1)) < LEAST_WORDS:
        return out
    starts = np.array(aligned)
    ends = starts[:, :2] + starts[:, 2:]
    grams = _shingles(a, b)
    for i, (s, t, _) in enumerate(aligned):
        if reached == len(aligned) - 1:
            break
        e, u = ends[i:, 0], ends[i:, 1]
        enough = np.maximum(e - s, u - t) >= LEAST_WORDS
        if not enough.any():
            break
        (x, x_in), (y, y_in) = _first_ends(grams[0], s, e), _first_ends(grams[1], t, u)
        of_y = np.searchsorted(y, x)
        of_y[of_y == len(y)] = 0
        shared = (y[of_y] == x) if len(y) else np.zeros(len(x), dtype=bool)
        both_in = np.maximum(x_in[shared], y_in[of_y[shared]])
        n_x, n_y, both = (np.cumsum(np.bincount(c, minlength=len(e) + 1)[: len(e)]) for c in (x_in, y_in, both_in))
        alike = both / np.maximum(1, n_x + n_y - both)
        good = np.flatnonzero(enough & (alike >= SIMILARITY))
        if len(good) and i + int(good[-1]) > reached:
            j = int(good[-1])
            reached = i + j
            out.append((s, int(e[j]), t, int(u[j]), float(alike[j])))
    return out


def _with_own_id(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_own_id``: the doc_id as a long; null for rows without id or text, and where rows of one id have different texts, for all but those
    with the text of least hash."""
    own = F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long"))
    digest = F.xxhash64("text")
    mixed = docs.filter("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("_mixed")).agg(
        F.min(digest).alias("_least"), F.max(digest).alias("_most")).filter("_least <> _most")
    mixed = cut_lineage(mixed.drop("_most"))
    if mixed.isEmpty():
        return docs.withColumn("_own_id", own)
    joined = docs.join(mixed, F.col("doc_id") == F.col("_mixed"), "left")
    return joined.withColumn("_own_id", F.when(F.col("_least").isNull() | (digest == F.col("_least")), own)).drop("_mixed", "_least")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id, first_start_word, first_n_words, similarity`` for every passage of
    ``docs`` that stands in an earlier document (by doc_id) as well.

    A passage has LEAST_WORDS words or more; of its five-word shingles and those of its counterpart, a share of SIMILARITY is
    common to both.  Every seed is held against its first place in the corpus and the document before, and where that leaves documents
    unmet, every run of LEAST_WORDS words and pairs of seeds as well, so work grows with the seeds, not with the pairs of
    documents that share a passage.  A document that repeats many others has a row for each passage; one that
    repeats nothing has none.  Null ids and null, empty or short texts have no passages; equal rows of a doc_id are one document, whose
    passages aren't held against each other; of rows of one id with different texts only those with one of the texts take part; other columns are left out.
    """
    ship(docs.sparkSession)
    docs = _with_own_id(docs).filter("_own_id is not null").select(F.col("_own_id").alias("doc_id"), "text")
    bounds = block_bounds(docs)
    pairs = paired(seeds(docs), bounds, True)
    met, crowd = matches(pairs, bool(bounds), True), crowd_table(pairs)
    if crowd is not None:
        longer = paired(seeds(docs, docs.sparkSession.sparkContext.broadcast(crowd)), bounds, False)
        met = met.unionAll(matches(longer, bool(bounds), False))
    linked = chains(met)

    def side(which: int, key: str, places: str) -> DataFrame:
        start, end = F.greatest(F.get(places, F.lit(0)) - MARGIN, F.lit(0)), F.element_at(places, -1) + SEED + MARGIN
        own = [F.when(F.lit(which == 0), F.col(c)).alias(c) for c in ("doc_id", "src_id", "pos", "src_pos")]
        return linked.select(F.col(key).alias("at"), "chain", F.lit(which).alias("side"), start.alias("start"), end.alias("end"), *own)

    wanted = side(0, "doc_id", "pos").unionAll(side(1, "src_id", "src_pos"))
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("at"), words(F.col("text")).alias("words")).select(
        "at", F.array_join("words", " ").alias("text"), F.size("words").alias("n"))
    # Words from start to end of a text with one blank between words: no whole text is taken apart again, and none goes to Python.
    said = F.expr("substring_index(substring_index(text, ' ', least(end, n)), ' ', -greatest(least(end, n) - start, 0))")
    read = texts.join(wanted, "at").select(said.alias("said"), "chain", "side", "doc_id", "src_id", "pos", "src_pos")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["chain"]):
            out = []
            sides = table.column("side").to_numpy()
            docs_at, sources, places, src_places = (table.column(c).to_pylist() for c in ("doc_id", "src_id", "pos", "src_pos"))
            hashes, counts = word_hashes(*texts_of(table.column("said").combine_chunks()))
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                second = start + int(np.argmax(sides[start:stop]))  # several rows of one doc_id: the first by text is taken
                a, b = (hashes[ends[k] : ends[k + 1]] for k in (start, second))
                pos, src = places[start], src_places[start]
                x, y = max(0, pos[0] - MARGIN), max(0, src[0] - MARGIN)
                aligned = equal_runs(a, b, [p - x for p in pos], [p - y for p in src])
                out += [(docs_at[start], x + s, e - s, sources[start], y + t, u - t, alike) for s, e, t, u, alike in similar_spans(a, b, aligned)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)

    names = ["doc_id", "start_word", "n_words", "first_doc_id", "first_start_word", "first_n_words"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("similarity", pa.float64())])
    ordered = read.repartition("chain").sortWithinPartitions("chain", "side", "said")
    shape = ", ".join(f"{n} long" for n in names) + ", similarity double"
    passed = ordered.mapInArrow(align, shape).repartition("doc_id")
    return passed.sortWithinPartitions("doc_id", "start_word", F.desc("n_words"), *names[3:]).mapInArrow(_uncovered, shape)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fewest passages of each document that cover the same words; they come by start, the longest first, of equal ones the first source.

    Of all passages that begin within what is covered so far, the one that reaches farthest goes on; so a word lies in two of them at most, and
    their number follows the covered words, whatever the number of sources.
    """
    now, covered, ahead, ahead_end = None, 0, None, 0
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            doc, start, n = row[:3]
            if doc != now or start > covered:  # what was ahead is needed; a new stretch may begin here
                if ahead is not None:
                    out.append(ahead)
                    covered, ahead = ahead_end, None
                if doc != now:
                    now, covered, ahead_end = doc, 0, 0
            if start + n <= max(covered, ahead_end):
                continue
            if start > covered or covered == 0:
                out.append(row)
                covered = ahead_end = start + n
            else:
                ahead, ahead_end = row, start + n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), batch.schema)], schema=batch.schema)
    if ahead is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(ahead, batch.schema)], schema=batch.schema)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages of ``found`` cut from their texts; the first document of each keeps its own.

    A text keeps all its other words and what stands between them; one that is all passages becomes empty.
    ``n_chars``, if there, follows the text; rows without passages stay as they are, and so do rows that repeat an id with another text
    than the one in which the passages were found.
    """
    word = regex.compile(r"[^\x20\x09-\x0D]+")

    @F.udf("string", useArrow=True)
    def cut(text: str | None, spans: list | None) -> str | None:
        if text is None or spans is None:
            return None
        places = [m.start() for m in word.finditer(text)]
        out, at = [], 0
        for start, end in sorted((s["start_word"], s["start_word"] + s["n_words"]) for s in spans):
            start, end = (places[k] if k < len(places) else len(text) for k in (start, end))
            if start > at:
                out.append(text[at:start])
            at = max(at, end)
        return "".join([*out, text[at:]])

    # Passages of one document are no more than its text holds.
    spans = found.groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    whole = _with_own_id(docs).select(F.col("_own_id").alias("cut_id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(spans, "cut_id", "left").withColumn("new", cut(F.when(F.col("spans").isNotNull(), F.col("text")), "spans"))
    text = F.coalesce("new", "text")
    fresh = {"text": text, "n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return joined.select(*(fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
