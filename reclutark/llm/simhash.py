"""SimHash near-duplicates: pivot distance tables discard pairs, exact bit distances verify the survivors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import local_components, runs
from reclutark.llm.graph import connected_components
from reclutark.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3

#: Reference fingerprints: as many as two longs hold distances of eight bits each.
PIVOTS = 16

#: Distinct fingerprints that one task compares at once; larger buckets are divided further, none is cut.
BUCKET = 4096

#: Shingles whose bits are summed at once, so that a very long text needs no more memory than a long one.
CHUNK = 1 << 16

_SIGN = 1 << 63


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text as a signed 64-bit integer; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return _signed(hashed(joined, 42))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(starts)).tolist()
    return _signed(sum(1 << b for b in bits))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """``doc_id, fp`` (a signed long) and the columns ``keep`` for every row of ``docs``; whole texts, a null text has no words."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"), *keep)


def references(count: int = PIVOTS, seed: int = 64) -> list[int]:
    """Seeded reference fingerprints."""
    return np.random.default_rng(seed).integers(-_SIGN, _SIGN, count, dtype=np.int64).tolist()


def pivot_table(fp: Column, pivots: list[int]) -> list[Column]:
    """Bit distances to eight reference fingerprints per long, eight bits each."""
    columns = []
    for k in range(0, len(pivots), 8):
        packed = F.lit(0).cast("long")
        for i, pivot in enumerate(pivots[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * i))
        columns.append(packed.alias(f"pivots_{k // 8}"))
    return columns


def _split_bits(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, p)) for p in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def first_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Masks of which two fingerprints within ``max_bits`` agree on at least one: of twice as many blocks as may differ, any
    half."""
    blocks = _split_bits(list(range(64)), 2 * max_bits)
    return [_mask(sum(half, [])) for half in combinations(blocks, max_bits)]


def finer_masks(mask: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks that add a part of the bits outside ``mask``; two fingerprints within ``max_bits`` agree on one of the parts."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [_signed((mask | _mask(part)) & (2 * _SIGN - 1)) for part in _split_bits(rest, max_bits + 1)]


def _matcher(max_bits: int):
    """Links of each bucket as stars, so that a group of n gives n - 1 rows, not its pairs."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["mask", "value"]):
            fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
            pivots = np.stack([table.column(c).to_numpy() for c in table.column_names if c.startswith("pivots_")], axis=1)
            near = pivots.copy().view(np.int8).reshape(len(fp), -1)
            a, b = [], []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if stop - start > 1:
                    left, right = _links(fp[start:stop], near[start:stop], max_bits)
                    if len(left):
                        root = local_components(stop - start, left, right)
                        moved = np.flatnonzero(root != np.arange(stop - start))
                        a.append(node[start + root[moved]])
                        b.append(node[start + moved])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return match


def _links(fp: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket within ``max_bits``: ordered by the first pivot's distance, each row meets those that follow within
    reach; the maximum coordinate difference over all pivots discards, the exact distance verifies."""
    order = np.argsort(pivots[:, 0], kind="stable")
    fp, pivots = fp[order], pivots[order]
    reach = np.searchsorted(pivots[:, 0], pivots[:, 0] + max_bits, side="right")
    left, right = [], []
    for i, stop in enumerate(reach.tolist()):
        if stop > i + 1:
            near = np.abs(pivots[i + 1 : stop] - pivots[i]).max(axis=1) <= max_bits
            j = np.flatnonzero(near) + i + 1
            j = j[np.bitwise_count(fp[j] ^ fp[i]) <= max_bits]
            if len(j):
                left.append(np.full(len(j), order[i]))
                right.append(order[j])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def near_links(classes: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that connect just those ``node``s whose distinct ``fp`` are within ``max_bits`` of each other, at once or
    over others.

    Rows meet only where they agree on half of the blocks.  A bucket above ``bucket`` rows is divided by further parts
    of the bits that are still free; each division keeps every pair within reach, and ends when the free bits can't
    hold more than ``bucket`` values.
    """
    known = classes.select("node", "fp", *pivot_table(F.col("fp"), references(pivots)))
    rows = known.withColumn("mask", F.explode(F.array(*map(F.lit, first_masks(max_bits)))))
    masks, links = first_masks(max_bits), None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        can_grow = [m for m in masks if 2 ** (64 - (m % (2 * _SIGN)).bit_count()) > bucket]
        if not can_grow:
            return _united(links, _match(rows, max_bits))
        finer = {m: finer_masks(m, max_bits) for m in can_grow}
        steps = F.broadcast(rows.sparkSession.createDataFrame(list(finer.items()), "mask long, finer array<long>"))
        counts = rows.groupBy("mask", "value").count().filter(F.col("count") > bucket)
        large = cut_lineage(counts.join(steps, "mask"))
        if large.isEmpty():
            return _united(links, _match(rows, max_bits))
        links = _united(links, _match(rows.join(large, ["mask", "value"], "left_anti"), max_bits))
        rows = rows.join(large, ["mask", "value"]).withColumn("mask", F.explode("finer")).select(*known.columns, "mask")
        masks = sorted({f for parts in finer.values() for f in parts})


def _match(rows: DataFrame, max_bits: int) -> DataFrame:
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_matcher(max_bits), "a long, b long")


def _united(links: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if links is None else links.union(more)


def components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    Fingerprints within ``max_bits`` bits are linked; ``component_id`` is the smallest doc_id reachable, itself included.
    Equal fingerprints are one class before any search, so copies by the thousand cost one row there.  Texts that are null, empty or
    blank have fingerprint zero and are linked like any other.  A row without doc_id gets the component of its fingerprint, null if
    no row with an id has it.  Repeated rows get a row each; an empty table gives none; other columns are left out.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"))
    # A doc_id that stands on several rows joins their fingerprints.
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    own = prints.join(repeated, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = connected_components(near_links(classes, max_bits, bucket=bucket).union(own))
    named = classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of least doc_id, null last, and of one id the one whose row has the least hash.

    Groups are those of the fingerprints, whatever the ids: rows that repeat a doc_id with other texts are no copies of each other, and rows without doc_id
    are copies like any other.  Null and empty texts are copies of each other.  Of equal rows one stays; an empty table gives none.
    """
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    prints = cut_lineage(fingerprints(docs.withColumn("_digest", digest), shingle, "_digest"))
    classes = cut_lineage(prints.select("fp").distinct().withColumn("node", F.col("fp")))
    labels = connected_components(near_links(classes, max_bits))
    named = prints.join(classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "fp")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("_id"), F.col("first._digest").alias("_kept"))
    rows = docs.withColumn("_digest", digest)
    kept = rows.join(chosen, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_digest") == F.col("_kept")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_digest"]).select(*(F.col(f"`{c}`") for c in docs.columns))
