"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space and U+0009 to U+000D, nothing else.
BLANKS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not blanks; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


def crc_fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the key as text; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def sampled(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the keys: the same rows whatever the partitions."""
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / total)))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables cut between groups, with the bounds of the groups in each, from batches sorted by ``keys``.

    No group is split; only the last group of a batch waits for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in keys) and all(
            batch.column(k)[0].as_py() == batch.column(k)[-1].as_py() for k in keys
        ):
            held.append(batch)  # one group fills the whole batch
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = _bounds(table, keys)
        last = int(bounds[-2])
        if last:
            yield table.slice(0, last), bounds[:-1]
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes along the undirected links left-right."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            break
    return root


#: Bytes whose words are hashed at once; a word of so many or more is hashed by itself.
HASHED_AT_ONCE = 1 << 22

_BASE = np.uint64(0xD1342543DE82EF95)


@cache
def _letters(lower: bool) -> np.ndarray:
    """A 64-bit number for each byte, the same for a letter of A-Z and its small one if ``lower``; 0 for blanks."""
    numbers = np.random.default_rng(64).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        numbers[65:91] = numbers[97:123]
    numbers[[32, *range(9, 14)]] = 0
    return numbers


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(HASHED_AT_ONCE, base)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after the other in ``data`` (bytes), and the number of words of each text.

    ``offsets`` are the ends of the texts, with the beginning of the first before them.  A word's hash is a polynomial in its bytes, taken from prefix
    sums, so no word becomes a Python object; it depends on the word alone.
    """
    found, firsts = [], []
    start, end = int(offsets[0]), int(offsets[-1])
    letters, (up, down) = _letters(lower), _powers()
    inner = offsets[1:-1]
    while start < end:
        stop = min(end, start + HASHED_AT_ONCE)
        if stop < end:  # not within a word
            part = letters[data[start:stop]] == 0
            cut = start + int(len(part) - np.argmax(part[::-1])) if part.any() else start
            ahead = inner[np.searchsorted(inner, stop, side="right") - 1] if len(inner) and inner[0] <= stop else start
            stop = max(cut, int(ahead))
            if stop <= start:  # one word of more bytes
                rest = letters[data[start:end]] == 0
                stop = start + int(np.argmax(rest)) if rest.any() else end
                later = inner[np.searchsorted(inner, start, side="right") :]
                stop = min(stop, int(later[0])) if len(later) else stop
                found.append(np.array([_long_word(data[start:stop], lower)], dtype=np.uint64))
                firsts.append(np.array([start]))
                start = stop
                continue
        numbers = letters[data[start:stop]]
        inside = np.zeros(stop - start + 2, dtype=bool)
        inside[1:-1] = numbers != 0
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = inner[(inner > start) & (inner < stop)] - start  # a text's end is a word's end
        begins[cuts] |= inside[1 + cuts]
        ends[cuts - 1] |= inside[cuts]
        sums = np.zeros(stop - start + 1, dtype=np.uint64)
        np.cumsum(numbers * up[: stop - start], out=sums[1:])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        h = (sums[last] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for k in np.flatnonzero(last - first >= HASHED_AT_ONCE):
            h[k] = _long_word(data[start + first[k] : start + last[k]], lower)
        found.append(h)
        firsts.append(first + start)
        start = stop
    hashes = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    places = np.concatenate(firsts) if firsts else np.zeros(0, dtype=np.int64)
    return hashes, np.diff(np.searchsorted(places, offsets))


def _long_word(word: np.ndarray, lower: bool) -> int:
    return xxhash.xxh64_intdigest(word.tobytes().lower() if lower else word.tobytes())


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts, as they lie; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the Python workers of the session, once; they may run in other folders or on other machines."""
    context = spark.sparkContext
    if getattr(context, "_reclutark_shipped", None) is None:
        package = Path(__file__).resolve().parents[1]
        file = Path(tempfile.mkdtemp(prefix="reclutark-code-"), "reclutark.zip")
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as packed:
            for source in sorted(package.rglob("*.py")):
                packed.write(source, source.relative_to(package.parent))
        context.addPyFile(str(file))
        context._reclutark_shipped = str(file)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written tables: the one of ``spark.checkpoint.dir``; a scratch folder only for a local master without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="reclutark-tables-")
    return folder
