"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import local_components, runs, sampled, ship
from reclutark.llm.graph import connected_components
from reclutark.session import cut_lineage

COSINE = 0.98

#: Vectors that the rotation is fitted on, at most: chosen by a hash of their ids.
SAMPLE = 20_000

#: Bits of a code, and bits of a table's key.  Each permutation of the bits gives ``BITS / KEY_BITS`` tables.
BITS, KEY_BITS, PERMUTATIONS = 64, 16, 4

ITERATIONS, SEED = 50, 10

#: Distance between unit vectors at the least cosine of a link.
REACH = (2 * (1 - COSINE)) ** 0.5

#: Vectors of a bucket that one task compares at once; larger buckets are compared block by block, by as many tasks as there are pairs
#: of blocks.
BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; each is scaled by a power of two first, which is exact, so that no square over- or underflows."""
    exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0, keepdims=True))[1]
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Rotation:
    """Centre and rotation of vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, dimension: int, bits: int = BITS, iterations: int = ITERATIONS):
        random = np.random.default_rng(SEED)
        self.bits = min(bits, dimension)
        if len(vectors) < 2:
            self.mean = np.zeros(dimension)
            self.matrix = np.linalg.qr(random.normal(size=(dimension, dimension)))[0][:, : self.bits]
            return
        units = unit(vectors)
        mean = units.mean(axis=0)
        scatter = np.sqrt(((units - mean) ** 2).sum(axis=1).mean())
        # Vectors that are all within reach of a link are not centred: what is left then would be noise, and so would be their codes.
        self.mean = mean * np.clip((scatter - REACH) / REACH, 0, 1)
        centred = units - self.mean
        spread, axes = np.linalg.eigh(centred.T @ centred)
        basis = axes[:, ::-1][:, : self.bits]
        projected = centred @ basis
        rotation = np.linalg.qr(random.normal(size=(self.bits, self.bits)))[0]
        for _ in range(iterations):  # codes for the rotation, then the rotation for the codes
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ projected)
            rotation = (left @ right).T
        self.matrix = basis @ rotation

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Sign bits, one row of 0 and 1 per vector."""
        return ((unit(vectors) - self.mean) @ self.matrix >= 0).astype(np.uint8)


def _is_usable() -> Column:
    """Whether a row can be linked: id and label not null, every component finite, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(there & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that can be linked."""
    return vectors.select("vec_id", "label", "embedding").filter(_is_usable())


def fit(vectors: DataFrame, rows: int = SAMPLE) -> dict[int, Rotation]:
    """A rotation per dimension, learnt from ``rows`` vectors at most; dimensions that aren't in the sample get a seeded one when needed."""
    found = sampled(vectors, rows, vectors.count(), "vec_id").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    by_size: dict[int, list] = {}
    for vector in found["embedding"]:
        by_size.setdefault(len(vector), []).append(np.asarray(vector, dtype=float))
    return {d: Rotation(np.stack(v), d) for d, v in by_size.items()}


def tables(bits: int, key_bits: int = KEY_BITS, permutations: int = PERMUTATIONS) -> list[np.ndarray]:
    """Bits of each table: several seeded permutations, each cut in substrings, four at least where there are as many bits."""
    random = np.random.default_rng(SEED + 1)
    orders = [np.arange(bits), *(random.permutation(bits) for _ in range(permutations - 1))]
    parts = -(-bits // max(1, min(key_bits, bits // 4)))
    return [part for order in orders for part in np.array_split(order, parts)]


def _keys(rotations: dict[int, Rotation]):
    @F.pandas_udf("array<int>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """A vector's key in each table."""
        for batch in batches:
            sizes = batch.map(len).to_numpy()
            out = np.empty(len(batch), dtype=object)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                rotation = rotations.get(int(d)) or Rotation(np.zeros((0, int(d))), int(d))
                codes = rotation.codes(np.stack(batch.iloc[at].to_list()).astype(float))
                parts = [codes[:, t].astype(np.int64) @ (1 << np.arange(len(t))) for t in tables(rotation.bits)]
                for row, i in zip(np.stack(parts, axis=1), at):
                    out[i] = row
            yield pd.Series(out)

    return keys


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each unit (a bucket, or two blocks of one): per vector the copies it is linked to, and stars that connect them."""
        for table, bounds in runs(batches, ["unit", "table", "key", "label", "size"]):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            side, other, number = (table.column(c).to_numpy() for c in ("side", "other", "table"))
            keys = table.column("keys").combine_chunks()
            width = np.diff(keys.offsets.to_numpy())
            vectors = table.column("embedding").combine_chunks()
            size = np.diff(vectors.offsets.to_numpy())
            all_keys, all_values = keys.flatten().to_numpy(), vectors.flatten().to_numpy()
            key_at, value_at = np.append(0, np.cumsum(width)), np.append(0, np.cumsum(size))
            a, b, links = [], [], []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if stop - start < 2:
                    continue
                x = all_values[value_at[start] : value_at[stop]].astype(float).reshape(stop - start, -1)
                k = all_keys[key_at[start] : key_at[stop]].reshape(stop - start, -1)
                units = unit(x)
                left, right = np.nonzero(np.triu(units @ units.T >= cosine, 1))
                here = (k[left, : number[start]] != k[right, : number[start]]).all(axis=1)  # an earlier table has seen the others
                # Of two blocks, only pairs across; pairs within a block belong to the unit of that block alone.
                here &= (side[start + left] != side[start + right]) | (side[start + left] == other[start + left])
                left, right = left[here], right[here]
                if not len(left):
                    continue
                own = copies[start:stop]
                total = np.bincount(left, own[right], stop - start) + np.bincount(right, own[left], stop - start)
                root = local_components(stop - start, left, right)
                hit = np.flatnonzero(total)
                a.append(node[start + hit])
                b.append(node[start + root[hit]])
                links.append(total[hit].astype(np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in (a, b, links)], names=["a", "b", "links"])

    return compare


def linked(classes: DataFrame, rotations: dict[int, Rotation], cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``a, b, links``: for each ``node`` of ``classes(node, label, embedding, copies)`` and each unit in which it has links, the
    copies it is linked to there, and a node ``b`` that stands for its component there.

    A pair is counted in the first table whose key it shares, so no pair is counted twice and none is written out.
    """
    ship(classes.sparkSession)
    keyed = cut_lineage(classes.withColumn("size", F.size("embedding")).withColumn("keys", _keys(rotations)("embedding")))
    # Keys alone find the buckets of more than one vector; vectors follow only into those.
    homes = keyed.select("node", "label", "size", F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "key", "label", "size"]
    counts = homes.groupBy(*bucket).count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    placed = homes.join(counts.drop("count"), bucket).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A unit is a pair of blocks, or one block with itself; its number holds both.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("other", other).withColumn(
        "unit", F.least("side", "other") * F.col("blocks").cast("long") + F.greatest("side", "other"))
    order = ["unit", *bucket]
    whole = units.select(*order, "side", "other", "node").join(keyed.select("node", "copies", "keys", "embedding"), "node")
    return whole.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(cosine), "a long, b long, links long")


def components(vectors: DataFrame, cosine: float = COSINE, rows: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors have as many components, and the cosine of the original
    vectors in double precision is ``cosine`` or more; they are found if they share a key in one of the tables.  Equal vectors of a label are one class
    before the search: its copies count as links of each other.  Null, zero and non-finite vectors link with nothing.  A null vec_id has no links
    and no component, and is kept.  Rows that repeat a vec_id count as vectors of their own, whatever their labels, lengths and vectors, with links of their
    own; they share the component.
    """
    good = cut_lineage(usable(vectors))
    # Adding zero makes a negative zero a positive one, so that equal vectors are equal as keys.
    zero = F.lit(0.0).cast(good.schema["embedding"].dataType.elementType)
    good = good.withColumn("embedding", F.transform("embedding", lambda x: x + zero))
    # A class has a number of its own, as a vec_id may stand in several.
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    found = cut_lineage(linked(classes.drop("least"), fit(good, rows), cosine, block))
    others = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    member = cut_lineage(good.join(classes, ["label", "embedding"]).select("vec_id", "node", "copies"))
    # The classes of a repeated vec_id are one component.
    homes = member.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").drop("last")
    own = member.join(homes, "vec_id").select("a", F.col("node").alias("b"))
    labels = connected_components(found.select("a", "b").union(own))
    joined = classes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    n_links = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")
    linkable = member.join(others, "node", "left").join(named, "node").select("vec_id", n_links, "component_id")
    shared = member.join(named, "node").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = vectors.filter(~_is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links")).join(shared, "vec_id", "left")
    rest = rest.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linkable.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
