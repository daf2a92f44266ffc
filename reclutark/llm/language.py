"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import ship

#: Hashed n-gram space, 15 bits: with the number of languages, it bounds the model, whatever the size of the corpus.
CELLS = 1 << 15

#: Longest n-grams.
ORDERS = 3

MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
SHIFT = np.uint64(64 - 15)
SMOOTHING = 0.1

#: Expectation-maximisation ends when no proportion moves by more, or after this many rounds.
TOLERANCE = 1e-4
ROUNDS = 60

#: Log-likelihood that a further language must gain, per logarithm of the number of n-grams.
PENALTY = 2.0

#: Characters whose n-grams are hashed at once.
CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point the number it is hashed by: its own for a letter, that of a blank for all else."""
    points = np.arange(0x110000, dtype=np.uint64)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letter, points, np.uint64(32)) * MIX[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the hashed n-grams of a whole text; letters are lower-cased, all that is no letter is a blank."""
    total = np.zeros(CELLS, dtype=np.int64)
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        seen = min(at, ORDERS - 1)
        codes = np.frombuffer(text[at - seen : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for cells in _cells(codes, seen):
            total += np.bincount(cells, minlength=CELLS)
    total[_blanks()] = 0  # n-grams of blanks alone tell nothing
    found = np.flatnonzero(total)
    return found, total[found]


def _cells(codes: np.ndarray, seen: int) -> list[np.ndarray]:
    """Cells of the n-grams of each order that end after the first ``seen`` characters."""
    single = _letters()[codes]
    grams, out = single, []
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(grams) < 2:
                break
            grams = grams[:-1] * MIX[1] + single[n - 1 :]
        new = grams[max(0, seen - n + 1) :]
        out.append((((new ^ (new >> np.uint64(31))) * MIX[2] + np.uint64(n)) >> SHIFT).astype(np.int64))
    return out


@cache
def _blanks() -> list[int]:
    return [int(c[0]) for c in _cells(np.full(ORDERS, 32), 0)]


@dataclass
class Model:
    """Languages and the logarithm of each cell's probability in each of them."""

    languages: list[str]
    log_likelihood: np.ndarray

    def mixture(self, text: str | None) -> tuple[str, float]:
        """Main language of a text and its proportion; ``und`` without a letter."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return "und", 0.0
        cells, counts = gram_counts(text)
        scores = self.log_likelihood[cells]
        counts = counts.astype(float)
        everyone = _maximise(scores, counts, ROUNDS // 4)[0]
        order = np.argsort(-everyone, kind="stable")
        cost = PENALTY * np.log(counts.sum() + 1)
        chosen, share = order[:1], np.ones(1)
        best = float(counts @ scores[:, order[0]])
        for k in range(2, len(order) + 1):  # languages join in the order of their proportions, while each pays its penalty
            shares, value = _maximise(scores[:, order[:k]], counts, ROUNDS)
            if value - best <= cost:
                break
            chosen, share, best = order[:k], shares, value
        main = int(np.argmax(share))
        return self.languages[chosen[main]], float(share[main])


def _maximise(scores: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages, and the log-likelihood, by expectation-maximisation."""
    top = scores.max(axis=1, keepdims=True)
    likelihood = np.exp((scores - top).astype(float))
    share = np.full(scores.shape[1], 1 / scores.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        moved = share * ((counts / (likelihood @ share)) @ likelihood) / total
        done = np.abs(moved - share).max() < TOLERANCE
        share = moved
        if done:
            break
    return share, float(counts @ (np.log(likelihood @ share) + top[:, 0]))


def learn(docs: DataFrame, lang: str = "lang") -> Model:
    """Counts every n-gram of every row that has a text and a language; each task adds up before the shuffle.

    A language's counts take no more than the hashed cells, so the model that reaches the driver is bounded by the number of
    languages.  Without such rows the model knows no language and everything is ``und``.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1)):
                cells, counts = gram_counts(text.as_py())
                if (key := name.as_py()) not in totals:
                    totals[key] = np.zeros(CELLS, dtype=np.int64)
                totals[key][cells] += counts
        for key, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found), pa.array(total[found])], names=["lang", "cell", "n"])

    known = docs.select(F.col("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counted = known.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counted["lang"].unique())
    table = np.full((CELLS, len(names)), SMOOTHING)
    for k, name in enumerate(names):
        own = counted[counted["lang"] == name]
        table[own["cell"], k] += own["n"]
    return Model(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``: the main language of each whole text and its proportion.

    Each text is taken as a mixture of the model's languages; the proportions come from expectation-maximisation over all its
    n-grams, the set of languages from the likelihood less a penalty per language.  Ties go to the first language by name.  Null and
    empty texts, and texts without a letter, are ``und`` with score 0.  Rows are independent; null ids and repeated rows
    give a row each, other columns are left out.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.mixture(t) for t in batch], columns=["lang_pred", "score"]).astype({"score": float})

    flag = F.lit(False) if held_out is None else held_out
    return docs.select("doc_id", flag.alias("held_out"), of("text").alias("found")).select("doc_id", "held_out", "found.*")
