"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, as one Spark column."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from reclutark.llm.common import sampled, words
from reclutark.session import cut_lineage

#: Labelled rows that the rules are learnt from, at most: a larger table is sampled by a hash of its ids.
TRAINING_ROWS = 20_000

TREES, DEPTH, SEED = 24, 3, 5
LASSO = 0.002

#: Names of the statistics, in the order of the vectors.
STATISTICS = [
    "n_words", "word_length", "symbol_share", "mark_share", "bar_share", "capital_share", "digit_share", "repeat_share",
    "distinct_share", "dup_line_share", "line_words",
]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The statistics of each whole text beside the columns ``keep``; a null text counts as empty, with zero for every share."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("t"), words(F.col("text")).alias("w"), F.split(text, "\n").alias("l"))
    chars, n, lines = F.greatest(F.length("t"), F.lit(1)), F.size("w"), F.size("l")

    def share(kind: str) -> Column:
        """Of the characters, those of a class."""
        return (F.length("t") - F.length(F.regexp_replace("t", f"[{kind}]+", ""))) / chars

    repeated = F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1))))
    return base.select(
        *keep, F.log1p(n.cast("double")).alias("n_words"), (F.length("t") / F.greatest(n, F.lit(1))).alias("word_length"),
        share("#*$%&<>").alias("symbol_share"), share("!?").alias("mark_share"), share("|").alias("bar_share"),
        share(r"\p{Lu}").alias("capital_share"), share("0-9").alias("digit_share"),
        (repeated / F.greatest(n, F.lit(1))).alias("repeat_share"),
        (F.size(F.array_distinct("w")) / F.greatest(n, F.lit(1))).alias("distinct_share"),
        ((lines - F.size(F.array_distinct("l"))) / lines).alias("dup_line_share"), (n / lines).alias("line_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: statistic, whether above or not, threshold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(and_, [F.col(name) > bound if above else F.col(name) <= bound for name, above, bound in self.bounds])


@dataclass
class Ensemble:
    """Rules with weights; the score is the logistic function of their sum."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = reduce(add, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights.items()], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def tree_rules(forest) -> list[Rule]:
    """Every path from a root to a node, with the bounds on one side of a statistic drawn together."""
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        _walk(tree._call_java("rootNode"), {}, found)
    return list(found)


def _walk(node, path: dict[tuple[str, bool], float], found: dict[Rule, None]) -> None:
    if path:
        found[Rule(tuple((name, above, bound) for (name, above), bound in sorted(path.items())))] = None
    if node.getClass().getSimpleName() == "LeafNode":
        return
    name, bound = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
    low, high = path.get((name, False), bound), path.get((name, True), bound)
    _walk(node.leftChild(), path | {(name, False): min(low, bound)}, found)
    _walk(node.rightChild(), path | {(name, True): max(high, bound)}, found)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAINING_ROWS) -> Ensemble:
    """Learns from the labelled rows of ``docs`` that aren't ``held_out`` (a column of ``doc_id``), ``rows`` of them at most.

    A forest of shallow trees gives the rules, a lasso-penalised logistic regression their weights; rules of weight zero go.
    Rows without id or label teach nothing, a doc_id with several labels counts with each; without labels of both kinds the score is
    their share everywhere (one half without any).
    """
    marked = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out)
    kinds = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(kinds) < 2:
        only = next(iter(kinds), None)
        return Ensemble({None: 0.0, 0.0: -20.0, 1.0: 20.0}[only], {})
    chosen = sampled(marked, rows, sum(kinds.values()), "doc_id")
    texts = docs.select("doc_id", "text").filter(~held_out)
    # At most ``rows`` ids and labels go to every task, so no text is shuffled for them.
    seen = cut_lineage(statistics(texts.join(F.broadcast(chosen), "doc_id"), "doc_id", "label").repartition(8, "doc_id").sortWithinPartitions("doc_id", "label"))
    vectors = seen.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=10, subsamplingRate=0.7, seed=SEED).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return Ensemble(math.log(kinds[1.0] / kinds[0.0]), {})
    held = seen.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=40, tol=1e-4).fit(cut_lineage(held))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray()) if w}
    return Ensemble(float(model.intercept), weights)


def scored(docs: DataFrame, model: Ensemble, *keep: str) -> DataFrame:
    """``keep`` and ``score`` for every row of ``docs``: the statistics and the rules are columns, so nothing leaves the JVM.

    The score counts as not deterministic, so that a filter on it stays above; pushed below, it would repeat each
    statistic in each rule."""
    return statistics(docs, *keep).select(*keep, F.when(F.monotonically_increasing_id() >= 0, model.score()).alias("score"))


def classify(docs: DataFrame, model: Ensemble, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; 1 from ``threshold`` on.

    Null and empty texts are scored by their (zero) statistics; null ids and repeated rows give a row each; other columns are
    left out, whatever their names.
    """
    return scored(docs, model, "doc_id").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; no join, as statistics and rules are columns of the row itself."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = scored(docs.select(F.col("text"), whole.alias("row")), model, "row")
    return held.filter(F.col("score") >= threshold).select("row.*")
