"""Every document operator over awkward rows, and over none; the values are held in the operators' own tests."""

import public_tokenizers
import pytest
from llm.samples import AWKWARD
from pyspark.sql import functions as F

from reclutark.llm import bpe, language, mixing, outliers, passages, rules, simhash, token_counts

ENSEMBLE = rules.Ensemble(0.0, {rules.Rule((("n_words", True, 1.0),)): 1.0})
MODEL = language.Model([], None)


OPERATORS = {
    "outliers": outliers.filtered,
    "rules": lambda d: rules.classify(d, ENSEMBLE, F.lit(False)),
    "rules_kept": lambda d: rules.keep_good(d, ENSEMBLE, 0.0),
    "simhash": simhash.components,
    "encode": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "round_trip": lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")),
    "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "language": lambda d: language.identify(d, MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_awkward_row(documents, name):
    docs = documents(*AWKWARD)
    rows = OPERATORS[name](docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(a[0]) for a in AWKWARD)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_copies_of_awkward_rows(documents):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(documents(*AWKWARD)).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= got
    assert {c for d, _, c in got if d in (6, 7)} == {6}


def test_passages_and_mixture_of_awkward_rows(documents):
    docs = documents(*AWKWARD, (11, AWKWARD[4][1], "en", "src0"))
    covered = set()
    for r in passages.repeated(docs).collect():
        assert (r.doc_id, r.first_doc_id) == (11, 5)
        covered |= set(range(r.start_word, r.start_word + r.n_words))
    assert covered == set(range(30_000))
    assert passages.repeated(docs.limit(0)).collect() == []
    assert passages.without_repeats(docs.limit(0), passages.repeated(docs.limit(0))).collect() == []
    mixture = mixing.Mixture(F.coalesce("source", F.lit("none")))
    rows = mixing.mixed(docs, mixture).collect()
    assert all(r.row.doc_id == r.doc_id for r in rows) and mixing.mixed(docs.limit(0), mixture).collect() == []


def test_no_native_operator_runs_python(table):
    for df in (outliers.filtered(table("documents")), rules.classify(table("documents"), ENSEMBLE, F.lit(False))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
