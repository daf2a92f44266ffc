import pytest
from pyspark.sql import functions as F

from reclutark.llm import mixing


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(same, folder):
    assert same("op3_mixing", folder)


def leaves(spark, *rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")


def shares(spark, mixture, *rows):
    return {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves(spark, *rows), mixture).collect()}


def test_shortage_goes_to_siblings_before_cousins(spark):
    mixture = mixing.Mixture(F.lit("a"), {"domain": {"a": 1, "b": 1}}, tenths=5, most_epochs=1)
    got = shares(spark, mixture, ("a", "en", "s1", 10), ("a", "en", "s2", 500), ("a", "de", "s1", 290), ("b", "en", "s1", 800))
    # 800 of 1600: 400 to each domain; 200 to each language of a; s1 can give 10 of its 100, its sibling s2 takes 190.
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("a", "de", "s1"): 200, ("b", "en", "s1"): 400}


def test_shortage_of_a_family_goes_up(spark):
    mixture = mixing.Mixture(F.lit("a"), {}, tenths=10, most_epochs=2)
    got = shares(spark, mixture, ("a", "en", "s1", 10), ("a", "de", "s1", 30), ("b", None, None, 1000))
    # 1040 wanted, 520 a domain; a holds 80 in two epochs, so b gives 960.
    assert got == {("a", "en", "s1"): 20, ("a", "de", "s1"): 60, ("b", None, None): 960}


def test_nothing_left_over_and_zero_weights(spark):
    mixture = mixing.Mixture(F.lit("a"), {"source": {"none": 0}}, tenths=7, most_epochs=3)
    rows = [("a", "en", f"s{i}", 10 + i) for i in range(7)] + [("a", "en", "none", 100), ("a", "fr", "s", 0)]
    got = shares(spark, mixture, *rows)
    assert sum(got.values()) <= sum(r[3] for r in rows) * 7 // 10 and got["a", "en", "none"] == 0 and got["a", "fr", "s"] == 0


def test_prefix_of_a_hot_leaf_and_whole_epochs(documents):
    docs = documents(*[(i, "word " * (1 + i % 5), "en", "src0") for i in range(600)], (None, "a b", "en", "src0"), (3, "c d e", "en", "src0"), (9000, None, "de", "src1"))
    mixture = mixing.Mixture(F.lit("web"), tenths=8, most_epochs=4)
    plan = mixing.plan(docs, mixture).filter("lang = 'en'").first()
    rows = mixing.mixed(docs, mixture).collect()
    taken = sum(r.n_tokens for r in rows)
    assert plan.budget - 5 < taken <= plan.budget and {r.epoch for r in rows} == {0}
    twice = mixing.Mixture(F.lit("web"), tenths=25, most_epochs=4)
    rows = mixing.mixed(docs, twice).collect()
    assert {r.epoch for r in rows} == {0, 1, 2} and sum(r.epoch == 0 for r in rows) == sum(r.epoch == 1 for r in rows) == 602
    assert rows[0].row.score == "x"


@pytest.mark.parametrize("rows, budget", [
    ([(None, "a b c d e")] * 100, 250), ([(k % 2, "a b c") for k in range(100)], 150), ([(None, f"w{k} b") for k in range(90)] + [(None, None)] * 9, 90),
    ([(5, "x")] * 3 + [(None, "a b")] * 40, 41),
])
def test_ties_never_go_over_the_budget(documents, rows, budget):
    mixture = mixing.Mixture(F.lit("web"), tenths=5)
    docs = documents(*[(i, t, "en", "src0") for i, t in rows])
    assert mixing.plan(docs, mixture).first().budget == budget
    got = mixing.mixed(docs, mixture).collect()
    taken = sum(r.n_tokens for r in got)
    assert budget - 4 <= taken <= budget
    given = {}
    for i, t in rows:
        given[i, t] = given.get((i, t), 0) + 1
    assert all(sum((r.row.doc_id, r.row.text) == k for r in got) <= n for k, n in given.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(docs.repartition(5), mixture).collect()))


def test_query_equals_its_sql_with_nulls_and_repeats(spark, documents, tmp_path, same):
    rows = [(k % 40 if k % 3 else None, "w " * (k % 6) + f"v{k % 5}", ("en", "de", None)[k % 3], (None, "src0", "src1", "src7")[k % 4]) for k in range(500)]
    documents(*rows, clashes=False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert same("op3_mixing", str(tmp_path), "/*.parquet")


def test_refined_prefix_equals_a_sorted_one(documents, monkeypatch):
    docs = documents(*[(i, "w " * (i % 7), "en", "src0") for i in range(400)])
    mixture = mixing.Mixture(F.lit("web"), tenths=3)
    fine = sorted(r.doc_id for r in mixing.mixed(docs, mixture).collect())
    monkeypatch.setattr(mixing, "BIN_BITS", 2)
    assert sorted(r.doc_id for r in mixing.mixed(docs, mixture).collect()) == fine
