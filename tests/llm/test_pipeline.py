import corpus_pipeline
import pytest
from llm.samples import AWKWARD
from llm.test_outliers import plain

from reclutark.llm import passages, simhash

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["classifier", "simhash", "passages", "mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_clean_documents_pass_the_classifier(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.05 * len(labels)


def test_one_of_each_group_stays(stages):
    before = simhash.components(stages[1]).collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({r.component_id for r in before})


def test_passages_are_cut_once(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    spans = {}
    for r in passages.repeated(stages[2]).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert spans and before.keys() == after.keys()
    for i, text in before.items():
        words = text.encode().split()
        assert after[i].encode().split() == [w for k, w in enumerate(words) if k not in spans.get(i, ())]


def test_mixture_and_tokens(stages):
    whole = sum(plain(r.text)[0] for r in stages[3].collect())
    taken = stages[4].collect()
    assert 0.7 * whole <= sum(plain(r.text)[0] for r in taken) <= 0.8 * whole
    known = {tuple(r) for r in stages[3].collect()}
    assert all(tuple(r) in known for r in taken)
    assert sorted(r.doc_id for r in stages[5].collect()) == sorted(r.doc_id for r in taken)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, stages[5].collect()))


def written(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_awkward_rows_through_all_stages(spark, documents, tmp_path):
    shared = " ".join(f"shared{i}" for i in range(70))
    rows = [*AWKWARD, (5, "another text under a known id", None, None, 1), (11, shared, "en", "src1", 9), (12, "before " * 9 + shared, "en", "src1", 9)]
    folder = written(spark, tmp_path, documents(*rows), [(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, None), (7, 1, 0), (7, 0, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        assert k == 4 or after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r[0] for r in rows}
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_no_documents(spark, documents, tmp_path):
    folder = written(spark, tmp_path, documents(AWKWARD[3]).limit(0), [])
    assert corpus_pipeline.run(spark, folder).collect() == []
