import os

import pytest

import corpus_pipeline
from codeloupe.llm import quality_gam
from tests.llm.conftest import prose
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_simhash import brute as near


@pytest.fixture
def folder(spark, docs, tmp_path):
    rows = [(k, prose(k, 60 + k % 20), "big" if k % 4 else "small") for k in range(120)]
    rows += [(200 + k, prose(k, 60 + k % 20), "big") for k in range(10)]  # copies
    rows += [(300 + k, " ".join(w + "###" for w in prose(k, 50).split()), "big") for k in range(60)]  # junk
    rows += [(400, f"{prose(900, 30)} {prose(901, 40)}", "small"), (401, None, "small"), (402, "", None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 300 <= i < 400), 0) for i, *_ in rows if i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(901, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_one_by_one(spark, folder):
    """Each stage against a brute-force version of it over what it was given."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if k < 4:
            assert docs.columns == names
        if name == "quality":
            model = quality_gam.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            good = model.score(quality_gam.feature_rows([(t or "").encode() for _, t in before])) >= quality_gam.THRESHOLD
            assert sorted(map(str, after)) == sorted(str(r) for r, g in zip(before, good) if g)
            assert not [i for i, _ in after if 300 <= i < 400] and len([i for i, _ in after if i < 300]) == 130
        elif name == "near_dedup":
            assert sorted(str(i) for i, _ in after) == sorted(i for i, _, _, c in near(before) if i == str(c))
        elif name == "decontamination":
            assert sorted(str(i) for i, _ in after) == sorted(x[0] for x in contaminated(before, [(1, prose(901, 40))]) if not x[-1])
            assert 400 in {i for i, _ in before} and 400 not in {i for i, _ in after}
        elif name == "mixing":
            assert set(after) == set(before) and len(after) >= len(before)
        else:
            assert sorted(map(str, after)) == sorted(map(str, before))
            for r in docs.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
                assert r["max(slot)"] + 1 == r["count(1)"]


def test_run_is_the_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(found.columns)
    assert corpus_pipeline.ORACLE_SQL is None
    assert not os.path.exists(f"{folder}/quality")
