import pytest

import corpus_pipeline
from tests.llm.conftest import frame, sentence
from tests.oracle import DATA, connect, difference
from textquarry.llm import registry

SF = f"{DATA}/sf0.001"


def test_stages_act_on_their_own_input(spark, tmp_path):
    import random

    draw = random.Random(9)
    texts = {i: sentence(draw, 120) for i in range(40)}
    passage = sentence(draw, 30)
    texts[40] = texts[3] + " more"
    texts[41] = texts[5][:200] + " " + passage + " " + texts[5][200:]
    texts[42] = "short one"
    docs = frame(spark, [(i, t, "en", f"s{i % 3}") for i, t in texts.items()])
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        if name != "shards":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[1] == set(range(42))
    assert seen[2] == set(range(40)) | {41}
    assert seen[3] == set(range(40))
    assert seen[4] <= seen[3] and seen[5] == seen[4]


def test_registered(spark):
    names = set(registry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert registry.queries()["pipeline"](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == ""
