"""The pipeline stage by stage against brute force, and as a whole."""

import corpus_pipeline
import numpy as np
import pytest
from test_llm_operators import DOCS, brute_groups, brute_removed, brute_stats, corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(1, 90), DOCS).repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 3), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, tables, tmp_path):
    docs, rows = spark.read.parquet(f"{tables}/documents.parquet"), corpus(1, 90)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "best_fit_packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    kept = {r["doc_id"] for r in seen["quality_rules"].collect()}
    base = {r[0] for r in rows if (s := brute_stats(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert kept <= base and len(kept) > 0.5 * len(base)
    texts = {r["doc_id"]: r["text"] for r in seen["quality_rules"].collect()}
    groups = brute_groups(list(texts.items()), 80)
    alone = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert alone == {i for i, (_, c) in groups.items() if i == c} and len(alone) < len(kept)
    want = {i: np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for i, (b, g) in brute_removed([(i, texts[i]) for i in alone]).items()}
    assert {r["doc_id"]: r["text"] for r in seen["suffix_dedup"].collect()} == want
    times = seen["target_mix"].groupBy("doc_id", "text").count().collect()
    assert all(want[r["doc_id"]] == r["text"] and 1 <= r["count"] <= 2 for r in times)
    packed = seen["best_fit_packing"].toPandas()
    assert packed.groupby("doc_id")["piece"].apply(lambda p: (p == 0).sum()).to_dict() == {r["doc_id"]: r["count"] for r in times}
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert corpus_pipeline.run(spark, tables).count() == len(packed)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
