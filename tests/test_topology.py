import pytest

from lodemill.operators import assembly, partition, topology

ROWS = [("f", 1, "MANIFOLD_SOLID_BREP", "#2", [2]), ("f", 2, "CLOSED_SHELL", "(#3,#4)", [3, 4]), ("f", 3, "ADVANCED_FACE", "#4,#9", [4, 9]), ("f", 4, "ADVANCED_FACE", "", []), ("f", 5, "EDGE_CURVE", "#5", [5])]


@pytest.fixture()
def entities(spark):
    return spark.createDataFrame(ROWS, "file string, id long, type string, params string, refs array<long>")


def test_summary(entities):
    r = topology.summary(entities).first()
    assert (r["entities"], r["roots"], r["leaves"], r["category"], r["types"]["ADVANCED_FACE"]) == (5, 1, 1, "topology", 2)


def test_validation(entities):
    r = topology.validated(entities).first()
    assert (r["euler"], r["euler_ok"], r["dangling"], r["dangling_ids"], r["watertight"], r["valid"]) == (1, False, 1, [9], True, False)


def test_rewrite(spark, entities):
    ids = spark.createDataFrame([("f", 4, 44), ("f", 2, 22)], "file string, id long, to long")
    got = {r["id"]: r["params"] for r in topology.rewritten(entities, ids).collect()}
    assert got == {1: "#22", 2: "(#3,#44)", 3: "#44,#9", 4: "", 5: "#5"}


def test_importance(entities):
    got = {r["id"]: r["importance"] for r in topology.importance(entities, {"CLOSED_SHELL": 1.0}).collect()}
    assert abs(got[2] - (0.5 + 0.3 * (0.6 / 2 + 0.4) + 0.1)) < 1e-9 and abs(got[4] - (0.5 * 0.4 + 0.3 * 0.6 + 0.1)) < 1e-9


def test_dfs_and_subtrees(spark, entities):
    order = assembly.dfs_order(topology.references(entities), "file")
    rows = [tuple(r)[1:] for r in order.orderBy("position").collect()]
    assert rows == [(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, 3, 3), (5, 4, 0)]
    sized = order.selectExpr("*", "10 as tokens")
    assert [r["chunk"] for r in topology.subtree_chunks(sized, "file", "tokens", 20).orderBy("position").collect()] == [0, 0, 1, 1, 2]


def test_partitions(spark):
    rows = spark.createDataFrame([("g", i, float(i % 8), float(i // 8), 0.0) for i in range(64)], "g string, id long, x double, y double, z double")
    cells = partition.octree(rows, "g", 10).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 64 and max(r["count"] for r in cells) <= 10
    assert partition.grid(rows, 2).select("cell").distinct().count() == 4
    assert partition.k_means(rows, 3).select("cluster").distinct().count() == 3
    assert partition.proximity_clusters(rows, "id", ["x", "y"], 1.0).select("cluster").distinct().count() == 1
