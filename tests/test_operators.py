import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.operators import chunks, clouds, graph, mesh, relational, spatial
from lodemill.plans import queries_more


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (60, 50)):
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(20)]
        p = {}

        def find(x):
            while p.setdefault(x, x) != x:
                x = p[x]
            return x

        for a, b in e:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        got = dict(map(tuple, graph.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()))
        assert got == {x: find(x) for x in p}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_paths_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert graph.reachable(e).count() == 9
    paths = {r["node"]: r["path"] for r in graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert paths[4] == [1, 2, 3, 4]
    hops = dict(map(tuple, graph.k_hop(e, spark.createDataFrame([(4,)], "node long"), 2, "backward").collect()))
    assert hops == {4: 0, 3: 1, 2: 2}


def test_levels_mark_all_referenced(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert dict(map(tuple, graph.levels(e).collect())) == {1: 0, 2: -1, 3: -1}


def test_budget(spark):
    rows = spark.createDataFrame([(0, i, w) for i, w in enumerate((3, 3, 3, 5, 9))], "d long, i int, w int")
    assert [r["chunk"] for r in chunks.budget_chunks(rows, ["d"], "i", "w", 6).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_sliding_chunks_drop_a_covered_tail(spark):
    rows = spark.range(5).select(F.lit(0).alias("g"), "id")
    got = chunks.sliding_chunks(rows, ["g"], ["id"], 3, 1).groupBy("chunk").agg(F.array_sort(F.collect_list("id"))).orderBy("chunk").collect()
    assert [list(r[1]) for r in got] == [[0, 1, 2], [2, 3, 4]]


def test_filter_on_an_absent_column_passes(spark):
    assert relational.filtered(spark.range(3), [("absent", "==", 1), ("id", "~", 1), ("id", ">", 0)]).count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_boxes(spark, seed):
    rng = random.Random(seed)
    b = [(i, x := rng.randrange(-20, 20) / 2, x + rng.randrange(8) / 2, y := rng.randrange(-20, 20) / 2, y + rng.randrange(8) / 2) for i in range(40)]
    df = spark.createDataFrame(b, "id long, x_min double, x_max double, y_min double, y_max double")
    touch = {(p[0], q[0]) for p in b for q in b if p[0] < q[0] and p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}
    got = [tuple(r) for r in spatial.overlaps(df, "id", ["x", "y"], 1.5).select("a_id", "b_id").collect()]
    assert len(got) == len(set(got)) and set(got) == touch
    inside = {(p[0], q[0]) for p in b for q in b if p[0] != q[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3] and q[4] <= p[4]}
    assert {tuple(r) for r in spatial.contains(df, "id", ["x", "y"], 1.5).collect()} == inside
    gap = lambda p, q: math.hypot(max(max(p[1], q[1]) - min(p[2], q[2]), 0), max(max(p[3], q[3]) - min(p[4], q[4]), 0))
    near = {(p[0], q[0]) for p in b for q in b if p[0] < q[0] and gap(p, q) <= 2}
    assert {tuple(r) for r in spatial.clearances(df, "id", ["x", "y"], 2.0, 2.0).select("a_id", "b_id").collect()} == near


def test_voxels_floor_negative_coordinates(spark):
    rows = spark.createDataFrame([(-0.5,), (0.5,), (-1.0,), (None,)], "x double")
    assert sorted(map(tuple, spatial.voxel_mean(rows, ["x"], 1.0).collect())) == [(-1, -0.75, 2), (0, 0.5, 1)]


CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


@pytest.fixture()
def cube(spark):
    facets = spark.createDataFrame([("m", i, *f) for i, f in enumerate(CUBE)], "mesh string, facet long, v0 long, v1 long, v2 long")
    vertices = spark.createDataFrame([("m", i, *map(float, c)) for i, c in enumerate(CORNERS)], "mesh string, vertex long, x double, y double, z double")
    return facets, vertices


def test_cube(cube):
    facets, vertices = cube
    m = mesh.manifold(facets).first()
    assert m["closed"] and m["manifold"] and m["consistent_winding"] and not m["boundary_edges"]
    e = mesh.euler(facets).first()
    assert (e["V"], e["E"], e["F"], e["euler"], e["genus"]) == (8, 18, 12, 2, 0)
    g = mesh.facet_geometry(mesh.corners(facets, vertices))
    a = mesh.area_and_volume(g).first()
    assert abs(a["area"] - 6) < 1e-9 and abs(a["volume"] - 1) < 1e-9
    angles = mesh.dihedral_angles(g)
    assert angles.count() == 18 and angles.where("angle > 1").count() == 12
    assert mesh.segments(facets, angles, 0.1).select("segment").distinct().count() == 6
    assert mesh.adjacency(facets).count() == 18
    d = [r["defect"] for r in mesh.angle_defect(g).collect()]
    assert abs(sum(d) - 4 * math.pi) < 1e-9
    assert mesh.quality(g).first()["degenerate"] == 0


def test_merge_vertices(spark):
    facets = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 3, 1, 0)], "mesh string, facet long, v0 long, v1 long, v2 long")
    vertices = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0), ("m", 3, 0.0, 0.0, 1e-9)], "mesh string, vertex long, x double, y double, z double")
    f, v = mesh.merge_vertices(facets, vertices)
    assert f.count() == 1 and v.count() == 3


def test_clouds(spark):
    rng = np.random.default_rng(0)
    p = np.column_stack((rng.uniform(-1, 1, 200), rng.uniform(-1, 1, 200), rng.normal(0, 1e-3, 200)))
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "cloud long, point long, x double, y double, z double")
    assert clouds.normals(df, 10).where("abs(nz) > 0.99").count() == 200
    plane = clouds.planes(df, 0.02).first()
    assert plane["inliers"] == 200 and abs(plane["c"]) > 0.99
    assert clouds.farthest_points(df, 5).select("point").distinct().count() == 5
    assert clouds.outliers(df).where("outlier").count() < 20
    c, s = math.cos(0.05), math.sin(0.05)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + 0.01
    both = [(0, "a", i, *map(float, x)) for i, x in enumerate(p)] + [(0, "b", i, *map(float, x)) for i, x in enumerate(q)]
    fit = clouds.register(spark.createDataFrame(both, "pair long, side string, point long, x double, y double, z double")).first()
    assert fit["fitness"] == 1.0 and fit["rmse"] < 0.01


def test_dfs_order_has_every_vertex(spark):
    sf_dir = "/root/testdata/sf0.001"
    count = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    got = queries_more.q_dfs_order(spark, sf_dir).toPandas()
    assert len(got) == got["node"].nunique() == sum(map(count, ("region", "nation", "customer", "orders")))
    assert got.groupby("depth").size().to_dict() == {0: count("region"), 1: count("nation"), 2: count("customer"), 3: count("orders")}
    for key, g in got.groupby("key"):
        g = g.sort_values("position")
        assert g["position"].tolist() == list(range(len(g))) and g["node"].iloc[0] == key
