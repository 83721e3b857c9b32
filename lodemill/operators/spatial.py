"""Spatial operators: voxels, box and distance joins over grid cells, neighbours, density clusters.

Joins are equi-joins on grid cells with the exact predicate after; a pair that shares several cells
is made once, in the cell that holds the lower corner of the boxes' intersection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed, connected_components


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def cell(x: Column | str, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size)


def voxel_mean(points: DataFrame, axes: list[str], size: float, values: list[str] = ()) -> DataFrame:
    """A row for each occupied voxel: its indices, the mean of axes and values, and the count."""
    cells = [cell(a, size).alias(f"{a}_voxel") for a in axes]
    return points.where(_all([F.col(a).isNotNull() for a in axes])).groupBy(*cells).agg(*(F.avg(x).alias(x) for x in (*axes, *values)), F.count("*").alias("n"))


def _boxed(boxes: DataFrame, id_: str, axes: list[str], size: float, side: str, grow: float = 0.0) -> DataFrame:
    cols = [F.col(id_).alias(f"{side}_id")]
    cols += [(F.col(f"{a}_min") - grow).alias(f"{side}_{a}_lo") for a in axes] + [(F.col(f"{a}_max") + grow).alias(f"{side}_{a}_hi") for a in axes]
    out = boxes.select(*cols)
    for a in axes:
        out = out.withColumn(f"_{a}", F.explode(F.sequence(cell(f"{side}_{a}_lo", size), cell(f"{side}_{a}_hi", size))))
    return out


def box_pairs(boxes: DataFrame, id_: str, axes: list[str], size: float, grow: float = 0.0) -> DataFrame:
    """Pairs a_id < b_id of closed boxes ({axis}_min, {axis}_max) that touch, each grown by ``grow``.

    Extents are a_{axis}_lo, a_{axis}_hi and so on, as grown. ``size`` is the grid cell: near the
    boxes' usual extent, so that a box lies in few cells.
    """
    a, b = _boxed(boxes, id_, axes, size, "a", grow), _boxed(boxes, id_, axes, size, "b", grow)
    out = a.join(b, [f"_{x}" for x in axes]).where("a_id < b_id")
    out = out.where(_all([(F.col(f"a_{x}_lo") <= F.col(f"b_{x}_hi")) & (F.col(f"b_{x}_lo") <= F.col(f"a_{x}_hi")) for x in axes]))
    first = _all([F.col(f"_{x}") == cell(F.greatest(f"a_{x}_lo", f"b_{x}_lo"), size) for x in axes])
    return out.where(first).drop(*(f"_{x}" for x in axes))


def overlap_volume(axes: list[str]) -> Column:
    return reduce(lambda p, q: p * q, [F.greatest(F.least(f"a_{x}_hi", f"b_{x}_hi") - F.greatest(f"a_{x}_lo", f"b_{x}_lo"), F.lit(0.0)) for x in axes])


def box_volume(side: str, axes: list[str]) -> Column:
    return reduce(lambda p, q: p * q, [F.col(f"{side}_{x}_hi") - F.col(f"{side}_{x}_lo") for x in axes])


def overlaps(boxes: DataFrame, id_: str, axes: list[str], size: float) -> DataFrame:
    """Touching pairs with the overlap and its share of the smaller box (severity)."""
    least = F.least(box_volume("a", axes), box_volume("b", axes))
    out = box_pairs(boxes, id_, axes, size).withColumn("overlap", overlap_volume(axes))
    return out.withColumn("severity", F.when(least > 0, F.col("overlap") / least).otherwise(0.0)).select("a_id", "b_id", "overlap", "severity")


def contains(boxes: DataFrame, id_: str, axes: list[str], size: float) -> DataFrame:
    """(outer, inner) of different boxes where the closed inner lies in the outer."""
    pairs = box_pairs(boxes, id_, axes, size)
    b_in_a = _all([(F.col(f"a_{x}_lo") <= F.col(f"b_{x}_lo")) & (F.col(f"b_{x}_hi") <= F.col(f"a_{x}_hi")) for x in axes])
    a_in_b = _all([(F.col(f"b_{x}_lo") <= F.col(f"a_{x}_lo")) & (F.col(f"a_{x}_hi") <= F.col(f"b_{x}_hi")) for x in axes])
    return pairs.where(b_in_a).select(F.col("a_id").alias("outer"), F.col("b_id").alias("inner")).unionByName(pairs.where(a_in_b).select(F.col("b_id").alias("outer"), F.col("a_id").alias("inner")))


def clearances(boxes: DataFrame, id_: str, axes: list[str], size: float, most: float) -> DataFrame:
    """Pairs of boxes no farther apart than ``most``, with their distance (0 if they touch)."""
    gap = [F.greatest(F.greatest(f"a_{x}_lo", f"b_{x}_lo") - F.least(f"a_{x}_hi", f"b_{x}_hi") + most, F.lit(0.0)) for x in axes]
    out = box_pairs(boxes, id_, axes, size, most / 2).withColumn("distance", F.sqrt(reduce(lambda p, q: p + q, [g * g for g in gap])))
    return out.where(F.col("distance") <= most).select("a_id", "b_id", "distance")


def point_pairs(points: DataFrame, id_: str, axes: list[str], radius: float) -> DataFrame:
    """Pairs a_id < b_id no farther apart than ``radius``, with their distance; cells of that size."""
    a = points.select(F.col(id_).alias("a_id"), *(F.col(x).alias(f"a_{x}") for x in axes))
    b = points.select(F.col(id_).alias("b_id"), *(F.col(x).alias(f"b_{x}") for x in axes))
    for x in axes:
        a = a.withColumn(f"_{x}", cell(f"a_{x}", radius))
        at = cell(f"b_{x}", radius)
        b = b.withColumn(f"_{x}", F.explode(F.array(at - 1, at, at + 1)))
    out = a.join(b, [f"_{x}" for x in axes]).where("a_id < b_id")
    d = F.sqrt(reduce(lambda p, q: p + q, [(F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in axes]))
    return out.withColumn("distance", d).where(F.col("distance") <= radius).select("a_id", "b_id", "distance")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "distance"))


def ball_neighbours(points: DataFrame, id_: str, axes: list[str], radius: float, fan_out: int) -> DataFrame:
    """The first ``fan_out`` neighbours by id within ``radius`` of each point, itself included; where
    there are fewer, the first fills up."""
    own = points.select(F.col(id_).alias("a_id"), F.col(id_).alias("b_id"), F.lit(0.0).alias("distance"))
    near = both_ways(point_pairs(points, id_, axes, radius)).unionByName(own)
    w = Window.partitionBy("a_id").orderBy("b_id")
    kept = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fan_out)
    lists = kept.groupBy("a_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b_id"))), lambda s: s["b_id"]).alias("near"))
    return lists.select("a_id", F.concat("near", F.array_repeat(F.col("near")[0], F.lit(fan_out) - F.size("near"))).alias("near"))


#: Cells of an axis that one task of density_clusters looks at, its surroundings aside.
TILE = 16


def _tile_clusters(n_axes: int, radius: float, min_points: int, reach: int, tile: int, chunk: int = 1 << 20):
    """For one tile with its surroundings: core points with their cell's node, links of nodes, border points."""

    def run(table):
        from itertools import product

        import numpy as np
        import pyarrow as pa

        ids = table["id"].to_numpy()
        x = np.stack([table[f"x{k}"].to_numpy() for k in range(n_axes)], 1)
        c = np.stack([table[f"c{k}"].to_numpy() for k in range(n_axes)], 1)
        order = np.lexsort((ids, *c.T[::-1]))
        ids, x, c = ids[order], x[order], c[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]).any(1)))
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate((first, [len(ids)])))
        cell_of = np.cumsum(new) - 1
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        if (np.sqrt(((high - low) ** 2).sum(1)) > radius).any():
            raise ValueError("coordinates are too large for cells of this radius")
        cells = c[first]
        base = cells.min(0) - reach
        width = cells.max(0) + reach + 1 - base
        place = np.zeros(len(cells), np.int64)
        for k in range(n_axes):
            place = place * width[k] + cells[:, k] - base[k]
        corner = np.array([table[f"t{k}"][0].as_py() for k in range(n_axes)]) * tile
        far = np.maximum(np.maximum(corner - cells, cells - (corner + tile - 1)), 0).max(1)  # cells away from the tile
        offsets = sorted(product(range(-reach, reach + 1), repeat=n_axes), key=lambda o: sum(v * v for v in o))

        def beside(at, offset):
            to = place[at]
            step = 0
            for k in range(n_axes):
                step = step * width[k] + offset[k]
            other = np.minimum(np.searchsorted(place, to + step), len(place) - 1)
            return other, place[other] == to + step

        def spans(lo, size):
            """(row, place) of all of lo[i] .. lo[i] + size[i] - 1, about ``chunk`` at a time."""
            i, ends = 0, np.cumsum(size)
            while i < len(lo):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, "right")))
                n = size[i:j]
                row = np.repeat(np.arange(i, j), n)
                yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i:j], n)
                i = j

        def near(p, q):
            return np.sqrt(((x[p] - x[q]) ** 2).sum(1)) <= radius

        core = (count >= min_points)[cell_of]  # a cell is so small that its points are near each other
        todo, found = np.flatnonzero(~core & (far <= reach)[cell_of]), np.zeros(len(ids), np.int64)
        for o in offsets:
            other, there = beside(cell_of[todo], o)
            asking, other = todo[there], other[there]
            for row, q in spans(first[other], count[other]):
                hit = near(asking[row], q)
                np.add.at(found, asking[row[hit]], 1)
            todo = todo[found[todo] < min_points]
        core |= found >= min_points
        own = (far == 0)[cell_of]
        # cores before the others in each cell
        order = np.lexsort((ids, ~core, cell_of))
        ids, x, core, own = ids[order], x[order], core[order], own[order]
        cores = np.add.reduceat(core.astype(np.int64), first)
        node = ids[first]  # the smallest core, if there is one
        out = [(ids[core & own], node[cell_of[core & own]], 0)]
        border = np.flatnonzero(~core & own)
        parent = np.arange(len(cells))

        def root(a):
            while (parent[a] != parent[parent[a]]).any():
                parent[:] = parent[parent]
            return parent[a]

        def joined(a, b):
            out.append((node[a], node[b], 1))
            while True:
                ra, rb = root(a), root(b)
                if (ra == rb).all():
                    return
                np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))

        def to_box(points, cell):
            return np.sqrt((np.maximum(np.maximum(low[cell] - x[points], x[points] - high[cell]), 0) ** 2).sum(1)) <= radius

        for o in offsets:
            other, there = beside(cell_of[border], o)
            asking, other = border[there], other[there]
            for row, q in spans(first[other], cores[other]):
                hit = near(asking[row], q)
                out.append((ids[asking[row[hit]]], node[cell_of[q[hit]]], 2))
            if o <= (0,) * n_axes:
                continue
            a = np.flatnonzero((far == 0) & (cores > 0))
            b, there = beside(a, o)
            there &= cores[b] > 0
            a, b = a[there], b[there]
            for most in (8, len(ids)):  # of most cells that touch, some of any few points are near
                apart = root(a) != root(b)
                a, b = a[apart], b[apart]
                met = np.zeros(len(a), bool)
                for pair, p in spans(first[a], np.minimum(cores[a], most)):
                    close = to_box(p, b[pair]) & ~met[pair]
                    pair, p = pair[close], p[close]
                    for row, q in spans(first[b[pair]], np.minimum(cores[b[pair]], most)):
                        met[pair[row[near(p[row], q)]]] = True
                joined(a[met], b[met])
                a, b = a[~met], b[~met]
        cols = [np.concatenate([r[0] for r in out]), np.concatenate([r[1] for r in out]), np.concatenate([np.full(len(r[0]), r[2]) for r in out])]
        return pa.table({"a": cols[0].astype(np.int64), "b": cols[1].astype(np.int64), "kind": cols[2].astype(np.int32)})

    return run


def density_clusters(points: DataFrame, id_: str, axes: list[str], radius: float, min_points: int) -> DataFrame:
    """(id, cluster) by density: core points have ``min_points`` within ``radius``, themselves included;
    clusters are components of near cores, named by their smallest core; border points take the
    smallest cluster near them; the rest is noise, -1. Ids are whole numbers, one for each point.

    Pairs are not made: points of a cell whose diagonal is below ``radius`` are near each other, so a cell
    with ``min_points`` has cores only, and two cells are linked by their first near cores. A point
    without finite coordinates is near itself alone.
    """
    n = len(axes)
    size = radius / n**0.5 * (1 - 1e-6)
    reach = int(radius // size) + 1
    usable = _all([F.coalesce(F.abs(F.col(a).cast("double")) < float("inf"), F.lit(False)) for a in axes])
    at = points.where(usable & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), *(F.col(a).cast("double").alias(f"x{k}") for k, a in enumerate(axes)))
    at = at.select("*", *(cell(f"x{k}", size).alias(f"c{k}") for k in range(n)))
    for k in range(n):
        at = at.withColumn(f"t{k}", F.explode(F.sequence(F.floor((F.col(f"c{k}") - 2 * reach) / TILE), F.floor((F.col(f"c{k}") + 2 * reach) / TILE))))
    tiles = [f"t{k}" for k in range(n)]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = _tile_clusters(n, float(radius), min_points, reach, TILE)
    found = checkpointed(at.repartition(parts, *tiles).groupBy(*tiles).applyInArrow(run, "a long, b long, kind int"))
    links = found.where("kind = 1").select("a", "b").unionByName(found.where("kind = 0").select(F.col("b").alias("a"), "b").distinct())
    label = checkpointed(connected_components(links, "a", "b"))
    cluster = found.where("kind <> 1").join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("component"))
    own = points.select(F.col(id_), usable.alias("usable"))
    alone = F.when(~F.col("usable") & F.lit(min_points <= 1), F.col(id_))
    return own.join(cluster, F.col(id_) == F.col("a"), "left").select(id_, F.coalesce("component", alone, F.lit(-1)).alias("cluster"))
