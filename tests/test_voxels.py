"""Voxels of meshes against recursion and flood fills; shapes of points against all sets of four."""

import itertools
import time

import numpy as np
import pytest

from lumenplex.jobs.model_queries import part_meshes
from lumenplex.operators import alpha_shapes, voxels


def halves(tri, longest):
    """Corners after cutting in four until no edge is longer."""
    edges = [np.linalg.norm(tri[i] - tri[i - 1]) for i in range(3)]
    if max(edges) <= longest:
        return [tuple(p) for p in tri]
    a, b, c = tri
    ab, bc, ca = (a + b) / 2, (b + c) / 2, (c + a) / 2
    return [p for t in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)) for p in halves(np.array(t), longest)]


def open_fill(plane):
    """What a flood from outside doesn't reach."""
    wide = np.pad(plane, 1)
    seen, stack = np.zeros_like(wide), [(0, 0)]
    seen[0, 0] = True
    while stack:
        x, y = stack.pop()
        for u, v in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= u < wide.shape[0] and 0 <= v < wide.shape[1] and not wide[u, v] and not seen[u, v]:
                seen[u, v] = True
                stack.append((u, v))
    return ~seen[1:-1, 1:-1]


TETRAHEDRON = ([(0, 0, 0), (13, 1, 0), (2, 11, 1), (3, 2, 17)], [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])
BOX = ([(x, y, z) for x in (-4, 6) for y in (0, 9) for z in (-7, 5)], [(0, 1, 3), (0, 3, 2), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 3, 7), (1, 7, 5)])


def meshes(spark):
    v = [(m, i, *map(float, p)) for m, (points, _) in enumerate((TETRAHEDRON, BOX)) for i, p in enumerate(points)]
    f = [(m, i, *t) for m, (_, faces) in enumerate((TETRAHEDRON, BOX)) for i, t in enumerate(faces)]
    return spark.createDataFrame(v, "mesh long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh long, fid long, a long, b long, c long")


@pytest.mark.parametrize("pitch", [1.0, 2.5])
def test_surfaces_and_insides_of_meshes(spark, pitch):
    vertices, faces = meshes(spark)
    got = {(r.mesh, r.i, r.j, r.k) for r in voxels.boundary_voxels(vertices, faces, pitch).collect()}
    want = set()
    for m, (points, tris) in enumerate((TETRAHEDRON, BOX)):
        for t in tris:
            want |= {(m, *(int(x / pitch) for x in p)) for p in halves(np.array([points[i] for i in t], float), pitch / 2)}
    assert got == want
    inner = {(r.mesh, r.i, r.j, r.k) for r in voxels.filled(voxels.boundary_voxels(vertices, faces, pitch)).collect()}
    for m in (0, 1):
        own = np.array([w[1:] for w in want if w[0] == m])
        low = own.min(0)
        block = np.zeros(own.max(0) - low + 1, bool)
        block[tuple((own - low).T)] = True
        for axis in range(3):
            for n in range(block.shape[axis]):
                plane = block.take(n, axis)
                block[(slice(None),) * axis + (n,)] = plane | open_fill(plane)
        assert {w[1:] for w in inner if w[0] == m} == {tuple(map(int, p + low)) for p in np.argwhere(block)}
    assert len(inner) > len(got)
    points = voxels.interior_points(vertices, faces, pitch).collect()
    assert {(p.mesh, round(p.x / pitch), round(p.y / pitch), round(p.z / pitch)) for p in points} == inner


def test_voxels_within_a_box(spark):
    vertices, faces = meshes(spark)
    every = {(r.i, r.j, r.k) for r in voxels.boundary_voxels(vertices, faces, 2.0).where("mesh = 1").collect()}
    got = {(r.i, r.j, r.k) for r in voxels.boundary_voxels(vertices, faces, 2.0, (-2, 2, -4), (4, 8, 6)).where("mesh = 1").collect()}
    assert got == {(i + 1, j - 1, k + 2) for i, j, k in every if -1 <= i < 2 and 1 <= j < 4 and -2 <= k < 3}


@pytest.mark.parametrize("seed", range(30))
def test_holes_equal_a_flood(seed):
    rng = np.random.default_rng(seed)
    plane = rng.random(rng.integers(1, 25, 2)) < rng.uniform(0.3, 0.7)
    assert (voxels.holes(plane) == (open_fill(plane) & ~plane)).all()


def test_nothing_has_no_inside(spark):
    vertices, faces = meshes(spark)
    assert voxels.filled(voxels.boundary_voxels(vertices, faces.limit(0), 1.0)).count() == 0


def small_by_hand(p, radius):
    out = set()
    for four in itertools.combinations(range(len(p)), 4):
        a, rest = p[four[0]], p[list(four[1:])]
        m = 2 * (rest - a)
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        centre = np.linalg.solve(m, (rest**2).sum(1) - (a**2).sum())
        r = np.linalg.norm(centre - a)
        others = np.delete(p, four, axis=0)
        if r < radius and (np.linalg.norm(others - centre, axis=1) >= r).all():
            out.add(four)
    return out


@pytest.mark.parametrize(("n", "radius", "width"), [(22, 2.5, None), (22, 40.0, None), (22, 2.0, 7.0)])
def test_small_simplices_equal_all_sets_of_four(spark, n, radius, width):
    rng = np.random.default_rng(n)
    clouds = {"a": rng.random((n, 3)) * 8, "b": rng.random((n - 2, 3)) * 5 - 9}
    rows = [(s, i, *map(float, x)) for s, p in clouds.items() for i, x in enumerate(p)] + [("a", 900, *map(float, clouds["a"][0])), ("c", 1, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "shape string, pid long, x double, y double, z double")
    got = alpha_shapes.small_simplices(points, radius, width).collect()
    for s, p in clouds.items():
        own = [(r.p0, r.p1, r.p2, r.p3) for r in got if r["shape"] == s]
        assert len(own) == len(set(own)) and set(own) == small_by_hand(p, radius)
    faces = alpha_shapes.alpha_surface(points, radius, width).where("shape = 'a'").collect()
    sides = [f for four in small_by_hand(clouds["a"], radius) for f in itertools.combinations(four, 3)]
    assert {(r.a, r.b, r.c) for r in faces} == {f for f in sides if sides.count(f) == 1}


def test_blocks_give_what_one_block_gives(spark):
    rng = np.random.default_rng(9)
    rows = [(0, i, *map(float, x)) for i, x in enumerate(rng.random((700, 3)) * 12)]
    points = spark.createDataFrame(rows, "shape int, pid long, x double, y double, z double")
    many, one = (sorted(map(tuple, alpha_shapes.small_simplices(points, 1.5, w).select("p0", "p1", "p2", "p3").collect())) for w in (3.0, 1000.0))
    assert many == one and len(one) > 500
    assert alpha_shapes.small_simplices(points.limit(0), 1.5).count() == 0


def test_corners_join_without_a_broadcast(spark):
    """Exploded arrays look small to Spark: a million meshes were sent whole."""
    vertices, faces = part_meshes(spark, "/root/testdata/sf0.001")
    plan = voxels.boundary_voxels(vertices, faces, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan


@pytest.mark.parametrize("together", [1, 7, 1 << 18])
def test_planes_are_filled_some_at_once(spark, together):
    """Whatever is filled together; a voxel far off, in a plane of 10^12 places, takes no memory."""
    rng = np.random.default_rng(together)
    rows, want = [(None, 0, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], {(None, 0, x, y) for x in range(3) for y in range(3)}
    for mesh, at in itertools.product("abc", range(-2, 5)):
        plane = rng.random(rng.integers(1, 16, 2)) < 0.6
        rows += [(mesh, at, int(x) - 3, int(y) - 4) for x, y in np.argwhere(plane)]
        want |= {(mesh, at, int(x) - 3, int(y) - 4) for x, y in np.argwhere(plane | open_fill(plane))}
    far = [("a", 1, 10**6, 0), ("a", 1, 0, -(10**6))]
    df = spark.createDataFrame(rows + far + rows[:40], "mesh string, i int, j int, k int")
    got = [tuple(r) for r in voxels.filled_planes(df, "i", together).collect()]
    assert len(got) == len(set(got)) and set(got) == want | set(far)


def test_a_block_takes_about_as_long_as_it_has_points(spark):
    """Each point was compared with all tetrahedra so far."""
    rng = np.random.default_rng(3)

    def small(n, width):
        points = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(rng.normal(size=(n, 3)))], "shape int, pid long, x double, y double, z double").cache()
        points.count()
        began = time.perf_counter()
        found = alpha_shapes.small_simplices(points, 0.8, width).collect()
        return time.perf_counter() - began, found, points

    small(50, 1000.0)
    few, many = small(1500, 1000.0), small(12000, 1000.0)
    assert many[0] < 8 * few[0]
    four = np.array([r[1:5] for r in many[1]])
    p = np.array([r[2:] for r in sorted(many[2].collect(), key=lambda r: r.pid)])
    faces = np.concatenate([four[:, list(f)] for f in itertools.combinations(range(4), 3)])
    assert len(np.unique(four, axis=0)) == len(four) and np.unique(faces, axis=0, return_counts=True)[1].max() == 2
    for corners, r in zip(four[::97], [r.radius for r in many[1]][::97]):
        centre = np.linalg.solve(2 * (p[corners[1:]] - p[corners[0]]), (p[corners[1:]] ** 2).sum(1) - (p[corners[0]] ** 2).sum())
        assert np.isclose(np.linalg.norm(p[corners[0]] - centre), r, atol=1e-6) and (np.linalg.norm(p - centre, axis=1) > r - 1e-6).all()


@pytest.mark.parametrize("kind", ["lattice", "dense spot", "hollow", "flat"])
def test_odd_clouds_have_the_simplices_of_all_sets_of_four(spark, kind):
    """Points in general position but for `lattice`, whose tetrahedra fill it once."""
    rng = np.random.default_rng(4)
    p = {
        "lattice": np.argwhere(np.ones((4, 5, 3))).astype(float),
        "dense spot": np.concatenate((rng.normal(size=(14, 3)) * 0.05, rng.normal(size=(10, 3)))),
        "hollow": (u := rng.normal(size=(24, 3))) / np.linalg.norm(u, axis=1)[:, None] * (1 + rng.random((24, 1)) / 9),
        "flat": rng.random((22, 3)) * (1, 1, 0.001),
    }[kind]
    points = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "shape int, pid long, x double, y double, z double")
    found = {tuple(r[1:5]) for r in alpha_shapes.small_simplices(points, 0.95).collect()}
    if kind == "lattice":
        assert np.isclose(sum(abs(np.linalg.det(p[list(f[1:])] - p[f[0]])) for f in found) / 6, 3 * 4 * 2)
    else:
        assert found == small_by_hand(p, 0.95)


def test_blocks_stay_in_tasks_of_their_own(spark):
    """Their points are few bytes, for which one task did all of them."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(s, i, *map(float, x)) for s in range(20) for i, x in enumerate(rng.random((20, 3)))], "shape int, pid long, x double, y double, z double")
    found = alpha_shapes.small_simplices(points, 0.3, 10.0)
    assert found.rdd.getNumPartitions() == 4 and found.count() > 0
