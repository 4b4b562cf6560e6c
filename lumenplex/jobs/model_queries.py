"""Registered queries over fitted models and what belongs to them; those without SQL are tested against loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.functions.columns import circumsphere, tidy
from lumenplex.jobs import spot_calling
from lumenplex.jobs.queries import _CODES, SIZES, _out, _r, query
from lumenplex.operators import alpha_shapes, blurred_model, codebooks, local_patterns, model_registration, tiling, voxels
from lumenplex.operators.lineage import cut
from lumenplex.sources.adapters import event_grid, read, vector_codes, vector_stack


def day_codes(spark: SparkSession, d: str) -> DataFrame:
    """CODES of the event grid: one for each six hours of the day, the frames' mean values then, by the largest."""
    mean = event_grid(spark, d).groupBy("n", F.floor(F.col("m1") / 6).cast("int").alias("j")).agg(F.avg("v").alias("c"))
    top = mean.agg(F.max("c").alias("top"))  # one row
    return mean.crossJoin(F.broadcast(top)).select("n", "j", (F.col("c") / F.col("top")).alias("c"))


@query()
def blurred_density(spark: SparkSession, d: str) -> DataFrame:
    m = blurred_model.fit(event_grid(spark, d), day_codes(spark, d), SIZES, 2, 1, {"m0": 1, "m1": 1}, 0.01, inner={"m0": 16, "m1": 12})
    return _out(m.density(), "m0", "m1", "j")


@query()
def mixed_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    m = blurred_model.fit(event_grid(spark, d), day_codes(spark, d), SIZES, 2, 1, {"m0": 1}, 0.0, mixing=True, inner={"m0": 20, "m1": 24})
    return _out(m.reconstruction(), "n", "m0", "m1")


@query()
def two_phase_density(spark: SparkSession, d: str) -> DataFrame:
    codes = day_codes(spark, d)
    decoys = codes.select(((F.col("n") * 2 + 1) % 5).alias("n"), (F.col("j") + 100).alias("j"), "c")
    found = spot_calling.two_phase(event_grid(spark, d), codes, decoys, SIZES, 1, {"m0": 2, "m1": 2}, {"m0": 16, "m1": 12}, {"m0": 1}, iterations=((1, 1), (3, 5)))
    return _out(found, "m0", "m1", "j")


@query(
    f"""with recursive {_CODES}, b as (select j, n % 4 as ch, n // 4 as r, c from codes), z as (select j, ch, r, c from b where r = 0 union all select b.j, b.ch, b.r, b.c + 0.1 * (b.ch + 1) * z.c from z join b on b.j = z.j and b.ch = z.ch and b.r = z.r + 1)
select (4 * r + ch)::int as n, j, {_r('c')} as c from z"""
)
def phased_codes(spark: SparkSession, d: str) -> DataFrame:
    return _out(codebooks.phased(vector_codes(spark, d), 4, [0.1, 0.2, 0.3, 0.4]), "n", "j", v="c")


@query()
def codes_of_blobs(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    radius = {"m0": 2, "m1": 1}
    centres = local_patterns.blobs(g, ["m0", "m1"], 0.3, 2, {a: (SIZES[a], r) for a, r in radius.items()})
    found = local_patterns.read_codes(local_patterns.patches(g, centres, radius), radius, 1, 5, 1.2, blur={"m0": 1})
    return _out(found, "blob", "status", "code", v="r2")


@query()
def model_translations(spark: SparkSession, d: str) -> DataFrame:
    axes = list(SIZES)
    tiled = tiling.tiles(spark, SIZES, {"m0": 16, "m1": 8}, dict.fromkeys(axes, 4), outer=False)
    blocks = cut(model_registration.blocks(tiling.deal(event_grid(spark, d), tiled, axes), 5))
    t, _ = model_registration.register(blocks, day_codes(spark, d), 4, 4)
    rows = [(n, k, float(x)) for n, own in enumerate(t) for k, x in enumerate(own)]  # a number a frame and axis
    return _out(spark.createDataFrame(rows, "n int, axis int, t double"), "n", "axis", v="t")


# Meshes and shapes.

_CORNERS = (("0", "0", "0"), ("s", "1", "0"), ("1", "s", "2"), ("2", "1", "s"))
_TRIANGLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))


def part_meshes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a tetrahedron for each part, as large as the part."""
    own = {"0": F.lit(0), "1": F.lit(1), "2": F.lit(2), "s": F.col("p_size")}
    base = [F.col("p_partkey") % 10, F.col("p_partkey") % 7, F.lit(0)]
    points = F.array(*[F.array(*[(b + own[c]).cast("double") for b, c in zip(base, p)]) for p in _CORNERS])
    parts = read(spark, d, "part")
    vertices = parts.select(F.col("p_partkey").alias("mesh"), F.posexplode(points).alias("vid", "p")).select("mesh", F.col("vid").cast("long").alias("vid"), *[F.col("p")[i].alias(x) for i, x in enumerate("xyz")])
    faces = parts.select(F.col("p_partkey").alias("mesh"), F.posexplode(F.array(*[F.array(*map(F.lit, t)) for t in _TRIANGLES])).alias("fid", "f"))
    return vertices, faces.select("mesh", F.col("fid").cast("long").alias("fid"), *[F.col("f")[i].cast("long").alias(x) for i, x in enumerate("abc")])


def _corner(k: int) -> str:
    return ", ".join(f"(b{i} + {c})::double as {'abc'[n]}_{x}" for n in (0, 1, 2) for i, (x, c) in enumerate(zip("xyz", _CORNERS[k[n]])))


_FACES = " union all ".join(f"select k, {_corner(t)} from parts" for t in _TRIANGLES)
_EDGE = "sqrt(({p}_x - {q}_x) ** 2 + ({p}_y - {q}_y) ** 2 + ({p}_z - {q}_z) ** 2)"


@query(
    f"""with parts as (select p_partkey as k, p_size as s, p_partkey % 10 as b0, p_partkey % 7 as b1, 0 as b2 from part), f as ({_FACES}),
e as (select *, greatest({", ".join(_EDGE.format(p=p, q=q) for p, q in ("ab", "bc", "ac"))}) as e from f), h as (select *, (2 ** list_filter(range(20), lambda h: e <= 4 * 2 ** h)[1])::int as n from e),
i as (select *, unnest(range(n + 1)) as i from h), j as (select *, unnest(range(n - i + 1)) as j from i)
select distinct k as mesh, {", ".join(f"trunc((a_{x} + (b_{x} - a_{x}) * (i / n) + (c_{x} - a_{x}) * (j / n)) / 8)::int as {p}" for x, p in zip("xyz", "ijk"))} from j"""
)
def mesh_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return voxels.boundary_voxels(*part_meshes(spark, d), 8.0)


@query()
def mesh_interiors(spark: SparkSession, d: str) -> DataFrame:
    return voxels.filled(voxels.boundary_voxels(*part_meshes(spark, d), 8.0))


_PLACES = ", ".join(f"list_transform(embedding, lambda v: v::double)[{3 * p + i + 1}] as {'abcd'[p]}{i}" for p in range(4) for i in range(3))
_OFF = ", ".join(f"{'bcd'[p]}{i} - a{i} as {'uvw'[p]}{i}" for p in range(3) for i in range(3))
_CROSS = ", ".join(f"{p}{(i + 1) % 3} * {q}{(i + 2) % 3} - {p}{(i + 2) % 3} * {q}{(i + 1) % 3} as {p}{q}{i}" for p, q in ("vw", "wu", "uv") for i in range(3))


@query(
    f"""with x as (select vec_id, {_PLACES} from embeddings), o as (select *, {_OFF} from x), c as (select *, {_CROSS}, u0 * u0 + u1 * u1 + u2 * u2 as uu, v0 * v0 + v1 * v1 + v2 * v2 as vv, w0 * w0 + w1 * w1 + w2 * w2 as ww from o),
t as (select *, nullif(2 * (u0 * vw0 + u1 * vw1 + u2 * vw2), 0) as t from c), r as (select vec_id, a0, a1, a2, {", ".join(f"(uu * vw{i} + vv * wu{i} + ww * uv{i}) / t as r{i}" for i in range(3))} from t)
select vec_id as k, {", ".join(f"round(a{i} + r{i}, 3) + 0.0 as {x}" for i, x in enumerate("xyz"))}, round(sqrt(r0 * r0 + r1 * r1 + r2 * r2), 3) + 0.0 as radius from r"""
)
def circumspheres(spark: SparkSession, d: str) -> DataFrame:
    v = vector_stack(spark, d)
    found = circumsphere([[F.col("obs")[3 * p + i] for i in range(3)] for p in range(4)])
    return v.select(F.col("m0").alias("k"), *[tidy(c, 3).alias(x) for c, x in zip(found, ("x", "y", "z", "radius"))])


@query()
def alpha_surfaces(spark: SparkSession, d: str) -> DataFrame:
    points = vector_stack(spark, d).select(F.col("j").alias("shape"), F.col("m0").alias("pid"), *[F.col("obs")[i].alias(x) for i, x in enumerate("xyz")])
    return alpha_shapes.alpha_surface(points, 0.1, 0.5)
