"""Registered queries over datasets, tiles, models and registration, each beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.functions.columns import tidy
from lumenplex.jobs import spot_calling
from lumenplex.jobs.queries import _AFF, _BLUR2, _BOOKS, _CODES, _DENSE, _GRID, _NEAR, _PC, _ROL, _SERIES, DAY, SIZES, _books, _conv, _dense, _kernel, _lit, _out, _r, query
from lumenplex.operators import codebooks, correlation, density, geometry, grids, pointclouds, registration, tiled, tiling
from lumenplex.operators.lineage import shared_dir
from lumenplex.sources.adapters import event_grid, event_points, event_series, read, vector_codes, vector_stack
from lumenplex.sources.bundle import Bundle


def _kernel4(name: str, sigma: float) -> str:
    r = tiled.kernel(sigma, 4.0, True)[-1][0]
    return f"{name} as (select d, exp(-d * d / (2.0 * {sigma} * {sigma})) / sum(exp(-d * d / (2.0 * {sigma} * {sigma}))) over () as w from (select unnest(range({-r}, {r + 1})) as d))"


def _mirrored(out: str, src: str, axis: str, size: int) -> str:
    rest = ", ".join(c for c in ("n", "m0", "m1", "v") if c != axis)
    return f"{out} as (select {rest}, unnest([{axis}, -1 - {axis}, {2 * size - 1} - {axis}]) as {axis} from {src})"


@query(
    f"with {_DENSE}, {_kernel4('ka', 1.5)}, {_kernel4('kb', 1.0)}, {_mirrored('i0', 'dense', 'm0', 40)}, {_conv('b0', 'i0', 'm0', 40, 'ka')}, {_mirrored('i1', 'b0', 'm1', 24)}, {_conv('b1', 'i1', 'm1', 24, 'kb')} select n, m0, m1, {_r('v')} as v from b1"
)
def gaussian_reflected(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.gaussian(_dense(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}, truncate=4.0, border="reflect"), "n", "m0", "m1")


_NORM = _BLUR2.replace("grid as (select", "raw as (select", 1).replace(", ka as", ", grid as (select n, m0, m1, v / (select max(v) from raw) as v from raw), ka as", 1).replace("1.0 * 1.0", "1.5 * 1.5").replace("range(-3, 4)", "range(-5, 6)")


@query(f"with {_NORM} select n, m0, m1, {_r('x.v / (1 + b1.v)')} as v from grid x join b1 using (n, m0, m1)")
def double_norm(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.doublenorm(event_grid(spark, d), SIZES, 1.0, 1.5), "n", "m0", "m1")


@query(
    f"with {_GRID}, box as (select * from (select distinct n from grid) cross join (select unnest(range(20))::int as m0) cross join (select unnest(range(13))::int as m1)) select b.n, b.m0, b.m1, {_r('coalesce(g.v, -1.0)')} as v from box b left join grid g on g.n = b.n and g.m0 = b.m0 + 30 and g.m1 = b.m1 - 3"
)
def cropped(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.crop(event_grid(spark, d), {"m0": 30, "m1": -3}, {"m0": 50, "m1": 10}, -1.0), "n", "m0", "m1")


@query(f"with {_GRID}, u as (select (n + 1) % 5 as n, m0 + 5 as m0, m1, v, n as k from grid where v >= 100 and m0 + 5 < 40) select coalesce(g.n, u.n) as n, coalesce(g.m0, u.m0)::int as m0, coalesce(g.m1, u.m1) as m1, {_r('coalesce(u.v, g.v)')} as v from grid g full join u on g.n = u.n and g.m0 = u.m0 and g.m1 = u.m1")
def overwritten(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    new = g.where("v >= 100").select(((F.col("n") + 1) % 5).cast("int").alias("n"), (F.col("m0") + 5).alias("m0"), "m1", "v", F.col("n").alias("k"))
    return _out(grids.overwrite(g, new, SIZES, "k"), "n", "m0", "m1")


@query(f"with {_GRID} select floor(a.v / 20)::bigint as bin_x, floor(b.v / 20)::bigint as bin_y, {_r('ln(1 + sum(c.v))')} as log_n from grid a join grid b using (m0, m1) join grid c using (m0, m1) where a.n = 0 and b.n = 1 and c.n = 2 group by 1, 2")
def weighted_bins(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    a, b, c = (g.where(F.col("n") == k).select("m0", "m1", F.col("v").alias(x)) for k, x in enumerate("abc"))
    return _out(grids.log_counts(a.join(b, ["m0", "m1"]).join(c, ["m0", "m1"]), "a", "b", 20, "c"), "bin_x", "bin_y", v="log_n")


# Tiles.


@query(
    f"""with {_SERIES}, t as (select put, least(put + 250, 1400) as stop from (select unnest(range(40, 1400, 250)) as put))
select put::varchar as tile, count(*) as n_rows, {_r('sum(v)')} as total, {_r('sum(case when m0 >= put and m0 < stop then v else 0 end)')} as own from series join t on m0 >= put - 40 and m0 < stop + 40 group by put"""
)
def tiles_inside(spark: SparkSession, d: str) -> DataFrame:
    dealt = tiling.deal(event_series(spark, d), tiling.tiles(spark, DAY, {"m0": 250}, {"m0": 40}, outer=False), ["m0"])
    own = F.when((F.col("m0") >= F.col("put_start_m0")) & (F.col("m0") < F.col("put_stop_m0")), F.col("v")).otherwise(0.0)
    return dealt.groupBy("tile").agg(F.count("*").alias("n_rows"), tidy(F.sum("v")).alias("total"), tidy(F.sum(own)).alias("own"))


@query(
    """with t as (select put, greatest(put - 40, 0) as look, least(put + 250, 1440) as stop, least(put + 290, 1440) as until from (select unnest(range(0, 1440, 250)) as put))
select (look // 4)::int as look_start, (until // 4)::int as look_stop, (put // 4)::int as put_start, (stop // 4)::int as put_stop, coalesce(n, 0) as n_events
from t left join (select (hour(ts) * 60 + minute(ts)) // 250 * 250 as put, count(*) as n from events group by 1) using (put)"""
)
def coarse_tiles(spark: SparkSession, d: str) -> DataFrame:
    tiled = tiling.tiles(spark, DAY, {"m0": 250}, {"m0": 40})
    own = read(spark, d, "events").select((F.hour("ts") * 60 + F.minute("ts")).alias("m0"))
    n = tiling.owned(tiling.deal(own, tiled, ["m0"]), ["m0"]).groupBy("tile").agg(F.count("*").alias("n_events"))
    small = tiling.downsampled(tiled, {"m0": 4}).join(n, "tile", "left")
    return small.select(*[F.col(f"{b}_m0").alias(b) for b in ("look_start", "look_stop", "put_start", "put_stop")], F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query(
    """with b as (select p_partkey as k, p_size as s0, p_size + p_partkey % 7 as e0, regexp_extract(p_brand, '([0-9]+)$', 1)::int as s1, regexp_extract(p_brand, '([0-9]+)$', 1)::int + p_partkey % 5 as e1 from part)
select a.k as tile, b.k as other from b a join b on a.k <> b.k and a.s0 < b.e0 and b.s0 < a.e0 and a.s1 < b.e1 and b.s1 < a.e1 and a.s0 < a.e0 and a.s1 < a.e1 and b.s0 < b.e0 and b.s1 < b.e1"""
)
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    brand, k = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long"), F.col("p_partkey")
    boxes = read(spark, d, "part").select(k.alias("tile"), F.col("p_size").cast("long").alias("look_start_x"), (F.col("p_size") + k % 7).alias("look_stop_x"), brand.alias("look_start_y"), (brand + k % 5).alias("look_stop_y"))
    return tiling.neighbours(boxes, ["x", "y"])


@query(
    """with t as (select distinct l_orderkey % 5 as p0, 10 + l_suppkey % 7 as p1, 20 + l_linenumber as p2, 30 + l_partkey as p3 from lineitem),
f as (select unnest([[p1, p2, p3], [p0, p2, p3], [p0, p1, p3], [p0, p1, p2]]) as f from t) select f[1]::bigint as a, f[2]::bigint as b, f[3]::bigint as c from f group by f having count(*) = 1"""
)
def surface_of_tetrahedra(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    points = (F.col("l_orderkey") % 5, 10 + F.col("l_suppkey") % 7, 20 + F.col("l_linenumber"), 30 + F.col("l_partkey"))
    return geometry.boundary_faces(x.select(*[p.cast("long").alias(f"p{i}") for i, p in enumerate(points)]).distinct())


# Models.

_DENSITY = "density as (select vec_id as m0, label as j, abs(embedding[1]::double) as v from embeddings union all select vec_id, (label + 1) % 10, abs(embedding[2]::double) from embeddings)"
_SHOWN = f"{_CODES}, {_DENSITY}, shown as (select c.n, d.m0, sum(d.v * c.c) as v from density d join codes c using (j) where c.c <> 0 group by c.n, d.m0)"


def _reconstruction(spark: SparkSession, d: str) -> DataFrame:
    x = vector_stack(spark, d)
    one = x.select("m0", "j", F.abs(F.col("obs")[0]).alias("v"))
    two = x.select("m0", ((F.col("j") + 1) % 10).alias("j"), F.abs(F.col("obs")[1]).alias("v"))
    return density.reconstructed(one.unionByName(two), vector_codes(spark, d), ["m0"])


@query(f"with {_SHOWN} select n, m0, {_r('v')} as v from shown")
def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return _out(_reconstruction(spark, d), "n", "m0")


@query(f"with {_SHOWN} select n, m0, {_r('coalesce(x.v, 0)')} as v, {_r('coalesce(s.v, 0)')} as explained, {_r('coalesce(x.v, 0) - coalesce(s.v, 0)')} as \"left\" from stack x full join shown s using (n, m0)")
def left_over_signal(spark: SparkSession, d: str) -> DataFrame:
    stack = vector_stack(spark, d).select("m0", F.posexplode("obs").alias("n", "v"))
    found = density.left_over(stack, _reconstruction(spark, d), ["m0"])
    return found.select("n", "m0", *[tidy(F.col(c)).alias(c) for c in ("v", "explained", "left")])


_BOOK3 = "book as (select j, list(ch order by r) as c from (select k as j, r, (k // (3 ** (3 - r))::int % 3)::int as ch from (select distinct p_size as k from part) cross join (select unnest(range(4))::int as r)) group by j)"


@query(
    f"""with {_BOOK3}, t as (select k, (k * 7919 + 104729) % 81 as x from (select unnest(range(81)) as k)), u as (select k, [(x // 27 % 3)::int, (x // 9 % 3)::int, (x // 3 % 3)::int, (x % 3)::int] as c from t),
good as (select k, c from u where not exists (select 1 from book where (book.c[1] <> u.c[1])::int + (book.c[2] <> u.c[2])::int + (book.c[3] <> u.c[3])::int + (book.c[4] <> u.c[4])::int < 1) order by k limit 24)
select k as decoy, r, c[r + 1] as ch from good cross join (select unnest(range(4))::int as r)"""
)
def decoy_codes(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.decoys(_lit(spark, d, F.col("p_size")), 4, 3, 1, 24)


# Point clouds and datasets.

_FAR = "(select {x}.j, min(sqrt((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1))) as d from {x} left join {y} on a.j = b.j group by {x}.j, {x}.m0, {x}.m1)"


@query(
    f"""with {_PC}, o as (select j, avg(coalesce(d, 'inf'::double)) as x from {_FAR.format(x='a', y='b')} group by j), t as (select j, avg(coalesce(d, 'inf'::double)) as x from {_FAR.format(x='b', y='a')} group by j)
select j, {_r('o.x')} as ours, {_r('coalesce(t.x, 0)')} as theirs, false as unmatched from (select distinct j from a) join o using (j) left join t using (j)"""
)
def voxel_divergences(spark: SparkSession, d: str) -> DataFrame:
    found = pointclouds.voxel_divergences(event_points(spark, d, 0, 60.0), event_points(spark, d, 2, 100.0), ["m0", "m1"])
    return found.select("j", tidy(F.col("ours")).alias("ours"), tidy(F.coalesce("theirs", F.lit(0.0))).alias("theirs"), "unmatched")


@query(
    f"""with {_ROL}, c as (select (select count(*) from r p where status = 'good' and not {_NEAR.format(o='b')}) as fn, (select count(*) from b p where not {_NEAR.format(o='usable')}) as fp,
(select count(*) from b p where {_NEAR.format(o='usable')}) as agreement, (select count(*) from r where status = 'good') as n_good)
select fn, fp, agreement, n_good, {_r('1 - fn / n_good')} as detection_rate, {_r('fp / greatest(fp + agreement, 1)')} as false_discovery_rate from c"""
)
def accuracy_of_points(spark: SparkSession, d: str) -> DataFrame:
    found = spot_calling.accuracy(_rolonies(spark, d), event_points(spark, d, 2, 100.0), 3.0, ["m0", "m1"])
    return found.select("fn", "fp", "agreement", "n_good", *[tidy(F.col(c)).alias(c) for c in ("detection_rate", "false_discovery_rate")])


def _rolonies(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("m0") + F.col("m1")) % 7 == 0, "bad").when((F.col("m0") + F.col("m1")) % 5 == 0, "other").otherwise("good")
    return event_points(spark, d, 0, 60.0).withColumn("status", status)


def _bundle(spark: SparkSession, d: str) -> Bundle:
    return Bundle(event_grid(spark, d), _books(spark, d)[1], _rolonies(spark, d))


@query(f"with {_ROL}, {_BOOKS} select (select count(*) from r) as n_spots, (select count(*) from r where status = 'good') as n_good_spots, (select count(distinct j) from theirs_hot) as n_genes")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return _bundle(spark, d).counts()


@query(
    f"""with {_ROL}, {_BOOKS} select 'stack' as member, n::bigint as k, count(*) as n_rows, {_r('sum(v)')} as total from grid group by n
union all select 'codebook', j, count(*), {_r('sum(coalesce(c, 0))')} from theirs_hot group by j union all select 'rolonies', j, count(*), {_r('sum(m0 + m1)')} from r group by j"""
)
def dataset_read_back(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    _bundle(spark, d).write(path)
    found = Bundle.read(spark, path)
    parts = [(found.stack, "n", "v"), (found.codebook, "j", "c"), (found.rolonies, "j", F.col("m0") + F.col("m1"))]
    rows = None
    for member, (df, k, v) in zip(("stack", "codebook", "rolonies"), parts):
        total = F.sum(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)).cast("double"))
        own = df.groupBy(F.col(k).cast("long").alias("k")).agg(F.count("*").alias("n_rows"), tidy(total).alias("total")).select(F.lit(member).alias("member"), "k", "n_rows", "total")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query(f"with {_GRID} select n, (m0 // 3)::int as m0, (m1 // 3)::int as m1, {_r('sum(v) / 9.0')} as v from grid group by n, m0 // 3, m1 // 3")
def dataset_downsampled(spark: SparkSession, d: str) -> DataFrame:
    return _out(_bundle(spark, d).downsample(3).stack, "n", "m0", "m1")


@query(f"with {_ROL} select j, (m0 // 3)::int as m0, (m1 // 3)::int as m1, status from r union all select j, ((m0 + 1) // 3)::int, (m1 // 3)::int, 'good' from a")
def dataset_with_more_spots(spark: SparkSession, d: str) -> DataFrame:
    more = event_points(spark, d, 1, 60.0)
    return _bundle(spark, d).with_more(more).downsample(3).rolonies.select("j", "m0", "m1", "status")


# Registration.


_LESS = f"{_DENSE}, less as (select n, m0, m1, v / 1000 - avg(v / 1000) over (partition by n) as v from dense)"


@query(f"with {_LESS} select a.n as f1, b.n as f2, a.m0 - b.m0 as t_m0, a.m1 - b.m1 as t_m1, {_r('sum(a.v * b.v)')} as product from less a join less b on (a.n, b.n) in ((0, 1), (4, 2)) group by all")
def products_at_all_offsets(spark: SparkSession, d: str) -> DataFrame:
    found = correlation.products_of_frames(event_grid(spark, d).withColumn("v", F.col("v") / 1000), SIZES, [(0, 1), (4, 2)])
    return _out(found, "f1", "f2", "t_m0", "t_m1", v="product")


@query(
    f"""with {_DENSE}, l0 as (select n, m0, m1, v / 1000 - avg(v / 1000) over (partition by n, m1) as v from dense), l1 as (select n, m0, m1, v - avg(v) over (partition by n, m0) as v from l0),
s as (select a.n as f1, b.n as f2, a.m0 - b.m0 as t0, a.m1 - b.m1 as t1, sum(a.v * b.v) as p from l1 a join l1 b on a.n < b.n group by all), best as (select * from s qualify row_number() over (partition by f1, f2 order by p desc, t0, t1) = 1),
o as (select f1, f2, -t0 as d0, -t1 as d1 from best union all select f2, f1, t0, t1 from best union all select n, n, 0, 0 from (select unnest(range(5)) as n)),
c as (select f1, d0 - avg(d0) over (partition by f2) as e0, d1 - avg(d1) over (partition by f2) as e1 from o), t as (select f1 as n, avg(e0) as t0, avg(e1) as t1 from c group by f1)
select n::int as n, unnest([0, 1])::int as axis, round(unnest([t0, t1]), 6) + 0.0 as t from t"""
)
def translations_of_frames(spark: SparkSession, d: str) -> DataFrame:
    found = correlation.frame_translations(event_grid(spark, d).withColumn("v", F.col("v") / 1000), [0, 1, 2, 3, 4], SIZES)
    return _out(found, "n", "axis", v="t")


@query(
    f"""with {_GRID}, s as (select a.n as f1, b.n as f2, a.m0 - b.m0 as t0, a.m1 - b.m1 as t1, sum(a.v * b.v) as p from grid a join grid b on abs(a.m0 - b.m0) <= 3 and abs(a.m1 - b.m1) <= 2 group by all),
best as (select *, row_number() over (partition by f1, f2 order by p desc, t0, t1) as k from s) select f1, f2, unnest([0, 1])::int as axis, unnest([t0, t1])::double as d from best where k = 1"""
)
def offsets_of_frames(spark: SparkSession, d: str) -> DataFrame:
    return registration.pair_offsets(event_grid(spark, d), ["m0", "m1"], {"m0": 3, "m1": 2})


_MOVES = "t as (select n, 0.4 * n as t0, 1.5 - 0.3 * n as t1 from (select distinct n from grid))"


@query(
    f"""with {_GRID}, {_MOVES}, b as (select max(t0) as h0, max(t1) as h1, 40 + ceil(max(t0) - min(t0)) as z0, 24 + ceil(max(t1) - min(t1)) as z1 from t),
p as (select n, t0 - h0 as t0, t1 - h1 as t1, z0, z1 from t cross join b),
x as (select g.n, m0 - floor(t0)::int - s as m0, m1, v * case s when 0 then 1 - (t0 - floor(t0)) else t0 - floor(t0) end as v, t1, z0, z1 from grid g join p using (n) cross join (select unnest([0, 1]) as s)),
y as (select n, m0, m1, sum(v) as v, any_value(t1) as t1, any_value(z1) as z1 from x where m0 between 0 and z0 - 1 group by n, m0, m1),
z as (select n, m0, m1 - floor(t1)::int - s as m1, v * case s when 0 then 1 - (t1 - floor(t1)) else t1 - floor(t1) end as v, z1 from y cross join (select unnest([0, 1]) as s))
select n, m0::int as m0, m1::int as m1, {_r('sum(v)')} as v from z where m1 between 0 and z1 - 1 group by n, m0, m1"""
)
def moved_frames(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    n = F.col("n")
    each = F.posexplode(F.array(0.4 * n, 1.5 - 0.3 * n)).alias("axis", "t")
    t = g.select("n").distinct().select("n", each)
    return _out(registration.apply_translations(g, t, ["m0", "m1"], [40, 24], "full", "linear"), "n", "m0", "m1")


@query(
    f"""with p as (select label as n, unnest(range(63))::int as axis, unnest(embedding[:63])::double as x, unnest(embedding[2:])::double as d from embeddings)
select n, axis, {_r('regr_slope(d, x)')} as slope, {_r('regr_intercept(d, x)')} as shift from p group by n, axis"""
)
def fitted_lines(spark: SparkSession, d: str) -> DataFrame:
    found = registration.fit_affines(_component_pairs(spark, d), ["m0"])
    return found.select("n", "axis", tidy(F.col("coefficients")[0]).alias("slope"), tidy(F.col("coefficients")[1]).alias("shift"))


def _component_pairs(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(F.slice("obs", 1, 63).alias("x"), F.slice("obs", 2, 63).alias("d"))
    rows = vector_stack(spark, d).select(F.col("j").alias("n"), "m0", F.posexplode(both).alias("axis", "p"))
    return rows.select("n", "axis", "m0", F.col("p.x").alias("x_m0"), F.col("p.d").alias("d"))


@query(
    f"""with p as (select label as n, vec_id as m0, unnest(range(63))::int as axis, unnest(embedding[:63])::double as x, unnest(embedding[2:])::double as d from embeddings), f as (select n, axis, regr_slope(d, x) as s, regr_intercept(d, x) as c from p group by n, axis)
select n, axis, m0, {_r('s * x + c - d')} as residual from p join f using (n, axis)"""
)
def residuals_of_lines(spark: SparkSession, d: str) -> DataFrame:
    points = _component_pairs(spark, d)
    found = registration.affine_residuals(points, registration.fit_affines(points, ["m0"]), ["m0"])
    return _out(found, "n", "axis", "m0", v="residual")


@query(
    f"""with {_DENSE}, o as (select * from (select unnest(range(5))::int as n) cross join (select unnest(range(50))::int as m0) cross join (select unnest(range(30))::int as m1))
select o.n, o.m0, o.m1, {_r('coalesce(s.v, -1.0)')} as v from o left join dense s on s.n = o.n and s.m0 = round_even(o.m0 + ({_AFF[0][2]}::double + o.m0 * {_AFF[0][0]}::double + o.m1 * {_AFF[0][1]}::double), 0)::int and s.m1 = round_even(o.m1 + ({_AFF[1][2]}::double + o.m0 * {_AFF[1][0]}::double + o.m1 * {_AFF[1][1]}::double), 0)::int"""
)
def affine_on_a_larger_grid(spark: SparkSession, d: str) -> DataFrame:
    return _out(registration.resample_affine(_dense(spark, d), _AFF, {"m0": 50, "m1": 30}, -1.0), "n", "m0", "m1")


_LEVELS = list(range(60, 400, 20))
_MEET = "exists (select 1 from {o} o where o.j = p.j and (o.m0 - p.m0) ** 2 + (o.m1 - p.m1) ** 2 <= 9)"


@query(
    f"""with {_GRID}, a as (select m0, m1, n as j from grid where v >= 60), b as (select m0 + 2 as m0, (m1 + n) % 24 as m1, n as j, v from grid where v >= 60), t as (select unnest({_LEVELS})::double as threshold),
c as (select threshold, (select count(*) from b where v >= threshold) as n_found, (select count(*) from a p where not {_MEET.format(o='(select * from b where v >= threshold)')}) as fn,
(select count(*) from b p where v >= threshold and not {_MEET.format(o='a')}) as fp from t)
select threshold, n_found, fn, fp, {_r('1 - fn / (select count(*) from a)')} as detection_rate, {_r('fp / greatest(n_found, 1)')} as false_discovery_rate from c"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d).where(F.col("v") >= 60)
    found = g.select((F.col("m0") + 2).alias("m0"), ((F.col("m1") + F.col("n")) % 24).alias("m1"), F.col("n").alias("j"), "v")
    rows = pointclouds.sweep(event_points(spark, d, 0, 60.0), found, 3.0, ["m0", "m1"], _LEVELS)
    return rows.select("threshold", "n_found", "fn", "fp", *[tidy(F.col(c)).alias(c) for c in ("detection_rate", "false_discovery_rate")])


_LOADS = "loads as (select n, m0 % 5 as j, avg(v) / 100 as c from grid group by n, m0 % 5)"
_ELLIPSE = "(select * from (select unnest(range(-2, 3)) as d0) cross join (select unnest(range(-1, 2)) as d1) where (d0 / 2.0) ** 2 + d1 ** 2 <= 1)"


@query(
    f"""with {_GRID}, {_LOADS}, {_kernel('k', 1.0)}, level as (select 0.5 * max(v) as level from grid where n >= 3), spots as (select n, m0, m1 from grid cross join level where v > level),
grown as (select distinct n, m0 + d0 as m0, m1 + d1 as m1 from spots cross join {_ELLIPSE}), plain as (select n, m0, m1, v / s as v from grid join (select j, sum(c) as s from loads group by j) on j = n),
{_conv('seen', 'plain', 'm0', 40, 'k')}, shown as (select c.n, x.m0, x.m1, sum(x.v * c.c) as v from seen x semi join grown using (n, m0, m1) join loads c on c.j = x.n group by 1, 2, 3)
select n, m0, m1, {_r('coalesce(g.v, 0)')} as v, {_r('coalesce(s.v, 0)')} as explained, {_r('coalesce(g.v, 0) - coalesce(s.v, 0)')} as "left" from grid g full join shown s using (n, m0, m1)"""
)
def gated_explanation(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    loads = g.groupBy("n", (F.col("m0") % 5).alias("j")).agg((F.avg("v") / 100).alias("c"))
    found = g.select("m0", "m1", F.col("n").alias("j"), "v")
    shown = density.gated_reconstruction(found, loads, loads.where("j >= 3"), SIZES, {"m0": 2, "m1": 1}, {"m0": 1.0}, 0.5)
    both = density.left_over(g, shown, ["m0", "m1"])
    return both.select("n", "m0", "m1", *[tidy(F.col(c)).alias(c) for c in ("v", "explained", "left")])
