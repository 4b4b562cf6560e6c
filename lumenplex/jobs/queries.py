"""Registered queries over whole tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.functions import rectangles
from lumenplex.functions.columns import channels_to_rgb, circumcircle, label_color, line_in_box, mix_channels, squared_distance_to_line, tidy
from lumenplex.operators import codebooks, density, discovery, evidence, geometry, grids, pointclouds, registration, tiling
from lumenplex.sources.adapters import EVENT_TYPES, HOURS, ROWS, event_grid, event_points, event_series, read, vector_codes, vector_stack

SIZES = {"m0": ROWS, "m1": HOURS}
DAY = {"m0": 24 * 60}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Tables of the SQL side.
_N = "(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::int"
_CENTS = "sum(cast(round(value * 100) as bigint))::double / 100.0"
_GRID = f"grid as (select {_N} as n, (user_id % 40)::int as m0, hour(ts)::int as m1, {_CENTS} as v from events group by all)"
_DENSE = f"{_GRID}, dense as (select n, m0, m1, coalesce(v, 0.0) as v from (select unnest(range(5))::int as n) cross join (select unnest(range(40))::int as m0) cross join (select unnest(range(24))::int as m1) left join grid using (n, m0, m1))"
_SERIES = f"series as (select {_N} as n, (hour(ts) * 60 + minute(ts))::int as m0, {_CENTS} as v from events group by all)"
_LINE = f"{_SERIES}, line as (select n, m0, coalesce(v, 0.0) as v from (select unnest(range(5))::int as n) cross join (select unnest(range(1440))::int as m0) left join series using (n, m0))"
_STACK = "stack as (select vec_id as m0, label as j, unnest(embedding)::double as v, unnest(range(64))::int as n from embeddings)"
_CODES = f"{_STACK}, codes as (select n, j, avg(v) as c from stack group by n, j)"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _kernel(name: str, sigma: float) -> str:
    r = grids.kernel(sigma)[-1][0]
    return f"{name} as (select d, exp(-d * d / (2.0 * {sigma} * {sigma})) / sum(exp(-d * d / (2.0 * {sigma} * {sigma}))) over () as w from (select unnest(range({-r}, {r + 1})) as d))"


def _conv(out: str, src: str, axis: str, size: int, kernel: str) -> str:
    keys = ", ".join(c for c in ("n", "m0", "m1") if c != axis and (c != "m1" or size != 1440))
    return f"{out} as (select {keys}, ({axis} + d)::int as {axis}, sum(v * w) as v from {src} cross join {kernel} where {axis} + d between 0 and {size - 1} group by {keys}, {axis} + d)"


def _frames(spark: SparkSession) -> DataFrame:
    return spark.range(len(EVENT_TYPES)).select(F.col("id").cast("int").alias("n"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return grids.dense(event_grid(spark, d), SIZES, _frames(spark))


def _line(spark: SparkSession, d: str) -> DataFrame:
    return grids.dense(event_series(spark, d), DAY, _frames(spark))


def _out(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    return df.select(*keys, tidy(F.col(v)).alias(v))


# Normalisation and background.


@query(f"with {_DENSE} select n, m0, m1, {_r('(v - lo) / nullif(hi - lo, 0)')} as v from dense join (select n, min(v) lo, max(v) hi from dense group by n) using (n)")
def minmax_frames(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.minmax(_dense(spark, d), ["n"]), "n", "m0", "m1")


@query(f"with {_DENSE} select n, m0, m1, {_r('(v - lo) / nullif(hi - lo, 0)')} as v from dense join (select n, m1, min(v) lo, max(v) hi from dense group by n, m1) using (n, m1)")
def minmax_fibres(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.minmax(_dense(spark, d), ["n", "m1"]), "n", "m0", "m1")


@query(f"with {_SERIES}, {_kernel('k', 2.5)}, {_conv('b', 'series', 'm0', 1440, 'k')} select n, m0, {_r('v')} as v from b")
def gaussian_1d(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.gaussian(event_series(spark, d), DAY, {"m0": 2.5}), "n", "m0")


_BLUR2 = f"{_GRID}, {_kernel('ka', 1.5)}, {_kernel('kb', 1.0)}, {_conv('b0', 'grid', 'm0', 40, 'ka')}, {_conv('b1', 'b0', 'm1', 24, 'kb')}"


@query(f"with {_BLUR2} select n, m0, m1, {_r('v')} as v from b1")
def gaussian_2d(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.gaussian(event_grid(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}), "n", "m0", "m1")


@query(f"with {_LINE}, {_kernel('k', 2.0)}, {_conv('b', 'line', 'm0', 1440, 'k')} select n, m0, {_r('x.v + 0.7 * (x.v - b.v)')} as v from line x join b using (n, m0)")
def sharpen_1d(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.sharpen(_line(spark, d), DAY, {"m0": 2.0}, {"m0": 0.7}), "n", "m0")


_SHARP2 = f"""{_DENSE}, {_kernel('ka', 1.5)}, {_kernel('kb', 1.0)}, {_conv('b0', 'dense', 'm0', 40, 'ka')},
s0 as (select n, m0, m1, x.v + 0.5 * (x.v - b0.v) as v from dense x join b0 using (n, m0, m1)), {_conv('b1', 's0', 'm1', 24, 'kb')}"""


@query(f"with {_SHARP2} select n, m0, m1, {_r('x.v + 0.25 * (x.v - b1.v)')} as v from s0 x join b1 using (n, m0, m1)")
def sharpen_2d(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.sharpen(_dense(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}, {"m0": 0.5, "m1": 0.25}), "n", "m0", "m1")


@query(f"with {_BLUR2} select n, m0, m1, {_r('greatest(x.v - b1.v, 0.0)')} as v from grid x join b1 using (n, m0, m1)")
def background_subtracted(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.subtract_background(event_grid(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}), "n", "m0", "m1")


@query(f"with {_GRID}, {_kernel('kb', 1.0)}, {_conv('b1', 'grid', 'm1', 24, 'kb')} select n, m0, m1, {_r('greatest(x.v - b1.v, 0.0)')} as v from grid x join b1 using (n, m0, m1)")
def background_last_axis(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.subtract_background(event_grid(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}, last_axis_only=True), "n", "m0", "m1")


@query(
    f"""with {_DENSE}, u as (select n, m0, m1, (v - lo) / nullif(hi - lo, 0) as v from dense join (select n, min(v) lo, max(v) hi from dense group by n) using (n)),
{_kernel('ka', 1.5)}, {_kernel('kb', 1.0)}, {_conv('b0', 'u', 'm0', 40, 'ka')}, {_conv('b1', 'b0', 'm1', 24, 'kb')},
s as (select n, m0, m1, greatest(u.v - b1.v, 0.0) as v from u join b1 using (n, m0, m1))
select n, m0, m1, {_r('(v - lo) / nullif(hi - lo, 0)')} as v from s join (select n, min(v) lo, max(v) hi from s group by n) using (n)"""
)
def preprocessing_chain(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.preprocessed(_dense(spark, d), SIZES, {"m0": 1.5, "m1": 1.0}, ["n"]), "n", "m0", "m1")


@query(f"with {_SERIES} select n, m0 // 10 as m0, {_r('sum(v) / 10.0')} as v from series group by 1, 2")
def decimated(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.decimate(event_series(spark, d), "m0", 10, 1440), "n", "m0")


@query(f"with {_GRID} select n, m0 // 7 as m0, m1 // 5 as m1, {_r('sum(v) / 35.0')} as v from grid where m0 < 35 and m1 < 20 group by 1, 2, 3")
def block_means(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.block_mean(event_grid(spark, d), {"m0": 7, "m1": 5}, SIZES), "n", "m0", "m1")


@query(f"with {_GRID} select n, m0 // 7 as m0, m1 // 5 as m1, {_r('sum(v) / 35.0')} as v from grid group by 1, 2, 3")
def block_sums(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.block_sum(event_grid(spark, d), {"m0": 7, "m1": 5}), "n", "m0", "m1")


@query(f"with {_GRID} select floor(a.v / 20)::bigint as a, floor(b.v / 20)::bigint as b, {_r('ln(count(*))')} as log_n from grid a join grid b using (m0, m1) where a.n = 0 and b.n = 1 group by 1, 2")
def colour_bleed(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    a, b = (g.where(F.col("n") == k).select("m0", "m1", F.col("v").alias(x)) for k, x in enumerate("ab"))
    found = grids.log_counts(a.join(b, ["m0", "m1"]), "a", "b", 20)
    return found.select(F.col("bin_x").alias("a"), F.col("bin_y").alias("b"), tidy(F.col("log_n")).alias("log_n"))


_MIX = [[1.1, -0.2, 0.0, 0.05], [-0.1, 1.2, -0.1, 0.0], [0.0, -0.15, 1.05, -0.1], [0.02, 0.0, -0.2, 1.1]]


@query(
    f"with {_STACK}, mix as (select unnest({[k for k in range(4) for _ in range(4)]}) as c, unnest({[k % 4 for k in range(16)]}) as e, unnest({[x for r in _MIX for x in r]})::double as w) "
    f"select m0, (n // 4 * 4 + e)::int as n, {_r('greatest(sum(v * w), 0.0)')} as v from stack join mix on n % 4 = c group by m0, n // 4 * 4 + e"
)
def colour_mixing(spark: SparkSession, d: str) -> DataFrame:
    v = vector_stack(spark, d).select("m0", mix_channels("obs", _MIX).alias("obs"))
    return _out(evidence.to_long(v), "m0", "n")


# Evidence, labels, peaks.

_E = f"""{_CODES}, sized as (select m0, sqrt(sum(v * v)) as s from stack group by m0), loud as (select j, sqrt(sum(c * c)) as l from codes group by j),
e as (select m0, k.j, sum(x.v * k.c) / ((any_value(s) + LOW) * any_value(l)) as e from stack x join codes k using (n) join sized using (m0) join loud on loud.j = k.j group by m0, k.j)"""
_LOW_DEFAULT = "(select max(v) * 0.0005 * 64 from stack)"


@query(f"with {_E.replace('LOW', '0.05')} select m0, j, {_r('e')} as e from e")
def evidence_of_codes(spark: SparkSession, d: str) -> DataFrame:
    return _out(evidence.evidence(vector_stack(spark, d), vector_codes(spark, d), 0.05), "m0", "j", v="e")


@query(f"with {_E.replace('LOW', _LOW_DEFAULT)} select m0, j, {_r('e')} as e from e")
def evidence_default_floor(spark: SparkSession, d: str) -> DataFrame:
    return _out(evidence.evidence(vector_stack(spark, d), vector_codes(spark, d)), "m0", "j", v="e")


@query(f"with {_E.replace('LOW', '0.05')} select m0, (case when max(e) < 0.2 then -1 else arg_max(j, e) end)::int as j, {_r('max(e)')} as e from e group by m0")
def labelled_density(spark: SparkSession, d: str) -> DataFrame:
    return _out(evidence.best_code(vector_stack(spark, d), vector_codes(spark, d), 0.05, 0.2), "m0", "j", v="e")


@query(f"with {_E.replace('LOW', '0.05')} select m0, j, {_r('e')} as e from e where e > 0.5 * (select max(e) from e)")
def relative_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = evidence.evidence(vector_stack(spark, d), vector_codes(spark, d), 0.05)
    return _out(evidence.above_share_of_top(e, 0.5), "m0", "j", v="e")


@query(
    f"""with {_GRID}, f as (select n as j, m0, m1, v::float as v from grid) select j, m0, m1, {_r('v::double')} as v from f a
where v > 20 and not exists (select 1 from f b where b.j = a.j and abs(b.m0 - a.m0) <= 1 and abs(b.m1 - a.m1) <= 2 and b.v > a.v)"""
)
def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d).withColumnRenamed("n", "j")
    found = grids.peaks(g, {"m0": 1, "m1": 2}, 20.0)
    return found.select("j", "m0", "m1", tidy(F.col("v").cast("double")).alias("v"))


# Point clouds.

_PC = f"{_GRID}, a as (select m0, m1, n as j from grid where v >= 60), b as (select m0 + 2 as m0, m1, n as j from grid where v >= 100)"
_NEAR = "exists (select 1 from {o} o where o.j = p.j and (o.m0 - p.m0) * (o.m0 - p.m0) + (o.m1 - p.m1) * (o.m1 - p.m1) <= 9)"


def _clouds(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return pointclouds.match(event_points(spark, d, 0, 60.0), event_points(spark, d, 2, 100.0), 3.0, ["m0", "m1"])


@query(f"with {_PC} select m0, m1, j from a p where not {_NEAR.format(o='b')}")
def match_missed(spark: SparkSession, d: str) -> DataFrame:
    return _clouds(spark, d)["fn"]


@query(f"with {_PC} select m0, m1, j from b p where not {_NEAR.format(o='a').replace('<= 9', '<= 1')}")
def match_false(spark: SparkSession, d: str) -> DataFrame:
    return pointclouds.match(event_points(spark, d, 0, 60.0), event_points(spark, d, 2, 100.0), 1.0, ["m0", "m1"])["fp"]


@query(f"with {_PC} select m0, m1, j from b p where {_NEAR.format(o='a')}")
def match_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _clouds(spark, d)["agreement"]


_ROL = f"{_PC}, r as (select *, case when (m0 + m1) % 7 = 0 then 'bad' when (m0 + m1) % 5 = 0 then 'other' else 'good' end as status from a), usable as (select * from r where status <> 'bad')"


@query(
    f"""with {_ROL} select 'fn' as kind, m0, m1, j from r p where status = 'good' and not {_NEAR.format(o='b')}
union all select 'fp', m0, m1, j from b p where not {_NEAR.format(o='usable')} union all select 'agreement', m0, m1, j from b p where {_NEAR.format(o='usable')}"""
)
def match_by_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("m0") + F.col("m1")) % 7 == 0, "bad").when((F.col("m0") + F.col("m1")) % 5 == 0, "other").otherwise("good")
    truth = event_points(spark, d, 0, 60.0).withColumn("status", status)
    found = pointclouds.match_rolonies(truth, event_points(spark, d, 2, 100.0), 3.0, ["m0", "m1"])
    parts = [df.select(F.lit(k).alias("kind"), "m0", "m1", "j") for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"with {_PC}, d as (select a.j, a.m0, a.m1, min(sqrt((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1))) as d from a left join b on a.j = b.j group by all) "
    f"select j, {_r(chr(99) + 'oalesce(avg(coalesce(d, ' + chr(39) + 'inf' + chr(39) + '::double)), 0)')} as divergence from (select j from a union select j from b) left join d using (j) group by j"
)
def meanmin_divergence(spark: SparkSession, d: str) -> DataFrame:
    found = pointclouds.meanmin_divergence(event_points(spark, d, 0, 60.0), event_points(spark, d, 2, 100.0), ["m0", "m1"])
    return _out(found, "j", v="divergence")


@query(f"with {_PC}, s as (select unnest([0, -1, 1, 0, 0]) as x, unnest([0, 0, 0, -1, 1]) as y) select (m0 + x)::int as m0, (m1 + y)::int as m1, max(j) as j from a cross join s group by m0 + x, m1 + y")
def voxel_labels(spark: SparkSession, d: str) -> DataFrame:
    return pointclouds.voxel_labels(event_points(spark, d, 0, 60.0), ["m0", "m1"], 1)


@query(
    f"with {_PC}, s as (select x, y from (select unnest(range(-2, 3)) as x) cross join (select unnest(range(-1, 2)) as y) where x * x / 4.0 + y * y <= 1) "
    "select distinct (m0 + x)::int as m0, (m1 + y)::int as m1 from a cross join s"
)
def ellipsoid_dilation(spark: SparkSession, d: str) -> DataFrame:
    return pointclouds.dilate(event_points(spark, d, 0, 60.0), {"m0": 2, "m1": 1})


# Codebooks: brands and sizes of parts as numbers in base 3, one channel lit per digit.

_LIT = "{t} as (select k as j, r, (k // (3 ** (3 - r))::int % 3)::int as ch from (select distinct {k} as k from part) cross join (select unnest(range(4))::int as r))"
_BRAND, _SIZE = "regexp_extract(p_brand, '([0-9]+)$', 1)::int", "p_size"
_HOT = "{t}_hot as (select j, r, c as ch, (ch = c)::int::double as c from {t} cross join (select unnest(range(3))::int as c))"
_BOOKS = ", ".join([_LIT.format(t="ours", k=_BRAND), _LIT.format(t="theirs", k=_SIZE), _HOT.format(t="ours"), _HOT.format(t="theirs")])
_DIST = f"{_BOOKS}, d as (select a.j as i, b.j, sum(abs(a.c - b.c)) as d from ours_hot a join theirs_hot b using (r, ch) group by a.j, b.j)"


def _lit(spark: SparkSession, d: str, number) -> DataFrame:
    k = read(spark, d, "part").select(number.alias("j")).distinct()
    return k.select("j", F.posexplode(F.array(*[F.floor(F.col("j") / 3**e).cast("int") % 3 for e in (3, 2, 1, 0)])).alias("r", "ch"))


def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    lit = (_lit(spark, d, x) for x in (brand, F.col("p_size")))
    return tuple(codebooks.onehot(x, 3).select("j", "r", "ch", (F.col("r") * 3 + F.col("ch")).alias("n"), "c") for x in lit)


@query(f"with {_BOOKS} select j, r, ch, c from ours_hot")
def codebook_onehot(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d)[0].select("j", "r", "ch", "c")


@query(f"with {_BOOKS} select j from theirs where (r = 1 and ch = 1) or (r = 3 and ch = 0) group by j having count(*) = 2")
def codebook_query(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.query_onehot(_books(spark, d)[1], "?1?0")


@query(f"with {_DIST} select i, j, d from d")
def codebook_distances(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.distances(*_books(spark, d))


@query(
    f"""with {_DIST}, a as (select count(*) n, count(*) filter (d > 0) fn from (select min(d) d from d group by i)), b as (select count(*) n, count(*) filter (d > 0) fp from (select min(d) d from d group by j))
select fn, fp, {_r('fp / b.n')} as fdr, {_r('1 - fn / a.n')} as dr from a cross join b"""
)
def codebook_comparison(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.compare(*_books(spark, d)).select("fn", "fp", tidy(F.col("fdr")).alias("fdr"), tidy(F.col("dr")).alias("dr"))


@query(f"with {_DIST} select i, j from d where d <= 2")
def codebook_pairing(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.pairing(*_books(spark, d), 2)


@query(f"with {_DIST}, p as (select i, j from d where d <= 2) select (select max(n) <= 1 from (select count(*) n from p group by i)) as i_unambiguous, (select max(n) <= 1 from (select count(*) n from p group by j)) as j_unambiguous")
def pairing_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.multiplicity(codebooks.pairing(*_books(spark, d), 2))


@query(f"with {_BOOKS} select b.r * 3 + b.ch as n, b.j, coalesce(case when b.r <> 2 then b.c end, a.c) as c from theirs_hot b left join ours_hot a using (r, ch, j)")
def codebook_merged_entries(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = _books(spark, d)
    return codebooks.merge_entries(ours, theirs.withColumn("c", F.when(F.col("r") != 2, F.col("c"))))


@query(f"with {_BOOKS}, top as (select max(j) as t from ours) select n, j, c from (select r * 3 + ch as n, j, c from ours_hot union all select r * 3 + ch, j + t + 1, c from theirs_hot cross join top where j not in (select j from ours))")
def codebook_merged(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = _books(spark, d)
    return codebooks.merge_codebooks(ours, theirs, 0.0)


# Discovery: 16 rounds of 4 channels.

_ROUNDS = """x as (select vec_id as m0, unnest(range(16))::int as r, list_transform(embedding, lambda y: abs(y::double)) as o from embeddings),
y as (select m0, r, o[r * 4 + 1 : r * 4 + 4] as c from x),
z as (select m0, r, list_max(c) as top, c[1] + c[2] + c[3] + c[4] as total, list_position(c, list_max(c)) - 1 as best from y),
picked as (select m0, r, top, total, case when top > {s} * total / 4 then best else -1 end as ch from z)"""


def _positive(spark: SparkSession, d: str) -> DataFrame:
    return vector_stack(spark, d).select("m0", F.transform("obs", lambda x: F.abs(x)).alias("obs"))


@query(
    f"with {_ROUNDS.format(s=1.6)}, v as (select m0, string_agg(ch::varchar, ',' order by r) as code, count(*) filter (ch >= 0) as good from picked group by m0) select code, count(*) as n_voxels from v where good >= 0.9 * 16 group by code"
)
def seek_codes(spark: SparkSession, d: str) -> DataFrame:
    return discovery.seek(_positive(spark, d), 4, 1.6, 0.9)


_SCALED = "topv as (select max(list_max(list_transform(embedding, lambda w: abs(w::double)))) as t from embeddings), " + _ROUNDS.replace("abs(y::double)) as o from embeddings", "abs(y::double) / t) as o from embeddings cross join topv")
_SHARE = f"{_SCALED.format(s=2.0)}, v as (select m0, string_agg(ch::varchar, ',' order by r) as code, sum(case when ch >= 0 then top else 0 end) / (sum(total) + 0.01) as share from picked group by m0)"
_SQUARES = f"{_SCALED.format(s=2.0)}, w as (select m0, list_sum(list_transform(o, lambda t: t * t)) as s from x where r = 0), v as (select m0, string_agg(ch::varchar, ',' order by r) as code, sum(case when ch >= 0 then top * top else 0 end) / (any_value(s) + 0.001) as share from picked join w using (m0) group by m0)"


@query(f"with {_SHARE} select m0, {_r('share')} as share, code from v")
def signal_shares(spark: SparkSession, d: str) -> DataFrame:
    x = discovery.signal_share(_positive(spark, d), 4, 2.0)
    return x.select("m0", tidy(F.col("share")).alias("share"), "code")


@query(f"with {_SQUARES} select code, count(*) as n_voxels from v where share / (select max(share) from v) >= 0.8 group by code")
def seek_codes_by_share(spark: SparkSession, d: str) -> DataFrame:
    return discovery.seek_by_share(_positive(spark, d), 4, 0.8, stand_out=2.0)


@query(f"with {_SQUARES} select code, count(*) as n_voxels from v where share / (select max(share) from v) >= 1 group by code")
def seek_codes_by_top_share(spark: SparkSession, d: str) -> DataFrame:
    return discovery.seek_by_share(_positive(spark, d), 4, 1.0, stand_out=2.0)


# Rectangles and tiles.


@query(
    """with b as (select p_partkey as k, [p_size, regexp_extract(p_brand, '([0-9]+)$', 1)::int] as s, [p_size + p_partkey % 7, regexp_extract(p_brand, '([0-9]+)$', 1)::int + p_partkey % 5] as e from part),
i as (select k, s, e, [greatest(s[1], 10), greatest(s[2], 5)] as a, [least(e[1], 30), least(e[2], 15)] as z from b)
select k, a[1] as s0, a[2] as s1, case when z[1] <= a[1] or z[2] <= a[2] then a[1] else z[1] end as e0, case when z[1] <= a[1] or z[2] <= a[2] then a[2] else z[2] end as e1,
(10 >= s[1] and 10 < e[1] and 12 >= s[2] and 12 < e[2]) as holds, (e[1] = s[1] and e[2] = s[2]) as is_empty, (s[1] + e[1]) / 2.0 as centre0 from i"""
)
def box_operations(spark: SparkSession, d: str) -> DataFrame:
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    k = F.col("p_partkey")
    start = F.array(F.col("p_size").cast("long"), brand)
    own = rectangles.box(start, F.array(F.col("p_size") + k % 7, brand + k % 5))
    fixed = rectangles.box(F.array(F.lit(10).cast("long"), F.lit(5).cast("long")), F.array(F.lit(30).cast("long"), F.lit(15).cast("long")))
    both = rectangles.intersection(own, fixed)
    point = F.array(F.lit(10).cast("long"), F.lit(12).cast("long"))
    rows = read(spark, d, "part").select(k.alias("k"), both.alias("i"), rectangles.holds(own, point).alias("holds"), rectangles.is_empty(own).alias("is_empty"), rectangles.center(own)[0].alias("centre0"))
    return rows.select("k", F.col("i.start")[0].alias("s0"), F.col("i.start")[1].alias("s1"), F.col("i.stop")[0].alias("e0"), F.col("i.stop")[1].alias("e1"), "holds", "is_empty", "centre0")


@query(
    f"""with {_SERIES}, k as (select unnest(range(0, (1440 - 200 - 30) // 200 + 2)) as k), last as (select max(k) as e from k),
t as (select k * 200 as put, case when k = e then 1440 else (k + 1) * 200 end as stop, greatest(k * 200 - 30, 0) as look, case when k = e then 1440 else (k + 1) * 200 + 30 end as until from k cross join last)
select put::varchar as tile, count(*) as n_rows, {_r('sum(v)')} as total, {_r('sum(case when m0 >= put and m0 < stop then v else 0 end)')} as own from series join t on m0 >= look and m0 < until group by put"""
)
def tiles_with_halo(spark: SparkSession, d: str) -> DataFrame:
    dealt = tiling.deal(event_series(spark, d), tiling.tiles(spark, DAY, {"m0": 200}, {"m0": 30}), ["m0"])
    own = F.when((F.col("m0") >= F.col("put_start_m0")) & (F.col("m0") < F.col("put_stop_m0")), F.col("v")).otherwise(0.0)
    return dealt.groupBy("tile").agg(F.count("*").alias("n_rows"), tidy(F.sum("v")).alias("total"), tidy(F.sum(own)).alias("own"))


# Registration.

_T = "(0.3 + 0.7 * n)"
_TAKE = "coalesce({x}, 0.0)"


@query(f"with {_LINE}, s as (select n, m0, floor{_T}::int as f, {_T} - floor{_T} as p from line) select s.n, s.m0, {_r('(1 - p) * coalesce(a.v, 0) + p * coalesce(b.v, 0)')} as v from s left join line a on a.n = s.n and a.m0 = s.m0 + f left join line b on b.n = s.n and b.m0 = s.m0 + f + 1")
def shift_linear(spark: SparkSession, d: str) -> DataFrame:
    return _shifted(spark, d, "linear")


@query(f"with {_LINE} select s.n, s.m0, {_r('coalesce(a.v, 0)')} as v from line s left join line a on a.n = s.n and a.m0 = s.m0 + round_even({_T.replace('n', 's.n')}, 0)::int")
def shift_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _shifted(spark, d, "nearest")


@query(
    f"""with {_LINE}, g as (select n, m0, v, case when m0 = 0 then lead(v) over w - v when m0 = 1439 then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2 end as g from line window w as (partition by n order by m0)),
s as (select n, m0, floor{_T}::int as f, {_T} - floor{_T} as p from line)
select s.n, s.m0, {_r('(1 + 2 * p) * (1 - p) * (1 - p) * coalesce(a.v, 0) + p * (1 - p) * (1 - p) * coalesce(a.g, 0) + p * p * (3 - 2 * p) * coalesce(b.v, 0) - p * p * (1 - p) * coalesce(b.g, 0)')} as v
from s left join g a on a.n = s.n and a.m0 = s.m0 + f left join g b on b.n = s.n and b.m0 = s.m0 + f + 1"""
)
def shift_hermite(spark: SparkSession, d: str) -> DataFrame:
    return _shifted(spark, d, "hermite")


def _shifted(spark: SparkSession, d: str, method: str) -> DataFrame:
    moved = grids.shift(_line(spark, d), "m0", 0.3 + 0.7 * F.col("n"), 1440, method, 1440)
    every = _line(spark, d).select("n", "m0")
    return _out(every.join(moved, ["n", "m0"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))), "n", "m0")


_ARG = f"{_GRID}, top as (select n, arg_max(m0, (v, -m0, -m1)) as x0, arg_max(m1, (v, -m0, -m1)) as x1 from grid group by n), p as (select a.n as f1, b.n as f2, unnest([0, 1])::int as axis, unnest([a.x0 - b.x0, a.x1 - b.x1])::double as d from top a cross join top b)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    top = codebooks.argmax(event_grid(spark, d), ["n"], "v", ["m0", "m1"])
    a, b = (top.select(F.col("n").alias(f), F.col("m0").alias(f"{f}0"), F.col("m1").alias(f"{f}1")) for f in ("f1", "f2"))
    each = F.posexplode(F.array((F.col("f10") - F.col("f20")).cast("double"), (F.col("f11") - F.col("f21")).cast("double")))
    return a.crossJoin(b).select("f1", "f2", each.alias("axis", "d"))  # frames are few


@query(f"with {_ARG}, m as (select f2, axis, avg(d) as m from p group by all) select f1 as n, axis, {_r('avg(d - m)')} as t from p join m using (f2, axis) group by f1, axis")
def centred_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _out(registration.centred(_pairs(spark, d)), "n", "axis", v="t")


@query(
    f"""with {_ARG}, m as (select f2, axis, avg(d) as m from p group by all), t as (select f1 as n, axis, avg(d - m) / 3 as t from p join m using (f2, axis) group by f1, axis),
s as (select axis, min(t) as lo, max(t) as hi from t group by axis)
select 'valid' as mode, n, axis, {_r('t - lo + 1')} as t, (case axis when 0 then 40 else 24 end - 3 - floor(hi - lo))::int as size from t join s using (axis)
union all select 'full', n, axis, {_r('t - hi')}, (case axis when 0 then 40 else 24 end + ceil(hi - lo))::int from t join s using (axis)"""
)
def common_regions(spark: SparkSession, d: str) -> DataFrame:
    t = registration.centred(_pairs(spark, d)).withColumn("t", F.col("t") / 3)
    parts = [registration.region(t, {0: 40, 1: 24}, mode, "hermite").select(F.lit(mode).alias("mode"), "n", "axis", tidy(F.col("t")).alias("t"), "size") for mode in ("valid", "full")]
    return parts[0].unionByName(parts[1])


@query(f"with {_GRID} select a.m0 - b.m0 as t_m0, a.m1 - b.m1 as t_m1, {_r('sum(a.v * b.v)')} as product from grid a cross join grid b where a.n = 0 and b.n = 1 and abs(a.m0 - b.m0) <= 4 and abs(a.m1 - b.m1) <= 4 group by 1, 2")
def products_at_offsets(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    found = registration.products_at_offsets(*[g.where(F.col("n") == k).select("m0", "m1", "v") for k in (0, 1)], ["m0", "m1"], 4)
    return _out(found, "t_m0", "t_m1", v="product")


_AFF = [[0.02, -0.01, 0.3], [0.01, 0.03, -0.6]]


@query(
    f"with {_DENSE} select d.n, d.m0, d.m1, {_r('coalesce(s.v, 0)')} as v from dense d left join dense s on s.n = d.n and s.m0 = round_even(d.m0 + (0.3::double + d.m0 * 0.02::double + d.m1 * -0.01::double), 0)::int and s.m1 = round_even(d.m1 + (-0.6::double + d.m0 * 0.01::double + d.m1 * 0.03::double), 0)::int"
)
def affine_resampling(spark: SparkSession, d: str) -> DataFrame:
    grid = _dense(spark, d)
    points = registration.affine_coordinates(grid.select("n", "m0", "m1"), _AFF, ["m0", "m1"])
    return _out(registration.sample(grid, points, ["m0", "m1"]), "n", "m0", "m1")


# Colours, labels, geometry.


@query("select vec_id as m0, (case when label = 9 then 0 else label % 6 + 1 end)::int as colour from embeddings")
def label_colours(spark: SparkSession, d: str) -> DataFrame:
    j = F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("m0"), label_color(j, 7).cast("int").alias("colour"))


def _rgb_sql(w: tuple[int, ...]) -> str:
    return "floor(least(greatest(a * {} + b * {} + c * {} + e * {}, 0.0), 1.0) * 255)::int".format(*[f"{x * 0.25}::double" for x in w])


@query(
    f"""with {_DENSE}, top as (select n, min(v) as l, max(v) - min(v) as t from dense group by n), x as (select m0, m1, max((v - l) / t) filter (n = 0) as a, max((v - l) / t) filter (n = 1) as b, max((v - l) / t) filter (n = 2) as c, max((v - l) / t) filter (n = 3) as e from dense join top using (n) group by m0, m1)
select m0, m1, {_rgb_sql((1, 1, 3, 4))} as red, {_rgb_sql((2, 4, 3, 2))} as green, {_rgb_sql((4, 2, 1, 1))} as blue from x"""
)
def four_channel_rgb(spark: SparkSession, d: str) -> DataFrame:
    g = _dense(spark, d)
    bounds = g.where("n < 4").groupBy("n").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = g.join(bounds, "n").groupBy("m0", "m1").agg(*[F.max(F.when(F.col("n") == k, F.struct("v", "lo", "hi"))).alias(f"c{k}") for k in range(4)])
    part = lambda f: [F.col(f"c{k}.{f}") for k in range(4)]
    red, green, blue = channels_to_rgb(part("v"), 0.25, part("lo"), part("hi"))
    return x.select("m0", "m1", red.alias("red"), green.alias("green"), blue.alias("blue"))


_XYZ = "x as (select vec_id as k, list_transform(embedding, lambda y: y::double) as e from embeddings)"


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    v = vector_stack(spark, d)
    return v, [F.col("obs")[i] for i in range(12)]


@query(
    f"""with {_XYZ}, y as (select k, [e[1] - e[4], e[2] - e[5], e[3] - e[6]] as d, e[7:9] as u from x)
select k, {_r('greatest(d[1]*d[1] + d[2]*d[2] + d[3]*d[3] - (d[1]*u[1] + d[2]*u[2] + d[3]*u[3]) ** 2 / (u[1]*u[1] + u[2]*u[2] + u[3]*u[3]), 0)')} as d2 from y"""
)
def cylinder_distances(spark: SparkSession, d: str) -> DataFrame:
    v, e = _components(spark, d)
    return v.select(F.col("m0").alias("k"), tidy(squared_distance_to_line(e[0:3], e[3:6], e[6:9])).alias("d2"))


@query(
    f"""with {_XYZ} select k, {_r('greatest(least((-1 - e[1]) / e[4], (1 - e[1]) / e[4]), least((-1 - e[2]) / e[5], (1 - e[2]) / e[5]), least((-1 - e[3]) / e[6], (1 - e[3]) / e[6]))')} as enters,
{_r('least(greatest((-1 - e[1]) / e[4], (1 - e[1]) / e[4]), greatest((-1 - e[2]) / e[5], (1 - e[2]) / e[5]), greatest((-1 - e[3]) / e[6], (1 - e[3]) / e[6]))')} as leaves from x"""
)
def lines_in_box(spark: SparkSession, d: str) -> DataFrame:
    v, e = _components(spark, d)
    low, high = line_in_box(e[0:3], e[3:6], [-1.0] * 3, [1.0] * 3)
    return v.select(F.col("m0").alias("k"), tidy(low).alias("enters"), tidy(high).alias("leaves"))


@query(
    f"""with {_XYZ}, t as (select k, e[1] as ax, e[2] as ay, e[3] - e[1] as dx, e[4] - e[2] as dy, e[5] - e[1] as cx, e[6] - e[2] as cy from x), u as (select *, 2 * (dx * cy - dy * cx) as w from t),
c as (select k, ax, ay, (cy * (dx*dx + dy*dy) - dy * (cx*cx + cy*cy)) / nullif(w, 0) as ux, (dx * (cx*cx + cy*cy) - cx * (dx*dx + dy*dy)) / nullif(w, 0) as uy from u)
select k, round(ax + ux, 3) + 0.0 as x, round(ay + uy, 3) + 0.0 as y, round(sqrt(ux * ux + uy * uy), 3) + 0.0 as radius from c"""
)
def circumcircles(spark: SparkSession, d: str) -> DataFrame:
    v, e = _components(spark, d)
    x, y, r = circumcircle([(e[0], e[1]), (e[2], e[3]), (e[4], e[5])])
    return v.select(F.col("m0").alias("k"), tidy(x, 3).alias("x"), tidy(y, 3).alias("y"), tidy(r, 3).alias("radius"))


@query(
    f"""with {_GRID}, m as (select n, (m1 + 1) % 24 as m1, m0, v from grid), a as (select n, m0, m1, v / sum(v) over (partition by n) as a from grid), b as (select n, m0, m1, v / sum(v) over (partition by n) as b from m)
select n, {_r('0.5 * sum(abs(coalesce(a, 0) - coalesce(b, 0)))')} as loss from a full join b using (n, m0, m1) group by n"""
)
def total_variation(spark: SparkSession, d: str) -> DataFrame:
    g = event_grid(spark, d)
    moved = g.withColumn("m1", (F.col("m1") + 1) % 24)
    return _out(geometry.total_variation(g, moved, ["n", "m0", "m1"], ["n"]), "n", v="loss")


@query(f"with {_DENSE} select x.n, x.m0, x.m1, min((x.m0 - s.m0) ** 2 + (x.m1 - s.m1) ** 2)::double as g from dense x join dense s on s.n = x.n and s.v >= 100 group by 1, 2, 3")
def distance_to_signal(spark: SparkSession, d: str) -> DataFrame:
    seeds = event_grid(spark, d).where(F.col("v") >= 100).select("n", "m0", "m1", F.lit(0).cast("long").alias("g"))
    one = geometry.distance_transform(seeds, "m0", 40, ["n", "m1"])
    return geometry.distance_transform(one, "m1", 24, ["n", "m0"]).select("n", "m0", "m1", "g")


def _transformed(out: str, src: str, value: str, first: int, second: int) -> str:
    steps = [f"{out}{i} as (select n, {o}, y.{a}::int as {a}, min({g} + (y.{a} - x.{a}) ** 2) as g from {s} x join (select unnest(range({n})) as {a}) y on true group by n, {o}, y.{a})" for i, (a, o, n, s, g) in enumerate((("m0", "m1", first, src, value), ("m1", "m0", second, f"{out}0", "g")))]
    return ", ".join(steps)


_FAR_OFF = f"{_DENSE}, f as (select n, m0, m1, 100000.0::double * (1 - least(v / 200, 1.0)) as g from dense), {_transformed('a', 'f', 'g', 40, 24)}, soft as (select n, m0, m1, 1 / (1 + exp(-(least(g, 100000.0::double) - 6.0) / 2.0)) as v from a1)"


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).withColumn("v", F.least(F.col("v") / 200, F.lit(1.0)))


@query(f"with {_FAR_OFF}, h as (select n, m0, m1, 100000.0::double * (1 - v) as g from soft), {_transformed('b', 'h', 'g', 40, 24)} select n, m0, m1, {_r('g')} as g from b1")
def skeleton_of_signal(spark: SparkSession, d: str) -> DataFrame:
    return _out(geometry.skeleton(_signal(spark, d), SIZES, 6.0, 2.0), "n", "m0", "m1", v="g")


@query(
    f"""with {_FAR_OFF}, h as (select n, m0 + 1 as m0, m1 + 1 as m1, 100000.0::double * (1 - v) as g from soft union all
select n, m0, m1, 0.0::double from (select unnest(range(5))::int as n) cross join (select unnest(range(42))::int as m0) cross join (select unnest(range(26))::int as m1) where m0 in (0, 41) or m1 in (0, 25)),
{_transformed('b', 'h', 'g', 42, 26)} select n, m0 - 1 as m0, m1 - 1 as m1, {_r('g')} as g from b1 where m0 between 1 and 40 and m1 between 1 and 24"""
)
def padded_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return _out(geometry.skeleton(_signal(spark, d), SIZES, 6.0, 2.0, padded=True), "n", "m0", "m1", v="g")


# Iterative fits: no SQL; tests hold them against loops in numpy.


@query()
def deconvolved(spark: SparkSession, d: str) -> DataFrame:
    return _out(grids.lucy_richardson(_dense(spark, d), SIZES, {"m0": 1.0, "m1": 0.7}, 5), "n", "m0", "m1")


@query()
def iterative_density(spark: SparkSession, d: str) -> DataFrame:
    codes = vector_codes(spark, d).withColumn("c", F.abs("c"))
    found = density.fit(_positive(spark, d), codes, 6).density()
    return _out(found, "m0", "j")
