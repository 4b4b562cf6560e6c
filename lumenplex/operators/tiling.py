"""Tiles with halos as tables: what to read (look), what to keep of it (grab), where it goes (put)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tiles of equal boxes in one row; tasks, by the first tiles, that share a cell's pairs.
TOGETHER, SHARES = 256, 16

MODES = ("short", "reduplicate", "drop")


def axis_tiles(length: int, inner: int, border: int, last: str = "short") -> list[tuple[int, int, int, int, int, int]]:
    """(look start, look stop, grab start, grab stop, put start, put stop) along one axis."""
    if last not in MODES:
        raise ValueError(f"{last}: one of {MODES}")
    if inner + border >= length:
        return [(0, length, 0, length, 0, length)]
    end = (length - inner - border) // inner + 1
    out = []
    for k in range(end + 1):
        put, stop, look = k * inner, (k + 1) * inner, max(k * inner - border, 0)
        until = stop + border
        if k == end:
            if last == "drop" or put >= length:
                continue
            stop = until = length
            if last == "reduplicate":
                look = min(look, length - inner - border)
                put = look + border
        out.append((look, until, put - look, stop - look, put, stop))
    return out


def inside_tiles(length: int, inner: int, border: int) -> list[tuple[int, int, int, int, int, int]]:
    """Tiles that never put anything into the outer border; each looks `border` around what it puts."""
    out = []
    for put in range(border, length - border, inner):
        stop = min(put + inner, length - border)
        out.append((put - border, stop + border, border, border + stop - put, put, stop))
    return out


def tiles(spark: SparkSession, sizes: dict[str, int], inner: dict[str, int], border: dict[str, int] | None = None, outer: bool = True, last: str = "short") -> DataFrame:
    """tile and {look,grab,put}_{start,stop}_axis for every tile of a grid: products of the axes' tiles."""
    out = None
    for a, size in sizes.items():
        b = (border or {}).get(a, 0)
        rows = axis_tiles(size, inner[a], b, last) if outer else inside_tiles(size, inner[a], b)
        names = [f"{what}_{end}_{a}" for what in ("look", "grab", "put") for end in ("start", "stop")]
        one = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in names))
        out = one if out is None else out.crossJoin(one)  # tiles are few by construction
    keys = [f"put_start_{a}" for a in sizes]
    return out.withColumn("tile", F.concat_ws("/", *keys))


def deal(stack: DataFrame, tiled: DataFrame, axes: list[str]) -> DataFrame:
    """Rows with every tile that looks at them; border rows are in several. Rows and tiles meet in cells as wide as the widest tile."""
    widest = tiled.agg(*[F.max(F.col(f"look_stop_{a}") - F.col(f"look_start_{a}")).alias(a) for a in axes]).first()
    width = {a: max(int(widest[a] or 1), 1) for a in axes}
    cells, seen, inside = tiled, stack, F.lit(True)
    for a in axes:
        cells = cells.withColumn(f"__c_{a}", F.explode(F.sequence(F.floor(F.col(f"look_start_{a}") / width[a]), F.floor((F.col(f"look_stop_{a}") - 1) / width[a]))))
        seen = seen.withColumn(f"__c_{a}", F.floor(F.col(a) / width[a]))
        inside = inside & (F.col(a) >= F.col(f"look_start_{a}")) & (F.col(a) < F.col(f"look_stop_{a}"))
    keys = [f"__c_{a}" for a in axes]
    return seen.join(cells, keys).where(inside).drop(*keys)


def owned(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Rows of dealt tiles that their tile puts: every voxel once."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & (F.col(a) >= F.col(f"put_start_{a}")) & (F.col(a) < F.col(f"put_stop_{a}"))
    return rows.where(keep)


def neighbours(tiled: DataFrame, axes: list[str], what: str = "look", together: int = TOGETHER) -> DataFrame:
    """Pairs of tiles (tile, other) whose boxes overlap.

    Tiles of equal boxes are taken together, up to `together` in a row; such rows meet in grid cells as wide as the widest
    box, and a pair of rows counts in the cell where what they share begins. Only then are their tiles paired: what is
    compared grows with the different boxes, what is returned with the pairs. Each cell's rows are dealt to several tasks.
    """
    widest = tiled.agg(*[F.max(F.col(f"{what}_stop_{x}") - F.col(f"{what}_start_{x}")).alias(x) for x in axes]).first()
    width = {x: max(int(widest[x] or 1), 1) for x in axes}
    bounds = [f"{end}_{x}" for x in axes for end in ("start", "stop")]
    boxes = tiled.select("tile", *[F.col(f"{what}_{b}").alias(b) for b in bounds])
    for x in axes:
        boxes = boxes.where(F.floor(f"start_{x}") <= F.floor(F.col(f"stop_{x}") - 1))
    number = F.row_number().over(Window.partitionBy(*bounds).orderBy("tile")) - 1
    alike = boxes.withColumn("part", F.floor(number / together)).groupBy(*bounds, "part").agg(F.collect_list("tile").alias("tiles"))

    def side(name: str) -> DataFrame:
        out = alike.select(F.col("tiles").alias(name), *[F.col(b).alias(f"{name}_{b}") for b in bounds])
        for x in axes:
            first, last = (F.floor(F.col(f"{name}_{end}_{x}") - off).cast("long") for end, off in (("start", 0), ("stop", 1)))
            out = out.select("*", F.explode(F.sequence(F.floor(first / width[x]), F.floor(last / width[x]))).alias(f"cell_{x}"))
        return out

    meet = F.lit(True)
    for x in axes:
        low, high = F.greatest(f"tile_start_{x}", f"other_start_{x}"), F.least(f"tile_stop_{x}", f"other_stop_{x}")
        meet = meet & (low < high) & (F.floor(low / width[x]) == F.col(f"cell_{x}"))
    ours = side("tile").withColumn("share", F.pmod(F.xxhash64("tile"), F.lit(SHARES)))
    theirs = side("other").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = ours.join(theirs.hint("merge"), [*[f"cell_{x}" for x in axes], "share"]).where(meet)
    pairs = met.select(F.explode("tile").alias("tile"), "other").select("tile", F.explode("other").alias("other"))
    return pairs.where(F.col("tile") != F.col("other"))


def simple_tiles(start: int, stop: int, size: int, drop_last: bool = True) -> list[tuple[int, int]]:
    """Boxes of one size along an axis, without halos; the last one, whole or not, is dropped unless told otherwise."""
    edges = list(range(start, stop, size))
    if not edges:
        raise ValueError("an empty axis")
    return list(zip(edges, edges[1:] if drop_last else [*edges[1:], stop]))


def downsampled(tiled: DataFrame, d: dict[str, int]) -> DataFrame:
    """Tiles with every bound divided by the axis' factor, rounded down."""
    bounds = [f"{what}_{end}_{a}" for a in d for what in ("look", "grab", "put") for end in ("start", "stop")]
    return tiled.withColumns({b: F.floor(F.col(b) / d[b.rsplit("_", 1)[1]]).cast("int") for b in bounds})
