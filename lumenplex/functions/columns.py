"""Expressions on columns of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays; NULL entries count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for reports, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def linear(v1: Column, v2: Column, t: Column | float) -> Column:
    """Linear interpolation from v1 (t = 0) to v2 (t = 1)."""
    t = t if isinstance(t, Column) else F.lit(t)
    return (1 - t) * v1 + t * v2


def hermite(v1: Column, d1: Column, v2: Column, d2: Column, t: Column | float) -> Column:
    """Cubic interpolation through v1 and v2 with slopes d1 and d2."""
    t = t if isinstance(t, Column) else F.lit(t)
    u = 1 - t
    return (1 + 2 * t) * u * u * v1 + t * u * u * d1 + t * t * (3 - 2 * t) * v2 - t * t * u * d2


def label_color(label: Column, limit: int) -> Column:
    """-1 stays the background colour 0; other labels cycle through 1..limit - 1."""
    return F.when(label == -1, F.lit(0)).otherwise(F.pmod(label, F.lit(limit - 1)) + 1)


#: Shares of red, green and blue that each of four channels gets: fixed values.
CHANNEL_RGB = ((1, 2, 4), (1, 4, 2), (3, 3, 1), (4, 2, 1))


def channels_to_rgb(channels: list[Column], scale: float = 0.5, low: list[Column] | None = None, high: list[Column] | None = None) -> list[Column]:
    """Three 0..255 integers from four channels, each less its least value and over its span (no bounds: as they are).

    Bounds of each channel normalise each; the same bounds for all normalise them together.
    """
    parts = [(c - lo) / (hi - lo) for c, lo, hi in zip(channels, low, high)] if low and high else channels
    out = []
    for k in range(3):
        mixed = sum((p * (w[k] * scale) for p, w in zip(parts[1:], CHANNEL_RGB[1:])), parts[0] * (CHANNEL_RGB[0][k] * scale))
        out.append(F.floor(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    return out


def squared_distance_to_line(point: list[Column], at: list[Column], direction: list[Column]) -> Column:
    """Squared distance of a point to a line; the direction has any length but 0."""
    d = [p - a for p, a in zip(point, at)]
    length = sum((u * u for u in direction[1:]), direction[0] * direction[0])
    along = sum((x * u for x, u in zip(d[1:], direction[1:])), d[0] * direction[0])
    return F.greatest(sum((x * x for x in d[1:]), d[0] * d[0]) - along * along / length, F.lit(0.0))


def line_in_box(at: list[Column], direction: list[Column], start: list[float], stop: list[float]) -> tuple[Column, Column]:
    """Parameters of entry and exit of a line through a point strictly inside a box (slab by slab)."""
    low, high = [], []
    for a, u, s, e in zip(at, direction, start, stop):
        one, two = (F.lit(s) - a) / u, (F.lit(e) - a) / u
        low.append(F.when(u != 0, F.least(one, two)).otherwise(F.lit(float("-inf"))))
        high.append(F.when(u != 0, F.greatest(one, two)).otherwise(F.lit(float("inf"))))
    return F.greatest(*low), F.least(*high)


def circumcircle(points: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """Centre x, centre y and radius of a triangle's circumcircle; NULL for collinear points."""
    (ax, ay), (bx, by), (cx, cy) = points
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    twice = 2 * (bx * cy - by * cx)
    twice = F.when(twice != 0, twice)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / twice, (bx * c2 - cx * b2) / twice
    return ax + ux, ay + uy, F.sqrt(ux * ux + uy * uy)


def circumsphere(points: list[list[Column]]) -> tuple[Column, Column, Column, Column]:
    """Centre x, y, z and radius of a tetrahedron's circumsphere; NULL for flat ones."""
    a = points[0]
    u, v, w = ([x - y for x, y in zip(p, a)] for p in points[1:])
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    inner = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    vw, wu, uv = cross(v, w), cross(w, u), cross(u, v)
    twelve = 2 * inner(u, vw)
    twelve = F.when(twelve != 0, twelve)
    off = [(inner(u, u) * x + inner(v, v) * y + inner(w, w) * z) / twelve for x, y, z in zip(vw, wu, uv)]
    return (*[x + y for x, y in zip(a, off)], F.sqrt(inner(off, off)))


def mix_channels(obs: Column | str, matrix: list[list[float]]) -> Column:
    """obs of rounds of C channels, each round times a C x C matrix, negative results set to 0."""
    c = len(matrix)
    obs = F.col(obs) if isinstance(obs, str) else obs
    columns = F.array(*[F.array(*[F.lit(float(matrix[k][d])) for k in range(c)]) for d in range(c)])
    rounds = F.transform(F.sequence(F.lit(0), (F.size(obs) / c).cast("int") - 1), lambda r: F.slice(obs, r * c + 1, c))
    return F.flatten(F.transform(rounds, lambda x: F.transform(columns, lambda m: F.greatest(dot(x, m), F.lit(0.0)))))
