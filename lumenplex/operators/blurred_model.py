"""Densities with a point spread: what is seen is a blurred non-negative mix of codes, over all tiles of a stack at once.

Model: obs[m, r, c] ~ gain[r, c] * sum_k mixing[c, k] * sum_j blur(F[., j])[m] * Z[r, k, j] + a[m] + b[r, c], frames
n = r * channels + c; Z is the codebook with what earlier rounds leave behind (see `phased`). The blur is Gaussian with
zeros beyond the stack's border, its own adjoint, and acts on frames as on densities, so it is done on frames.

A stack is cut into tiles; a row holds a tile's voxels as arrays, its densities as places and values. A step of the
densities needs two blurs around each voxel: every tile sends what lies within twice the blur's reach of its neighbours
to them (one shuffle of halos, written), and all that follows is map-only with sums of a few numbers over all tiles:
the step's length by an exact line search over the whole stack, then trial lengths, all ten of the backtracking in one
pass. Gains, mixing and frames' backgrounds follow from sums of at most rounds * channels^2 numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenplex.operators.density import codebook_matrix
from lumenplex.operators.lineage import cut
from lumenplex.operators.tiled import blurred, kernel

#: A tile's own width by the number of axes.
INNER = {1: 2048, 2: 48, 3: 16}
LEAST_GAIN, LEAST_STEP, BACK, TRIES = 1e-10, 1e-10, 0.9, 10


def phased(book: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Codes (rounds, channels, J) with the share `left` (channels) of each round's signal carried into the next."""
    out = book.astype(float).copy()
    for r in range(1, len(out)):
        out[r] += left[:, None] * out[r - 1]
    return out


def nonnegative(gamma: np.ndarray, phi: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """The y >= 0 that makes y gamma y / 2 - phi y least: an active set of free entries, a few numbers wide."""
    n = len(phi)
    gamma = gamma + ridge * np.eye(n)
    y, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n + 10):
        slope = phi - gamma @ y
        slope[free] = -np.inf
        if slope.max() <= 1e-12 * max(np.abs(phi).max(), 1e-300):
            break
        free[slope.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.solve(gamma[np.ix_(free, free)], phi[free])
            if (trial[free] > 0).all():
                y = trial
                break
            low = free & (trial <= 0)
            y = y + (y[low] / np.maximum(y[low] - trial[low], 1e-300)).min() * (trial - y)
            free &= y > 1e-15
            y[~free] = 0
            if not free.any():
                break
    return y


def blur_all(x: np.ndarray, sigmas: list[int]) -> np.ndarray:
    """x (*axes, rest) blurred along its first axes, zeros beyond."""
    for i, s in enumerate(sigmas):
        x = blurred(x, i, kernel(s))
    return x


def gains_from(with_left: np.ndarray, own: np.ndarray, gains: np.ndarray, mixing: np.ndarray) -> np.ndarray:
    """Each frame's best gain, from the sums of `Model._products`; as it was where its codes show nothing."""
    up, down = np.einsum("ck,rck->rc", mixing, with_left), np.einsum("ck,rkl,cl->rc", mixing, own, mixing)
    good = down > LEAST_GAIN
    return np.maximum(np.where(good, up / np.where(good, down, 1), gains), LEAST_GAIN)


def mixing_from(with_left: np.ndarray, own: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Each channel's best non-negative mix of the channels' codes."""
    each = [(g, with_left[:, c]) for c, g in enumerate(gains.T)]
    return np.array([nonnegative(np.einsum("r,rkl->kl", g**2, own), np.einsum("r,rk->k", g, left)) for g, left in each])


@dataclass(frozen=True)
class Frame:
    """How a stack is cut: sizes, tiles' own widths and blur levels by axis."""

    axes: tuple[str, ...]
    sizes: tuple[int, ...]
    inner: tuple[int, ...]
    sigmas: tuple[int, ...]

    def own(self, tile: tuple[int, ...]) -> list[tuple[int, int]]:
        return [(k * w, min((k + 1) * w, n)) for k, w, n in zip(tile, self.inner, self.sizes)]

    def look(self, tile: tuple[int, ...], times: int) -> list[tuple[int, int]]:
        """The tile and what lies within `times` the blur's reach, inside the stack."""
        return [(max(lo - 3 * s * times, 0), min(hi + 3 * s * times, n)) for (lo, hi), s, n in zip(self.own(tile), self.sigmas, self.sizes)]

    def lookers(self, tile: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Tiles whose look of two reaches holds some of this tile's voxels."""
        spans = []
        for (lo, hi), w, s, n in zip(self.own(tile), self.inner, self.sigmas, self.sizes):
            spans.append(range(max(lo - 6 * s, 0) // w, min(hi - 1 + 6 * s, n - 1) // w + 1))
        return itertools.product(*spans)

    def counts(self) -> list[int]:
        return [-(-n // w) for n, w in zip(self.sizes, self.inner)]


def _shape(box: list[tuple[int, int]]) -> tuple[int, ...]:
    return tuple(hi - lo for lo, hi in box)


def _within(box: list[tuple[int, int]], outer: list[tuple[int, int]]) -> tuple[slice, ...]:
    return tuple(slice(lo - o, hi - o) for (lo, hi), (o, _) in zip(box, outer))


def _meet(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(max(x, u), min(y, v)) for (x, y), (u, v) in zip(a, b)]


@dataclass
class Model:
    """Parameters and tiles of a fit; `update` changes one of them at a time."""

    frame: Frame
    tiles: DataFrame
    names: list
    book: np.ndarray  # rounds, channels, codes
    penalty: float
    gains: np.ndarray = None
    mixing: np.ndarray = None
    offsets: np.ndarray = None
    losses: list[float] = field(default_factory=list)
    _sums: tuple | None = None

    def __post_init__(self) -> None:
        r, c, _ = self.book.shape
        self.gains, self.mixing, self.offsets = np.ones((r, c)), np.eye(c), np.zeros(r * c)

    @property
    def loads(self) -> np.ndarray:
        """Frames by codes: what one unit of each code's density adds to each frame."""
        mixed = np.einsum("rc,ck,rkj->rcj", self.gains, self.mixing, self.book)
        return mixed.reshape(-1, mixed.shape[-1])

    def _shown(self) -> Callable[[np.ndarray], np.ndarray]:
        """From blurred codes (..., frames before gains and mixing) to frames."""
        gains, mixing, (r, c, _) = self.gains, self.mixing, self.book.shape

        def shown(z: np.ndarray) -> np.ndarray:
            return (np.einsum("mrk,ck->mrc", z.reshape(-1, r, c), mixing) * gains).reshape(z.shape)

        return shown

    def _summed(self, df: DataFrame, of: Callable[[pd.Series], np.ndarray], width: int) -> np.ndarray:
        """Sums over all tiles of the `width` numbers that `of` makes of a row."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    total += of(row)
            yield pd.DataFrame({"x": [total]})

        each = df.mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("i", "v"))
        got = {r["i"]: r["v"] for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # `width` numbers
        return np.array([got.get(i, 0.0) for i in range(width)])

    def _mapped(self, fn: Callable[[tuple], dict]) -> DataFrame:
        """Tiles with some columns made anew."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = [fn(row) for row in pdf.itertuples(index=False)]
                yield pdf.assign(**{k: [m[k] for m in made] for k in made[0]}) if made else pdf

        return self.tiles.mapInPandas(run, self.tiles.schema)

    def update(self, what: str) -> None:
        """F, gains, mixing, a or b."""
        {"F": self._update_densities, "gains": self._update_gains, "mixing": self._update_mixing, "a": self._update_voxels, "b": self._update_frames}[what]()

    def _wide(self) -> DataFrame:
        """Tiles with what their neighbours hold of e (what is left over) and f, written."""
        frame, n, j = self.frame, self.book.shape[0] * self.book.shape[1], len(self.names)
        shown, offsets, penalty, d = self._shown(), self.offsets, self.penalty, len(self.frame.axes)
        keys = [f"t{i}" for i in range(d)]
        sent = ", ".join(f"{k} int" for k in keys) + ", lo array<int>, hi array<int>, e array<double>, fi array<int>, fv array<double>, x array<double>, a array<double>"

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    tile = tuple(row[:d])
                    own = frame.own(tile)
                    x, a = np.asarray(row.x, float).reshape(*_shape(own), n), np.asarray(row.a, float).reshape(_shape(own))
                    e = x - a[..., None] - offsets - penalty - shown(np.asarray(row.z, float).reshape(x.shape))
                    f = np.zeros((*_shape(own), j))
                    f.ravel()[np.asarray(row.fi, int)] = row.fv
                    rows = []
                    for to in frame.lookers(tile):
                        near = _meet(own, frame.look(to, 2))
                        close = _meet(own, frame.look(to, 1))
                        wide = np.zeros((*_shape(near), j))
                        if all(lo < hi for lo, hi in close):
                            wide[_within(close, near)] = f[_within(close, own)]
                        at = np.flatnonzero(wide)
                        itself = to == tile
                        rows.append((*to, [lo for lo, _ in near], [hi for _, hi in near], e[_within(near, own)].ravel(), at.astype(np.int32), wide.ravel()[at], x.ravel() if itself else [], a.ravel() if itself else []))
                    yield pd.DataFrame(rows, columns=[*keys, "lo", "hi", "e", "fi", "fv", "x", "a"])

        def receive(pdf: pd.DataFrame) -> pd.DataFrame:
            tile = tuple(int(pdf[k].iloc[0]) for k in keys)
            far, near = frame.look(tile, 2), frame.look(tile, 1)
            e, f, own = np.zeros((*_shape(far), n)), np.zeros((*_shape(near), j)), None
            for row in pdf.itertuples(index=False):
                box = list(zip(row.lo, row.hi))
                e[_within(box, far)] = np.asarray(row.e, float).reshape(*_shape(box), n)
                part = np.zeros((*_shape(box), j))
                part.ravel()[np.asarray(row.fi, int)] = row.fv
                close = _meet(box, near)
                if all(lo < hi for lo, hi in close):
                    f[_within(close, near)] = part[_within(close, box)]
                own = row if len(row.x) else own
            at = np.flatnonzero(f)
            return pd.DataFrame([(*tile, own.x, own.a, e.ravel(), at.astype(np.int32), f.ravel()[at])], columns=[*keys, "x", "a", "e", "fi", "fv"])

        schema = ", ".join(f"{k} int" for k in keys) + ", x array<double>, a array<double>, e array<double>, fi array<int>, fv array<double>"
        return cut(self.tiles.mapInPandas(send, sent).groupBy(*keys).applyInPandas(receive, schema))

    def _update_densities(self) -> None:
        frame, n, j, d = self.frame, self.book.shape[0] * self.book.shape[1], len(self.names), len(self.frame.axes)
        loads, sigmas = self.loads, list(self.frame.sigmas)
        codes, columns = self.book.reshape(n, j), self.tiles.columns
        wide = self._wide()

        def opened(row) -> tuple:
            """own, what is left over there, densities and direction within one reach."""
            tile = tuple(row[:d])
            own, near, far = frame.own(tile), frame.look(tile, 1), frame.look(tile, 2)
            e = np.asarray(row.e, float).reshape(*_shape(far), n)
            f = np.zeros((*_shape(near), j))
            f.ravel()[np.asarray(row.fi, int)] = row.fv
            down = blur_all(e, sigmas)[_within(near, far)] @ loads
            down[(f <= 0) & (down <= 0)] = 0  # nothing below zero
            return _within(own, near), e[_within(own, far)], f, down

        def seen(y: np.ndarray, own: tuple, of: np.ndarray) -> np.ndarray:
            return blur_all(y @ of.T, sigmas)[own]

        def line(row) -> np.ndarray:
            own, e, _, down = opened(row)
            along = seen(down, own, loads)
            return np.array([(down[own] ** 2).sum(), (e * along).sum(), (along**2).sum()])

        size, slope, curve = self._summed(wide, line, 3)
        rate = 0.0
        if size > LEAST_STEP and curve > 0:

            def trial(rates: list[float]) -> np.ndarray:
                def losses(row) -> np.ndarray:
                    own, e, f, down = opened(row)
                    out = []
                    for r in rates:
                        more = seen(np.maximum(f + r * down, 0) - f, own, loads)
                        out.append(0.5 * (more**2).sum() - (e * more).sum())
                    return np.array(out)

                return self._summed(wide, losses, len(rates))

            first = slope / curve
            rates = [first]
            if trial(rates)[0] >= 0:
                rates = [first * BACK**i for i in range(1, TRIES)]
                better = np.flatnonzero(trial(rates) < 0)
                rates = [rates[better[0]]] if len(better) else [0.0]
            rate = rates[0]

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for row in pdf.itertuples(index=False):
                    own, _, f, down = opened(row)
                    f = np.maximum(f + rate * down, 0) if rate else f
                    inside = f[own].ravel()
                    at = np.flatnonzero(inside)
                    rows.append((*row[:d], row.x, row.a, seen(f, own, codes).ravel(), at.astype(np.int32), inside[at]))
                yield pd.DataFrame(rows, columns=columns)

        self.tiles = cut(wide.mapInPandas(step, self.tiles.schema))
        self._sums = None

    def _products(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over voxels, by round: left-over times blurred codes (r, c, k), and blurred codes' own products (r, k, k)."""
        if self._sums is None:
            (r, c, _), offsets, penalty = self.book.shape, self.offsets, self.penalty

            def of(row) -> np.ndarray:
                x = np.asarray(row.x, float).reshape(-1, r * c) - np.asarray(row.a, float)[:, None] - offsets - penalty
                x, z = x.reshape(-1, r, c), np.asarray(row.z, float).reshape(-1, r, c)
                return np.concatenate((np.einsum("mrc,mrk->rck", x, z).ravel(), np.einsum("mrc,mrk->rck", z, z).ravel()))

            both = self._summed(self.tiles, of, 2 * r * c * c)
            self._sums = tuple(s.reshape(r, c, c) for s in np.split(both, 2))
        return self._sums

    def _update_gains(self) -> None:
        self.gains = gains_from(*self._products(), self.gains, self.mixing)

    def _update_mixing(self) -> None:
        self.mixing = mixing_from(*self._products(), self.gains)

    def _update_voxels(self) -> None:
        shown, offsets, n = self._shown(), self.offsets, len(self.offsets)

        def of(row) -> dict:
            left = np.asarray(row.x, float).reshape(-1, n) - offsets - shown(np.asarray(row.z, float).reshape(-1, n))
            return {"a": np.maximum(left.mean(1), 0)}

        self.tiles = self._mapped(of)
        self._sums = None

    def _rests(self) -> np.ndarray:
        """By frame the sums of what is left without frames' backgrounds, of its squares and of what codes show; the number of voxels."""
        shown, n = self._shown(), len(self.offsets)

        def of(row) -> np.ndarray:
            u = shown(np.asarray(row.z, float).reshape(-1, n))
            left = np.asarray(row.x, float).reshape(-1, n) - np.asarray(row.a, float)[:, None] - u
            return np.concatenate((left.sum(0), (left**2).sum(0), u.sum(0), [len(u)]))

        return self._summed(self.tiles, of, 3 * n + 1)

    def _update_frames(self) -> None:
        n, s = len(self.offsets), self._rests()
        self.offsets = np.maximum(s[:n] / max(s[-1], 1), 0)
        self._sums = None

    def loss(self) -> float:
        n, s = len(self.offsets), self._rests()
        b = self.offsets
        return float(0.5 * (s[n : 2 * n] - 2 * b * s[:n] + s[-1] * b * b).sum() + self.penalty * s[2 * n : 3 * n].sum())

    def _voxelwise(self, of: Callable, schema: str) -> DataFrame:
        """Rows (axes and more) that `of` makes of a tile's row, its own box's places given as columns."""
        frame, d = self.frame, len(self.frame.axes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    own = frame.own(tuple(row[:d]))
                    at, more = of(row)
                    places = np.unravel_index(at, _shape(own))
                    yield pd.DataFrame({a: p.astype(np.int32) + lo for a, p, (lo, _) in zip(frame.axes, places, own)} | more)

        return self.tiles.mapInPandas(run, ", ".join(f"{a} int" for a in frame.axes) + ", " + schema)

    def density(self) -> DataFrame:
        """axes, j, v: densities scaled by their code's total load; zeros left out."""
        j, load, names = len(self.names), self.loads.sum(0), np.array(self.names)

        def of(row) -> tuple[np.ndarray, dict]:
            at, v = np.asarray(row.fi, int), np.asarray(row.fv, float)
            keep = v > 0
            return at[keep] // j, {"j": names[at[keep] % j], "v": v[keep] * load[at[keep] % j]}

        return self._voxelwise(of, "j int, v double")

    def reconstruction(self, backgrounds: bool = True) -> DataFrame:
        """LONG with v: what codes show through blur, gains and mixing, and with the backgrounds if asked for."""
        shown, offsets, n = self._shown(), self.offsets, len(self.offsets)

        def of(row) -> tuple[np.ndarray, dict]:
            u = shown(np.asarray(row.z, float).reshape(-1, n))
            if backgrounds:
                u = u + np.asarray(row.a, float)[:, None] + offsets
            m = np.repeat(np.arange(len(u)), n)
            return m, {"n": np.tile(np.arange(n, dtype=np.int32), len(u)), "v": u.ravel()}

        return self._voxelwise(of, "n int, v double").select("n", *self.frame.axes, "v")

    def backgrounds(self) -> DataFrame:
        """axes, n, v: the voxel's and the frame's background."""
        offsets = self.offsets
        both = F.transform(F.array(*map(F.lit, offsets.tolist())), lambda b: b + F.col("v"))
        own = self._voxelwise(lambda row: (np.arange(len(row.a)), {"v": np.asarray(row.a, float)}), "v double")
        return own.select(F.posexplode(both).alias("n", "v"), *self.frame.axes).select("n", *self.frame.axes, "v")


def model(stack: DataFrame, codes: DataFrame, sizes: dict[str, int], rounds: int = 1, sigmas: dict[str, int] | None = None, penalty: float = 0.0, inner: dict[str, int] | None = None, left: list[float] | None = None) -> Model:
    """A model of a LONG stack before its first step: no densities, gains 1, no mixing, no backgrounds.

    left: the share of each channel's signal that a round leaves to the next. Absent voxels are zeros.
    """
    names, matrix = codebook_matrix(codes)
    n = len(matrix)
    if n % rounds:
        raise ValueError(f"{n} frames in {rounds} rounds")
    book = matrix.reshape(rounds, n // rounds, len(names))
    if left is not None:
        book = phased(book, np.asarray(left, float))
    axes = tuple(sizes)
    width = {a: (inner or {}).get(a, INNER[len(axes)]) for a in axes}
    frame = Frame(axes, tuple(sizes.values()), tuple(width.values()), tuple((sigmas or {}).get(a, 0) for a in axes))
    keys = [f"t{i}" for i in range(len(axes))]
    own = stack.where(" and ".join(f"{a} between 0 and {s - 1}" for a, s in sizes.items()) + f" and n between 0 and {n - 1}")
    dealt = own.select(*[F.floor(F.col(a) / width[a]).cast("int").alias(k) for a, k in zip(axes, keys)], "n", *axes, F.col("v").cast("double").alias("v"))
    # A row for every tile, so that none is missing where the stack is empty.
    count, at, every = 1, F.col("id"), []
    for k, c in zip(keys, frame.counts()):
        every.append((F.floor(at / count) % c).cast("int").alias(k))
        count *= c
    nothing = [F.lit(None).cast("int").alias(x) for x in ("n", *axes)]
    dealt = dealt.unionByName(stack.sparkSession.range(count).select(*every, *nothing, F.lit(None).cast("double").alias("v")))

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = tuple(int(pdf[k].iloc[0]) for k in keys)
        box = frame.own(tile)
        x = np.zeros((*_shape(box), n))
        pdf = pdf[pdf["v"].notna() & pdf["n"].notna()]
        np.add.at(x, (*[pdf[a].to_numpy(int) - lo for a, (lo, _) in zip(axes, box)], pdf["n"].to_numpy(int)), pdf["v"].to_numpy(float))
        return pd.DataFrame([(*tile, x.ravel(), np.zeros(x.size // n), np.zeros(x.size), np.empty(0, np.int32), np.empty(0))], columns=[*keys, "x", "a", "z", "fi", "fv"])

    schema = ", ".join(f"{k} int" for k in keys) + ", x array<double>, a array<double>, z array<double>, fi array<int>, fv array<double>"
    return Model(frame, cut(dealt.groupBy(*keys).applyInPandas(filled, schema)), names, book, penalty)


def fit(stack: DataFrame, codes: DataFrame, sizes: dict[str, int], iterations: int = 100, rounds: int = 1, sigmas: dict[str, int] | None = None, penalty: float = 0.0, gains: bool = True, mixing: bool = False, inner: dict[str, int] | None = None, left: list[float] | None = None) -> Model:
    """Per iteration densities, then gains, mixing, voxels' and frames' backgrounds; what isn't learnt stays."""
    m = model(stack, codes, sizes, rounds, sigmas, penalty, inner, left)
    for _ in range(iterations):
        for what in ["F", *["gains"] * gains, *["mixing"] * mixing, "a", "b"]:
            m.update(what)
    return m


def fit_block(x: np.ndarray, book: np.ndarray, sigmas: list[int], penalty: float, plan: list[str]) -> np.ndarray:
    """A tile's scaled densities (*axes, codes) from its own voxels x (*axes, frames) alone: the updates of plan, in order."""
    space, (r, c, j) = x.shape[:-1], book.shape
    codes = book.reshape(r * c, j)
    f, a, b, gains, mixing = np.zeros((*space, j)), np.zeros(space), np.zeros(r * c), np.ones((r, c)), np.eye(c)
    z = np.zeros(x.shape)
    for what in plan:
        loads = np.einsum("rc,ck,rkj->rcj", gains, mixing, book).reshape(r * c, j)
        allowed = x - a[..., None] - b - penalty
        shown = (np.einsum("mrk,ck->mrc", z.reshape(-1, r, c), mixing) * gains).reshape(x.shape)
        if what == "F":
            e = allowed - shown
            down = blur_all(e, sigmas) @ loads
            down[(f <= 0) & (down <= 0)] = 0
            along = blur_all(down @ loads.T, sigmas)
            curve = (along**2).sum()
            if (down**2).sum() > LEAST_STEP and curve > 0:
                for i in range(TRIES):
                    y = np.maximum(f + (e * along).sum() / curve * BACK**i * down, 0)
                    more = blur_all((y - f) @ loads.T, sigmas)
                    if 0.5 * (more**2).sum() < (e * more).sum():
                        f = y
                        break
            z = blur_all(f @ codes.T, sigmas)
        elif what == "a":
            a = np.maximum((x - shown - b).mean(-1), 0)
        elif what == "b":
            b = np.maximum((x - shown - a[..., None]).reshape(-1, r * c).mean(0), 0)
        else:
            zs, left = z.reshape(-1, r, c), allowed.reshape(-1, r, c)
            with_left, own = np.einsum("mrc,mrk->rck", left, zs), np.einsum("mrc,mrk->rck", zs, zs)
            if what == "gains":
                gains = gains_from(with_left, own, gains, mixing)
            else:
                mixing = mixing_from(with_left, own, gains)
    return f * np.einsum("rc,ck,rkj->j", gains, mixing, book)
