"""Quality classifier by compression: does a text shrink more beside good text or beside bad text?

Two zstandard dictionaries are built from good and from bad labelled text, whole texts one after the other; the window
is as long as a dictionary, so nothing of it is out of reach. A whole text is compressed in chunks with each; the
normalised size difference goes through a logistic calibration to a score.

Fitting uses a bounded sample: the SAMPLE labelled rows of each class with the least hash of their id, in that order,
and of these whole texts as long as they fit SAMPLE_BYTES. The calibration sees every sampled text, whole and inside
tasks, beside dictionaries that were built without its fold. Scoring covers every text whole.

Odd input: a null text is empty; empty texts get the calibrated score of equal sizes; labels that are
null, of ids without a document or contradictory for one id are left out; without labels of both classes the score
is the constant share of good ones (0.5 without any); repeated rows are scored each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import InitVar, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenplex.llm.common import written

#: Bounds of the labelled sample: rows of a class, and bytes of their texts, which are taken whole or not at all.
SAMPLE, SAMPLE_BYTES = 1500, 8_000_000
FOLDS, TASKS = 4, 16
CHUNK, LEVEL = 1024, 12
THRESHOLD = 0.3


def _compressor(dictionary: bytes):
    """A compressor whose window holds the whole dictionary and a chunk."""
    import zstandard

    size = len(dictionary) + CHUNK
    shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=size, window_log=max(size.bit_length(), 10), write_content_size=False, write_checksum=False, write_dict_id=False)
    ready = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(dict_data=ready, compression_params=shape)


@dataclass
class Compressors:
    """The two dictionaries, ready to compress; the library copies them, so the given ones aren't kept."""

    good: InitVar[bytes]
    bad: InitVar[bytes]

    def __post_init__(self, good: bytes, bad: bytes) -> None:
        self.pair = [_compressor(raw) for raw in (good, bad)]

    def difference(self, text: str | None) -> float:
        """(size with good - size with bad) / size of the text, all in bytes."""
        return self.difference_of(_raw(text))

    def difference_of(self, raw: bytes) -> float:
        if not raw:
            return 0.0
        good, bad = (c.compress for c in self.pair)
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        g, b = sum(len(good(x)) for x in chunks), sum(len(bad(x)) for x in chunks)
        return (g - b) / len(raw)


@dataclass(frozen=True)
class Model:
    """Dictionaries (of SAMPLE_BYTES at most, and line ends) and calibration; it goes to the tasks packed, with their code."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def packed(self) -> tuple[bytes, bytes, float, float]:
        """The dictionaries compressed, so that a worker holds them whole in its compressors alone."""
        import zstandard

        return zstandard.compress(self.good), zstandard.compress(self.bad), self.slope, self.intercept

    @classmethod
    def unpacked(cls, good: bytes, bad: bytes, slope: float, intercept: float) -> Model:
        import zstandard

        return cls(zstandard.decompress(good), zstandard.decompress(bad), slope, intercept)

    def scorer(self):
        """The score of a text; it doesn't hold the model."""
        compressors, slope, intercept = Compressors(self.good, self.bad), self.slope, self.intercept

        def score(text: str | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(slope * compressors.difference(text) + intercept, -30, 30))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (x, y), slightly ridged."""
    mu, sd = x.mean(), max(x.std(), 1e-6)
    a = np.c_[(x - mu) / sd, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w += np.linalg.solve(curve, a.T @ (y - p) - 1e-2 * w)
    return float(w[0] / sd), float(w[1] - w[0] * mu / sd)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(_raw(t.as_py())) for t in b.column("t")], pa.int64())], ["id", "size"])


def _dictionary(texts: list[bytes]) -> bytes:
    return b"\n".join(texts) or b"\n" * 8


def _measured(sample):
    """Size differences of sampled texts beside the dictionaries without their fold; a task takes a share of one fold.

    sample: a broadcast list of (class, fold, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                fold, share = task % FOLDS, task // FOLDS
                compressors = Compressors(*(_dictionary([t for c, f, t in sample.value if c == y and f != fold]) for y in (1, 0)))
                own = [i for i, (_, f, _) in enumerate(sample.value) if f == fold][share :: TASKS // FOLDS]
                found = [compressors.difference_of(sample.value[i][2]) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.float64())], ["i", "x"])

    return run


def _fitting(sized: list[tuple]) -> list:
    """The ids, in order, whose texts fit what those before them leave of SAMPLE_BYTES."""
    out, left = [], SAMPLE_BYTES
    for i, n in sized:
        if n <= left:
            out.append(i)
            left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from labelled rows only; labels: doc_id and a label 0 or 1."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    order = F.xxhash64("id", F.lit(17))
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "id").limit(SAMPLE).collect()]  # 2 * SAMPLE at most
    label_of = {r["id"]: r["y"] for r in ids}
    share = float(np.mean([*label_of.values()])) if label_of else 0.5
    sizes = {}
    if label_of:
        body = F.col(f"`{text}`")
        wanted = docs.where(F.col(f"`{doc_id}`").isin([*label_of]) & body.isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), body.alias("t"))
        sample = written(wanted.groupBy("id").agg(F.min("t").alias("t")).repartition(TASKS, "id"), "sample")
        kind = wanted.schema["id"].dataType.simpleString()
        sizes = {r["id"]: r["size"] for r in sample.mapInArrow(_sized, f"id {kind}, size long").collect()}
    by = {y: _fitting([(r["id"], sizes[r["id"]]) for r in ids if r["y"] == y and sizes.get(r["id"])]) for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        logit = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return Model(b"\n" * 8, b"\n" * 8, 0.0, logit)
    text_of = {r["id"]: _raw(r["t"]) for r in sample.where(F.col("id").isin(by[0] + by[1])).collect()}  # 2 * SAMPLE_BYTES at most
    chosen = [(y, nth % FOLDS, text_of[i]) for y in (0, 1) for nth, i in enumerate(by[y])]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chosen)
    found = spark.range(0, TASKS, 1, TASKS).mapInArrow(_measured(shared), "i long, x double").collect()
    x_of = {r["i"]: r["x"] for r in found}
    good, bad = (_dictionary([t for c, _, t in chosen if c == y]) for y in (1, 0))
    slope, intercept = _logistic(np.array([x_of[i] for i in range(len(chosen))]), np.array([float(y) for y, _, _ in chosen]))
    # The sample is balanced where labels aren't: the intercept goes back to the share of good ones among all.
    n = known.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in n}
    return Model(good, bad, slope, float(intercept + np.log(n[1] / n[0]) - np.log(len(by[1]) / len(by[0]))))


def training_rows(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: the others are held out."""
    return labels.where(~held_out(F.col(f"`{doc_id}`")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(packed: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model.unpacked(*packed).scorer()
        for b in batches:
            out = [score(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*b.schema.names[:-1], "__score"])

    return run


def score_texts(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The columns in keep and the score of each row's whole text."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("__score", DoubleType())])
    done = rows.mapInArrow(_scored(model.packed()), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("__score").alias(out))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows, with their own columns, whose texts score at least the threshold; only texts go to Python."""
    packed = model.packed()

    @F.arrow_udf(DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model.unpacked(*packed).scorer()
        for some in texts:
            yield pa.array([own(t.as_py()) for t in some], pa.float64())

    return docs.where(score(F.col(f"`{text}`")) >= threshold)
