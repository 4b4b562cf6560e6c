"""A dataset directory: one Parquet table per member, and one row of metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = ("stack", "codebook", "rolonies", "voxels", "translations", "mesh_vertices", "mesh_faces")


@dataclass(frozen=True)
class Bundle:
    """An annotated dataset. Only stack, codebook and rolonies are required; nothing is read until it is used."""

    stack: DataFrame
    codebook: DataFrame
    rolonies: DataFrame
    voxels: DataFrame | None = None
    translations: DataFrame | None = None
    mesh_vertices: DataFrame | None = None
    mesh_faces: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bundle:
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        held = set(meta.pop("members").split(","))
        return Bundle(**{m: spark.read.parquet(f"{path}/{m}") for m in MEMBERS if m in held}, meta=meta)

    def write(self, path: str) -> None:
        """Every member, the metadata last: a directory with metadata is complete."""
        held = [m for m in MEMBERS if getattr(self, m) is not None]
        for m in held:
            getattr(self, m).write.parquet(f"{path}/{m}")
        spark = self.stack.sparkSession
        one = {"description": "", "name": "", "units": "", "version": 1} | self.meta | {"members": ",".join(held)}
        spark.range(1).select(*[F.lit(v).alias(k) for k, v in one.items()]).coalesce(1).write.parquet(f"{path}/meta")

    def labelled(self) -> DataFrame:
        """rolonies with a status ('good' unless given) and remarks."""
        r = self.rolonies
        for name, default in (("status", "good"), ("remarks", "")):
            r = r.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in r.columns else F.lit(default))
        return r

    def counts(self) -> DataFrame:
        """n_spots, n_good_spots and n_genes, in one row."""
        genes = self.codebook.agg(F.countDistinct("j").alias("n_genes"))
        return self.labelled().agg(F.count("*").alias("n_spots"), F.count_if(F.col("status") == "good").alias("n_good_spots")).crossJoin(genes)

    def with_more(self, more: DataFrame) -> Bundle:
        """The bundle with rolonies appended; every other member stays."""
        return replace(self, rolonies=self.labelled().unionByName(replace(self, rolonies=more).labelled(), allowMissingColumns=True))

    def downsample(self, d: int, axes: tuple[str, ...] = ("m0", "m1", "m2")) -> Bundle:
        """Frames averaged over blocks of d voxels along the axes; rolonies move with them."""
        from lumenplex.operators.grids import block_mean

        own = [a for a in axes if a in self.stack.columns]
        moved = self.rolonies.withColumns({a: F.floor(F.col(a) / d).cast("int") for a in own if a in self.rolonies.columns})
        return replace(self, stack=block_mean(self.stack, dict.fromkeys(own, d), trim=False), rolonies=moved)
