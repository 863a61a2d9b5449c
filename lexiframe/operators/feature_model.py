"""Features of context rows as an ML estimator: fit on training rows, saved, loaded, applied to others."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators.dataset import ROW_KEYS
from lexiframe.operators.features import FeatureOptions, assemble_features, fit_pcas, fit_prototypes, pool_embeddings


class ContextFeatures(Estimator):
    """Learns prototypes from the embedding table and a PCA per pool from the rows it is fit on."""

    def __init__(
        self,
        options: FeatureOptions = FeatureOptions(),
        embeddings: DataFrame | None = None,
        ctx: str = "ctx",
        keys: Sequence[str] = ROW_KEYS,
    ):
        super().__init__()
        options.check(embeddings is not None)
        self.options, self.embeddings, self.ctx, self.keys = options, embeddings, ctx, tuple(keys)

    def _fit(self, dataset: DataFrame) -> ContextFeaturesModel:
        """The width of a context is the greatest of ``dataset``; no rows are an error."""
        prototypes, pca, kinds, width = None, {}, self._reduced(), F.max(F.size(self.ctx)).alias("width")
        if kinds:
            # All in one pass: rows may be dear to make, and their vectors take many times the room of the contexts.
            seen = Observation()
            pooled = dataset.observe(seen, width)
            for kind in kinds:
                pooled = pool_embeddings(pooled, self.embeddings, (kind,), self.ctx, self.keys)
            fits = fit_pcas(pooled, [f"{kind}_pooled" for kind in kinds], self.options.reduce_to)
            pca, length = {kind: fits[f"{kind}_pooled"] for kind in kinds}, seen.get["width"]
        else:
            length = dataset.agg(width).first()["width"]
        if length is None:
            raise ValueError("features are fit on at least one row")
        if self.options.prototypes:
            prototypes = fit_prototypes(self.embeddings, self.options.n_prototypes)
        return ContextFeaturesModel(self.options, self.embeddings, prototypes, pca, length, self.ctx, self.keys)

    def _reduced(self) -> list[str]:
        """The pools that lose components."""
        if self.options.reduce_to is None or not self.options.needs_embeddings:
            return []
        if self.options.reduce_to >= self.embeddings.select(F.size("vec")).first()[0]:
            return []
        wanted = {"mean": self.options.mean_pooled, "position": self.options.position_pooled, "max": self.options.max_pooled}
        return [kind for kind, on in wanted.items() if on]


class ContextFeaturesModel(Model, MLWritable, MLReadable):
    """Adds ``features`` to rows; ``names`` and ``categorical`` say what they are.

    Rows may have narrower contexts than those of the fit: they are padded on the left.
    """

    def __init__(
        self,
        options: FeatureOptions,
        embeddings: DataFrame | None,
        prototypes: np.ndarray | None,
        pca: dict[str, PipelineModel],
        length: int,
        ctx: str = "ctx",
        keys: Sequence[str] = ROW_KEYS,
    ):
        super().__init__()
        self.options, self.embeddings, self.prototypes, self.pca = options, embeddings, prototypes, pca
        self.length, self.ctx, self.keys = length, ctx, tuple(keys)

    def _assembled(self, rows: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        missing = F.array_repeat(F.lit(0), F.greatest(F.lit(self.length) - F.size(self.ctx), F.lit(0)))
        padded = rows.withColumn(self.ctx, F.slice(F.concat(missing, self.ctx), -self.length, self.length))
        return assemble_features(
            padded, self.options, self.embeddings, self.prototypes, self.pca, self.ctx, self.keys, self.length
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._assembled(dataset)[0]

    def _named(self, which: int) -> list[str]:
        spark = SparkSession.getActiveSession()
        fields = ", ".join([*(f"`{k}` long" for k in self.keys), f"`{self.ctx}` array<int>"])
        return self._assembled(spark.createDataFrame([], fields))[which]

    @property
    def names(self) -> list[str]:
        return self._named(1)

    @property
    def categorical(self) -> list[str]:
        return self._named(2)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ContextFeaturesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802  named by Spark
        model, spark = self.model, SparkSession.getActiveSession()
        facts = {"options": asdict(model.options), "length": model.length, "ctx": model.ctx, "keys": model.keys, "pca": list(model.pca)}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/settings")
        if model.embeddings is not None:
            model.embeddings.select("id", "vec").write.parquet(f"{path}/embeddings")
        if model.prototypes is not None:
            rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.prototypes)]
            spark.createDataFrame(rows, "place int, centre array<double>").coalesce(1).write.parquet(f"{path}/prototypes")
        for kind, fitted in model.pca.items():
            fitted.write().save(f"{path}/pca-{kind}")


class _Reader(MLReader):
    def load(self, path: str) -> ContextFeaturesModel:
        spark = SparkSession.getActiveSession()
        facts = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        options = FeatureOptions(**facts["options"])
        embeddings = spark.read.parquet(f"{path}/embeddings") if options.needs_embeddings else None
        prototypes = None
        if options.prototypes:
            rows = spark.read.parquet(f"{path}/prototypes").orderBy("place").collect()
            prototypes = np.array([r["centre"] for r in rows])
        pca = {kind: PipelineModel.load(f"{path}/pca-{kind}") for kind in facts["pca"]}
        return ContextFeaturesModel(options, embeddings, prototypes, pca, facts["length"], facts["ctx"], facts["keys"])
