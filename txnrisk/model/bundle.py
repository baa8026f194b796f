"""A trained model with all that serving needs, saved as one folder of Spark tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.model import encode
from txnrisk.model.importance import node_importance
from txnrisk.model.score import score, with_decision
from txnrisk.operators.asof import PROFILE_KEYS, Profiles


class Bundle(NamedTuple):
    model: PipelineModel
    encoders: DataFrame
    features: list[str]
    categories: list[str]
    threshold: float
    pr_auc: float | None
    report: DataFrame | None
    importance: DataFrame | None
    curve: DataFrame | None = None
    scales: dict[str, float] | None = None
    profiles: Profiles | None = None

    def require(self, df: DataFrame) -> None:
        """Raise if the input lacks a feature: for paths that derive all of them, where a gap is a fault and not a missing value."""
        absent = [c for c in self.features if c not in df.columns]
        if absent:
            raise ValueError(f"the model's features are not in the input: {absent}")

    def vector(self, df: DataFrame) -> DataFrame:
        """Serving input: encoded categories, features in order, unreadable or missing values as the sentinel.

        The same code prepares training rows, so training and serving cannot drift apart.
        """
        kept = df.select("*")
        coded = encode.apply_encoders(df, self.encoders, self.categories)
        inputs = encode.numeric_inputs(coded, self.features)
        with_vector = VectorAssembler(inputCols=self.features, outputCol="features").transform(inputs)
        return with_vector.select(*[c for c in kept.columns if c not in self.features], *self.features, "features")

    def score(self, df: DataFrame) -> DataFrame:
        """Encoded input columns plus ``score``."""
        return score(self.vector(df), self.model).drop("features")

    def score_and_decide(self, df: DataFrame) -> DataFrame:
        return with_decision(self.score(df), self.threshold)


def save_bundle(bundle: Bundle, path: str) -> None:
    """``model/`` by Spark ML, everything else as small Parquet tables below ``path``."""
    spark = bundle.encoders.sparkSession
    bundle.model.write().overwrite().save(f"{path}/model")
    bundle.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
    names = [(i, c, c in bundle.categories) for i, c in enumerate(bundle.features)]
    spark.createDataFrame(names, "position int, feature string, is_category boolean").write.mode("overwrite").parquet(f"{path}/features")
    extra = [c for c in bundle.categories if c not in bundle.features]
    if extra:
        raise ValueError(f"categories outside the feature list: {extra}")
    row = [(float(bundle.threshold), bundle.pr_auc)]
    spark.createDataFrame(row, "threshold double, pr_auc double").write.mode("overwrite").parquet(f"{path}/threshold")
    scales = list((bundle.scales or {}).items())
    spark.createDataFrame(scales, "signal string, scale double").write.mode("overwrite").parquet(f"{path}/scales")
    if bundle.profiles is not None:
        for name in PROFILE_KEYS:
            getattr(bundle.profiles, name).write.mode("overwrite").parquet(f"{path}/profiles/{name}")
    for name in ("report", "curve"):
        table = getattr(bundle, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    if bundle.importance is not None:
        # Gain and split counts come from the stored trees; the effect, if measured, from the table.
        stages = [s for s in bundle.model.stages if hasattr(s, "trees")]
        place = bundle.model.stages.index(stages[0])
        nodes = node_importance(spark, f"{path}/model/stages/{place}_{stages[0].uid}", bundle.features)
        effect = bundle.importance if "effect" in bundle.importance.columns else bundle.importance.withColumn("effect", F.lit(None).cast("double"))
        nodes.join(effect.select("feature", "effect"), "feature", "left").write.mode("overwrite").parquet(f"{path}/importance")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    limits = spark.read.parquet(f"{path}/threshold").first()

    def optional(name: str) -> DataFrame | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.parquet(f"{path}/{name}") if exists else None

    scales = {r["signal"]: r["scale"] for r in spark.read.parquet(f"{path}/scales").collect()} or None
    profiles = {name: optional(f"profiles/{name}") for name in PROFILE_KEYS}
    return Bundle(
        PipelineModel.load(f"{path}/model"),
        spark.read.parquet(f"{path}/encoders"),
        [r["feature"] for r in names],
        [r["feature"] for r in names if r["is_category"]],
        limits["threshold"],
        limits["pr_auc"],
        optional("report"),
        optional("importance"),
        optional("curve"),
        scales,
        Profiles(**profiles, scales=scales) if all(profiles.values()) else None,
    )
