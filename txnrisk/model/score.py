"""Model output as a plain column."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, model, name: str = "score") -> DataFrame:
    """Probability of the positive class as a double column; the learner's own columns are dropped."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def with_decision(df: DataFrame, threshold: float, score_column: str = "score") -> DataFrame:
    """Scored holdout output: FraudScore and the right-closed Decision next to the input columns."""
    from txnrisk.operators.decide import decide_cut

    return df.withColumn("FraudScore", F.col(score_column)).withColumn("Decision", decide_cut(score_column, threshold))
