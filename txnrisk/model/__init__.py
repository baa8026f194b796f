"""Model preparation, training, evaluation and scoring on Spark ML."""
