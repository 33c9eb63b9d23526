"""Spark-native tabular feature engineering and model evaluation.

Datasets and their cross-validation folds are rows of ordinary DataFrames
(``dataset, fold, split, row_id, <features>, target``).  Operators are plain
functions over DataFrames; whatever has to be learned from training rows is a
small state DataFrame that is joined (or inlined) back when it is applied.
"""

__version__ = "0.1.0"
