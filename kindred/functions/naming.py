"""Key and suffix strings of models, and the JSON form of a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names users see in keys and in stored paths.
ADJUSTED_SUFFIX = "_adjusted"
METHOD_FOLDERS = {"separate_grid": "gridSearch"}


def adjusted_suffix(use_adjusted: Column) -> Column:
    return F.when(use_adjusted, F.lit(ADJUSTED_SUFFIX)).otherwise(F.lit(""))


def model_key(model: Column, classifier: Column, use_adjusted: Column) -> Column:
    return F.concat(model, F.lit("_"), classifier, adjusted_suffix(use_adjusted))


def method_folder(params: Column) -> Column:
    folder = params
    for name, value in METHOD_FOLDERS.items():
        folder = F.when(params == name, F.lit(value)).otherwise(folder)
    return folder


def prediction_json(label: Column, model: Column, classifier: Column) -> Column:
    return F.to_json(F.struct(label.alias("grupo_predicho"), model.alias("modelo"),
                              classifier.alias("clasificador")))
