"""Training rows for the next-component predictor: n-grams, observations, features.

Sequences: prog (key), pos (integers from 0), component. See operators.predictor for models.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.ordered import CHUNK_ROWS, dense_index, previous, ranked, running
from loomwork.operators.tagging import OTHER, component_name

START = "<START>"
# fixed values: features that describe the sample, not the data
BAD_FEATURES = ("num_rows_sampled",)


def add_extra_info(calls: DataFrame) -> DataFrame:
    """Add component_name and nargs."""
    return calls.withColumns(
        {"component_name": component_name(), "nargs": F.greatest(F.size("args"), F.lit(0))}
    )


def _padded(before: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(START), F.lit(n - 1) - F.size(before)), before)


PLACE = "__place"


def _placed(seqs: DataFrame, keys: list[str], order: str, dense: bool) -> DataFrame:
    return seqs.withColumn(PLACE, F.col(order)) if dense else ranked(seqs, keys, order, PLACE)


def ngrams(
    seqs: DataFrame, n: int, keys: list[str] | None = None, order: str = "pos",
    value: str = "component", chunk_rows: int = CHUNK_ROWS, dense: bool = False,
) -> DataFrame:
    """Add `ngram`: the n values that end at each row, padded with <START> on the left.

    dense=True says that `order` counts on without large gaps, as positions of a program do;
    otherwise rows get places by one sort first.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return seqs.withColumn("ngram", F.array(value))
    keys = keys or ["prog"]
    rows = previous(
        _placed(seqs, keys, order, dense), keys, PLACE, F.col(value), n - 1, "__before", chunk_rows
    )
    return rows.withColumn(
        "ngram", F.concat(_padded(F.col("__before"), n), F.array(value))
    ).drop("__before", PLACE)


def seq_unique_ngrams(
    seqs: DataFrame, n: int, keys: list[str] | None = None, order: str = "pos",
    value: str = "component", chunk_rows: int = CHUNK_ROWS, dense: bool = False,
) -> DataFrame:
    """As ngrams, over the sequence without consecutive repeats, aligned to every row."""
    keys = keys or ["prog"]
    near = previous(
        _placed(seqs, keys, order, dense), keys, PLACE, F.col(value), 1, "__last", chunk_rows
    )
    last = F.get("__last", F.lit(0))
    starts = (last.isNull() | (last != F.col(value))).cast("long")
    runs = running(
        near.withColumn("__start", starts).drop("__last"), keys, PLACE,
        sums={"__run": F.col("__start")}, chunk_rows=chunk_rows,
    ).drop(PLACE)
    heads = runs.filter("__start = 1").select(*keys, "__run", value)
    grams = ngrams(heads, n, keys, "__run", value, chunk_rows, dense=True)
    return runs.join(grams.select(*keys, "__run", "ngram"), [*keys, "__run"]).drop("__run", "__start")


def observations(
    progs: DataFrame, n: int, keys: list[str] | None = None, chunk_rows: int = CHUNK_ROWS,
    dense: bool = False,
) -> DataFrame:
    """Rows (keys..., pos, role, prev, component). Role O is dropped after the n-grams, so
    such calls still appear as context."""
    keys = keys or ["prog"]
    rows = seq_unique_ngrams(progs, n, keys, chunk_rows=chunk_rows, dense=dense)
    return rows.filter(F.col("tag") != OTHER).select(
        *keys, "pos", F.col("tag").alias("role"),
        F.slice("ngram", 1, n - 1).alias("prev") if n > 1
        else F.array().cast("array<string>").alias("prev"),
        "component",
    )


def clean_features(features: DataFrame) -> DataFrame:
    """Drop bookkeeping features and values that are NaN or infinite."""
    bad_value = F.col("num").isNotNull() & (F.isnan("num") | (F.abs("num") == math.inf))
    return features.filter(~F.col("feature").isin(*BAD_FEATURES) & ~bad_value)


def prefix_features(features: DataFrame, prefix: Column) -> DataFrame:
    return features.withColumn("feature", F.concat_ws("_", prefix, "feature"))


def feature_rows(
    obs: DataFrame, keys: list[str], arg_features: DataFrame | None = None
) -> DataFrame:
    """Long feature rows (keys..., feature, num, str) of the observations.

    arg_features has (keys..., arg, feature, num, str); without it only the previous
    components and the role are features.
    """
    none = F.lit(None).cast("double").alias("num")
    context = obs.select(
        *keys, F.posexplode("prev").alias("i", "str")
    ).select(*keys, F.concat(F.lit("prev_component_"), "i").alias("feature"), none, "str")
    role = obs.select(*keys, F.lit("role").alias("feature"), none, F.col("role").alias("str"))
    rows = context.unionByName(role)
    if arg_features is None:
        return rows
    cleaned = prefix_features(
        clean_features(arg_features), F.concat(F.lit("arg_"), F.col("arg"))
    )
    wanted = cleaned.join(obs.select(*keys), keys, "left_semi")
    return rows.unionByName(wanted.select(*keys, "feature", "num", "str"))


def encoded_names(rows: DataFrame) -> DataFrame:
    """(…, name, value): strings one-hot as feature=value, numbers as they are."""
    is_text = F.col("str").isNotNull()
    return rows.withColumns(
        {
            "name": F.when(is_text, F.concat_ws("=", "feature", "str")).otherwise(
                F.col("feature")),
            "value": F.when(is_text, F.lit(1.0)).otherwise(F.col("num")),
        }
    )


def vocabulary(rows: DataFrame) -> DataFrame:
    """(name, idx): all names in sorted order, numbered from 0."""
    return dense_index(encoded_names(rows).select("name").distinct(), ["name"], "idx")


def vectorize(rows: DataFrame, keys: list[str], vocab: DataFrame) -> DataFrame:
    """Sparse vectors in long form (keys..., idx, value); names outside vocab are dropped."""
    return encoded_names(rows).join(vocab, "name").select(*keys, "idx", "value")


def label_classes(labels: DataFrame, col: str) -> DataFrame:
    """(class, idx): distinct labels in sorted order, numbered from 0."""
    classes = labels.select(F.col(col).alias("class")).distinct()
    return dense_index(classes, ["class"], "idx")


def encode_labels(labels: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    """Add `label`, the index of the class."""
    return labels.join(
        classes.select(F.col("class").alias(col), F.col("idx").alias("label")), col
    )


def previous_components(steps: Column, n: int) -> Column:
    """The last n - 1 steps of a candidate, padded on the left; empty for n = 1."""
    if n == 1:
        return F.array().cast("array<string>")
    return F.slice(
        F.concat(F.array_repeat(F.lit(START), n - 1), steps), -(n - 1), n - 1
    )


def component_catalog(obs: DataFrame) -> DataFrame:
    """(role, component): the components seen as transforms and as models."""
    return obs.filter(F.col("role").isin("T", "M")).select("role", "component").distinct()
