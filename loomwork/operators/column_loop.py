"""Pipeline stages over the feature columns of a table.

Every column except the reserved ones is a feature. A stage takes the features it finds,
fits one `pyspark.ml` component and leaves the table with the features replaced, so stages
chain in an ordinary `Pipeline`.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from loomwork.operators import catalog
from loomwork.operators.profile import NUMERIC

RESERVED = ("row_id", "label", "rawPrediction", "probability", "prediction")
FEATURES = "features"
SMUDGE = "__"


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _is_number(kind) -> bool:
    return isinstance(kind, (*NUMERIC, T.BooleanType))


def get_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in RESERVED], *cols)


def remove_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def used_slots(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """Indices of a vector column that hold a nonzero somewhere."""
    cells = df.select(F.posexplode(vector_to_array(col)).alias("idx", "v"))
    return cells.filter("v <> 0").select("idx").distinct()


def vector_width(df: DataFrame, col: str) -> int:
    """Width of a vector column, from its metadata or else from one row."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    row = df.select(F.size(vector_to_array(col))).first()
    return row[0] if row else 0


def width(df: DataFrame) -> int:
    """Number of feature columns, counting the slots of vectors."""
    types = _types(df)
    return sum(
        vector_width(df, c) if isinstance(types[c], VectorUDT) else 1
        for c in feature_columns(df)
    )


def split_vectors(df: DataFrame) -> DataFrame:
    """Vector features as one numeric column per slot."""
    types = _types(df)
    for c in feature_columns(df):
        if isinstance(types[c], VectorUDT):
            n = vector_width(df, c)
            cells = vector_to_array(c)
            df = df.select(
                *[k for k in df.columns if k != c],
                *[cells[i].alias(f"{c}_{i}") for i in range(n)],
            )
    return df


def merge_columns(
    df: DataFrame, results: dict[str, str], widths: dict[str, int]
) -> DataFrame:
    """Put results (input column to result column) back into the table.

    When all results are one column wide they overwrite their inputs in place; otherwise the
    inputs go and all results are appended.
    """
    if all(widths[c] == 1 for c in results):
        values = {}
        for c, r in results.items():
            is_vector = isinstance(df.schema[r].dataType, VectorUDT)
            values[c] = vector_to_array(r)[0] if is_vector else F.col(r)
        return df.withColumns(values).drop(*results.values())
    return df.drop(*results)


def _assembler(cols: list[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error")


class TableStepModel(Model):
    """Fitted whole-table transform: all features become one vector."""

    def __init__(self, cols: list[str], stages: PipelineModel, outputs: list[str]):
        super().__init__()
        self.cols, self.stages, self.outputs = cols, stages, outputs

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [c for c in dataset.columns if c in RESERVED]
        done = self.stages.transform(dataset)
        if len(self.outputs) == 1 and self.outputs[0] == "__out":
            return done.select(*kept, F.col("__out").alias(FEATURES))
        others = [c for c in feature_columns(dataset) if c not in self.cols]
        return done.select(
            *kept, *others,
            *[F.col(o).alias(c) for c, o in zip(self.cols, self.outputs)],
        )


class TableStep(Estimator):
    """Fit a transform on the whole table."""

    def __init__(self, component: str):
        super().__init__()
        self.component = component

    def _fit(self, dataset: DataFrame) -> TableStepModel:
        part = catalog.resolve(self.component)
        types = _types(dataset)
        cols = feature_columns(dataset)
        if part.takes == catalog.VECTOR:
            op = part.build(width(dataset)).setInputCol("__in").setOutputCol("__out")
            stages = Pipeline(stages=[_assembler(cols, "__in"), op])
            return TableStepModel(cols, stages.fit(dataset), ["__out"])
        fits = _is_number if part.takes == catalog.NUMBERS else (
            lambda k: isinstance(k, T.StringType)
        )
        if not cols or not all(fits(types[c]) for c in cols):
            raise TypeError(f"{self.component} needs {part.takes}")
        outputs = [f"__o_{i}" for i in range(len(cols))]
        op = part.build(len(cols)).setInputCols(cols).setOutputCols(outputs)
        return TableStepModel(cols, Pipeline(stages=[op]).fit(dataset), outputs)


class ColumnLoopModel(Model):
    def __init__(self, fitted: list[tuple[list[str], PipelineModel, dict[str, str]]],
                 widths: dict[str, int], smudged: set[str], split: bool,
                 failed: dict[str, str] | None = None):
        super().__init__()
        self.fitted, self.widths, self.smudged, self.split = fitted, widths, smudged, split
        #: columns that were left alone because their fit failed, and why
        self.failed = failed or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = split_vectors(dataset) if self.split else dataset
        results: dict[str, str] = {}
        extra: list[str] = []
        if self.smudged:
            df = df.withColumns(
                {c: F.concat(F.lit(SMUDGE), F.col(c)) for c in self.smudged}
            )
        for _, stages, named in self.fitted:
            df = stages.transform(df)
            results.update(named)
            extra += [
                s.getOutputCol() for s in stages.stages if isinstance(s, VectorAssembler)
            ]
        return merge_columns(df.drop(*extra), results, self.widths)


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


class ColumnLoop(Estimator):
    """Fit a transform on every feature column by itself.

    Columns it does not fit stay as they are; string columns get a second try with a prefix.
    Components that handle slots alone, or many columns at once, are fitted in one job.
    """

    def __init__(self, component: str):
        super().__init__()
        self.component = component

    def _fit(self, dataset: DataFrame) -> ColumnLoopModel:
        part = catalog.resolve(self.component)
        df = split_vectors(dataset)
        cols = feature_columns(df)
        types = _types(df)
        numbers = [c for c in cols if _is_number(types[c])]
        strings = [c for c in cols if isinstance(types[c], T.StringType)]
        fitted, widths, smudged, failed = [], {}, set(), {}
        if part.takes == catalog.VECTOR and part.slotwise and numbers:
            fitted.append(self._together(part, df, numbers))
            widths.update({c: 1 for c in numbers})
        elif part.takes == catalog.NUMBERS and numbers:
            fitted.append(self._many(part, df, numbers))
            widths.update({c: 1 for c in numbers})
        elif part.takes == catalog.STRINGS and strings:
            try:
                fitted.append(self._many(part, df, strings))
            except Exception:
                smudged = set(strings)
                retry = df.withColumns(
                    {c: F.concat(F.lit(SMUDGE), F.col(c)) for c in strings}
                )
                fitted.append(self._many(part, retry, strings))
            widths.update({c: 1 for c in strings})
        elif part.takes == catalog.VECTOR and numbers:
            for i, c in enumerate(numbers):
                try:
                    one = self._single(part, df, c, i)
                    width = vector_width(one[1].transform(df), f"__r_{i}")
                except Exception as error:
                    failed[c] = _reason(error)  # this column is left alone
                    continue
                fitted.append(one)
                widths[c] = width
        if not fitted:
            why = "; ".join(f"{c}: {reason}" for c, reason in failed.items())
            raise ValueError(f"{self.component} fits no column{': ' if why else ''}{why}")
        return ColumnLoopModel(fitted, widths, smudged, df is not dataset, failed)

    @staticmethod
    def _many(part, df, cols):
        outputs = [f"__r_{c}" for c in cols]
        op = part.build(len(cols)).setInputCols(cols).setOutputCols(outputs)
        return cols, Pipeline(stages=[op]).fit(df), dict(zip(cols, outputs))

    @staticmethod
    def _single(part, df, col, i):
        op = part.build(1).setInputCol(f"__a_{i}").setOutputCol(f"__r_{i}")
        stages = Pipeline(stages=[_assembler([col], f"__a_{i}"), op])
        return [col], stages.fit(df), {col: f"__r_{i}"}

    @staticmethod
    def _together(part, df, cols):
        op = part.build(len(cols)).setInputCol("__a").setOutputCol("__b")
        stages = Pipeline(stages=[_assembler(cols, "__a"), op, _Spread("__b", cols)])
        return cols, stages.fit(df), {c: f"__r_{c}" for c in cols}


class _Spread(Model):
    """Slots of a vector as result columns."""

    def __init__(self, vector: str, cols: list[str]):
        super().__init__()
        self.vector, self.cols = vector, cols

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cells = vector_to_array(self.vector)
        return dataset.select(
            *[c for c in dataset.columns if c != self.vector],
            *[cells[i].alias(f"__r_{c}") for i, c in enumerate(self.cols)],
        )


class ModelStepModel(Model):
    def __init__(self, cols: list[str], model: PipelineModel):
        super().__init__()
        self.cols, self.model = cols, model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        done = self.model.transform(dataset)
        proba = (
            vector_to_array("probability") if "probability" in done.columns
            else F.lit(None).cast("array<double>")
        )
        return done.select(
            *[c for c in ("row_id", "label") if c in dataset.columns],
            F.col("prediction").alias("pred"), proba.alias("proba"),
        )


class ModelStep(Estimator):
    """Fit a model on all features; its output has row_id, label, pred and proba."""

    def __init__(self, component: str):
        super().__init__()
        self.component = component

    def _fit(self, dataset: DataFrame) -> ModelStepModel:
        part = catalog.resolve(self.component)
        cols = feature_columns(dataset)
        op = part.build(width(dataset)).setFeaturesCol("__in").setLabelCol("label")
        stages = Pipeline(stages=[_assembler(cols, "__in"), op])
        return ModelStepModel(cols, stages.fit(dataset))


def as_vector(df: DataFrame, array_col: str, n: int) -> DataFrame:
    """A float array column as the `features` vector, with its width in the metadata."""
    vector = array_to_vector(F.col(array_col).cast("array<double>"))
    meta = {"ml_attr": {"num_attrs": n}}
    return df.withColumn(FEATURES, vector.alias(FEATURES, metadata=meta)).drop(
        *([array_col] if array_col != FEATURES else [])
    )
