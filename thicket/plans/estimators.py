"""Estimators of pyspark.ml: regression, classification, ranking; with Params, persistence, classes and probabilities."""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml import Model as MlModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.objectives import transform
from thicket.plans.api import TrainSet, train
from thicket.plans.model import Model
from thicket.plans.predict import predict
from thicket.sources.matrix import load_model, save_model

#: Labels that a classifier may tell apart.
MOST_CLASSES = 1000


class _Columns(HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    features: Param[list[str]] = Param(Params._dummy(), "features", "names of the feature columns", TypeConverters.toListString)
    categorical: Param[list[str]] = Param(Params._dummy(), "categorical", "features that hold codes", TypeConverters.toListString)
    queryCol: Param[str] = Param(Params._dummy(), "queryCol", "column of the query that a row belongs to", TypeConverters.toString)
    rowIdCol: Param[str] = Param(Params._dummy(), "rowIdCol", "column that tells rows apart", TypeConverters.toString)
    options: Param[dict[str, Any]] = Param(Params._dummy(), "options", "training parameters by name or alias")

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(categorical=[], options={}, labelCol="label", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction")

    def _column(self, param: Param) -> str | None:
        return self.getOrDefault(param) if self.isDefined(param) and self.getOrDefault(param) else None


class BoostedModel(MlModel, _Columns, MLWritable, MLReadable):
    """A fitted transformer. ``classes_``: the labels in order of their code; None unless it classifies."""

    def __init__(self, booster: Model | None = None, classes: list[Any] | None = None) -> None:
        super().__init__()
        self.booster, self.classes_ = booster, classes

    @property
    def feature_importances_(self) -> list[float]:
        return self.booster.importance()

    @property
    def n_features_(self) -> int:
        return len(self.booster.features)

    def _probabilities(self, df: DataFrame, name: str) -> DataFrame:
        out = predict(df, self.booster, "prediction", name)
        return out if self.booster.num_class > 1 else out.withColumn(name, F.array(1.0 - F.col(name), F.col(name)))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with an array of the classes' probabilities."""
        if self.classes_ is None:
            raise ValueError("only classifiers give probabilities")
        return self._probabilities(df, self.getProbabilityCol())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The model is walked once: probabilities and predictions are functions of the raw scores."""
        model, raw = self.booster, self.getRawPredictionCol()
        out = predict(dataset, model, "raw", raw)
        value = transform(model.objective, F.col(raw), model.sigmoid, model.squared)
        if self.classes_ is None:
            return out.withColumn(self.getPredictionCol(), value)
        p = F.col(self.getProbabilityCol())
        out = out.withColumn(self.getProbabilityCol(), value if model.num_class > 1 else F.array(1.0 - value, value))
        # the first of equals, as by a threshold of over one half
        best = F.array_position(p, F.array_max(p)).cast("int")
        return out.withColumn(self.getPredictionCol(), F.element_at(F.array(*(F.lit(c) for c in self.classes_)), best))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: BoostedModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"classes": self.instance.classes_})
        save_model(self.instance.booster, f"{path}/model", self.sparkSession)


class _ModelReader(MLReader):
    def load(self, path: str) -> BoostedModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = BoostedModel(load_model(f"{path}/model", self.sparkSession), found["classes"])
        out._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(out, found)
        return out


class _Boosted(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    objective = "regression"

    @keyword_only
    def __init__(self, *, features: list[str] | None = None, labelCol: str = "label", weightCol: str | None = None, queryCol: str | None = None, rowIdCol: str | None = None, categorical: list[str] | None = None, predictionCol: str = "prediction", probabilityCol: str = "probability", rawPredictionCol: str = "rawPrediction", options: dict[str, Any] | None = None) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setOptions(self, **options: Any) -> _Boosted:  # noqa: N802
        """More training parameters."""
        return self._set(options={**self.getOrDefault(self.options), **options})

    def _data(self, df: DataFrame, label: str) -> TrainSet:
        return TrainSet(df, self.getOrDefault(self.features), label, self._column(self.weightCol), self._column(self.queryCol), None, self._column(self.rowIdCol), self.getOrDefault(self.categorical))

    def _done(self, model: Model, classes: list[Any] | None = None) -> BoostedModel:
        return self._copyValues(BoostedModel(model, classes))

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        return self._done(train({"objective": self.objective, **self.getOrDefault(self.options)}, self._data(dataset, self.getLabelCol())))


class BoostedRegressor(_Boosted):
    pass


class BoostedRanker(_Boosted):
    objective = "lambdarank"


class BoostedClassifier(_Boosted):
    """Labels of any type become codes in their order: two give a binary model, more a multiclass one. Rows without a label don't train."""

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        label = self.getLabelCol()
        rows = dataset.where(F.col(label).isNotNull())
        classes = sorted(r[0] for r in rows.select(label).distinct().limit(MOST_CLASSES + 1).collect())
        if len(classes) > MOST_CLASSES:
            raise ValueError(f"{label} has over {MOST_CLASSES} different labels")
        code: Column = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)) - 1
        several = {"objective": "multiclass", "num_class": len(classes)} if len(classes) > 2 else {"objective": "binary"}
        coded = rows.withColumn("_class", code.cast("double"))
        return self._done(train({**several, **self.getOrDefault(self.options)}, self._data(coded, "_class")), classes)
