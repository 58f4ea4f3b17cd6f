"""Fitted models as pipeline stages: they transform, save and load like the built-in ones."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.operators.lockstep import Bins, Ensemble, nodes_of
from riskweave.operators.newton import Linear

ROWS_AT_ONCE = 4096


class _Classifier(Model, HasFeaturesCol, HasRawPredictionCol, HasProbabilityCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds raw score, class probabilities and predicted class under the columns named by its parameters."""

    content = Param(Params._dummy(), "content", "the fitted numbers as JSON", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._read: tuple[str, dict] | None = None

    def named(self, name: str, features: str) -> _Classifier:
        return self._set(featuresCol=features, rawPredictionCol=f"raw_{name}", probabilityCol=f"prob_{name}", predictionCol=f"pred_{name}")

    def holding(self, numbers: dict) -> _Classifier:
        return self._set(content=json.dumps(numbers))

    @property
    def numbers(self) -> dict:
        text = self.getOrDefault(self.content)
        if self._read is None or self._read[0] is not text:
            self._read = (text, json.loads(text))
        return self._read[1]

    def margin(self, features: Column) -> Column:
        raise NotImplementedError

    def probability(self, margin: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-margin))

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()]
        scored = df.withColumn(names[0], self.margin(vector_to_array(self.getFeaturesCol()))).withColumn(names[1], self.probability(F.col(names[0])))
        scored = scored.withColumn(names[2], (F.col(names[1]) > 0.5).cast("double"))
        two = lambda one, other: array_to_vector(F.array(other, one))
        return scored.withColumns({names[0]: two(F.col(names[0]), -F.col(names[0])), names[1]: two(F.col(names[1]), 1 - F.col(names[1]))})


class FittedLinear(_Classifier):
    """A logistic regression; scoring is one expression."""

    @staticmethod
    def of(fit: Linear) -> FittedLinear:
        return FittedLinear().holding(
            {"slopes": fit.slopes.tolist(), "offset": fit.offset, "coefficients": fit.coefficients.tolist(), "means": fit.mean.tolist(), "intercept": fit.intercept}
        )

    @property
    def coefficients(self) -> DenseVector:
        """Of the standardised features."""
        return Vectors.dense(self.numbers["coefficients"])

    @property
    def slopes(self) -> np.ndarray:
        return np.array(self.numbers["slopes"])

    @property
    def means(self) -> np.ndarray:
        return np.array(self.numbers["means"])

    def margin(self, features: Column) -> Column:
        slopes = F.array(*[F.lit(float(s)) for s in self.numbers["slopes"]])
        return F.aggregate(F.zip_with(features, slopes, lambda x, s: x * s), F.lit(float(self.numbers["offset"])), lambda a, x: a + x)


class FittedTrees(_Classifier):
    """An ensemble of trees. ``mean`` ensembles average probabilities, others add up to a log-odds score."""

    @staticmethod
    def of(ensemble: Ensemble, bins: Bins, width: int, mean: bool) -> FittedTrees:
        nodes = nodes_of(ensemble, bins, 1 / len(ensemble.trees) if mean else 1.0)
        return FittedTrees().holding({"width": width, "mean": mean, "start": ensemble.start, **{k: v.tolist() for k, v in nodes.items()}})

    @property
    def nodes(self) -> dict[str, np.ndarray]:
        """All nodes, tree after tree; ids count from 0 within a tree, and a leaf has feature -1."""
        kept = {k: np.array(v) for k, v in self.numbers.items() if isinstance(v, list)}
        return kept

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the features: of all impurity decrease for averaged trees, of all splits for added ones."""
        nodes, width = self.nodes, self.numbers["width"]
        inner = nodes["feature"] >= 0
        if self.numbers["mean"]:
            each = np.zeros((int(nodes["tree"].max()) + 1, width))
            np.add.at(each, (nodes["tree"][inner], nodes["feature"][inner]), nodes["gain"][inner])
            whole = each.sum(axis=1, keepdims=True)
            total = np.divide(each, whole, out=np.zeros_like(each), where=whole > 0).sum(axis=0)
        else:
            total = np.bincount(nodes["feature"][inner], minlength=width).astype(float)
        return Vectors.dense(total / (total.sum() or 1.0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row."""
        nodes = self.nodes
        firsts = np.flatnonzero(nodes["id"] == 0)
        base = np.repeat(firsts, np.diff(np.append(firsts, len(nodes["id"]))))
        feature, threshold, value = nodes["feature"], nodes["threshold"], nodes["value"]
        # Leaves lead to themselves, so every row takes as many steps as the deepest tree has.
        own = np.arange(len(feature))
        child = np.stack([np.where(feature >= 0, nodes["left"] + base, own), np.where(feature >= 0, nodes["right"] + base, own)])
        depth, reach = 0, np.isin(own, firsts)
        while (feature[reach] >= 0).any():
            split = reach & (feature >= 0)
            reach = np.zeros_like(reach)
            reach[child[:, split].ravel()] = True
            depth += 1
        used = np.maximum(feature, 0)
        out = np.empty(len(x))
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = x[at : at + ROWS_AT_ONCE]
            rows, total = np.arange(len(part)), np.full(len(part), float(self.numbers["start"]))
            for first in firsts:
                node = np.full(len(part), first)
                for _ in range(depth):
                    node = child[(part[rows, used[node]] > threshold[node]).astype(np.int64), node]
                total += value[node]
            out[at : at + ROWS_AT_ONCE] = total
        return out

    def margin(self, features: Column) -> Column:
        # A model's size follows its trees, not the rows.
        sent = _sent(self)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False)
            return pa.array(sent.value.scores(flat.reshape(len(x), -1)) if len(x) else np.empty(0))

        return score(features)

    def probability(self, margin: Column) -> Column:
        return margin if self.numbers["mean"] else super().probability(margin)

    def predictRaw(self, features) -> DenseVector:
        m = float(self.scores(np.asarray(features.toArray())[None, :])[0])
        return Vectors.dense([-m, m])

    def predictProbability(self, features) -> DenseVector:
        m = self.predictRaw(features)[1]
        p = m if self.numbers["mean"] else 1 / (1 + np.exp(-m))
        return Vectors.dense([1 - p, p])


class _Numbers:
    """What a task needs of a tree model."""

    def __init__(self, model: FittedTrees) -> None:
        self.numbers, self.nodes = {"start": model.numbers["start"]}, model.nodes

    scores = FittedTrees.scores


def _sent(model: FittedTrees):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(_Numbers(model))


class FittedCentres(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The number of the nearest centre, the first of equally near ones; one expression."""

    content = Param(Params._dummy(), "content", "the centres as JSON", TypeConverters.toString)

    @staticmethod
    def of(centres: np.ndarray, features: str, out: str) -> FittedCentres:
        return FittedCentres()._set(content=json.dumps(centres.tolist()), featuresCol=features, predictionCol=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self.getFeaturesCol()].dataType.typeName()
        x = F.col(self.getFeaturesCol()) if kind == "array" else vector_to_array(self.getFeaturesCol())
        away = []
        for centre in json.loads(self.getOrDefault(self.content)):
            gaps = F.zip_with(x, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b))
            away.append(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g))
        distances = F.array(*away)
        return df.withColumn(self.getPredictionCol(), (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))
