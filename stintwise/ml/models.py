"""Training of the stop, position and safety-car models with pyspark.ml, and leaf-wise trees of our own.

The boosted trees of MLlib bin features into histograms and train on Spark
partitions, so no step gathers rows.  Training sets that several fits read are
written to the shared folder once; a lost executor then costs a re-read, not a
rebuild of the features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.functions.scoring import StackParams, confidence, recommendation, stack_probability
from stintwise.ml import metrics
from stintwise.ml.leafwise import Growth, LeafwiseModel, train_leafwise
from stintwise.ml.splits import assign_folds, stable_bucket, stratified_split
from stintwise.operators.quality import fill_features, require_columns, validate_feature_arrays
from stintwise.schemas import (
    BASE_FEATURES,
    MODEL_FEATURES,
    POSITION_FEATURES,
    RAW_FEATURES,
    SAFETY_CAR_FEATURES,
    TARGET,
)
from stintwise.session import written

c = F.col
KEYS = ["session_key", "driver_number", "lap_number"]
SEED = 42


@dataclass(frozen=True)
class TrainingSize:
    """Rounds, depth and learning rate of the boosted models; trees and depth of the forest; leaves of a
    leaf-wise tree, and after how many rounds without gain such a model stops."""

    rounds: int = 400
    depth: int = 6
    step: float = 0.05
    trees: int = 200
    tree_depth: int = 10
    leaves: int = 63
    patience: int = 50


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Positives weigh as much as there are negatives for each."""
    weight = metrics.class_balance(df, label).select("scale_pos_weight").scalar()
    return df.withColumn("weight", F.when(c(label) == 1, weight).otherwise(F.lit(1.0)))


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")


def _gbt(label: str, size: TrainingSize, **more) -> GBTClassifier:
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol=label,
        weightCol="weight",
        predictionCol="_prediction",
        maxIter=size.rounds,
        maxDepth=size.depth,
        stepSize=size.step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=SEED,
        **more,
    )
    return trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")


def train_gbt(
    df: DataFrame, label: str = TARGET, features: list[str] = MODEL_FEATURES, size: TrainingSize = TrainingSize()
) -> PipelineModel:
    """First base model: boosted trees with class weights."""
    rows = weighted(fill_features(df, features), label)
    return Pipeline(stages=[_assembler(features), _gbt(label, size)]).fit(rows)


def train_second_base(
    df: DataFrame, label: str = TARGET, features: list[str] = MODEL_FEATURES, size: TrainingSize = TrainingSize()
) -> LeafwiseModel:
    """Second base model: leaf-wise boosted trees that stop once the AUC of a held-out tenth no longer rises."""
    held = stable_bucket([k for k in KEYS if k in df.columns], 10, SEED + 7) == 0
    rows = weighted(fill_features(df, features), label).withColumn("held_out", held)
    growth = Growth(rounds=size.rounds, leaves=size.leaves, depth=size.depth, step=size.step, patience=size.patience, seed=SEED)
    return train_leafwise(rows, label, features, "held_out", "weight", growth)


def train_forest_base(
    df: DataFrame, label: str = TARGET, features: list[str] = MODEL_FEATURES, size: TrainingSize = TrainingSize()
) -> PipelineModel:
    rows = weighted(fill_features(df, features), label)
    forest = RandomForestClassifier(
        featuresCol="_features",
        labelCol=label,
        weightCol="weight",
        predictionCol="_prediction",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        numTrees=size.trees,
        maxDepth=size.tree_depth,
        seed=SEED,
    )
    return Pipeline(stages=[_assembler(features), forest]).fit(rows)


def with_probability(model: PipelineModel | LeafwiseModel, df: DataFrame, name: str) -> DataFrame:
    """Rows with the model's probability of class 1; the model's own columns are dropped."""
    if isinstance(model, LeafwiseModel):
        return model.probability(df, name)
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("_probability")[1]).drop(
        "_features", "_raw", "_probability", "_prediction"
    )


def oof_predictions(
    df: DataFrame,
    k: int = 5,
    label: str = TARGET,
    features: list[str] = MODEL_FEATURES,
    size: TrainingSize = TrainingSize(),
) -> DataFrame:
    """Both base probabilities of every row, from models that never saw its fold."""
    folded = assign_folds(fill_features(df, features), label, KEYS, k)
    parts = []
    for fold in range(k):
        train, out = folded.where(c("fold") != fold), folded.where(c("fold") == fold)
        first = train_gbt(train, label, features, size)
        second = train_second_base(train, label, features, size)
        parts.append(with_probability(second, with_probability(first, out, "p_xgb"), "p_lgb"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def train_meta(oof: DataFrame, label: str = TARGET) -> PipelineModel:
    """Logistic regression over both base probabilities, scaled to mean 0 and deviation 1."""
    stages = [
        VectorAssembler(inputCols=["p_xgb", "p_lgb"], outputCol="_two"),
        StandardScaler(inputCol="_two", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_features",
            labelCol=label,
            predictionCol="_prediction",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            maxIter=100,
        ),
    ]
    return Pipeline(stages=stages).fit(oof)


def stack_params(meta: PipelineModel) -> StackParams:
    """The meta model as four numbers per base model, for scoring by expression."""
    scaler, logistic = meta.stages[1], meta.stages[2]
    return StackParams(
        mean=tuple(float(x) for x in scaler.mean),
        scale=tuple(float(x) or 1.0 for x in scaler.std),
        coef=tuple(float(x) for x in logistic.coefficients),
        intercept=float(logistic.intercept),
    )


def stack_score(df: DataFrame, params: StackParams) -> DataFrame:
    """Probability, confidence and advice from both base probabilities."""
    p = stack_probability(c("p_xgb"), c("p_lgb"), params)
    return df.withColumn("_p", p).withColumns(
        {
            "pitstop_probability": F.round("_p", 4),
            "confidence": F.round(confidence(c("_p")), 4),
            "recommendation": recommendation(c("_p")),
        }
    ).drop("_p")


def train_position(df: DataFrame, size: TrainingSize = TrainingSize(), label: str = "final_position") -> PipelineModel:
    rows = fill_features(df, POSITION_FEATURES)
    forest = RandomForestRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="predicted_position",
        numTrees=size.trees,
        maxDepth=size.tree_depth,
        minInstancesPerNode=5,
        seed=SEED,
    )
    return Pipeline(stages=[_assembler(POSITION_FEATURES), forest]).fit(rows)


def train_safety_car(
    df: DataFrame, size: TrainingSize = TrainingSize(rounds=500, depth=5), label: str = "safety_car_within_5_laps"
) -> PipelineModel:
    rows = weighted(fill_features(df, SAFETY_CAR_FEATURES), label)
    return Pipeline(stages=[_assembler(SAFETY_CAR_FEATURES), _gbt(label, size)]).fit(rows)


def request_features(requests: DataFrame) -> DataFrame:
    """The 11 inputs of valid on-demand requests, which carry the 7 raw values."""
    valid, _ = validate_feature_arrays(requests)
    named = valid.withColumns({n: F.get("features", F.lit(i)) for i, n in enumerate(RAW_FEATURES)})
    return named.withColumns(
        {
            "tyre_age_sq": c("tyre_age") * c("tyre_age"),
            "heat_deg_interaction": c("track_temperature") * c("tyre_age") / 100.0,
            "wet_stint": c("rainfall") * c("stint_number"),
            "abs_sector_delta": F.abs("sector_delta"),
        }
    )


def score_requests(requests: DataFrame, model: PipelineModel) -> DataFrame:
    scored = with_probability(model, fill_features(request_features(requests), BASE_FEATURES), "pitstop_probability")
    return scored.withColumns(
        {
            "confidence": confidence(c("pitstop_probability")),
            "recommendation": recommendation(c("pitstop_probability")),
        }
    )


@dataclass(frozen=True)
class TrainedStack:
    first: PipelineModel
    second: LeafwiseModel
    params: StackParams
    evaluation: DataFrame
    validation: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        filled = fill_features(rows, MODEL_FEATURES)
        both = with_probability(self.second, with_probability(self.first, filled, "p_xgb"), "p_lgb")
        return stack_score(both, self.params)


def train_pipeline(
    df: DataFrame, threshold: float = 0.90, k: int = 5, size: TrainingSize = TrainingSize(), label: str = TARGET
) -> TrainedStack:
    """Split, out-of-fold stacking, final fits, evaluation and gate."""
    require_columns(df, [*KEYS, *MODEL_FEATURES, label])
    parts = written(
        stratified_split(fill_features(df.select(*KEYS, *MODEL_FEATURES, label), MODEL_FEATURES), label, KEYS),
        "training-set",
    )
    train = parts.where(c("split") == "train").drop("split")
    validation = parts.where(c("split") == "validation").drop("split")
    oof = written(oof_predictions(train, k, label, size=size).select("p_xgb", "p_lgb", label), "oof")
    params = stack_params(train_meta(oof, label))
    first, second = train_gbt(train, label, size=size), train_second_base(train, label, size=size)
    both = with_probability(second, with_probability(first, validation, "p_xgb"), "p_lgb")
    scored = written(
        both.withColumn("p_stack", stack_probability(c("p_xgb"), c("p_lgb"), params)).select(
            *KEYS, "p_xgb", "p_lgb", "p_stack", label
        ),
        "validation-scores",
    )
    compared = metrics.model_comparison(
        scored, {"first": "p_xgb", "second": "p_lgb", "ensemble": "p_stack"}, label
    )
    return TrainedStack(first, second, params, metrics.approve(compared, "auc", threshold), scored)
