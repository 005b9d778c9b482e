"""Queries of splits, evaluation, training and scoring.

Trained models use few rounds here, so that all queries run in minutes; the defaults are those of ``TrainingSize``.
Their twins compare what does not depend on the fit: which rows are scored, labels, folds, and that scores are sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.catalog.join_queries import SC_WITHIN_5
from stintwise.catalog.lap_queries import F16_SQL
from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.ml import encoding, metrics, models, splits
from stintwise.operators.joins import label_pit_within_3, label_sc_within_5
from stintwise.plans.pitstop import build_pitstop_features
from stintwise.plans.position import build_position_features
from stintwise.plans.safety_car import build_safety_car_features
from stintwise.schemas import BASE_FEATURES, MODEL_FEATURES, RAW_FEATURES, TARGET
from stintwise.session import written

c = F.col
DRIVER = ["session_key", "driver_number"]
KEY = [*DRIVER, "lap_number"]
LAPS = "session_key, driver_number, lap_number"
SMALL = models.TrainingSize(rounds=3, depth=3, step=0.3, trees=5, tree_depth=5, leaves=8)

LABELLED = f"""(SELECT {LAPS}, ts, pitstop_probability AS p, speed, throttle, CASE WHEN EXISTS (SELECT 1 FROM f_pit q WHERE q.session_key = l.session_key
    AND q.driver_number = l.driver_number AND q.lap_number BETWEEN l.lap_number + 1 AND l.lap_number + 3) THEN 1 ELSE 0 END AS y FROM f_predictions l)"""


def _labelled(t: Tables) -> DataFrame:
    rows = t.predictions.select(*KEY, "ts", c("pitstop_probability").alias("p"), "speed", "throttle")
    return label_pit_within_3(rows, t.pit).withColumnRenamed(TARGET, "y")


def _bucket(keys: list[str], buckets: int, seed: int) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8))::BIGINT % {buckets})"


# splits ---------------------------------------------------------------------


@query(f"SELECT {LAPS}, y, CASE WHEN {_bucket(['y', *KEY], 10000, 42)} < 8000 THEN 'train' ELSE 'validation' END AS split FROM {LABELLED} x")
def stratified_split(t: Tables) -> DataFrame:
    return splits.stratified_split(_labelled(t), "y", KEY).select(*KEY, "y", "split")


@query(f"SELECT {LAPS}, y, CAST({_bucket(['y', *KEY], 5, 43)} AS INT) AS fold FROM {LABELLED} x")
def assign_folds(t: Tables) -> DataFrame:
    return splits.assign_folds(_labelled(t), "y", KEY).select(*KEY, "y", "fold")


@query(
    f"""SELECT {LAPS}, CASE WHEN ROW_NUMBER() OVER (ORDER BY event_time, session_key, driver_number, lap_number) <= floor((SELECT COUNT(*) FROM f_laps) * 0.8)
    THEN 'train' ELSE 'validation' END AS split FROM f_laps"""
)
def temporal_split(t: Tables) -> DataFrame:
    rows = t.laps.select(*KEY, "event_time")
    return splits.temporal_split(rows, ["event_time", *KEY]).select(*KEY, "split")


# evaluation -----------------------------------------------------------------


@query(
    f"""SELECT pos AS positives, n - pos AS negatives, pos / CAST(n AS DOUBLE) AS positive_rate, (n - pos) / CAST(GREATEST(pos, 1) AS DOUBLE) AS scale_pos_weight
    FROM (SELECT CAST(SUM(y) AS BIGINT) AS pos, COUNT(*) AS n FROM {LABELLED} x) z""",
    digits="positive_rate scale_pos_weight",
)
def class_balance(t: Tables) -> DataFrame:
    return metrics.class_balance(_labelled(t), "y")


def _auc(score: str) -> str:
    """Pairs of a positive and a negative, won or tied."""
    per = f"SELECT {score} AS s, SUM(y) AS pos, SUM(1 - y) AS neg FROM {LABELLED} x GROUP BY 1"
    return f"""SELECT SUM(a.pos * b.neg * CASE WHEN a.s > b.s THEN 1.0E0 WHEN a.s = b.s THEN 0.5E0 ELSE 0.0E0 END)
    / (SELECT CAST(SUM(y) * SUM(1 - y) AS DOUBLE) FROM {LABELLED} x) AS auc FROM ({per}) a, ({per}) b"""


@query(_auc("p"), digits="auc")
def auc(t: Tables) -> DataFrame:
    return metrics.auc(_labelled(t), "p", "y")


@query(
    f"SELECT 'ensemble' AS model, auc FROM ({_auc('p')}) a UNION ALL SELECT 'throttle' AS model, auc FROM ({_auc('throttle')}) b",
    digits="auc",
)
def model_comparison(t: Tables) -> DataFrame:
    rows = _labelled(t).withColumn("throttle", c("throttle").cast("double"))
    return metrics.model_comparison(rows, {"ensemble": "p", "throttle": "throttle"}, "y")


def _class(k: int) -> str:
    said = "p >= 0.5" if k else "p < 0.5"
    return f"""SELECT {k} AS class, COALESCE(hit / NULLIF(CAST(said AS DOUBLE), 0), 0) AS precision, COALESCE(hit / NULLIF(CAST(n AS DOUBLE), 0), 0) AS recall,
    COALESCE(2 * hit / NULLIF(CAST(said + n AS DOUBLE), 0), 0) AS f1, n AS support, right_ / CAST(total AS DOUBLE) AS accuracy
    FROM (SELECT COUNT(CASE WHEN {said} AND y = {k} THEN 1 END) AS hit, COUNT(CASE WHEN {said} THEN 1 END) AS said, COUNT(CASE WHEN y = {k} THEN 1 END) AS n,
      COUNT(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 END) AS right_, COUNT(*) AS total FROM {LABELLED} x) z"""


@query(f"{_class(0)} UNION ALL {_class(1)}", digits="precision recall f1 accuracy")
def classification_metrics(t: Tables) -> DataFrame:
    return metrics.classification_metrics(_labelled(t), "p", "y")


@query(
    "SELECT SQRT(AVG((win_probability - pitstop_probability) * (win_probability - pitstop_probability))) AS rmse, AVG(ABS(win_probability - pitstop_probability)) AS mae FROM f_predictions",
    digits="rmse mae",
)
def regression_metrics(t: Tables) -> DataFrame:
    return metrics.regression_metrics(t.predictions, "win_probability", "pitstop_probability")


@query(f"SELECT auc, CAST(0.82 AS DOUBLE) AS auc_threshold, auc >= 0.82 AS approved FROM ({_auc('p')}) a", digits="auc")
def approve(t: Tables) -> DataFrame:
    return metrics.approve(metrics.auc(_labelled(t), "p", "y"), "auc", 0.82)


# training -------------------------------------------------------------------


def _training(t: Tables) -> DataFrame:
    """The batch features, written once: every fit reads them several times."""
    return written(build_pitstop_features(t.raw_laps).select(*KEY, *MODEL_FEATURES, TARGET), "features")


def _chance(name: str) -> Column:
    return F.coalesce(c(name).between(0.0, 1.0), F.lit(False))


def _scored(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEY, TARGET, _chance(name).alias("scored"))


_SCORED_SQL = f"SELECT {LAPS}, {TARGET}, TRUE AS scored FROM ({F16_SQL}) f"

# What a model tells of rows it has not learnt from must beat what those rows' labels alone give: half of all pairs in
# order for a class, the rows' mean for a number.  The test tables are drawn at random, so signal is put beside them:
# whether a stop is near follows the tyres' age, as it does in races, with noise by the row's key.
HELD_OUT = f"{_bucket(KEY, 5, 77)} = 0"
_SIGNAL_SQL = f"""(SELECT {LAPS}, CASE WHEN tyre_age + {_bucket(KEY, 8, 5)} >= 6 THEN 1 ELSE 0 END AS y, {HELD_OUT} AS held_out FROM ({F16_SQL}) f)"""


def _signal(t: Tables) -> DataFrame:
    """The batch features with a label that follows from them, and which rows are held out."""
    rows = build_pitstop_features(t.raw_laps).select(*KEY, *MODEL_FEATURES)
    near = (c("tyre_age") + splits.stable_bucket(KEY, 8, 5) >= 6).cast("int")
    return written(rows.withColumns({TARGET: near, "held": splits.stable_bucket(KEY, 5, 77) == 0}), "signal")


def _judged(rows: DataFrame, train, floor: float) -> DataFrame:
    """Held-out rows of both classes, and whether the AUC on them reaches ``floor``."""
    model = train(rows.where("NOT held").drop("held"))
    scored = models.with_probability(model, rows.where("held"), "p")
    found = metrics.auc(scored, "p", TARGET).select((c("auc") >= floor).alias("reached"))
    counts = rows.where("held").agg(F.sum(TARGET).alias("positives"), F.count(F.lit(1)).alias("held_out"))
    return counts.crossJoin(found).withColumn("auc_floor", F.lit(floor))


def _judged_sql(floor: float) -> str:
    return f"SELECT CAST(SUM(y) AS BIGINT) AS positives, COUNT(*) AS held_out, TRUE AS reached, CAST({floor} AS DOUBLE) AS auc_floor FROM {_SIGNAL_SQL} s WHERE held_out"


@query(_judged_sql(0.85))
def held_out_gbt(t: Tables) -> DataFrame:
    return _judged(_signal(t), lambda rows: models.train_gbt(rows, size=SMALL), 0.85)


@query(_judged_sql(0.85))
def held_out_leafwise(t: Tables) -> DataFrame:
    size = models.TrainingSize(rounds=6, depth=4, step=0.3, leaves=12, patience=3)
    return _judged(_signal(t), lambda rows: models.train_second_base(rows, size=size), 0.85)


@query(_judged_sql(0.85))
def held_out_forest(t: Tables) -> DataFrame:
    return _judged(_signal(t), lambda rows: models.train_forest_base(rows, size=SMALL), 0.85)


@query(_SCORED_SQL)
def train_gbt(t: Tables) -> DataFrame:
    rows = _training(t)
    return _scored(models.with_probability(models.train_gbt(rows, size=SMALL), rows, "p_xgb"), "p_xgb")


@query(_SCORED_SQL)
def train_small_gbt(t: Tables) -> DataFrame:
    """The model over the first 11 features."""
    rows = _training(t)
    model = models.train_gbt(rows, features=BASE_FEATURES, size=SMALL)
    return _scored(models.with_probability(model, rows, "p_xgb"), "p_xgb")


@query(_SCORED_SQL)
def train_second_base(t: Tables) -> DataFrame:
    rows = _training(t)
    return _scored(models.with_probability(models.train_second_base(rows, size=SMALL), rows, "p_lgb"), "p_lgb")


@query(_SCORED_SQL)
def train_forest_base(t: Tables) -> DataFrame:
    rows = _training(t)
    return _scored(models.with_probability(models.train_forest_base(rows, size=SMALL), rows, "p_lgb"), "p_lgb")


@query(f"SELECT {LAPS}, {TARGET}, CAST({_bucket([TARGET, *KEY], 3, 43)} AS INT) AS fold, TRUE AS scored FROM ({F16_SQL}) f")
def oof_predictions(t: Tables) -> DataFrame:
    oof = models.oof_predictions(_training(t), k=3, size=SMALL)
    return oof.select(*KEY, TARGET, "fold", (_chance("p_xgb") & _chance("p_lgb")).alias("scored"))


def _sound() -> Column:
    """A served score whose confidence and advice follow from its probability."""
    p = c("pitstop_probability")
    return _chance("pitstop_probability") & (F.abs(c("confidence") - F.abs(p - 0.5) * 2) < 2e-4) & c("recommendation").isNotNull()


@query(f"SELECT {LAPS}, TRUE AS sound FROM f_scores")
def train_meta(t: Tables) -> DataFrame:
    """Meta model over two base probabilities, scored by its formula."""
    rows = label_pit_within_3(t.scores.select(*KEY, "p_xgb", "p_lgb"), t.pit)
    oof = written(rows, "oof")
    scored = models.stack_score(oof, models.stack_params(models.train_meta(oof)))
    return scored.select(*KEY, _sound().alias("sound"))


@query("SELECT session_key, driver_number, final_position, TRUE AS placed FROM f_grid WHERE final_position IS NOT NULL")
def train_position(t: Tables) -> DataFrame:
    rows = written(encoding.encode_position_features(build_position_features(t.grid)), "results")
    placed = c("predicted_position").between(1, 22).alias("placed")
    return models.train_position(rows, SMALL).transform(rows).select(*DRIVER, "final_position", placed)


@query(f"SELECT session_key, lap_number, MAX({SC_WITHIN_5}) AS safety_car_within_5_laps, TRUE AS scored FROM f_raw l GROUP BY session_key, lap_number")
def train_safety_car(t: Tables) -> DataFrame:
    laps = build_safety_car_features(label_sc_within_5(t.raw_laps, t.race_control))
    rows = written(encoding.encode_safety_car_features(laps), "safety-car")
    scored = models.with_probability(models.train_safety_car(rows, SMALL), rows, "p")
    return scored.select("session_key", "lap_number", "safety_car_within_5_laps", _chance("p").alias("scored"))


@query(f"SELECT {LAPS}, TRUE AS sound FROM f_nested WHERE n_features = {len(RAW_FEATURES)}")
def score_requests(t: Tables) -> DataFrame:
    """Requests with the right number of values, scored by the 11-feature model."""
    model = models.train_gbt(_training(t), features=BASE_FEATURES, size=SMALL)
    requests = t.nested_predictions.select(*KEY, "features")
    return models.score_requests(requests, model).select(*KEY, _sound().alias("sound"))


@query(
    f"""SELECT model, CAST(0.9 AS DOUBLE) AS auc_threshold, TRUE AS sound FROM (VALUES ('first'), ('second'), ('ensemble')) m(model)
    WHERE EXISTS (SELECT 1 FROM ({F16_SQL}) f WHERE {TARGET} = 1)"""
)
def train_pipeline(t: Tables) -> DataFrame:
    """Split, out-of-fold stack, final fits and gate: both bases and the ensemble, approved by their own AUC."""
    found = models.train_pipeline(_training(t), k=2, size=SMALL).evaluation
    gated = _chance("auc") & (c("approved") == (c("auc") >= c("auc_threshold")))
    return found.select("model", c("auc_threshold").cast("double").alias("auc_threshold"), gated.alias("sound"))
