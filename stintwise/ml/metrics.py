"""Evaluation as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts, positive rate and the weight that balances the classes."""
    positives, rows = F.sum(c(label).cast("bigint")), F.count(F.lit(1))
    return df.agg(positives.alias("positives"), (rows - positives).alias("negatives")).select(
        "positives",
        "negatives",
        (c("positives") / (c("positives") + c("negatives"))).alias("positive_rate"),
        (c("negatives") / F.greatest("positives", F.lit(1))).alias("scale_pos_weight"),
    )


def _rank_sums(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Exact ``auc`` per key by rank sums, ties counted half; rows without a score or label do not count.

    Equal scores are counted first.  The negatives below a score are those in
    lower bins of scores (a window over bins of two decimals) and those below it
    in its own bin, so no task orders all scores.
    """
    positive = c(label).cast("bigint")
    per_score = (
        df.where(c(score).isNotNull() & c(label).isNotNull())
        .groupBy(*keys, c(score).alias("_s"))
        .agg(F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
        .withColumn("_bin", F.floor(c("_s") * 100))
    )
    per_bin = per_score.groupBy(*keys, "_bin").agg(F.sum("_neg").alias("_in"))
    lower = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bin")) - c("_in")
    bins = per_bin.select(*keys, "_bin", lower.alias("_lower"))
    own = F.sum("_neg").over(Window.partitionBy(*keys, "_bin").orderBy("_s")) - c("_neg")
    below = per_score.withColumn("_own", own).join(bins, [*keys, "_bin"])
    wins = below.withColumn("_wins", c("_pos") * (c("_own") + c("_lower") + c("_neg") / 2.0))
    area = F.sum("_wins") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))
    return wins.groupBy(*keys).agg(area.alias("auc"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve."""
    return _rank_sums(df, [], score, label)


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes, and the accuracy."""
    said = (c(score) >= threshold).cast("int")
    hits = {k: F.count_if((said == k) & (c(label) == k)) for k in (0, 1)}
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[hits[k].alias(f"_hit{k}") for k in (0, 1)],
        *[F.count_if(said == k).alias(f"_said{k}") for k in (0, 1)],
        *[F.count_if(c(label) == k).alias(f"_is{k}") for k in (0, 1)],
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    per_class = [
        F.struct(
            F.lit(k).alias("class"),
            ratio(c(f"_hit{k}"), c(f"_said{k}")).alias("precision"),
            ratio(c(f"_hit{k}"), c(f"_is{k}")).alias("recall"),
            ratio(2 * c(f"_hit{k}"), c(f"_said{k}") + c(f"_is{k}")).alias("f1"),
            c(f"_is{k}").alias("support"),
            ratio(c("_hit0") + c("_hit1"), c("_rows")).alias("accuracy"),
        )
        for k in (0, 1)
    ]
    return counts.select(F.inline(F.array(*per_class)))


def regression_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    off = c(predicted) - c(actual)
    return df.agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"))


def approve(metrics: DataFrame, metric: str, threshold: float, lower_is_better: bool = False) -> DataFrame:
    """The evaluation record with its gate."""
    passed = c(metric) <= threshold if lower_is_better else c(metric) >= threshold
    return metrics.withColumns({f"{metric}_threshold": F.lit(threshold), "approved": F.coalesce(passed, F.lit(False))})


def model_comparison(df: DataFrame, scores: dict[str, str], label: str) -> DataFrame:
    """AUC of each model's score column, from one pass over the rows."""
    items = F.array(*[F.struct(F.lit(n).alias("model"), c(s).alias("_score")) for n, s in scores.items()])
    long = df.select(c(label).alias("_label"), F.inline(items))
    return _rank_sums(long, ["model"], "_score", "_label")
