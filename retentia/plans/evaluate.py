"""Quality of a score table: `label` 0/1, `pred` 0/1, `score` in [0, 1].

Every figure comes from counts.  Where several are wanted, stage or persist the
score table first, as each report reads it once.
"""

from pyspark.sql import DataFrame, functions as F

from retentia import schema as S
from retentia.functions.exact import share
from retentia.operators.running import running_counts


CELLS = {
    (a, p): f"count_if(label = {a} AND pred = {p})" for a in (0, 1) for p in (0, 1)
}


def accuracy(scores: DataFrame) -> DataFrame:
    return scores.agg(share("count_if(label = pred)", "count(label = pred)").alias("accuracy"))


def confusion_matrix(scores: DataFrame) -> DataFrame:
    """Four rows (actual, predicted, n); empty cells are 0."""
    rates = scores.agg(*[F.expr(n).alias(f"n{a}{p}") for (a, p), n in CELLS.items()])
    return rates.selectExpr(_inline(f"'actual', {a}, 'predicted', {p}, 'n', n{a}{p}" for a, p in CELLS))


def _rates(scores: DataFrame) -> DataFrame:
    """One row: cell counts n.., supports s., and precision, recall and F1 of
    class 0, class 1, macro and weighted.  An empty denominator gives 0."""
    def ratio(num, den):
        return F.expr(f"coalesce(try_divide(CAST({num} AS double), CAST({den} AS double)), 0.0D)")

    counts = scores.agg(*[F.expr(n).alias(f"n{a}{p}") for (a, p), n in CELLS.items()])
    rates = counts.selectExpr("*", "n00 + n01 AS s0", "n10 + n11 AS s1", "n00 + n01 + n10 + n11 AS s")
    rates = rates.withColumns({
        "p0": ratio("n00", "n00 + n10"), "p1": ratio("n11", "n01 + n11"),
        "r0": ratio("n00", "s0"), "r1": ratio("n11", "s1"),
    })
    rates = rates.withColumns({
        c: ratio(f"2.0D * p{i} * r{i}", f"p{i} + r{i}") for i, c in enumerate(("f0", "f1"))
    })
    averages = {f"{m}_macro": F.expr(f"({m}0 + {m}1) / 2.0D") for m in "prf"}
    averages |= {f"{m}_weighted": ratio(f"{m}0 * s0 + {m}1 * s1", "s") for m in "prf"}
    return rates.withColumns({**averages, "correct": ratio("n00 + n11", "s")})


# Lines of the class report and the columns of _rates they show.
LINES = {
    S.CLASS_NAMES[0]: ("p0", "r0", "f0", "s0"),
    S.CLASS_NAMES[1]: ("p1", "r1", "f1", "s1"),
    "accuracy": ("CAST(NULL AS double)", "CAST(NULL AS double)", "correct", "s"),
    "macro avg": ("p_macro", "r_macro", "f_macro", "s"),
    "weighted avg": ("p_weighted", "r_weighted", "f_weighted", "s"),
}
MEASURES = ("precision", "recall", "f1", "support")


def _inline(rows) -> str:
    return "inline(array(" + ", ".join(f"named_struct({row})" for row in rows) + "))"


def classification_report(scores: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    return _rates(scores).selectExpr(_inline(
        f"'class', '{name}', " + ", ".join(f"'{m}', {c}" for m, c in zip(MEASURES, columns))
        for name, columns in LINES.items()
    ))


def roc_auc(scores: DataFrame, cuts: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only.

    Twice the area is a sum of whole numbers, so the result does not depend on
    how the scores are spread over tasks.
    """
    runs = running_counts(scores, cuts)
    twice = "CAST(CAST(neg AS decimal(18,0)) * (CAST(cum_pos - pos AS decimal(19,0)) * 2 + pos) AS decimal(38,0))"
    pairs = "CAST(all_pos AS decimal(19,0)) * CAST(all_neg AS decimal(18,0)) * 2"
    return runs.agg(share(f"sum({twice})", f"max({pairs})").alias("roc_auc"))


def roc_curve(scores: DataFrame, cuts: int | None = None, drop_collinear: bool = False) -> DataFrame:
    """threshold, fpr, tpr for every distinct score, and the start (null, 0, 0).

    With `drop_collinear`, a point whose next step equals its own step lies on a
    straight line and is left out; the first and last score always stay.
    """
    runs = running_counts(scores, cuts)
    is_first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    if drop_collinear:
        straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
        runs = runs.where(is_first | ~F.coalesce(straight, F.lit(False)))
    # The start comes with the top score, so no union and second pass is needed.
    points = F.when(
        is_first,
        F.array(F.struct(F.lit(None).cast("double").alias("threshold"),
                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")), _point()),
    ).otherwise(F.array(_point()))
    return runs.select(F.inline(points))


def _point():
    return F.struct(
        F.col("score").alias("threshold"),
        share("cum_neg", "all_neg").alias("fpr"),
        share("cum_pos", "all_pos").alias("tpr"),
    )


def evaluate_report(scores: DataFrame) -> DataFrame:
    """metric, value: accuracy, AUC, the confusion cells and the class report.

    Two passes over `scores`, one for the counts and one for the curve; pass a
    staged or persisted frame.
    """
    metrics = {"accuracy": "correct"}
    metrics |= {f"actual_{a}_predicted_{p}": f"n{a}{p}" for a, p in CELLS}
    metrics |= {
        f"{name} {measure}": column
        for name, columns in LINES.items() if name != "accuracy"
        for measure, column in zip(MEASURES, columns)
    }
    counted = _rates(scores).selectExpr(_inline(
        f"'metric', '{name}', 'value', CAST({column} AS double)" for name, column in metrics.items()
    ))
    area = roc_auc(scores).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return counted.unionByName(area)


def log_loss(scores: DataFrame) -> DataFrame:
    """Mean negative log-likelihood; probabilities are kept off 0 and 1 by 1e-15."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    return scores.agg(
        (-F.avg(F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss")
    )
