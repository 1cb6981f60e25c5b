"""Text classifier for ambiguous mentions: split, fit, predict, evaluate."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.operators.labels import COPIES, LABEL_COLUMNS, copies, drop_excluded
from litmine.operators.numbering import running_sums
from litmine.session import cut

# Settings of the two classifiers.
MAX_ITER = 50
MENTION_TOL = 0.1
PRIMARY_TOL = 1e-6
TRAIN_TENTHS = 8

PRIMARY_COLUMNS = ("pdb_id", "match_type", "deposition_year", "pmc_id", "pm_id", "primary_citation", "publication_year", "sentence")


def split(df: DataFrame, *keys: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """80/20 split by the MD5 of the seed and the row's keys (leading 32 bits, modulo 10; nulls are left out), so that it
    depends on no partitioning and any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys or df.columns])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10
    return df.filter(bucket < TRAIN_TENTHS), df.filter(bucket >= TRAIN_TENTHS)


def fit(training: DataFrame, text: str = "blinded_sentence", tol: float = MENTION_TOL,
        num_features: int = 1 << 18) -> PipelineModel:
    """Tokens -> hashed term counts -> logistic regression on ``label``, in which a row weighs as much as its ``copies``."""
    regression = LogisticRegression(tol=tol, maxIter=MAX_ITER)
    if COPIES in training.columns:
        regression = regression.setWeightCol(COPIES)
    stages = [
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=num_features),
        regression,
    ]
    return Pipeline(stages=stages).fit(training)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def accepted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows that the model accepts. It looks at the sentence only, so mentions can be chosen before they meet the entries."""
    return model.transform(rows).filter(F.col("prediction") == 1.0).select(*rows.columns)


def predict_mentions(model: PipelineModel, unassigned: DataFrame) -> DataFrame:
    """Unassigned mentions that the model accepts."""
    return accepted(model, drop_excluded(unassigned)).select(*LABEL_COLUMNS)


def predict_primary(model: PipelineModel, candidates: DataFrame) -> DataFrame:
    """Candidates that the model takes for primary citations. Counted ones have no ``deposition_year`` and keep ``copies``."""
    return accepted(model, candidates).select(*[c for c in (*PRIMARY_COLUMNS, COPIES) if c in candidates.columns])


def _terms(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows with a stored key ``row``, and ``(row, index, value)`` of their features."""
    vector = F.unwrap_udt("features")
    scored = cut(
        model.transform(rows).select("*", F.monotonically_increasing_id().alias("row"), vector["indices"].alias("at"), vector["values"].alias("of"))
        .drop("words", "features", "rawPrediction")
    )
    terms = scored.select("row", F.explode(F.arrays_zip("at", "of")).alias("x")).select("row", F.col("x.at").alias("index"), F.col("x.of").alias("value"))
    return scored.drop("at", "of"), terms


def _total(cond: Column, number: Column | str = COPIES) -> Column:
    """How many rows, copies included, meet the condition."""
    return F.coalesce(F.sum(F.when(cond, F.col(number) if isinstance(number, str) else number)), F.lit(0)).cast("bigint")


def optimum_check(model: PipelineModel, training: DataFrame, limit: float) -> DataFrame:
    """Whether the fitted weights are an optimum, from the rows alone: ``n``, ``positives``, and whether the greatest part of the
    gradient of the mean log loss is at most ``limit`` and the loss is below that of the share of positives.

    The loss is convex, so a gradient of zero is the optimum. One aggregate by feature gives all parts of it.
    """
    scored, terms = _terms(model, training)
    p = F.get(vector_to_array("probability"), F.lit(1))
    rows = cut(scored.select("row", "label", (p - F.col("label")).alias("error"), p.alias("p"), copies(scored).alias(COPIES)))
    n = F.sum(COPIES)

    def mean(value: Column) -> Column:
        return F.sum(value * F.col(COPIES)) / n

    share = mean(F.col("label"))
    loss = mean(-F.log(F.when(F.col("label") == 1.0, F.col("p")).otherwise(1 - F.col("p"))))
    constant = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    whole = rows.agg(
        F.coalesce(n, F.lit(0)).alias("n"), _total(F.col("label") == 1.0).alias("positives"),
        F.abs(mean(F.col("error"))).alias("intercept"), (loss < constant).alias("better_than_share"),
    )
    errors = rows.select("row", (F.col("error") * F.col(COPIES)).alias("error"))
    parts = terms.join(errors, "row").groupBy("index").agg(F.abs(F.sum(F.col("error") * F.col("value"))).alias("part"))
    greatest = parts.agg(F.coalesce(F.max("part"), F.lit(0.0)).alias("part"))
    small = F.greatest(F.col("part") / F.col("n"), "intercept") <= limit
    return whole.crossJoin(greatest).select("n", "positives", small.alias("gradient_small"), "better_than_share")  # one row each


def score_check(model: PipelineModel, candidates: DataFrame) -> DataFrame:
    """``(candidates, accepted_wrongly, refused_wrongly)``: predictions against scores made anew from the weights, as a join of
    the rows' features with the table of weights, whose size is that of the feature space."""
    scored, terms = _terms(model, candidates)
    weights = model.stages[-1].coefficients.toArray()
    used = weights.nonzero()[0]
    table = candidates.sparkSession.createDataFrame([(int(i), float(weights[i])) for i in used], "index int, weight double")
    sums = terms.join(table, "index").groupBy("row").agg(F.sum(F.col("value") * F.col("weight")).alias("sum"))
    score = F.coalesce("sum", F.lit(0.0)) + float(model.stages[-1].intercept)
    hit = F.col("prediction") == 1.0
    met = scored.join(sums, "row", "left").withColumns({"score": score, COPIES: copies(scored)})
    return met.agg(
        _total(F.lit(True)).alias("candidates"), _total(hit & (F.col("score") < -1e-9)).alias("accepted_wrongly"),
        _total(~hit & (F.col("score") > 1e-9)).alias("refused_wrongly"),
    )


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and the rates from them, in one aggregate; a rate without a base is null."""
    hit, truth = F.col("prediction") == 1.0, F.col("label") == 1.0

    number = copies(predictions)

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, number).otherwise(0)).cast("bigint")

    counts = predictions.groupBy(*by).agg(
        count(hit & truth).alias("tp"),
        count(~hit & ~truth).alias("tn"),
        count(hit & ~truth).alias("fp"),
        count(~hit & truth).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        "*",
        F.try_divide(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(1.0 * fp, fp + tn).alias("fpr"),
        F.try_divide(1.0 * fn, fn + tp).alias("fnr"),
        F.try_divide(1.0 * tp, tp + fn).alias("sensitivity"),
        F.try_divide(1.0 * tn, tn + fp).alias("specificity"),
        # With a hard 0/1 score the ROC curve has one inner point.
        ((F.lit(1.0) + F.try_divide(1.0 * tp, tp + fn) - F.try_divide(1.0 * fp, fp + tn)) / 2).alias("roc"),
    )


def area_under_roc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``(n, positives, area)`` in one row: the share of pairs of a positive and a negative row in which the positive one has the
    higher score, equal scores counting half. Exact: equal scores are one row of counts, and one range sort of these
    gives the negatives below. Rows without a score or label are left out; without both kinds of rows the area is null."""
    truth = F.col(label) == 1.0
    rows = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    number = copies(scored)
    ties = rows.groupBy(F.col(score).alias("score")).agg(_total(truth, number).alias("hits"), _total(~truth, number).alias("misses"))
    ranked = running_sums(ties, "score", upto=F.col("misses"))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("hits", "upto", "misses")]
    pairs = F.sum(wide[0] * (2 * wide[1] - wide[2])).cast("double")
    positives, negatives = F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("misses"), F.lit(0))
    area = F.try_divide(pairs, 2.0 * positives * negatives)
    return ranked.agg((positives + negatives).alias("n"), positives.alias("positives"), area.alias("area"))


def evaluate(model: PipelineModel, training: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics for both parts: confusion counts, rates, and the area under ROC on probabilities."""
    scored = model.transform(training).withColumn("part", F.lit("training")).unionByName(
        model.transform(test).withColumn("part", F.lit("testing"))
    )
    score = F.get(vector_to_array("probability"), F.lit(1)).alias("score")
    scored = cut(scored.select("part", "label", "prediction", score, copies(scored).alias(COPIES)))
    areas = [area_under_roc(scored.filter(F.col("part") == part)).select(F.lit(part).alias("part"), "area") for part in ("training", "testing")]
    areas = areas[0].unionByName(areas[1]).withColumnRenamed("area", "roc_probability")
    return confusion(scored, "part").join(areas, "part")


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
