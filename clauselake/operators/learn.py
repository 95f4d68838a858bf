"""Text classifiers on Spark ML: split, train, score, grade, save."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from clauselake.functions.text import let, unfold

FEATURES = 1 << 16


def encode_labels(rows: DataFrame, labels: list[str], column: str = "label") -> DataFrame:
    """Index of the label in the given list; an unknown label gets index 0."""
    arr = F.array(*[F.lit(x) for x in labels])
    return rows.withColumn("label_idx", F.greatest(F.array_position(arr, F.col(column)) - 1, F.lit(0)).cast("int"))


def label_name(index: Column, labels: list[str]) -> Column:
    chain = F
    for i, name in enumerate(labels):
        chain = chain.when(index == i, F.lit(name))
    return chain.otherwise(F.concat(F.lit("unknown_"), index.cast("string")))


def split_rows(rows: DataFrame, key: str, label: str | None = None, share: float = 0.2, seed: int = 42,
               per_bucket: int = 10_000, buckets: int | None = None) -> DataFrame:
    """Add is_validation: a fixed share of the rows, of every label when a label is given.

    The order within a label is a seeded hash of the key.  Hash buckets are
    counted first: all but one of a label lie wholly on one side of the cut, so
    only the keys of that bucket are ranked.  There are more buckets the more
    rows there are (`per_bucket` on average).
    """
    if buckets is None:
        buckets = min(1 << 20, max(16, rows.count() // per_bucket))
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    out = rows.withColumn("h", digest).withColumn("b", 
        F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("int"))
    group = [label] if label else []
    # a count per label and bucket
    sizes = out.groupBy(*group, "b").agg(F.count("*").alias("size"))
    upto = W.partitionBy(*group).orderBy("b")
    sizes = (sizes.withColumn("before", F.sum("size").over(upto.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
             .withColumn("total", F.sum("size").over(W.partitionBy(*group)))
             .withColumn("quota", F.ceil(F.col("total") * share)))
    sizes = sizes.where("before < quota").select(*[F.col(g).alias("_g") for g in group], F.col("b").alias("_b"), "before", "quota",
                                                 (F.col("before") + F.col("size") <= F.col("quota")).alias("whole"))
    same = [F.col(g).eqNullSafe(F.col("_g")) for g in group] + [F.col("b") == F.col("_b")]
    placed = out.join(sizes, reduce(lambda a, b: a & b, same), "left")
    cut = (placed.where("not whole").select(key, *group, "h", "before", "quota")
           .withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("h", key)))
           .where(F.col("before") + F.col("r") <= F.col("quota")).select(F.col(key).alias("_key"), F.lit(True).alias("in")).distinct())
    return (placed.join(cut, placed[key] == F.col("_key"), "left")
            .withColumn("is_validation", F.coalesce(F.col("whole") | F.col("in"), F.col("whole"), F.col("in"), F.lit(False)))
            .select(*rows.columns, "is_validation"))


def classifier(max_iter: int = 20, features: int = FEATURES) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="label_idx", featuresCol="features", maxIter=max_iter, regParam=0.01),
    ])


def count_classifier(features: list[str], smoothing: float = 1.0) -> Pipeline:
    """A multinomial model of counts: one pass of sums per label, which any other engine can work out again."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                            NaiveBayes(labelCol="label_idx", featuresCol="features", smoothing=smoothing)])


def train(rows: DataFrame, max_iter: int = 20, pipeline: Pipeline | None = None) -> PipelineModel:
    """Fit on the rows that are not held out, the text classifier or a `pipeline` of your own."""
    return (pipeline or classifier(max_iter)).fit(rows.where("not is_validation"))


def score(model: PipelineModel, rows: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """(keys…, label, confidence): the likeliest class and its probability."""
    probs = vector_to_array("probability")
    return (model.transform(rows)
            .select(*keys, F.col("prediction").cast("int").alias("prediction"), F.array_max(probs).alias("confidence"))
            .withColumn("label", label_name(F.col("prediction"), labels)))


def quality(scored: DataFrame, truth: str = "label_idx", prediction: str = "prediction") -> DataFrame:
    """Accuracy and weighted precision, recall and F1 from the confusion counts."""
    cells = scored.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    by_truth = W.partitionBy(truth)
    by_guess = W.partitionBy(prediction)
    rows = (cells.withColumn("support", F.sum("n").over(by_truth)).withColumn("guessed", F.sum("n").over(by_guess))
            .withColumn("hit", F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)))
    classes = rows.groupBy(truth).agg(F.max("support").alias("support"), F.sum("hit").alias("hit"),
                                      F.max(F.when(F.col("hit") > 0, F.col("guessed"))).alias("guessed"))
    p = F.coalesce(F.col("hit") / F.col("guessed"), F.lit(0.0))
    r = F.col("hit") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    total = F.sum("support")
    return classes.agg((F.sum("hit") / total).alias("accuracy"),
                       (F.sum(p * F.col("support")) / total).alias("precision"),
                       (F.sum(r * F.col("support")) / total).alias("recall"),
                       (F.sum(f1 * F.col("support")) / total).alias("f1"), total.alias("n"))


def save_model(model: PipelineModel, path: str, labels: list[str], kind: str, rows: int) -> None:
    """Model and a one-row description next to it."""
    spark = _session()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(kind, labels, rows)], "kind string, labels array<string>, training_rows bigint") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), _session().read.json(f"{path}/metadata")


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def external_model(make_predict: Callable, max_chars: int | None = None, batch_size: int = 8) -> Callable[[Column], Column]:
    """Hook for a model of your own.

    `make_predict()` runs once per Python worker, loads the model and returns a
    function from an array of texts to {"label": …, "confidence": …}; Spark
    hands it Arrow batches.  Texts are given whole; for a model that reads at
    most so many characters use `score_windows`, or cut them by `max_chars`.
    """
    udf = predict_batch_udf(
        make_predict, batch_size=batch_size,
        return_type=T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    return lambda text: udf(text if max_chars is None else F.left(text, F.lit(max_chars)))


def text_windows(text: Column, width: int, overlap: int) -> Column:
    """Windows of `width` characters that overlap, in order; a short or empty text is one, a null text none.

    The text is cut once into blocks and windows are put together from them, so
    the cost follows the length of the text.
    """
    step = width - overlap
    if not 0 <= overlap < width:
        raise ValueError("windows must be wider than their overlap")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.floor((F.greatest(F.length(text) - overlap, F.lit(1)) - 1) / step).cast("int")
    return let(blocks, lambda cut: F.transform(F.sequence(F.lit(0), last), lambda i: F.left(
        F.array_join(F.slice(cut, i + 1, -(-width // step)), ""), F.lit(width))))


def score_windows(rows: DataFrame, model: Callable[[Column], Column], keys: list[str], text: str = "text", width: int = 4000,
                  overlap: int = 200) -> DataFrame:
    """(keys…, label, confidence) of whole texts by a model that reads `width` characters at a time.

    Every text is cut into windows that overlap, all windows are scored, and the
    surest window of a text decides (of equals the first label).  Null texts have
    no windows and no row.
    """
    windows = unfold(rows, keys, text_windows(F.col(text), width, overlap), "at", "window")
    best = F.struct((-F.col("s.confidence")).alias("order"), F.col("s.label").alias("label"))
    scored = windows.select(*keys, model(F.col("window")).alias("s")).groupBy(*keys).agg(F.min(best).alias("best"))
    return scored.select(*keys, "best.label", (-F.col("best.order")).alias("confidence"))
