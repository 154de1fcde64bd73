"""A detector of synthetic speech on pooled features: split, fit, score, evaluate, save and load, with spark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from . import scoring

ITERATIONS, PENALTY = 50, 0.01


def pooled(features: DataFrame) -> DataFrame:
    """features(vec_id, frame_idx, coefficients) to vec_id, pooled: mean and deviation of each coefficient over the frames."""
    rows = features.select("vec_id", F.posexplode("coefficients").alias("k", "v")).groupBy("vec_id", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct("k", "m", "s")))  # one entry for each coefficient
    return rows.groupBy("vec_id").agg(F.concat(F.transform(listed, lambda r: r["m"]), F.transform(listed, lambda r: r["s"])).alias("pooled"))


def fit(rows: DataFrame, iterations: int = ITERATIONS, penalty: float = PENALTY) -> tuple[PipelineModel, list[float]]:
    """rows(pooled, label 0/1): the model, and the loss after each iteration."""
    vectors = rows.select(array_to_vector(F.col("pooled").cast("array<double>")).alias("pooled_vector"), F.col("label").cast("double").alias("label"))
    steps = [StandardScaler(inputCol="pooled_vector", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", maxIter=iterations, regParam=penalty)]
    model = Pipeline(stages=steps).fit(vectors)
    return model, list(model.stages[-1].summary.objectiveHistory)


def scores(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with p (of label 1) and decision."""
    vectors = rows.withColumn("pooled_vector", array_to_vector(F.col("pooled").cast("array<double>")))
    p = vector_to_array("probability")[1]
    return model.transform(vectors).withColumn("p", p).withColumn("decision", scoring.decision(F.col("p"))).select(*rows.columns, "p", "decision")


def evaluated(scored: DataFrame) -> DataFrame:
    """One row: accuracy, loss, n, eer, threshold of rows(label, p)."""
    return scoring.accuracy_and_loss(scored).crossJoin(F.broadcast(scoring.equal_error_rate(scored.select("label", F.col("p").alias("score")))))  # one row each


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_and_evaluate(rows: DataFrame, path: str) -> DataFrame:
    """rows(vec_id, pooled, label): fits on the first part of each label, saves and reloads the model, and evaluates it on the other part."""
    parts = scoring.stratified_split(rows, "label", "vec_id")
    model, _ = fit(parts.where("part = 'train'"))
    return evaluated(scores(parts.where("part = 'val'"), load(save(model, path))))


#: What an epoch leaves behind.
EPOCH = "epoch int, weights array<double>, bias double, train_loss double, val_loss double, val_accuracy double, val_eer double"


def standardised(rows: DataFrame, part: str = "part") -> DataFrame:
    """rows with pooled less the mean of the training part, over its deviation (constant columns are only centred). The moments are one row of a few numbers."""
    each = rows.where(F.col(part) == "train").select(F.posexplode("pooled").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = each.agg(F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")).alias("s")))).alias("moments"))
    scaled = F.zip_with("pooled", "moments", lambda v, m: (v - m["m"]) / m["s"])
    return rows.crossJoin(F.broadcast(moments)).withColumn("pooled", scaled).drop("moments")


def probability(weights: list[float], bias: float):
    """p of label 1 of the column pooled."""
    w = F.array(*map(F.lit, weights))
    z = F.aggregate(F.zip_with("pooled", w, lambda x, y: x * y), F.lit(float(bias)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def epochs_of(spark: SparkSession, folder: str, at_most: int) -> list[Row]:
    """The epochs that stand in a folder without a gap, up to so many."""
    out = []
    for k in range(at_most):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch-{k}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            break
        out.append(spark.read.schema(EPOCH).json(f"{folder}/epoch-{k}").first())
    return out


def fit_epochs(rows: DataFrame, folder: str, epochs: int = 10, batches: int = 1, rate: float = 1.0, penalty: float = PENALTY) -> list[Row]:
    """Logistic regression of rows(vec_id, pooled (standardised), label 0/1, part train/val) by gradient steps; what each epoch leaves behind, in order.

    An epoch deals the training rows anew over so many batches by a hash, takes a step for each (a gradient is a sum by coefficient, added up in the tasks first), then
    measures loss on both parts and accuracy and equal error rate on the other one, and writes all that with the weights to the folder. A run over a folder with epochs goes
    on after the last whole one, so a lost driver costs an epoch at most.
    """
    spark = rows.sparkSession
    path = new_path(spark, "epochs")  # read many times
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    done = epochs_of(spark, folder, epochs)
    weights, bias = (list(done[-1].weights), done[-1].bias) if done else ([0.0] * (rows.agg(F.max(F.size("pooled"))).first()[0] or 0), 0.0)
    train = rows.where("part = 'train'")
    for epoch in range(len(done), epochs):
        for batch in range(batches):
            own = train.where(F.pmod(F.xxhash64("vec_id", F.lit(epoch)), F.lit(batches)) == batch) if batches > 1 else train
            gap = (probability(weights, bias) - F.col("label")).alias("gap")
            long = own.select(gap, F.posexplode(F.concat("pooled", F.array(F.lit(1.0)))).alias("k", "v"))
            gradient = {r.k: r.g for r in long.groupBy("k").agg(F.avg(F.col("gap") * F.col("v")).alias("g")).collect()}  # as many rows as coefficients
            if gradient:
                weights = [w - rate * (gradient[k] + penalty * w) for k, w in enumerate(weights)]
                bias -= rate * gradient[len(weights)]
        scored = rows.select("part", "label", probability(weights, bias).alias("p"))
        losses = scored.where("part = 'train'")
        val = scored.where("part = 'val'")
        known = scoring.accuracy_and_loss(val).first()
        eer = scoring.equal_error_rate(val.select("label", F.col("p").alias("score"))).first()
        row = (epoch, weights, bias, scoring.accuracy_and_loss(losses).first()["loss"], known["loss"], known["accuracy"], eer["eer"] if eer else None)
        spark.createDataFrame([row], EPOCH).coalesce(1).write.mode("overwrite").json(f"{folder}/epoch-{epoch}")
        done.append(epochs_of(spark, folder, epoch + 1)[-1])
    return done


def history(spark: SparkSession, folder: str, epochs: int) -> DataFrame:
    """epoch, train_loss, val_loss, val_accuracy, val_eer, weights, bias of a folder's epochs."""
    return spark.createDataFrame(epochs_of(spark, folder, epochs), EPOCH)
