"""A local text classifier on Spark ML: hashed TF-IDF and logistic regression, with a stratified split."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .agreement import macro_f1_of_truth


#: Hashes are counted by their leading bits first.
LEADING = 12


def stratified_split(df: DataFrame, label_col: str, id_col: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): of each label the share of rows of smallest hash, at least one where it has two.

    The cut of a label is found in two passes: counts of leading bits of the hashes tell in which of their 4096 ranges it
    falls, and only the rows of that range are ranked. So no task sorts a label. The cuts, a row a label, meet the rows by broadcast: a shuffle would bring all of a
    label's rows to one task. Null labels are a label."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    marked = df.withColumn("__h", h).withColumn("__b", F.shiftright(h, 64 - LEADING).cast("int"))
    counts = marked.groupBy(F.col(label_col).alias("__label"), "__b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__label").orderBy("__b"))
    total = F.sum("n").over(Window.partitionBy("__label"))
    cut = F.when(total > 1, F.greatest(F.lit(1), F.floor(total * share))).otherwise(0)
    counts = counts.select("__label", "__b", "n", upto.alias("upto"), cut.alias("cut"))
    at = counts.where((F.col("cut") > F.col("upto") - F.col("n")) & (F.col("cut") <= F.col("upto")))
    at = at.select("__label", F.col("__b").alias("__at"), (F.col("cut") - F.col("upto") + F.col("n")).alias("__need"))
    marked = marked.join(F.broadcast(at), F.col(label_col).eqNullSafe(F.col("__label")), "left").withColumn("__at", F.coalesce("__at", F.lit(-(2**31))))
    inside = F.when(F.col("__b") == F.col("__at"), F.row_number().over(Window.partitionBy("__label", "__b").orderBy("__h", id_col)))
    own = ["__h", "__b", "__label", "__at", "__need", "__place"]
    edge = marked.where("__b = __at").withColumn("__place", inside)
    fit = marked.where("__b > __at").drop(*own).unionByName(edge.where("__place > __need").drop(*own))
    return fit, marked.where("__b < __at").drop(*own).unionByName(edge.where("__place <= __need").drop(*own))


def train(df: DataFrame, text_col: str, label_col: str, features: int = 1 << 14, iterations: int = 50) -> PipelineModel:
    labels = StringIndexer(inputCol=label_col, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    stages = [
        labels, RegexTokenizer(inputCol=text_col, outputCol="__w", pattern=r"(?U)\W+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features), IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__probability", maxIter=iterations, regParam=0.01), IndexToString(inputCol="__p", outputCol="predicted", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """df with predicted and confidence; null texts are read as empty. The label column needn't be there."""
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    fitted = PipelineModel(model.stages[1:])
    out = fitted.transform(rows)
    return out.select(*df.columns, "predicted", F.round(F.array_max(vector_to_array("__probability")), 4).alias("confidence"))


def train_until(fit: DataFrame, held: DataFrame, text_col: str, label_col: str, features: int = 1 << 14, most: int = 160, patience: int = 2) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """(model, history): the model of best macro F1 on the held rows, and (iterations, macro F1) of all that were tried.
    Iterations double from 5 to most, which costs at most twice the last try, until ``patience`` tries bring nothing."""
    best, history, waited, iterations = None, [], 0, 5
    while iterations <= most and waited < patience:
        model = train(fit, text_col, label_col, features, iterations)
        found = predict(model, held, text_col, label_col)
        score = macro_f1_of_truth(found, label_col, "predicted").first()["macro_f1"] or 0.0
        waited = 0 if not history or score > max(f for _, f in history) else waited + 1
        if waited == 0:
            best = model
        history.append((iterations, score))
        iterations *= 2
    return best, history


def save(model: PipelineModel, path: str) -> None:
    """Keeps a model in a folder, over what was there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
