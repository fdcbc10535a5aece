"""Class labels and classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.functions import ids, vectors


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class").agg(F.count("*").alias("n"))


def majority_baseline(labels: DataFrame) -> DataFrame:
    """One line: the largest class and its share of all files."""
    counts = class_counts(labels)
    return counts.agg(
        F.max_by("class", F.struct(F.col("n"), F.col("class"))).alias("class"),
        F.max("n").alias("n"),
        F.sum("n").alias("total"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def of_classes(labels: DataFrame, classes: Sequence) -> DataFrame:
    return labels.filter(F.col("class").isin(*classes))


def with_minimum(labels: DataFrame, least: int = 2) -> DataFrame:
    """Labels of classes with at least `least` files."""
    large = class_counts(labels).filter(F.col("n") >= least).select("class")
    return labels.join(large, "class", "left_semi")


def labels_from_paths(paths: DataFrame, level: int = 0, id_col: str = "id") -> DataFrame:
    return paths.select(id_col, ids.class_from_path(F.col(id_col), level).alias("class"))


def labels_from_names(paths: DataFrame, separator: str = "_", id_col: str = "id") -> DataFrame:
    return paths.select(id_col, ids.class_from_prefix(ids.base_name(F.col(id_col)), separator).alias("class"))


def encode(labels: DataFrame) -> DataFrame:
    """Class numbers in alphabetical order."""
    names = labels.withColumn("class", F.col("class").cast("string"))
    indexer = StringIndexer(inputCol="class", outputCol="class_index", stringOrderType="alphabetAsc")
    return indexer.fit(names).transform(names)


def listed_classes(labels: DataFrame, known: Sequence = ()) -> list:
    """The known classes, then all others that the column `class` has. Rows without class have none."""
    found = {r[0] for r in labels.select("class").distinct().collect()} - {None}
    return [*known, *sorted(found - set(known))]


def to_table(labels: DataFrame, classes: Sequence) -> DataFrame:
    """(id, class) to one 0/1 column per class; an id may have several classes."""
    marks = [F.max((F.col("class") == c).cast("int")).alias(str(c)) for c in classes]
    return labels.groupBy("id").agg(*marks)


def from_table(table: DataFrame, classes: Sequence) -> DataFrame:
    """0/1 columns back to (id, class)."""
    entries = [F.struct(F.lit(str(c)).alias("class"), F.col(f"`{c}`").alias("mark")) for c in classes]
    return table.select("id", F.inline(F.array(*entries))).filter(F.col("mark") == 1).select("id", "class")


def accuracy(predictions: DataFrame, truth: str = "class", predicted: str = "predicted_class") -> DataFrame:
    right = (F.col(truth) == F.col(predicted)).cast("double")
    return predictions.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


# Classifiers -----------------------------------------------------------------------------------


def _prepared(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(vectors.doubles(F.col(features))))


def _stages(label: str, iterations: int) -> list:
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    svm = LinearSVC(featuresCol="_scaled", labelCol=label, maxIter=iterations, regParam=0.01)
    return [scaler, svm]


def svm_pipeline(labels: Sequence[str], iterations: int = 20) -> Pipeline:
    """Standardise, then one linear SVM per class against the rest."""
    indexer = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc")
    scaler, svm = _stages("label", iterations)
    rest = OneVsRest(classifier=svm, featuresCol="_scaled", labelCol="label", predictionCol="prediction", parallelism=4)
    names = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=list(labels))
    return Pipeline(stages=[indexer, scaler, rest, names])


def _class_names(df: DataFrame) -> list[str]:
    return [r["class"] for r in df.select("class").distinct().orderBy("class").toLocalIterator()]


def train(df: DataFrame, features: str = "rp", iterations: int = 20) -> PipelineModel:
    df = _prepared(df.withColumn("class", F.col("class").cast("string")), features)
    return svm_pipeline(_class_names(df), iterations).fit(df)


def classify(model: PipelineModel, df: DataFrame, features: str = "rp") -> DataFrame:
    """id, class (if there) and predicted_class."""
    if "class" in df.columns:
        df = df.withColumn("class", F.col("class").cast("string"))
    out = model.transform(_prepared(df, features))
    return out.select(*[c for c in ("id", "class") if c in df.columns], "predicted_class")


def cross_validate(df: DataFrame, features: str = "rp", folds: int = 10, iterations: int = 20, seed: int = 1) -> CrossValidatorModel:
    """k-fold accuracy of the whole pipeline, `avgMetrics` and `stdMetrics` on the result."""
    df = _prepared(df.withColumn("class", F.col("class").cast("string")), features)
    names = _class_names(df)
    indexed = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)
    pipeline = Pipeline(stages=svm_pipeline(names, iterations).getStages()[1:])
    return CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        parallelism=4,
        seed=seed,
    ).fit(indexed)


def cross_validate_columns(
    df: DataFrame, columns: Sequence[str], features: str = "rp", folds: int = 10, iterations: int = 20, seed: int = 1
) -> DataFrame:
    """Multi-label: mean accuracy per 0/1 column, each column its own problem."""
    df = _prepared(df, features)
    results = []
    for column in columns:
        problem = df.withColumn("label", F.col(column).cast("double"))
        pipeline = Pipeline(stages=_stages("label", iterations))
        model = CrossValidator(
            estimator=pipeline,
            estimatorParamMaps=ParamGridBuilder().build(),
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            numFolds=folds,
            parallelism=4,
            seed=seed,
        ).fit(problem)
        results.append((column, float(model.avgMetrics[0])))
    return df.sparkSession.createDataFrame(results, "category string, accuracy double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
