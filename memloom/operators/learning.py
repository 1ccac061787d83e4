"""Learned parts: what gets lost, clusters of artifacts, and blended importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as C


def _assembled(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def fit_loss(rows: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """Logistic regression with weights that balance the classes; C = 1."""
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("y")).first()
    if not n.y or n.y == n.n:
        raise ValueError("both classes are needed")
    weighted = rows.withColumn("w", F.when(F.col(label) == 1, F.lit(n.n / (2 * n.y))).otherwise(F.lit(n.n / (2 * (n.n - n.y)))))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", regParam=1.0 / n.n, maxIter=100)
    return Pipeline(stages=[*_assembled(columns), model]).fit(weighted)


def fit_vulnerability(rows: DataFrame, columns: list[str], label: str, alpha: float = 1.0) -> PipelineModel:
    """Ridge regression on scaled features."""
    ridge = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha / max(1, rows.count()), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[*_assembled(columns), ridge]).fit(rows)


def clusters(rows: DataFrame, embedding: str, k: int = 8, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means; rows without a usable vector are the caller's to drop."""
    v = rows.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).drop("features")


def learned_importance(artifacts: DataFrame, rates: DataFrame) -> DataFrame:
    """(id, importance): half type prior, half success rate of the type, times confidence, a fifth more for musts, at most 1."""
    r = rates.select("obj_type", F.col("rate").alias("r"))
    weight = 0.5 * C.type_weight(F.col("obj_type")) + 0.5 * F.coalesce("r", F.lit(0.5))
    must = F.when(F.coalesce(F.col("content").rlike(r"(?i)\b(must|require|required|critical|important)\b"), F.lit(False)), 1.2).otherwise(1.0)
    score = F.least(F.lit(1.0), weight * F.coalesce("confidence", F.lit(0.0)) * must)
    return artifacts.join(r, "obj_type", "left").select("id", F.round(score, 6).alias("importance"))


def evaluation(rows: DataFrame, truth: str, guess: str, bar: float = 0.1) -> DataFrame:
    """(mse, precision, recall): predictions clipped to 0..1."""
    g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(guess)))
    hit, said, real = (g > bar) & (F.col(truth) > bar), g > bar, F.col(truth) > bar
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(F.avg(F.pow(g - F.col(truth), 2)).alias("mse"), F.try_divide(n(hit), n(said)).alias("precision"), F.try_divide(n(hit), n(real)).alias("recall"))


def tfidf(rows: DataFrame, text: str, vocabulary: int = 500, dims: int = 50) -> DataFrame:
    """Adds ``vec``: the words of a text weighted by TF-IDF and reduced to their principal directions; the fallback where no embedding model is at hand."""
    width = min(dims, vocabulary)
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    stages = [words, StopWordsRemover(inputCol="_words", outputCol="_kept"), CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=vocabulary), IDF(inputCol="_tf", outputCol="_idf")]
    weighted = Pipeline(stages=stages).fit(rows).transform(rows)
    size = weighted.select("_idf").first()._idf.size  # one row tells the size of the vocabulary that was found
    reduced = PCA(k=min(width, size), inputCol="_idf", outputCol="_pc").fit(weighted).transform(weighted)
    return reduced.withColumn("vec", vector_to_array("_pc")).drop("_words", "_kept", "_tf", "_idf", "_pc")


def cluster_words(rows: DataFrame, words: str, most: int = 5) -> DataFrame:
    """(cluster, n, words, importance) of rows with a ``cluster``: the size, the most frequent words, and equal shares of importance."""
    n = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = rows.select("cluster", F.explode(words).alias("word")).groupBy("cluster", "word").count()
    w = Window.partitionBy("cluster").orderBy(F.desc("count"), "word")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("words"))
    total = n.agg(F.count("*").alias("k"))
    return n.join(top, "cluster", "left").crossJoin(F.broadcast(total)).select("cluster", "n", "words", (1 / F.col("k")).alias("importance"))
