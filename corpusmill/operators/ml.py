"""Text classification and clustering on spark.ml: character tf-idf, balanced logistic regression, cross-validated scores, k-means."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.sampling import folds
from corpusmill.session import materialise


#: Rows that a task of the optimiser takes.
ROWS_A_TASK = 2000
#: Classes that are weighed, at most.
MOST_CLASSES = 1000


def character_ngrams(c: Column | str, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, words padded with a blank at either end; a word shorter than n gives itself once."""
    words = F.transform(T.tokens(T.fold(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        return F.transform(at, lambda i: F.substring(w, i, F.lit(n)))

    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def text_pipeline(grams: str, vocabulary: int = 200_000, least: int = 2) -> list:
    """Counts, inverse document frequency, unit length."""
    return [
        CountVectorizer(inputCol=grams, outputCol="__tf", vocabSize=vocabulary, minDF=least),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__features", p=2.0),
    ]


def logistic(weights: float) -> LogisticRegression:
    """L2 logistic regression of strength C = 1 (the penalty is shared by all rows), not standardised."""
    return LogisticRegression(featuresCol="__features", labelCol="y", weightCol="__w", regParam=1.0 / max(weights, 1.0), standardization=False, maxIter=100, tol=1e-5)


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Weights that give both classes the same total: n / (2 * n of the class)."""
    n = {r[0]: r[1] for r in df.groupBy(y).count().limit(MOST_CLASSES + 1).collect()}
    if len(n) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    total = sum(n.values())
    w = F.lit(0.0)
    for k, c in n.items():
        w = F.when(F.col(y) == k, F.lit(total / (len(n) * c))).otherwise(w)
    return df.withColumn("__w", w)


def fit_text(df: DataFrame, text: str, y: str = "y") -> PipelineModel:
    """A classifier of texts; NULL texts count as blank. Two classes are needed."""
    return _fit(df.select(F.col(y).alias("y"), character_ngrams(F.coalesce(F.col(text), F.lit(""))).alias("__grams")))


def _fit(df: DataFrame) -> PipelineModel:
    features = Pipeline(stages=text_pipeline("__grams")).fit(df)
    x = features.transform(df).select(F.col("y").cast("double").alias("y"), "__features")
    rows = df.count()
    # every step of the optimiser is a job: few rows are better off in few tasks
    x = balanced(x).coalesce(max(1, rows // ROWS_A_TASK)).cache()
    model = logistic(rows).fit(x)
    x.unpersist()
    return PipelineModel([*features.stages, model])


def score_text(model: PipelineModel, df: DataFrame, text: str, threshold: float = 0.5) -> DataFrame:
    """All rows with probability and predicted class."""
    x = _score(model, df.withColumn("__grams", character_ngrams(F.coalesce(F.col(text), F.lit("")))), threshold)
    return x.select(*df.columns, "probability", "predicted")


def _score(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    x = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
    return x.withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def cross_validated(df: DataFrame, id_col: str, text: str, y: str = "y", k: int = 5) -> DataFrame:
    """(id, y, fold, probability): each row scored by a model that hasn't seen it."""
    x = folds(df.select(id_col, F.col(text), F.col(y).alias("y")), ["y"], k, id_col)
    # the n-grams are the same in every fold: they are made once
    x = x.select(id_col, "y", "fold", character_ngrams(F.coalesce(F.col(text), F.lit(""))).alias("__grams"))
    x = materialise(x, "grams")
    out = None
    for f in range(k):
        m = _fit(x.where(F.col("fold") != f))
        s = _score(m, x.where(F.col("fold") == f), 0.5).select(id_col, "y", "fold", F.round("probability", 6).alias("probability"))
        out = s if out is None else out.union(s)
    return out


def vectors(df: DataFrame, column: str) -> DataFrame:
    """Arrays as vectors of unit length."""
    return Normalizer(inputCol="__v", outputCol="__features").transform(df.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))).drop("__v")


def clusters(df: DataFrame, column: str, k: int, seeds: int = 20) -> tuple[DataFrame, float]:
    """Rows with their cluster by the best of `seeds` k-means runs, and the mean silhouette by cosine."""
    x = materialise(vectors(df, column), "vectors")
    best = min((KMeans(k=k, seed=s, featuresCol="__features", predictionCol="cluster").fit(x) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    out = best.transform(x)
    s = ClusteringEvaluator(featuresCol="__features", predictionCol="cluster", distanceMeasure="cosine").evaluate(out)
    return out.drop("__features"), s


def reduced_clusters(df: DataFrame, column: str, k: int, dimensions: int = 5, least: int = 30, seed: int = 7) -> DataFrame:
    """Five principal components and a divisive clustering: what stands in for density clustering of a learned layout. Clusters below `least` rows are outliers (-1)."""
    x = vectors(df, column)
    x = PCA(k=dimensions, inputCol="__features", outputCol="__pca").fit(x).transform(x)
    m = BisectingKMeans(k=k, minDivisibleClusterSize=least, seed=seed, featuresCol="__pca", predictionCol="topic").fit(x)
    out = m.transform(x).drop("__pca", "__features")
    small = out.groupBy("topic").count().where(F.col("count") < least).select("topic", F.lit(True).alias("__small"))
    return out.join(F.broadcast(small), "topic", "left").withColumn("topic", F.when(F.col("__small"), -1).otherwise(F.col("topic"))).drop("__small")


def silhouette(df: DataFrame, column: str, label: str) -> DataFrame:
    """Mean silhouette of given labels by cosine distance, from sums of unit vectors: no pairs of rows are formed."""
    x = vectors(df.withColumn("__label", F.col(label).cast("int")), column)
    value = ClusteringEvaluator(featuresCol="__features", predictionCol="__label", distanceMeasure="cosine").evaluate(x)
    return df.sparkSession.createDataFrame([(df.count(), round(value, 6))], "n_rows long, silhouette double")


def stability(df: DataFrame, id_col: str, column: str, ks: list[int], repeats: int = 3, share: float = 0.8) -> DataFrame:
    """(k, mean_ari): how alike the clusterings of resamples are to that of all rows, for each number of clusters; models are few, rows stay distributed."""
    from corpusmill.operators.metrics import rand_index
    from corpusmill.operators.sampling import resamples

    x = materialise(vectors(df.select(id_col, column), column), "vectors")
    drawn = materialise(resamples(x.select(id_col), repeats, share, id_col), "drawn")
    out = None
    for k in ks:
        full = KMeans(k=k, seed=1, featuresCol="__features", predictionCol="a").fit(x).transform(x).select(id_col, "a")
        for r in range(1, repeats + 1):
            part = x.join(drawn.where(F.col("repeat") == r).select(id_col), id_col)
            p = KMeans(k=k, seed=1, featuresCol="__features", predictionCol="b").fit(part).transform(part).select(id_col, "b")
            one = rand_index(full.join(p, id_col), "a", "b").select(F.lit(k).alias("k"), "ari")
            out = one if out is None else out.union(one)
    return out.groupBy("k").agg(F.round(F.avg("ari"), 6).alias("mean_ari"))
