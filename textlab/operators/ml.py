"""Class-weighted text classifiers on Spark ML, their soft-vote ensemble,
model selection by positive-class F1, parameter search and save / reload.

The original members are fine-tuned transformers; here each member is a
Spark ML ``Pipeline`` (regex tokens -> stop words -> hashed term frequencies ->
IDF -> classifier with a per-row class weight) over the whole text,
trained and applied by Spark on the executors.  Outputs have the same long
shape as any other model output: ``(par_id, model, p)``.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, ENGLISH_STOP_WORDS, SPLIT_SEED
from ..functions.text import TOKEN_PATTERN

# Spark-side members and their vote weights (same weight values, by position,
# as the transformer catalogue).
MEMBER_WEIGHTS = {"tfidf_logreg": 1.2, "naive_bayes": 0.9, "bigram_logreg": 0.9}


def training_frame(df: DataFrame, text: str = "text", label: str = "label",
                   weights=CLASS_WEIGHTS) -> DataFrame:
    """``(par_id, text, label DOUBLE, weight)`` with the class weight per row."""
    y = F.col(label).cast("double")
    return df.select("par_id", F.coalesce(F.col(text), F.lit("")).alias("text"), y.alias("label"),
                     F.when(y == 1.0, F.lit(weights[1])).otherwise(F.lit(weights[0])).alias("weight"))


#: Hash buckets of the term features.  Terms that share a bucket are one feature:
#: 2^18 keeps that rare for vocabularies up to about 10^5 terms.
NUM_FEATURES = 1 << 18


def _front(ngram: int = 1, num_features: int = NUM_FEATURES, max_tokens: int | None = None):
    """Text stages.  ``max_tokens`` cuts a text (for models with a fixed input
    length); hashed counts read the whole text, so the default is no cut."""
    tok = RegexTokenizer(inputCol="text", outputCol="tok_all", pattern=TOKEN_PATTERN, gaps=False,
                         toLowercase=True)
    stages, col = [tok], "tok_all"
    if max_tokens:
        stages.append(SQLTransformer(statement=f"SELECT *, slice(tok_all, 1, {int(max_tokens)}) AS tok_cut FROM __THIS__"))
        col = "tok_cut"
    stages.append(StopWordsRemover(inputCol=col, outputCol="tok", stopWords=list(ENGLISH_STOP_WORDS)))
    col = "tok"
    if ngram > 1:
        stages.append(NGram(n=ngram, inputCol="tok", outputCol=f"grams{ngram}"))
        col = f"grams{ngram}"
    return stages + [HashingTF(inputCol=col, outputCol=f"tf{ngram}", numFeatures=num_features),
                     IDF(inputCol=f"tf{ngram}", outputCol=f"features{ngram}")]


def _classifiers() -> dict:
    return {
        "tfidf_logreg": (1, LogisticRegression(featuresCol="features1", labelCol="label", weightCol="weight",
                                               maxIter=30, regParam=0.01)),
        "naive_bayes": (1, NaiveBayes(featuresCol="tf1", labelCol="label", weightCol="weight",
                                      modelType="multinomial")),
        "bigram_logreg": (2, LogisticRegression(featuresCol="features2", labelCol="label", weightCol="weight",
                                                maxIter=30, regParam=0.01)),
    }


def member_pipelines() -> dict[str, Pipeline]:
    return {name: Pipeline(stages=_front(n) + [clf]) for name, (n, clf) in _classifiers().items()}


def _few_parts(spark: SparkSession) -> SQLTransformer:
    """A stage that leaves no more partitions than the cluster has cores (no shuffle, no row less).

    Every step of a fit sends a vector of ``NUM_FEATURES`` doubles from each partition;
    with partitions that grow with the table, a fit would be slowed by those vectors.
    """
    return SQLTransformer(statement=f"SELECT /*+ COALESCE({spark.sparkContext.defaultParallelism}) */ * FROM __THIS__")


def featurize(train: DataFrame, *sizes: int) -> tuple[dict, DataFrame]:
    """Text stages and feature rows for every n-gram size, and the counts behind them.

    All sizes share one pass over the texts: the hashed counts of each are persisted
    side by side, and IDF is fitted on and applied to them, so nothing re-runs the tokenizer.
    """
    fronts, done, counts = {n: _front(n) for n in sizes}, set(), train
    for front in fronts.values():
        for stage in front[:-1]:
            if stage.getOutputCol() not in done:
                done.add(stage.getOutputCol())
                counts = stage.transform(counts)
    counts = counts.select("par_id", "label", "weight", *[f"tf{n}" for n in sizes]).persist()
    few = _few_parts(train.sparkSession).transform(counts)
    fitted = {n: [*front[:-1], front[-1].fit(few)] for n, front in fronts.items()}
    return {n: (stages, stages[-1].transform(few)) for n, stages in fitted.items()}, counts


def train_members(train: DataFrame) -> dict[str, PipelineModel]:
    """Each member = fitted front + fitted classifier, as one PipelineModel.  The
    classifiers are independent Spark jobs and are fitted side by side."""
    members = _classifiers()
    fronts, counts = featurize(train, *sorted({n for n, _ in members.values()}))

    @inheritable_thread_target(train.sparkSession)
    def fitted(name: str) -> PipelineModel:
        n, clf = members[name]
        stages, feats = fronts[n]
        return PipelineModel(stages=[*stages, clf.fit(feats)])

    pool = ThreadPool(len(members))
    try:
        return dict(zip(members, pool.map(fitted, members)))
    finally:
        pool.close()
        counts.unpersist()


def score_wide(models: dict[str, PipelineModel], df: DataFrame, key: str = "par_id") -> DataFrame:
    """``key, p_<model>, pred_<model>, z_<model>`` of every row, in one pass: the
    members share the text stages, so each stage runs once and the classifiers
    are applied to the same frame.  No row is moved."""
    out, done = df.select(key, "text"), set()
    for name, m in models.items():
        *front, clf = m.stages
        for stage in front:
            if stage.getOutputCol() not in done:
                done.add(stage.getOutputCol())
                out = stage.transform(out)
        named = clf.copy({clf.probabilityCol: f"prob_{name}", clf.rawPredictionCol: f"raw_{name}",
                          clf.predictionCol: f"hard_{name}"})
        out = named.transform(out)
    return out.select(key, *[c for name in models for c in (
        vector_to_array(f"prob_{name}")[1].alias(f"p_{name}"), F.col(f"hard_{name}").cast("int").alias(f"pred_{name}"),
        vector_to_array(f"raw_{name}").alias(f"z_{name}"))])


def score_members(models: dict[str, PipelineModel], df: DataFrame, key: str = "par_id") -> DataFrame:
    """Long ``(key, model, p, pred)``: P(class 1) and hard prediction, cut from the wide scores."""
    return score_wide(models, df, key).select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"p_{name}").alias("p"), F.col(f"pred_{name}").alias("pred"))
        for name in models])))


def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)


def _tuned(train: DataFrame) -> tuple[Pipeline, LogisticRegression, DataFrame]:
    """Text front up to the counts (fitted on no row), then IDF and classifier as
    the estimator to tune: IDF never sees a validation row."""
    *counts, idf = _front()
    feats = Pipeline(stages=counts).fit(train).transform(train).select("label", "weight", "tf1").persist()
    lr = LogisticRegression(featuresCol="features1", labelCol="label", weightCol="weight", maxIter=30)
    return Pipeline(stages=[_few_parts(train.sparkSession), idf, lr]), lr, feats


def best_by_f1(train: DataFrame, reg_params=(0.0, 0.01, 0.1)) -> tuple[object, DataFrame]:
    """Keep the candidate with the best validation F1 (positive class)."""
    pipe, lr, feats = _tuned(train)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    tvs = TrainValidationSplit(estimator=pipe, estimatorParamMaps=grid, evaluator=f1_evaluator(),
                               trainRatio=0.8, seed=SPLIT_SEED, parallelism=len(grid))
    try:
        model = tvs.fit(feats)
    finally:
        feats.unpersist()
    rows = [(float(pm[lr.regParam]), float(m)) for pm, m in zip(grid, model.validationMetrics)]
    table = train.sparkSession.createDataFrame(rows, "reg_param double, f1 double")
    return model, table


def param_search(train: DataFrame, folds: int = 3) -> DataFrame:
    """Cross-validated grid search; one row per candidate with its mean F1."""
    pipe, lr, feats = _tuned(train)
    grid = (ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1])
            .addGrid(lr.elasticNetParam, [0.0, 0.5]).build())
    # candidate fits are independent Spark jobs: run them side by side
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=f1_evaluator(),
                        numFolds=folds, seed=SPLIT_SEED, parallelism=len(grid))
    try:
        model = cv.fit(feats)
    finally:
        feats.unpersist()
    rows = [("tfidf_logreg", float(pm[lr.regParam]), float(pm[lr.elasticNetParam]), float(m))
            for pm, m in zip(grid, model.avgMetrics)]
    return train.sparkSession.createDataFrame(
        rows, "model string, reg_param double, elastic_net double, objective double")


def save_and_reload(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def roundtrip_check(spark: SparkSession, model: PipelineModel, df: DataFrame, path: str) -> DataFrame:
    """Predictions of a model before and after save / load agree row by row."""
    again = save_and_reload(model, path)
    a = model.transform(df).select("par_id", F.col("prediction").alias("a"))
    b = again.transform(df).select("par_id", F.col("prediction").alias("b"))
    return a.join(b, "par_id").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum((F.col("a") == F.col("b")).cast("long")).alias("n_equal"))


# ---------------------------------------------------------------- external models

def fit_k_class(rows: DataFrame, vec: str = "embedding", label: str = "label"):
    """Multinomial logistic regression on fixed-size vectors (Spark ML)."""
    from pyspark.ml.functions import array_to_vector
    data = rows.select(array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("features"),
                       F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=50, regParam=0.001).fit(data)


def external_scorer(coef, intercept, dim: int, batch_size: int = 1024):
    """An Arrow-batched scorer for an external model given as numpy weights.

    This is the hook for models that live outside Spark (a numpy / ONNX /
    torch model): ``predict_batch_udf`` ships the weights once per Python
    worker and scores whole Arrow batches; no row-at-a-time Python.  The
    weight matrix is classes x dim, a fixed size, never data-sized.
    """
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    w = np.asarray(coef, dtype=np.float64)
    b = np.asarray(intercept, dtype=np.float64)

    def make_predict_fn():
        def predict(x):
            z = x.astype(np.float64) @ w.T + b
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)
        return predict

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()),
                             batch_size=batch_size, input_tensor_shapes=[[dim]])
