"""Model routes as Spark ML pipelines.

Every fit is a Spark ML estimator on the whole training table; feature
preparation (casts, date parts, imputation, indexing, one-hot, assembly,
scaling) lives inside the ``Pipeline`` so the fitted model carries frozen
category lists and statistics to scoring time.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as CL
from pyspark.ml import clustering as CU
from pyspark.ml import feature as FT
from pyspark.ml import regression as RG
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quarry.operators.ordered import row_index
from quarry.session import cut_lineage

LABEL = "__label"
REGRESSION = "regression"
BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"


@dataclass
class FeatureSpec:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: str | None = None
    vector: str | None = None
    vector_size: int | None = None
    text_features: int = 1 << 14
    scale: bool = False


def _q(c: str) -> str:
    return f"`{c}`"


def feature_stages(spec: FeatureSpec) -> tuple[list, str]:
    """M1 cast, date parts (year, month, weekday), median imputation, string
    indexing (alphabetical, unseen kept), one-hot, assembly, optional scaling."""
    stages = []
    num_out = []
    casts = [f"CAST({_q(c)} AS DOUBLE) AS {_q(c + '__d')}" for c in spec.numeric]
    for c in spec.datetime:
        casts += [f"CAST(year({_q(c)}) AS DOUBLE) AS {_q(c + '__year')}",
                  f"CAST(month({_q(c)}) AS DOUBLE) AS {_q(c + '__month')}",
                  f"CAST(weekday({_q(c)}) AS DOUBLE) AS {_q(c + '__dow')}"]
    if casts:
        stages.append(FT.SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__"))
        imp_in = [c + "__d" for c in spec.numeric] + [c + s for c in spec.datetime for s in ("__year", "__month", "__dow")]
        imp_out = [c + "__imp" for c in imp_in]
        stages.append(FT.Imputer(inputCols=imp_in, outputCols=imp_out, strategy="median"))
        num_out = imp_out
    cat_out = []
    if spec.categorical:
        idx = [c + "__idx" for c in spec.categorical]
        stages.append(FT.StringIndexer(inputCols=spec.categorical, outputCols=idx, handleInvalid="keep",
                                       stringOrderType="alphabetAsc"))
        cat_out = [c + "__oh" for c in spec.categorical]
        stages.append(FT.OneHotEncoder(inputCols=idx, outputCols=cat_out, handleInvalid="keep", dropLast=True))
    extra = []
    if spec.text:
        stages += [FT.RegexTokenizer(inputCol=spec.text, outputCol="__tok", pattern=r"\W+", toLowercase=True),
                   FT.StopWordsRemover(inputCol="__tok", outputCol="__tok2"),
                   FT.HashingTF(inputCol="__tok2", outputCol="__tf", numFeatures=spec.text_features),
                   FT.IDF(inputCol="__tf", outputCol="__tfidf", minDocFreq=2)]
        extra.append("__tfidf")
    if spec.vector:
        # made by ``prepare`` before the pipeline; the size hint gives the assembler its width
        stages.append(FT.VectorSizeHint(inputCol="__vec", size=int(spec.vector_size or 0), handleInvalid="skip"))
        extra.append("__vec")
    stages.append(FT.VectorAssembler(inputCols=num_out + cat_out + extra, outputCol="__raw", handleInvalid="keep"))
    if spec.scale:
        stages.append(FT.StandardScaler(inputCol="__raw", outputCol="features", withMean=False, withStd=True))
    else:
        stages.append(FT.SQLTransformer(statement="SELECT *, __raw AS features FROM __THIS__"))
    return stages, "features"


REGRESSION_FAMILIES = ("linear", "ridge", "lasso", "elasticnet", "gbt", "random_forest", "decision_tree")
CLASSIFICATION_FAMILIES = ("logistic", "svm", "gbt", "random_forest", "decision_tree", "naive_bayes", "mlp")


def estimator(task: str, family: str, label: str = "label", n_features: int | None = None,
              n_classes: int = 2, seed: int = 42, **params):
    """M6-M10 a Spark ML estimator for the route."""
    common = {"featuresCol": "features", "labelCol": label}
    if task == REGRESSION:
        if family in ("linear", "ridge", "lasso", "elasticnet"):
            reg = {"linear": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.1, 1.0), "elasticnet": (0.1, 0.5)}[family]
            return RG.LinearRegression(regParam=params.get("regParam", reg[0]),
                                       elasticNetParam=params.get("elasticNetParam", reg[1]), **common)
        if family == "gbt":
            return RG.GBTRegressor(maxIter=params.get("maxIter", 20), maxDepth=params.get("maxDepth", 5),
                                   minInstancesPerNode=params.get("minInstancesPerNode", 1), seed=seed, **common)
        if family == "random_forest":
            return RG.RandomForestRegressor(numTrees=params.get("numTrees", 20), seed=seed, **common)
        if family == "decision_tree":
            return RG.DecisionTreeRegressor(maxDepth=params.get("maxDepth", 5), seed=seed, **common)
        if family == "survival":
            return RG.AFTSurvivalRegression(censorCol=params.get("censorCol", "censor"), **common)
        raise ValueError(family)
    prob = {"probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}
    if family == "logistic":
        return CL.LogisticRegression(regParam=params.get("regParam", 0.0), maxIter=params.get("maxIter", 100),
                                     **common, **prob)
    if family == "svm":
        base = CL.LinearSVC(regParam=params.get("regParam", 0.0), **common)
        return base if n_classes == 2 else CL.OneVsRest(classifier=base, **common)
    if family == "gbt":
        base = CL.GBTClassifier(maxIter=params.get("maxIter", 20), maxDepth=params.get("maxDepth", 5),
                                minInstancesPerNode=params.get("minInstancesPerNode", 1), seed=seed, **common)
        return base if n_classes == 2 else CL.OneVsRest(classifier=base, **common)
    if family == "random_forest":
        return CL.RandomForestClassifier(numTrees=params.get("numTrees", 20), seed=seed, **common, **prob)
    if family == "decision_tree":
        return CL.DecisionTreeClassifier(maxDepth=params.get("maxDepth", 5), seed=seed, **common, **prob)
    if family == "naive_bayes":
        return CL.NaiveBayes(modelType="gaussian", **common, **prob)
    if family == "mlp":
        hidden = params.get("hidden", [16])
        return CL.MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], seed=seed,
                                                 maxIter=params.get("maxIter", 100), **common, **prob)
    raise ValueError(family)


def prepare(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Columns the pipeline cannot derive in SQL: array embeddings -> vectors."""
    if spec.vector and "__vec" not in df.columns:
        return df.withColumn("__vec", array_to_vector(F.col(spec.vector).cast("array<double>")))
    return df


@dataclass
class Route:
    task: str
    target: str
    spec: FeatureSpec
    family: str
    params: dict = field(default_factory=dict)
    log_target: bool = False


def build_model(route: Route, train: DataFrame) -> PipelineModel:
    """Fit feature stages + label indexing + estimator on ``train``.  M5: with
    ``log_target`` the label is log1p(y) and predictions are expm1-ed at
    scoring time (an explicit flag kept in the route).

    The feature stages are fitted once on the whole table and their output (label and
    feature vector) is kept for the estimator's passes; the number of features and of
    classes is what the fitted stages say."""
    fitted, data = feature_table(route, train)
    try:
        return fit_on(route, fitted, data)
    finally:
        data.unpersist()


def inputs(spec: FeatureSpec, df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The columns of ``df`` that the features of ``spec`` are made of, and ``also``."""
    named = [*spec.numeric, *spec.categorical, *spec.datetime, spec.text, spec.vector, "__vec", *also]
    return df.select(*[F.col(_q(c)) for c in dict.fromkeys(named) if c in df.columns])


def feature_table(route: Route, train: DataFrame, also: Sequence[Route] = ()) -> tuple[PipelineModel, DataFrame]:
    """The fitted feature stages of ``route`` and the kept table (label, features and the
    censor columns of ``route`` and ``also``) that its estimator is fitted on.  Routes with
    one task, target, features and label scale have one such table."""
    if route.spec.vector and not route.spec.vector_size:
        route.spec.vector_size = train.select(F.size(route.spec.vector)).first()[0]  # one row
    stages, _ = feature_stages(route.spec)
    rows = prepare(train, route.spec).where(F.col(route.target).isNotNull())
    if route.task == REGRESSION:
        # not a stage: the fitted pipeline also scores tables without the target
        y = F.col(route.target).cast("double")
        rows = rows.withColumn(LABEL, F.log1p(y) if route.log_target else y)
    else:
        stages.append(FT.StringIndexer(inputCol=route.target, outputCol=LABEL, stringOrderType="alphabetAsc",
                                       handleInvalid="skip"))
    extra = {c for r in (route, *also) for c in
             ([r.params["censorCol"]] if "censorCol" in r.params else ["censor"] if r.family == "survival" else [])}
    # every stage is fitted in a pass of its own: what the table is made of is joined once.
    # Texts are large and their features' stages few: they are read again
    source = rows if route.spec.text else inputs(
        route.spec, rows, [LABEL, route.target, *sorted(extra)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(stages=stages).fit(source)
        kept = fitted.transform(source).select(LABEL, "features", *sorted(extra)).persist(StorageLevel.MEMORY_AND_DISK)
        if source is not rows:
            kept.count()  # made while its source is kept
        return fitted, kept
    finally:
        if source is not rows:
            source.unpersist()


def fit_on(route: Route, fitted: PipelineModel, data: DataFrame) -> PipelineModel:
    """The estimator of ``route`` fitted on a ``feature_table``."""
    n_features = None
    if route.family == "mlp":
        n_features = data.select(vector_to_array("features").alias("x")).select(F.size("x")).first()[0]
    n_classes = 0 if route.task == REGRESSION else len(class_labels(fitted))
    model = estimator(route.task, route.family, LABEL, n_features, max(n_classes, 2), **route.params).fit(data)
    return PipelineModel(stages=[*fitted.stages, model])


def class_labels(model: PipelineModel) -> list[str]:
    """The classes of the fitted label indexing, in the order of their numbers."""
    return next(s for s in model.stages if isinstance(s, FT.StringIndexerModel) and s.getOutputCol() == LABEL).labels


def predict(model: PipelineModel, df: DataFrame, route: Route, keep: Sequence[str] = ()) -> DataFrame:
    """C5 predictions (and class probabilities) for a table; class indices are
    decoded to the training labels (C6)."""
    cols = [*keep]
    if route.task != REGRESSION:
        labels = class_labels(model)
        if route.target not in df.columns:      # the label's indexing asks for its column
            model = PipelineModel(stages=[s for s in model.stages if not (
                isinstance(s, FT.StringIndexerModel) and s.getOutputCol() == LABEL)])
    out = model.transform(prepare(df, route.spec))
    if route.task == REGRESSION:
        p = F.expm1("prediction") if route.log_target else F.col("prediction")
        return out.select(*cols, p.alias("predicted"))
    dec = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int") + 1)
    sel = [*cols, dec.alias("predicted")]
    if "probability" in out.columns:
        sel.append(vector_to_array("probability").alias("probability"))
    elif "rawPrediction" in out.columns:
        sel.append(vector_to_array("rawPrediction").alias("margin"))
    return out.select(*sel)


# Candidate routes in the order in which they are tried, unless a list is given.
CANDIDATES = {
    REGRESSION: [("gbt", {}), ("random_forest", {}), ("ridge", {}), ("gbt", {"maxDepth": 7, "maxIter": 40}),
                 ("linear", {}), ("lasso", {}), ("decision_tree", {})],
    "classification": [("gbt", {}), ("random_forest", {}), ("logistic", {"regParam": 0.01}), ("decision_tree", {}),
                       ("logistic", {"regParam": 0.1}), ("naive_bayes", {})],
}


# Below SMALL rows boosting overfits, so regularised linear routes are tried;
# below MEDIUM rows boosting is held back (shallow trees, large leaves).
SMALL, MEDIUM = 500, 2000
SMALL_CANDIDATES = {
    REGRESSION: [("ridge", {}), ("lasso", {}), ("elasticnet", {}), ("ridge", {"regParam": 1.0})],
    "classification": [("logistic", {"regParam": 0.1}), ("svm", {"regParam": 0.1}), ("logistic", {"regParam": 0.01}),
                       ("logistic", {"regParam": 1.0})],
}
MEDIUM_CANDIDATES = {
    REGRESSION: [("gbt", {"maxDepth": 3, "minInstancesPerNode": 20}), ("elasticnet", {}), ("ridge", {}),
                 ("random_forest", {}), ("lasso", {})],
    "classification": [("gbt", {"maxDepth": 3, "minInstancesPerNode": 20}), ("logistic", {"regParam": 0.1}),
                       ("random_forest", {}), ("logistic", {"regParam": 0.01})],
}


def default_candidates(task: str, rows: int | None = None) -> list[tuple[str, dict]]:
    """M21 the candidate order of a task for a training table of ``rows`` rows."""
    table = CANDIDATES if rows is None or rows >= MEDIUM else MEDIUM_CANDIDATES if rows >= SMALL else SMALL_CANDIDATES
    return list(table[REGRESSION if task == REGRESSION else "classification"])


def evaluate(pred: DataFrame, task: str, actual: str, metric: str, labels: Sequence[str] | None = None) -> float | None:
    """A metric of ``predict``'s output.  ``labels`` are the fitted classes (the last one is
    the positive class of a binary task); without them the classes present are taken."""
    from quarry.operators import evaluation as E
    if task == REGRESSION:
        r = E.regression_metrics(pred.select(F.col(actual).cast("double").alias("actual"), "predicted")).first()
        return r[metric]
    if labels is None:
        labels = sorted(r[0] for r in pred.select(F.col(actual).cast("string")).distinct().collect())
    pos = labels[-1]
    if metric == "auc" and task == BINARY:
        score = "probability" if "probability" in pred.columns else "margin"
        p = pred.select((F.col(actual).cast("string") == pos).cast("int").alias("actual"),
                        F.element_at(score, F.lit(-1)).alias("score"))
        return E.auc(p).first()["auc"]
    avg = "binary" if task == BINARY else "macro"
    p = pred.select(F.col(actual).cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted"))
    r = E.classification_metrics(p, average=avg, positive=pos).first()
    return r["accuracy"] if metric == "accuracy" else r["f1"]


class _Stopped(Exception):
    """A candidate that the sweep no longer needs."""


def sweep(train: DataFrame, test: DataFrame, task: str, target: str, spec: FeatureSpec, metric: str,
          candidates: Sequence[tuple[str, dict]] | None = None, good_enough: float | None = None,
          stagnation_limit: int = 5, parallel: int = 1) -> tuple[PipelineModel | None, Route | None, DataFrame]:
    """M21 try candidate routes in order; keep a candidate when it beats the
    best so far, stop at the good-enough threshold or after
    ``stagnation_limit`` experiments without improvement.  Without ``candidates`` the
    list is chosen by task and size of the training table.  Returns (best model, its
    route, log table).

    The feature stages are fitted once and all candidates share their kept table and the
    kept test rows.  Up to
    ``parallel`` candidates are fitted at the same time, each in its own scheduler pool
    and job group (``spark.scheduler.mode`` FAIR shares the executors among the pools);
    they are judged in the given order whatever ends first, so the log but for its times
    is the same, and at a stop the jobs of candidates still running are cancelled."""
    from quarry.operators.explog import LOWER_IS_BETTER
    lower, sc = metric in LOWER_IS_BETTER, train.sparkSession.sparkContext
    routes = [Route(task, target, spec, family, dict(params))
              for family, params in candidates or default_candidates(task, train.count())]
    group, stop = f"sweep-{uuid.uuid4().hex}", threading.Event()
    log_columns = ("num int, model string, metric string, metric_value double, status string, error string, "
                   "fit_seconds double, predict_seconds double")
    if not routes:
        return None, None, train.sparkSession.createDataFrame([], log_columns)
    best_val, best_model, best_route, stale, rows = None, None, None, 0, []
    shared: dict[str, tuple[PipelineModel, DataFrame]] = {}
    tested: dict[str, DataFrame] = {}

    def features() -> tuple[PipelineModel, DataFrame]:
        if "table" not in shared:
            shared["table"] = feature_table(routes[0], train, routes[1:])
        return shared["table"]

    def held_out() -> DataFrame:
        if "test" not in tested:
            tested["test"] = inputs(spec, test, [target]).persist(StorageLevel.MEMORY_AND_DISK)
        return tested["test"]

    def attempt(num: int, route: Route):
        if parallel > 1:
            sc.setLocalProperty("spark.scheduler.pool", f"{group}-{num % parallel}")
            sc.setJobGroup(f"{group}-{num}", f"sweep candidate {num}: {route.family}")
        if stop.is_set():
            raise _Stopped
        t0 = time.time()
        model = fit_on(route, *features())
        t1 = time.time()
        if stop.is_set():
            raise _Stopped
        val = evaluate(predict(model, held_out(), route, keep=[target]), task, target, metric,
                       None if task == REGRESSION else class_labels(model))
        return model, val, round(t1 - t0, 3), round(time.time() - t1, 3)

    pool, running = None, {}
    if parallel > 1:
        pool = ThreadPoolExecutor(parallel)
        try:
            features()  # before the threads, so that they share it
            held_out()
        except Exception:  # noqa: BLE001 - every candidate reports it as its own crash
            pass
        # each candidate inherits the caller's local properties, not those of the one before it
        running = {num: pool.submit(inheritable_thread_target(train.sparkSession)(attempt), num, route)
                   for num, route in enumerate(routes, start=1)}
    try:
        for num, route in enumerate(routes, start=1):
            try:
                model, val, fit_s, predict_s = running[num].result() if pool else attempt(num, route)
                status = "discard"
                if val is not None and not math.isnan(val) and (
                        best_val is None or (val < best_val if lower else val > best_val)):
                    best_val, best_model, best_route, stale, status = val, model, route, 0, "keep"
                else:
                    stale += 1
                rows.append((num, route.family, metric, float(val) if val is not None else None, status, "",
                             fit_s, predict_s))
            except Exception as e:  # noqa: BLE001 - a failed route is a crash row, the sweep goes on
                rows.append((num, route.family, metric, None, "crash", str(e)[:220], None, None))
            if best_val is not None and good_enough is not None and (
                    best_val <= good_enough if lower else best_val >= good_enough):
                break
            if stale >= stagnation_limit:
                break
    finally:
        stop.set()
        if pool:
            pool.shutdown(wait=False, cancel_futures=True)
            while not all(f.done() for f in running.values()):
                for num, f in running.items():  # an iterative fit may have begun another job
                    if not f.done():
                        sc.cancelJobGroup(f"{group}-{num}")
                time.sleep(0.05)
        if "table" in shared:
            shared["table"][1].unpersist()
        if "test" in tested:
            tested["test"].unpersist()
    return best_model, best_route, train.sparkSession.createDataFrame(rows, log_columns)


def candidate_leaderboard(log: DataFrame, metric: str, k: int = 20) -> DataFrame:
    """K2 model, score, fit time, predict time of the sweep, best first, top k."""
    from quarry.operators.explog import LOWER_IS_BETTER
    order = F.asc_nulls_last("metric_value") if metric in LOWER_IS_BETTER else F.desc_nulls_last("metric_value")
    return (log.where(F.col("status") != "crash").orderBy(order, "num").limit(k)
            .select("model", F.col("metric_value").alias("score"), "fit_seconds", "predict_seconds"))


def forecast(df: DataFrame, date: str, target: str, horizon_share: float = 0.2, lags=(1, 7),
             windows=(7,), family: str = "gbt", **params) -> DataFrame:
    """M19 forecasting route: lag and rolling features of the target
    plus calendar parts, a time-ordered split (V1), and a regression route on
    the earlier part predicting the later part.  Returns (date, actual,
    predicted) for the held-out tail."""
    from quarry.operators.splits import time_split
    from quarry.operators.timeseries import lag_features
    feats = lag_features(df.select(date, target), [], [date], target, lags=lags, windows=windows)
    cols = [c for c in feats.columns if c.startswith(f"{target}_")]
    split = time_split(feats, [date], 1.0 - horizon_share)
    spec = FeatureSpec(numeric=cols, datetime=[date])
    route = Route(REGRESSION, target, spec, family, params)
    model = build_model(route, split.where(F.col("split") == "train"))
    out = predict(model, split.where(F.col("split") == "test"), route, keep=[date, target])
    return out.withColumnRenamed(target, "actual")


def forecast_ahead(df: DataFrame, future: DataFrame, date: str, target: str, lags=(1, 7), family: str = "gbt",
                   **params) -> DataFrame:
    """M19 predictions for an unlabelled future table: (date, step, predicted).

    One model per step ahead (direct forecasts): the model of step h learns the target
    from calendar parts and from the values ``lag + h - 1`` rows earlier, which are all
    known when the future begins, so no prediction feeds another.  The history is ordered
    by ``date``; the future's distinct dates, in order, are the steps."""
    from quarry.operators.timeseries import lag_features
    steps = row_index(future.select(date).distinct(), [date], name="__step", tie_break=False).withColumn(
        "step", (F.col("__step") + 1).cast("int")).drop("__step")
    horizon = steps.agg(F.max("step")).first()[0] or 0
    longest = max(lags) + horizon - 1
    # the last known values as a literal row: longest numbers
    tail = [r[0] for r in df.orderBy(F.desc(date)).limit(longest).select(F.col(target).cast("double")).collect()]
    out = None
    for h in range(1, horizon + 1):
        own = [lag + h - 1 for lag in lags]
        feats = lag_features(df.select(date, target), [], [date], target, lags=own, windows=())
        names = {f"{target}_lag{n}": n for n in own}
        missing = [c for c in names if c not in feats.columns]
        if missing:
            raise ValueError(f"lag columns {missing} not made; have {feats.columns}")
        route = Route(REGRESSION, target, FeatureSpec(numeric=list(names), datetime=[date]), family, params)
        model = build_model(route, feats.where(F.col(f"{target}_lag{max(own)}").isNotNull()))
        # step h after the last row: lag n of it lies n - h rows before the end
        known = {c: (tail[n - h] if n - h < len(tail) else None) for c, n in names.items()}
        row = steps.where(F.col("step") == h).withColumns({c: F.lit(v).cast("double") for c, v in known.items()})
        part = predict(model, row, route, keep=[date, "step"])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else steps.withColumn("predicted", F.lit(None).cast("double"))


def cross_validate(train: DataFrame, route: Route, metric: str, folds: int = 3, grid: dict | None = None,
                   seed: int = 42, key: Sequence[str] | None = None):
    """M12 grid search with k-fold cross-validation (Spark ``CrossValidator``).  The fold
    of a row is a hash of ``key`` (all columns unless given), so it does not depend on
    how the table is partitioned."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, \
        RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    stages, _ = feature_stages(route.spec)
    if route.task == REGRESSION:
        stages.append(FT.SQLTransformer(statement=f"SELECT *, CAST({_q(route.target)} AS DOUBLE) AS {LABEL} FROM __THIS__"))
        ev = RegressionEvaluator(metricName=metric if metric in ("rmse", "mae", "r2", "mse") else "rmse",
                                 labelCol=LABEL)
        n_classes = 0
    else:
        stages.append(FT.StringIndexer(inputCol=route.target, outputCol=LABEL, stringOrderType="alphabetAsc"))
        n_classes = train.select(route.target).distinct().count()
        ev = (BinaryClassificationEvaluator(metricName="areaUnderROC", labelCol=LABEL) if metric == "auc"
              else MulticlassClassificationEvaluator(metricName="f1" if metric == "f1" else "accuracy",
                                                     labelCol=LABEL))
    est = estimator(route.task, route.family, LABEL, None, max(n_classes, 2), **route.params)
    pipe = Pipeline(stages=stages + [est])
    gb = ParamGridBuilder()
    for name, values in (grid or {}).items():
        gb = gb.addGrid(est.getParam(name), values)
    from quarry.operators.splits import kfold
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=gb.build(), evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=2, foldCol="__fold")
    # every fold reads the table for each of its passes: what it is made of is joined once
    model = cv.fit(prepare(cut_lineage(kfold(train, list(key or train.columns), folds, seed, "__fold")), route.spec))
    return model, list(model.avgMetrics)


def stacking(train: DataFrame, test: DataFrame, route: Route, bases: Sequence[str], key: str,
             folds: int = 3) -> DataFrame:
    """M11 out-of-fold predictions of base routes (fold = hash of ``key``)
    become the features of a linear meta model; returns test predictions."""
    from quarry.operators.splits import kfold
    # every route reads the tables for each of its passes: what they are made of is joined once
    train, test = cut_lineage(train), cut_lineage(test)
    tr = kfold(train, [key], folds, name="_fold")
    oof_parts, test_feats = [], []
    for fam in bases:
        r = Route(route.task, route.target, route.spec, fam)
        parts = []
        for f in range(folds):
            m = build_model(r, tr.where(F.col("_fold") != f))
            parts.append(predict(m, tr.where(F.col("_fold") == f), r, keep=[key]).withColumnRenamed("predicted", fam))
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        oof_parts.append(oof)
        full = build_model(r, train)
        test_feats.append(predict(full, test, r, keep=[key]).withColumnRenamed("predicted", fam))
    meta_train = train.select(key, route.target)
    for o in oof_parts:
        meta_train = meta_train.join(o, key)
    meta_test = test.select(key, route.target)
    for t in test_feats:
        meta_test = meta_test.join(t, key)
    meta = Route(route.task, route.target, FeatureSpec(numeric=list(bases)),
                 "linear" if route.task == REGRESSION else "logistic")
    mm = build_model(meta, cut_lineage(meta_train))
    return predict(mm, meta_test, meta, keep=[key, route.target])


def kmeans_sweep(df: DataFrame, features: str = "features", ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42):
    """M15 k chosen by silhouette (E7): returns (best k, model, [(k, silhouette)])."""
    from quarry.operators.evaluation import silhouette
    scores, best = [], (None, None, -2.0)
    for k in ks:
        m = CU.KMeans(k=k, seed=seed, featuresCol=features).fit(df)
        s = silhouette(m.transform(df), features)
        scores.append((k, s))
        if s > best[2]:
            best = (k, m, s)
    return best[0], best[1], scores


def mixture(df: DataFrame, k: int, features: str = "features", seed: int = 42, reduce_to: int | None = None):
    """M15 Gaussian mixture; with ``reduce_to`` the vectors are first projected
    on that many principal components (full covariances in many dimensions
    are numerically fragile).  Returns a PipelineModel-like fitted model."""
    gmm = CU.GaussianMixture(k=k, seed=seed, featuresCol="__pca" if reduce_to else features)
    if not reduce_to:
        return gmm.fit(df)
    return Pipeline(stages=[FT.PCA(k=reduce_to, inputCol=features, outputCol="__pca"), gmm]).fit(df)


def hierarchical(df: DataFrame, k: int, features: str = "features", seed: int = 42):
    """M15 divisive hierarchical clustering (bisecting k-means)."""
    return CU.BisectingKMeans(k=k, seed=seed, featuresCol=features).fit(df)


def pca(df: DataFrame, k: int, features: str = "features"):
    """M16 principal components."""
    return FT.PCA(k=k, inputCol=features, outputCol="pca").fit(df)


def vectors(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    """array<float> embedding -> ML vector."""
    return df.withColumn(out, array_to_vector(F.col(column)))
