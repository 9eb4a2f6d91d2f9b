"""Scalar Column builders (F1-F12).  All JVM-side expressions, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number: what pandas.to_numeric and SQL casts agree on.
# Java's parser alone would also accept '1d', '1f', 'NaN', 'Infinity'.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """F1 numeric coerce: unparsable -> null.  Numeric input passes through."""
    c = _c(c)
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def to_timestamp_safe(c) -> Column:
    """F1 datetime coerce: unparsable -> null (ANSI-safe)."""
    c = _c(c)
    return F.coalesce(c.try_cast("timestamp_ntz"), F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"))


def weekday_mon0(c) -> Column:
    """F2 day of week with Monday = 0 (pandas ``dt.dayofweek``)."""
    return F.weekday(_c(c))


def clip(c, lower=None, upper=None) -> Column:
    """F3 clip; nulls stay null."""
    c = _c(c)
    out = c
    if lower is not None:
        out = F.when(out.isNull(), None).otherwise(F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(out.isNull(), None).otherwise(F.least(out, F.lit(upper)))
    return out


def error_cols(actual="actual", predicted="predicted") -> dict[str, Column]:
    """error = predicted - actual (4 digits); pct_error = error / actual * 100
    (2 digits), null where actual is 0."""
    err = F.round(_c(predicted) - _c(actual), 4)
    pct = F.round(err / F.nullif(_c(actual).cast("double"), F.lit(0.0)) * 100.0, 2)
    return {"error": err, "pct_error": pct}


def overfit_ratio(train, test) -> Column:
    """F6 gap relative to the test value: |tr-te| / max(|te|, 1e-10)."""
    return F.abs(_c(train) - _c(test)) / F.greatest(F.abs(_c(test)), F.lit(1e-10))


def overfit_ratio_sym(train, test) -> Column:
    """F6 scorecard form: |tr-te| / max(|tr|, |te|), NaN where both are 0 (as in the SQL)."""
    gap, most = F.abs(_c(train) - _c(test)), F.greatest(F.abs(_c(train)), F.abs(_c(test))).cast("double")
    return F.when(gap.isNotNull() & (most == 0), F.lit(float("nan"))).otherwise(gap / F.nullif(most, F.lit(0.0)))


# Metric values that generated code prints when it failed.
SENTINEL_VALUES = (999.0, 999.9, 999.99, 9999.0, 99999.0, 1000.0, 10000.0, -1.0, -999.0, -9999.0, 0.0)


def is_sentinel(value, lower_is_better: bool | Column, sentinels: Sequence[float] = SENTINEL_VALUES,
                error_in_log=None) -> Column:
    """F7 sentinel metric: NaN/inf, a known placeholder, >=500 when lower is
    better, or (with an error in the log) >=50 lower / <=0.001 higher."""
    v = _c(value).cast("double")
    lower = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    err = F.lit(False) if error_in_log is None else F.coalesce(_c(error_in_log), F.lit(False))
    return (v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | v.isin(*sentinels)
            | (lower & (v >= 500)) | (lower & (v >= 50) & err) | (~lower & (v <= 0.001) & err))


def _lower(c) -> Column:
    return F.lower(F.coalesce(_c(c), F.lit("")))


# Failure reasons for error text (lower-cased).  Rules are tried
# in order; a rule matches when any of its alternatives matches, and an
# alternative matches when the text contains all of its parts.
FAILURE_RULES = [
    ("data_path", [("filenotfounderror",), ("no such file or directory",)]),
    ("data_path", [("train.csv",), ("test.csv",)]),
    ("data_path_inject", [("name 'data_path' is not defined",), ("nameerror", "data_path")]),
    ("invalid_hyperparameter", [("validate_parameter_constraints",), ("invalid parameter",)]),
    ("invalid_hyperparameter", [("absolute_deviation",)]),
    ("missing_package", [("no module named",)]),
    ("timeout", [("timeout",)]),
    ("bad_output_format", [("no json in stdout",)]),
    ("bad_output_format", [("json", "decode")]),
]
FAILURE_DEFAULT = "runtime_error"

# Model families for code or model text (lower-cased), same rule shape.
FAMILY_RULES = [
    ("autogluon", [("tabularpredictor",), ("autogluon",)]),
    ("lightgbm", [("lgb",), ("lightgbm",)]),
    ("xgboost", [("xgb",), ("xgboost",)]),
    ("catboost", [("catboost",)]),
    ("random_forest", [("randomforest",)]),
    ("sklearn_gbm", [("gradientboosting",)]),
    ("prophet", [("prophet",)]),
    ("deep_learning", [("lstm",), ("gru",), ("torch", "nn.linear"), ("torch", "module")]),
    ("transformer", [("sentence_transformers",), ("transformers",)]),
    ("stacking_ensemble", [("stackingregressor",), ("stackingclassifier",), ("votingregressor",),
                           ("votingclassifier",)]),
    ("linear", [("ridge",), ("lasso",), ("elasticnet",), ("linearregression",), ("logisticregression",)]),
    ("svm", [("svc(",), ("svr(",)]),
    ("neural_network", [("mlpclassifier",), ("mlpregressor",)]),
]
FAMILY_DEFAULT = "other"
FAMILY_EMPTY = "unknown"


def classify_text(text, rules, default: str, empty: str | None = None) -> Column:
    """First rule whose alternative (all parts contained) matches the
    lower-cased text; ``empty`` for null / empty text when given."""
    t = _lower(text)
    out = F.when(F.coalesce(_c(text), F.lit("")) == "", F.lit(empty)) if empty is not None else None
    for label, alternatives in rules:
        cond = None
        for parts in alternatives:
            alt = None
            for part in parts:
                alt = t.contains(part) if alt is None else alt & t.contains(part)
            cond = alt if cond is None else cond | alt
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def classify_sql(text_sql: str, rules, default: str, empty: str | None = None) -> str:
    """The same rule table as a SQL CASE expression (for the oracle)."""
    t = f"lower(coalesce({text_sql}, ''))"
    q = lambda v: "'" + v.replace("'", "''") + "'"
    whens = [f"WHEN coalesce({text_sql}, '') = '' THEN {q(empty)}"] if empty is not None else []
    for label, alternatives in rules:
        cond = " OR ".join("(" + " AND ".join(f"contains({t}, {q(p)})" for p in parts) + ")"
                           for parts in alternatives)
        whens.append(f"WHEN {cond} THEN {q(label)}")
    return "CASE " + " ".join(whens) + f" ELSE {q(default)} END"


def failure_reason(error_text) -> Column:
    """F8 classify an error message (FAILURE_RULES, in order)."""
    return classify_text(error_text, FAILURE_RULES, FAILURE_DEFAULT)


def model_family(text) -> Column:
    """F9 model family from code or model text (FAMILY_RULES, in order)."""
    return classify_text(text, FAMILY_RULES, FAMILY_DEFAULT, FAMILY_EMPTY)


# Display name for each model-class pattern, first match wins.
MODEL_NAME_PATTERNS = [
    (r"(?:XGBRegressor|XGBClassifier|xgb\.XGB)", "XGBoost"),
    (r"(?:LGBMRegressor|LGBMClassifier|lgb\.LGBMModel)", "LightGBM"),
    (r"(?:CatBoostRegressor|CatBoostClassifier)", "CatBoost"),
    (r"(?:RandomForestRegressor|RandomForestClassifier)", "Random Forest"),
    (r"(?:GradientBoostingRegressor|GradientBoostingClassifier)", "Gradient Boosting"),
    (r"(?:ExtraTreesRegressor|ExtraTreesClassifier)", "Extra Trees"),
    (r"(?:AdaBoostRegressor|AdaBoostClassifier)", "AdaBoost"),
    (r"(?:BaggingRegressor|BaggingClassifier)", "Bagging"),
    (r"(?:StackingRegressor|StackingClassifier)", "Stacking Ensemble"),
    (r"(?:VotingRegressor|VotingClassifier)", "Voting Ensemble"),
    (r"Ridge\(", "Ridge"),
    (r"Lasso\(", "Lasso"),
    (r"ElasticNet\(", "ElasticNet"),
    (r"LinearRegression\(", "Linear Regression"),
    (r"LogisticRegression\(", "Logistic Regression"),
    (r"SVR\(|SVC\(", "SVM"),
    (r"KNeighborsRegressor|KNeighborsClassifier", "KNN"),
    (r"DecisionTreeRegressor|DecisionTreeClassifier", "Decision Tree"),
    (r"MLPRegressor|MLPClassifier", "Neural Net (MLP)"),
    (r"GaussianNB|BernoulliNB|MultinomialNB", "Naive Bayes"),
    (r"HuberRegressor", "Huber Regressor"),
    (r"SGDRegressor|SGDClassifier", "SGD"),
    (r"BayesianRidge", "Bayesian Ridge"),
    (r"(?:keras|tensorflow|tf\.)", "TensorFlow/Keras"),
    (r"(?:torch|nn\.Module)", "PyTorch"),
]


def model_name(code) -> Column:
    """F9 display model name from code text (case-sensitive patterns)."""
    c = F.coalesce(_c(code), F.lit(""))
    out = None
    for pat, name in MODEL_NAME_PATTERNS:
        out = F.when(c.rlike(pat), name) if out is None else out.when(c.rlike(pat), name)
    return out.otherwise("Custom Model")


def grade(score) -> Column:
    """F10 letter grade from a 0-100 score."""
    s = _c(score)
    return (F.when(s >= 90, "A+").when(s >= 80, "A").when(s >= 70, "B").when(s >= 60, "C").otherwise("D"))


def token_byte_length(token_text, is_special) -> Column:
    """F11 UTF-8 byte length of a token's text, 0 for special tokens."""
    return F.when(_c(is_special), F.lit(0)).otherwise(F.octet_length(_c(token_text)))


# Keys that look numeric but are not metrics, and fallback metric order.
NON_METRIC_KEYS = ("id", "row_id", "index", "count", "n", "epoch", "step", "batch", "iter",
                   "iteration", "size", "total", "num", "model")
FALLBACK_METRICS = ("rmse", "r2", "mape", "mae", "nse", "auc", "f1", "accuracy")


def valid_metrics(metrics_map) -> Column:
    """Drop non-metric keys and NaN/inf/null values from a map<string,double>."""
    return F.map_filter(_c(metrics_map), lambda k, v: (
        ~F.lower(k).isin(*NON_METRIC_KEYS) & v.isNotNull() & ~F.isnan(v)
        & (F.abs(v) != F.lit(float("inf")))))


def pick_metric(metrics_map, primary: str) -> tuple[Column, Column]:
    """F12 (metric_name, metric_val): primary as given / lower / upper, then the
    ``test_`` forms, then the fallbacks; the canonical primary name is kept."""
    m = valid_metrics(metrics_map)
    order = [primary, primary.lower(), primary.upper(), f"test_{primary}", f"test_{primary.lower()}",
             f"test_{primary.upper()}"] + [k for k in FALLBACK_METRICS if k != primary.lower()]
    seen, keys = set(), []
    for k in order:
        if k not in seen:
            seen.add(k)
            keys.append(k)
    name = None
    val = None
    for k in keys:
        present = F.map_contains_key(m, F.lit(k))
        nm = primary if k.lower().replace("test_", "") == primary.lower() else k
        name = F.when(present, F.lit(nm)) if name is None else name.when(present, F.lit(nm))
        val = F.when(present, m[k]) if val is None else val.when(present, m[k])
    # otherwise the first valid key in map order
    first = F.element_at(F.map_entries(m), 1)
    return name.otherwise(first["key"]), val.otherwise(first["value"])
