"""Features, splits, models, holdout evaluation and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.jobs_reports import _corr
from fixtures.oracle import money, over, total
from fixtures.registry import plain, register, rounded
from tillspark.operators import checks, eda, features, forecast, metrics, profile
from tillspark.schema import FEATURES
from tillspark.sources.model_store import ModelStore
from tillspark.sources.workspace import materialize

#: Features whose distinct values both engines count alike (feature_unique_counts_exact); sine, cosine
#: and deviations differ in their last bits.
COUNTED = [f for f in FEATURES if not f.startswith("day_of_year_") and "std" not in f]

FOLDS = 4


def _features_sql(keys: str, series: str) -> str:
    part = f"PARTITION BY {keys[:-2]} " if keys else ""
    lags = ", ".join(f"LAG(gross_sales, {k}) OVER w AS lag_{k}" for k in (1, 7, 14, 28))
    mean = lambda n: (
        f"CASE WHEN COUNT(*) OVER w{n} = {n} THEN "
        f"CAST(SUM({money('gross_sales')}) OVER w{n} AS DOUBLE) / {n} END AS rolling_{n}"
    )
    return f"""
        SELECT * EXCLUDE (day_of_series), rolling_7 / NULLIF(rolling_28, 0) AS trend_7_28 FROM (
          SELECT {keys}date, gross_sales AS target,
            CAST(ISODOW(date) - 1 AS INTEGER) AS weekday, CAST(MONTH(date) AS INTEGER) AS month,
            SIN(2 * PI() * DAYOFYEAR(date) / 365.25) AS day_of_year_sin,
            COS(2 * PI() * DAYOFYEAR(date) / 365.25) AS day_of_year_cos,
            {lags}, {mean(7)}, {mean(28)},
            CASE WHEN COUNT(*) OVER w7 = 7 THEN STDDEV_SAMP(gross_sales) OVER w7 END AS rolling_std_7,
            CAST(LAG(orders) OVER w AS DOUBLE) AS lag_orders_1,
            ROW_NUMBER() OVER w AS day_of_series
          FROM {series}
          WINDOW w AS ({part}ORDER BY date),
                 w7 AS ({part}ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
                 w28 AS ({part}ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
        WHERE day_of_series > 28"""


PARTS = {
    "country_days": f"""
        SELECT country, date, COALESCE(gross_sales, 0) AS gross_sales, COALESCE(orders, 0) AS orders
        FROM (SELECT country, CAST(UNNEST(GENERATE_SERIES(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP),
                     INTERVAL 1 DAY)) AS DATE) AS date
              FROM (SELECT country, MIN(date) AS a, MAX(date) AS z FROM lines GROUP BY country))
        LEFT JOIN (SELECT country, date, {total('gross_sales')} AS gross_sales,
                     COUNT(DISTINCT CASE WHEN is_sale THEN invoice_id END) AS orders
                   FROM lines GROUP BY country, date) USING (country, date)""",
    "history": "SELECT * FROM v_daily WHERE date < (SELECT MAX(date) FROM v_daily)",
    "country_history": """
        SELECT * FROM country_days WHERE date < (SELECT MAX(date) FROM country_days)""",
    "features": _features_sql("", "history"),
    "country_features": _features_sql("country, ", "country_history"),
    "numbered_days": """
        SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS pos, COUNT(*) OVER () AS n FROM features""",
    "split": """
        SELECT *, CASE WHEN pos <= FLOOR(n * CAST(0.65 AS DOUBLE)) THEN 'train'
                       WHEN pos <= FLOOR(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END
                    AS split FROM numbered_days""",
    "country_split": """
        SELECT *, CASE WHEN pos <= FLOOR(n * CAST(0.65 AS DOUBLE)) THEN 'train'
                       WHEN pos <= FLOOR(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END
                    AS split
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY date) AS pos,
                     COUNT(*) OVER (PARTITION BY country) AS n FROM country_features)""",
    "fitting": "SELECT * FROM split WHERE split <> 'test'",
    "training": "SELECT * FROM split WHERE split = 'train'",
    "holdout": f"""
        SELECT date, target, weekday,
          GREATEST(0, COALESCE(lag_7, (SELECT MEDIAN(target) FROM fitting))) AS seasonal_naive,
          (SELECT {total('target')} / COUNT(*) FROM fitting) AS dummy_mean
        FROM split WHERE split = 'test'""",
}
ISO = "STRFTIME(date, '%Y-%m-%d') AS date"


# Only these depend on the order of summation or on the mathematics library.
INEXACT = ["day_of_year_sin", "day_of_year_cos", "rolling_std_7", "dummy_mean"]


def _listed(columns: list[str]) -> str:
    return ", ".join(f"ROUND({c}, 3) AS {c}" if c in INEXACT else c for c in columns)


def _tidy(df):
    """Plain types, with the inexact columns rounded."""
    cols = [F.round(c, 3).alias(c) if c in INEXACT else F.col(c) for c in df.columns]
    return plain(df.select(*cols))


NUMBERS = ["target", *[f for f in FEATURES if f not in ("weekday", "month")]]


@register(
    "features_daily",
    over(f"SELECT {ISO}, weekday, month, {_listed(NUMBERS)} FROM features", **PARTS),
)
def _(m):
    return _tidy(m["features"])


@register(
    "features_by_country",
    over(f"SELECT country, {ISO}, weekday, month, {_listed(NUMBERS)} FROM country_features", **PARTS),
)
def _(m):
    return _tidy(m["country_features"])


@register(
    "features_future_row",
    over(
        f"SELECT {ISO}, weekday, month, {_listed(NUMBERS[1:])} FROM later WHERE target IS NULL",
        **PARTS,
        longer="""
          SELECT date, gross_sales, orders FROM history
          UNION ALL SELECT MAX(date) + INTERVAL 1 DAY, NULL, NULL FROM history""",
        later=_features_sql("", "longer"),
    ),
)
def _(m):
    return _tidy(_future(m))


def _future(m):
    built = features.engineer_features(features.drop_last_day(m["daily"]), include_future=True)
    return built.where(F.col("target").isNull()).drop("target")


@register("chronological_split", over(f"SELECT {ISO}, split FROM split", **PARTS))
def _(m):
    return plain(m["split"].select("date", "split"))


@register(
    "chronological_split_by_country",
    over(f"SELECT country, {ISO}, split FROM country_split", **PARTS),
)
def _(m):
    return plain(m["country_split"].select("country", "date", "split"))


@register(
    "split_report",
    over(
        """SELECT split, COUNT(*) AS rows, STRFTIME(MIN(date), '%Y-%m-%d') AS start,
                  STRFTIME(MAX(date), '%Y-%m-%d') AS "end" FROM split GROUP BY split""",
        **PARTS,
    ),
)
def _(m):
    return plain(features.split_report(m["split"]))


@register(
    "sample_inference_rows",
    over(
        f"""SELECT {ISO}, weekday, month, {_listed(NUMBERS[1:])} FROM split WHERE split = 'test'
            ORDER BY split.date LIMIT 5""",
        **PARTS,
    ),
)
def _(m):
    return _tidy(features.sample_inference_rows(m["split"]))


def _unique_counts(m, columns: list[str]):
    train = features.block(m["split"], "train").select(*columns)
    return profile.missing_summary(train).select(
        F.col("column").alias("feature"), F.col("unique_count").alias("train_unique")
    )


@register("feature_unique_counts")
def _(m):
    """Distinct values of every feature, unrounded; the last bits of some are the engine's own."""
    return _unique_counts(m, FEATURES)


@register(
    "feature_unique_counts_exact",
    over(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS train_unique FROM training"
            for c in COUNTED
        ),
        **PARTS,
    ),
)
def _(m):
    return _unique_counts(m, COUNTED)


@register("feature_correlations", over(_corr("training", {c: c for c in FEATURES}), **PARTS))
def _(m):
    return rounded(profile.correlations(features.block(m["split"], "train"), FEATURES))


_MARKS = [i / 10 for i in range(1, 10)]


def _binned(c: str, marks: str) -> str:
    """Number of marks at or below a value, the middle mark standing in for a missing one."""
    at = f"COALESCE(CAST({c} AS DOUBLE), {marks}[5])"
    return f"LIST_SUM(LIST_TRANSFORM({marks}, lambda k: CASE WHEN {at} >= k THEN 1 ELSE 0 END))"


def _cells_sql(c: str) -> str:
    x = f"CAST({c} AS INTEGER)" if c in ("weekday", "month") else _binned(c, "mx")
    return f"""SELECT '{c}' AS feature, {x} AS x, {_binned('target', 'my')} AS y
               FROM training, (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), {_MARKS}) AS mx,
                                      QUANTILE_CONT(target, {_MARKS}) AS my FROM training)"""


@register(
    "feature_mutual_information",
    over(
        """SELECT feature, ROUND(SUM(n * LN(n * CAST(rows AS DOUBLE) / (of_x * of_y)) / rows), 6) + 0
                    AS mutual_information_train
           FROM (SELECT feature, n, SUM(n) OVER (PARTITION BY feature) AS rows,
                        SUM(n) OVER (PARTITION BY feature, x) AS of_x,
                        SUM(n) OVER (PARTITION BY feature, y) AS of_y
                 FROM (SELECT feature, x, y, CAST(COUNT(*) AS DOUBLE) AS n FROM cells GROUP BY feature, x, y))
           GROUP BY feature""",
        **PARTS,
        cells=" UNION ALL ".join(_cells_sql(c) for c in FEATURES),
    ),
)
def _(m):
    return rounded(features.mutual_information(features.block(m["split"], "train")))


@register(
    "inference_violations",
    over(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} IS NOT NULL
                  AND NOT ISFINITE(CAST({c} AS DOUBLE))) AS violations FROM features"""
            for c in FEATURES
        ),
        **PARTS,
    ),
)
def _(m):
    return checks.inference_violations(m["features"], FEATURES)


@register(
    "fold_report",
    over(
        " UNION ALL ".join(
            f"""SELECT {i} AS fold,
                  STRFTIME(MAX(date) FILTER (WHERE pos <= n - {FOLDS - i} * size), '%Y-%m-%d') AS train_end,
                  STRFTIME(MIN(date) FILTER (WHERE pos > n - {FOLDS - i} * size), '%Y-%m-%d')
                    AS validation_start,
                  COUNT(*) FILTER (WHERE pos <= n - {FOLDS - i} * size) AS train_rows,
                  COUNT(*) FILTER (WHERE pos > n - {FOLDS - i} * size
                    AND pos <= n - {FOLDS - i - 1} * size) AS validation_rows FROM sized"""
            for i in range(FOLDS)
        ),
        **PARTS,
        sized=f"""SELECT date, pos, COUNT(*) OVER () AS n, COUNT(*) OVER () // {FOLDS + 1} AS size
                  FROM training""",
    ),
)
def _(m):
    return plain(forecast.fold_report(features.block(m["split"], "train"), FOLDS))


def _metrics_sql(column: str) -> str:
    return f"""
      ROUND(AVG(ABS(target - {column})), 3) AS "MAE",
      ROUND(SQRT(AVG(POWER(target - {column}, 2))), 3) AS "RMSE",
      ROUND(CASE WHEN MAX(target) = MIN(target) THEN CAST(SUM(POWER(target - {column}, 2)) = 0 AS DOUBLE)
           ELSE 1 - SUM(POWER(target - {column}, 2)) / NULLIF(VAR_POP(target) * COUNT(*), 0) END, 3) AS "R2",
      ROUND(SUM(ABS(target - {column})) / NULLIF(SUM(ABS(target)), 0), 3) AS "WAPE", COUNT(*) AS n"""


def _parts(m):
    split = m["split"]
    return [features.block(split, s) for s in ("train", "validation", "test")]


def _baselines(m):
    train, validation, test = _parts(m)
    both = train.unionByName(validation)
    models = {b: forecast.fit(b, both) for b in forecast.BASELINES}
    out = test
    for name, model in models.items():
        out = forecast.score(model, out).withColumnRenamed("prediction", name)
    return out.select("date", "target", "weekday", *models)


@register(
    "baseline_predictions",
    over(f"SELECT {ISO}, weekday, {_listed(['target', *forecast.BASELINES])} FROM holdout", **PARTS),
)
def _(m):
    return _tidy(_baselines(m))


@register(
    "baseline_holdout_metrics",
    over(
        " UNION ALL ".join(
            f"SELECT '{b}' AS model, {_metrics_sql(b)} FROM holdout" for b in forecast.BASELINES
        ),
        **PARTS,
    ),
)
def _(m):
    return rounded(forecast.holdout_metrics(_baselines(m), forecast.BASELINES), 3)


@register(
    "baseline_metrics_by_weekday",
    over(f"SELECT weekday, {_metrics_sql('seasonal_naive')} FROM holdout GROUP BY weekday", **PARTS),
)
def _(m):
    return rounded(
        forecast.regression_metrics(_baselines(m), "target", "seasonal_naive", ["weekday"]), 3
    )


@register(
    "forecast_measures",
    over(
        """SELECT CAST(YEAR(date) AS INTEGER) AS year,
             ROUND(AVG(ABS(target - dummy_mean)), 3) AS forecast_mae,
             ROUND(SQRT(AVG(POWER(target - dummy_mean, 2))), 3) AS forecast_rmse,
             ROUND(SUM(ABS(target - dummy_mean)) / NULLIF(SUM(target), 0), 3) AS forecast_wape,
             ROUND(AVG(ABS(target - seasonal_naive)), 3) AS seasonal_baseline_mae,
             ROUND(AVG(ABS(target - seasonal_naive)) - AVG(ABS(target - dummy_mean)), 3)
               AS mae_improvement_over_seasonal
           FROM holdout GROUP BY 1""",
        **PARTS,
    ),
)
def _(m):
    evaluated = _baselines(m).withColumnRenamed("dummy_mean", "selected")
    return rounded(
        metrics.forecast_measure(
            evaluated, list(metrics.FORECAST_MEASURES), [F.year("date").alias("year")]
        ),
        3,
    )


SELECTED = ["selected", *forecast.BASELINES]


def model_run(m):
    """Models fitted once for these rows and settings; later sessions open what is stored."""
    train, validation, _test = _parts(m)

    def run():
        features.require_split(m["split"])
        return forecast.stored_run(ModelStore(m.spark), train, validation, k=FOLDS, parallelism=8)

    return m.once("models", run)


def holdout(m):
    """Evaluated predictions of the holdout days, written once."""

    def write():
        models = {name: model_run(m).model(name) for name in SELECTED}
        return materialize(forecast.holdout_predictions(models, _parts(m)[2]), f"{m.folder}/holdout")

    return m.once("holdout", write)


@register("candidate_comparison")
def _(m):
    return model_run(m).table("comparison")


@register("search_results")
def _(m):
    return model_run(m).table("search_results")


@register("tuning_summary")
def _(m):
    return model_run(m).table("summary")


@register("model_manifest")
def _(m):
    return model_run(m).manifest_frame()


@register("holdout_predictions")
def _(m):
    return holdout(m)


@register("holdout_metrics")
def _(m):
    return forecast.holdout_metrics(holdout(m), SELECTED)


@register("holdout_metrics_by_weekday")
def _(m):
    return forecast.regression_metrics(holdout(m), "target", "selected", ["weekday"])


@register("residual_histogram")
def _(m):
    return eda.histogram(holdout(m), "residual", 25)


@register("residual_summary")
def _(m):
    return forecast.residual_summary(holdout(m))


@register("permutation_importance")
def _(m):
    return forecast.permutation_importance(model_run(m).model("selected"), _parts(m)[2])


@register("batch_inference")
def _(m):
    return forecast.batch_inference(model_run(m).model("selected"), _future(m), user_supplied=False)


@register("prediction_manifest")
def _(m):
    return forecast.prediction_manifest(model_run(m), _future(m))


@register("reloaded_model_scores", over("SELECT COUNT(*) AS rows, 0 AS different FROM split WHERE split = 'test'", **PARTS))
def _(m):
    """A stored model, loaded again, against one fitted anew: predictions which differ by a billionth."""
    train, _validation, test = _parts(m)
    stored = forecast.score(model_run(m).model("candidate_ridge"), test)
    fresh = forecast.score(forecast.fit("ridge", train), test).select("date", F.col("prediction").alias("again"))
    far = F.abs(F.col("prediction") - F.col("again")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("again"))
    return stored.join(fresh, "date").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(far.cast("int")), F.lit(0)).cast("int").alias("different")
    )


@register("panel_ridge_holdout")
def _(m):
    """One ridge model over all country series, evaluated per country."""
    split = m["country_split"]
    model = forecast.fit("ridge", split.where(F.col("split") != "test"))
    scored = forecast.score(model, split.where(F.col("split") == "test"))
    return forecast.regression_metrics(scored, by=["country"])
