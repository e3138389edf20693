import pytest
from pyspark.sql import functions as F

from tests.data import daily_frame
from tillspark.operators import features, forecast
from tillspark.operators.checks import CheckFailed
from tillspark.sources.model_store import ModelStore, content_of

SMALL = {
    "random_forest": {"trees": 3, "depth": 2},
    "gradient_boosting": {"trees": 2, "leaves": 3},
}


@pytest.fixture(scope="module")
def blocks(spark):
    split = features.chronological_split(features.engineer_features(daily_frame(spark)))
    return [features.block(split, s).cache() for s in ("train", "validation", "test")]


def test_a_second_session_opens_what_the_first_stored(spark, blocks, tmp_path, monkeypatch):
    train, validation, test = blocks
    monkeypatch.setitem(forecast.GRIDS, "random_forest", {"trees": [2], "depth": [2]})
    monkeypatch.setitem(forecast.GRIDS, "gradient_boosting", {"trees": [2], "leaves": [3]})
    store = ModelStore(spark, str(tmp_path / "store"))
    first = forecast.stored_run(store, train, validation, 2, 2, settings=SMALL)
    assert {r[0] for r in first.table("comparison").select("model").collect()} == set(forecast.CANDIDATES)
    row = first.table("summary").first()
    assert row["refit_rows"] == train.count() + validation.count() and row["refit_end"] == "2010-05-05"
    monkeypatch.setattr(forecast, "compare_candidates", lambda *a, **k: pytest.fail("fitted again"))
    again = forecast.stored_run(
        ModelStore(spark, str(tmp_path / "store")), train.repartition(3), validation, 2, 2, settings=SMALL
    )
    assert again.path == first.path and again.manifest == first.manifest
    for name in again.models:
        a, b = (
            [r["prediction"] for r in forecast.score(e.model(name), test).orderBy("date").collect()]
            for e in (first, again)
        )
        assert a == b and len(a) == test.count()
    told = {r["model"]: r for r in again.manifest_frame().collect()}
    assert told["candidate_ridge"]["fitted_rows"] == train.count()
    assert told["selected"]["fitted_rows"] == row["refit_rows"]
    assert len({r["model_sha256"] for r in told.values()}) == len(told)
    [sent] = forecast.prediction_manifest(again, test).collect()
    assert sent["rows"] == test.count() and sent["model_sha256"] == told["selected"]["model_sha256"]
    with pytest.raises(CheckFailed):
        again.model("nothing")


def test_other_rows_or_settings_have_another_key(blocks):
    train = blocks[0]
    assert content_of(train) == content_of(train.repartition(5))
    assert content_of(train) != content_of(train.withColumn("lag_1", F.col("lag_1") + 1))
    assert content_of(train.where("false"))["rows"] == 0
    assert ModelStore.key({"a": 1}) != ModelStore.key({"a": 2})


def test_a_broken_write_leaves_no_entry(spark, blocks, tmp_path):
    store = ModelStore(spark, str(tmp_path / "store"))
    model = forecast.fit("dummy_mean", blocks[0])
    broken = blocks[0].select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.save("k", {"m": (model, 1, "")}, {"t": broken}, {})
    assert store.open("k") is None
    assert store.save("k", {"m": (model, 1, "")}, {}, {"input": {"digest": ""}}).manifest["models"]["m"]["rows"] == 1
