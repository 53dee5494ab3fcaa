"""Metrics, comparisons, training runs, baselines and streaming."""

import uuid
from dataclasses import replace

import numpy as np
import pytest

from conftest import CORE, HOUSES, LAG_GAP, LOW, SPAN
from gridweave.functions.text import put
from gridweave.operators import baselines, evaluate, fuzzy
from gridweave.operators.quality import DataQualityError
from gridweave.operators.scaling import ColumnStats
from gridweave.plans import train
from gridweave.plans.preprocess import Prepared
from gridweave.session import stored
from gridweave.sources import files
from gridweave.sources.models import load_baseline
from gridweave.streaming.scoring import read_rows, score_stream, write_scores


def test_metrics_by_hand(spark):
    actual, predicted = np.array([40.0, 55.0, 90.0, 15.0]), np.array([42.0, 50.0, 99.0, 15.0])
    df = spark.createDataFrame(list(zip(actual.tolist(), predicted.tolist())), "a double, p double")
    row, error = evaluate.metrics(df, "a", "p").first(), actual - predicted
    assert row["mae"] == pytest.approx(np.abs(error).mean())
    assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert row["mape"] == pytest.approx((np.abs(error) / actual).mean() * 100)
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((actual - actual.mean()) ** 2).sum())


def test_rows_without_a_prediction_do_not_count(spark):
    pairs = [(40.0, 42.0), (55.0, 50.0), (1000.0, None), (None, 3.0)]
    some = evaluate.metrics(spark.createDataFrame(pairs, "a double, p double"), "a", "p").first()
    scored = evaluate.metrics(spark.createDataFrame(pairs[:2], "a double, p double"), "a", "p").first()
    assert some == scored


def test_guards_for_zero_and_constant_actuals(spark):
    df = spark.createDataFrame([(0.0, 1e-8), (0.0, 0.0)], "a double, p double")
    row = evaluate.metrics(df, "a", "p").first()
    assert row["mape"] == pytest.approx(50.0) and row["r2"] == 0.0


def test_missing_metric_gives_null_difference(spark):
    table = spark.createDataFrame(
        [("1h", "m", 1.0, 2.0, 3.0, 0.5), ("1h", "b", 2.0, None, 3.5, 0.25), ("24h", "m", 1.0, 1.0, 1.0, 1.0)],
        "horizon string, model string, mae double, rmse double, mape double, r2 double",
    )
    rows = {r["horizon"]: r for r in evaluate.compare_metrics(table, "m", "b", ["horizon"]).collect()}
    assert (rows["1h"]["mae_delta"], rows["1h"]["rmse_delta"], rows["1h"]["r2_delta"]) == (-1.0, None, 0.25)
    assert rows["24h"]["mae_delta"] is None


@pytest.fixture(scope="module")
def data(processed):
    raw, scaled, stats = processed
    return train.fit_data_from_files(scaled, raw, stats, "1h", "load_kwh")


def test_metrics_are_in_raw_units(data, part_rows):
    """A model that always says 0.25 predicts one raw value."""
    constant = fuzzy.FuzzyModel(
        tuple(CORE), np.full((6, 1), 0.5), np.full((6, 1), 0.1), fuzzy.rule_grid(1, 6), np.array([[0.25, 0, 0, 0, 0, 0, 0]])
    )
    rows, said = train.test_predictions(data, constant).toPandas(), LOW + 0.25 * SPAN
    assert len(rows) == part_rows[2] and np.allclose(rows["predicted_kwh"], said)
    assert np.allclose(rows["baseline_lag24_kwh"], rows["actual_kwh"] - LAG_GAP)
    pair = evaluate.metric_pair(train.test_predictions(data, constant)).first()
    assert pair["model_mae"] == pytest.approx(np.abs(rows["actual_kwh"] - said).mean())
    assert pair["lag24_mae"] == pytest.approx(LAG_GAP)
    assert pair["mae_delta_model_minus_lag24"] == pytest.approx(pair["model_mae"] - LAG_GAP)


def test_missing_lag_fails(data):
    without = data.rows.drop("load_lag_24", "raw_lag_24")
    with pytest.raises(DataQualityError, match="cannot build the lag-24 baseline"):
        baselines.persistence(without)
    with pytest.raises(DataQualityError, match="1 missing or non-finite"):
        evaluate.require_complete(data.rows.limit(1).selectExpr("double('NaN') AS x"), ("x",), "baseline")


def test_run_end_to_end(spark, data, part_rows, tmp_path):
    model = train.fit_horizons([data], n_mfs=1)["1h"]
    record = train.run_records(data, model, "run", paths={"model": "shared/m1"}).first()
    assert record["paths"] == {"model": "shared/m1"} and record["target_column"] == "load_kwh"
    assert train.run_records(data, model, "run").first()["paths"] == {}
    assert [record["train_fit_rows"], record["validation_rows"], record["test_rows"]] == part_rows
    assert record["n_rules"] == 1 and record["predictions_finite"] is True
    scored = train.score_fit_data(data, model).toPandas()
    fit = scored[scored["split"] == "train_fit"]
    assert record["train_rmse_scaled"] == pytest.approx(np.sqrt(((fit["predicted_scaled"] - fit["load_kwh_scaled"]) ** 2).mean()))
    diagnostics = {r["split"]: r for r in train.fit_diagnostics(train.score_fit_data(data, model), "load_kwh").collect()}
    assert diagnostics["validation"]["rmse"] == pytest.approx(record["validation_rmse_scaled"])

    frame = train.test_predictions(data, model, text_time=False)
    payload = evaluate.payload(frame, run_id="run", horizon="1h", feature_set="core", target="load_kwh")
    row = payload.first()
    assert row["unit"] == "kWh" and row["test"]["rows"] == part_rows[2] and row["baselines"]["lag24"]["missing_count"] == 0
    assert row["baselines"]["lag24"]["independent_from_model_output"] is True
    files.write_metrics(payload, str(tmp_path / "m.json"))
    files.write_metrics(payload, str(tmp_path / "m.csv"), "csv")
    flat = spark.read.option("header", True).csv(str(tmp_path / "m.csv"))
    assert "test.target_stats_kwh.std" in flat.columns and flat.count() == 1
    assert spark.read.json(str(tmp_path / "m.json")).first()["model"]["mae"] == pytest.approx(row["model"]["mae"])
    with pytest.raises(ValueError, match="unsupported format"):
        files.write_metrics(payload, str(tmp_path / "m.xml"), "xml")
    files.write_predictions(train.test_predictions(data, model), str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.count() == part_rows[2] and len(back.first()["ape"].split(".")[1]) == 10


def test_plot_window(data):
    frame = train.test_predictions(data, train.fit_horizons([data], n_mfs=1)["1h"])
    assert evaluate.plot_window(frame, days=1).count() == 24
    assert evaluate.plot_window(frame, str(HOUSES[1][0]), 1).count() == 24
    assert evaluate.plot_window(frame, "nobody", 1).count() == 0


def test_baselines_fit_save_and_compare(spark, data, part_rows, tmp_path):
    rows = data.rows.drop("split", "raw_lag_24", "load_kwh_scaled").selectExpr("* EXCEPT (load_kwh)", "load_kwh AS target_1h")
    from gridweave.operators.splits import add_split

    stats = {**data.stats, "load_lag_24": ColumnStats(0.0, 1.0, 1.0), "target_1h": data.stats["load_kwh"]}
    prepared = Prepared("1h", "target_1h", add_split(rows), stats)
    wide = train.train_baselines(prepared, "core", base=str(tmp_path), forest_trees=5, boost_rounds=5)
    assert set(baselines.MODEL_NAMES) <= set(wide.columns) and wide.count() == part_rows[2]
    long = train.baseline_rows(wide, "core", "1h")
    assert long.count() == 4 * part_rows[2]
    files.write_model_predictions(long, str(tmp_path / "predictions"))
    assert spark.read.parquet(str(tmp_path / "predictions")).filter("dataset = 'core'").count() == 4 * part_rows[2]
    scores = baselines.score_models(long, ["dataset", "horizon", "model"])
    table = baselines.comparison_table(scores).toPandas()
    assert sorted(table["metric"]) == ["mae", "mape", "r2", "rmse"]
    # the load is a linear function of the scaled lag
    assert table.set_index("metric").loc["rmse", "Linear Regression"] < 1e-6
    for name in baselines.MODEL_NAMES:
        assert load_baseline(str(tmp_path), "core", name, "1h").stages


def test_stream_scoring(spark, data, tmp_path):
    model = train.fit_horizons([data], n_mfs=1)["1h"]
    rows = data.rows.select("datetime", *CORE)
    rows.write.parquet(str(tmp_path / "in"))
    stream = read_rows(spark, str(tmp_path / "in"), "datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in CORE))
    query = write_scores(score_stream(stream, model, "load_kwh", data.stats), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["datetime", "predicted_kwh"])
    want = train.score_fit_data(data, model).toPandas().sort_values(["datetime", "predicted"])
    np.testing.assert_allclose(got["predicted_kwh"], want["predicted"], atol=1e-9)


def test_unusable_predictions_stop_the_run(data):
    model = train.fit_horizons([data], n_mfs=1)["1h"]
    hole = "CASE WHEN split = 'test' AND hour(datetime) = 9 THEN {} ELSE {} END"
    for column, value in (("humidity", "double('NaN')"), ("raw_lag_24", "CAST(NULL AS DOUBLE)"), ("humidity", "double('inf')")):
        bad = replace(data, rows=put(data.rows, {column: hole.format(value, column)}))
        with pytest.raises(DataQualityError, match="missing or non-finite"):
            train.test_predictions(bad, model)
    bad = replace(data, rows=put(data.rows, {"humidity": hole.format("double('NaN')", "humidity")}))
    with pytest.raises(DataQualityError, match="missing or non-finite"):
        train.run_records(bad, model, "run")


def jobs_of(spark, work) -> int:
    name = f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(name, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_checks_ride_along_with_the_write(spark, data):
    """Predictions and run records start no job besides those that write the scores."""
    model = train.fit_horizons([data], n_mfs=1)["1h"]
    test = replace(data, rows=data.rows.filter("split = 'test'"))
    once = jobs_of(spark, lambda: stored(train.score_fit_data(test, model), "test"))
    assert jobs_of(spark, lambda: train.test_predictions(data, model)) == once > 0
    every = jobs_of(spark, lambda: stored(train.score_fit_data(data, model), "test"))
    assert jobs_of(spark, lambda: train.run_records(data, model, "run")) == every


def test_empty_split_stops_the_preprocessing(spark, data, tmp_path):
    from gridweave.operators.splits import add_split
    from gridweave.plans import preprocess

    rows = data.rows.drop("split", "raw_lag_24", "load_kwh_scaled").selectExpr("* EXCEPT (load_kwh)", "load_kwh AS target_1h")
    late = Prepared("1h", "target_1h", add_split(rows, "2030-01-01 00:00:00"), {**data.stats, "target_1h": data.stats["load_kwh"]})
    only_core = {"core": preprocess.FEATURE_SETS["core"]}
    before, preprocess.FEATURE_SETS = preprocess.FEATURE_SETS, only_core
    try:
        with pytest.raises(DataQualityError, match="empty split: test"):
            preprocess.write_horizon(spark, late, str(tmp_path / "out"))
    finally:
        preprocess.FEATURE_SETS = before


def test_a_shared_folder_is_required(spark):
    from gridweave import session

    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")

    class Context:
        def getConf(self):
            return self

        def get(self, name):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_a_run_written_again_replaces_its_own_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda run, value: spark.createDataFrame([(run, "1h", value), (run, "24h", value)], "run_id string, horizon string, v double")
    for run, value in (("007", 1.0), ("b", 2.0), ("007", 3.0)):
        files.append_runs(rows(run, value), path)
    found = {(r["run_id"], r["horizon"]): r["v"] for r in files.read_runs(spark, path).collect()}
    assert found == {("007", "1h"): 3.0, ("007", "24h"): 3.0, ("b", "1h"): 2.0, ("b", "24h"): 2.0}
