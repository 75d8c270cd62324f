import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import customer, rows
from retentia import schema as S
from retentia.functions import shapley
from retentia.operators.split import stratified_split
from retentia.plans import evaluate, explain, features, score, train
from retentia.plans.features import FeatureSet
from retentia.sources.requests import score_requests
from retentia.streaming import scoring
from retentia.streaming.scoring import record_stream, score_requests_stream, score_stream

FEATURES = FeatureSet()
QUICK = train.BoosterSettings(rounds=5, depth=3, rate=0.3)


@pytest.fixture(scope="module")
def people(make):
    """Churn depends on contract, tenure and charge, with some noise."""
    rng = random.Random(3)
    out = []
    for i in range(400):
        contract = rng.choice(["Month-to-month", "One year", "Two year"])
        tenure, charge = rng.randrange(73), round(rng.uniform(18, 120), 2)
        odds = (contract == "Month-to-month") + (tenure < 20) + (charge > 70)
        out.append(customer(
            f"c{i:03}", contract, rng.choice(["DSL", "Fiber optic", "No"]), tenure, charge,
            round(tenure * charge, 2), int(odds + rng.random() > 2), rng.randrange(2),
            rng.choice(["Electronic check", "Mailed check"]), gender=rng.choice(["Male", "Female"]),
            Partner=rng.choice(["Yes", "No"])))
    return make.customers(out).repartition(3).persist()


@pytest.fixture(scope="module")
def fitted(people):
    split = stratified_split(people).persist()
    model = train.fit_model(split.where("is_test = 0"), FEATURES, QUICK)
    return model, split.where("is_test = 1")


def test_codes_follow_sorted_classes(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), ("a", "y")], "k string, v string")
    encoder = features.fit_encoder(df, ["k", "v"])
    # 'None' sorts before 'x' and 'y'
    assert rows(features.encode(df, encoder, ["k", "v"])) == [(1, 1), (0, 0), (2, 1), (0, 2)]


def test_unseen_class_is_zero_or_an_error(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "k string")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "k string")
    assert rows(features.encode(new, features.fit_encoder(seen, ["k"]), ["k"])) == [(1,), (0,), (0,)]
    strict = features.fit_encoder(seen, ["k"], strict=True)
    assert rows(features.encode(seen, strict, ["k"])) == [(0,), (1,)]
    with pytest.raises(Exception, match="Unseen label"):
        features.encode(new, strict, ["k"]).collect()


def test_categories_have_no_upper_number(spark):
    wide = spark.range(10_001).selectExpr("lpad(cast(id as string), 5, '0') k")
    coded = features.encode(wide, features.fit_encoder(wide, ["k"]), ["k"])
    assert rows(coded.agg({"k": "max"})) == [(10_000,)] and coded.distinct().count() == 10_001


def test_missing_numbers_take_the_mean(spark):
    seen = spark.createDataFrame([(1, 5.0), (3, None), (None, float("nan"))], "x int, y double")
    scaler = features.fit_scaler(seen, ["x", "y"])
    new = spark.createDataFrame([(None, None), (2, 5.0)], "x int, y double")
    got = scaler.transform(new).select(vector_to_array("features")).collect()
    assert [list(r[0]) for r in got] == [[0.0, 0.0], [0.0, 0.0]]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    scaled = features.fit_scaler(df, ["x", "y"]).transform(df)
    assert [list(r[0]) for r in scaled.select(vector_to_array("features")).collect()] == [
        [pytest.approx(-1.0), 0.0], [pytest.approx(1.0), 0.0]]


def test_features_are_ordered_numbers_for_the_trees(fitted):
    model, holdout = fitted
    trees, weights = explain.tree_nodes(holdout.sparkSession, model)
    splits = [n["split"] for t in trees for n in t.values() if n["leftChild"] >= 0]
    assert splits and all(s["numCategories"] == -1 for s in splits)
    assert len(trees) == len(weights) == QUICK.rounds


def test_scores_beat_chance_and_repeat(people, fitted):
    model, holdout = fitted
    table = train.score_table(model, holdout, FEATURES).persist()
    assert table.where("score < 0 or score > 1").count() == 0
    assert evaluate.roc_auc(table).first()[0] > 0.8
    again = train.fit_model(stratified_split(people).where("is_test = 0"), FEATURES, QUICK)
    assert sorted(rows(train.score_table(again, holdout, FEATURES))) == sorted(rows(table))


def test_rounds_have_no_more_tasks_than_cores(people, monkeypatch):
    """However many splits the staged files have."""
    stage, booster, dealt = train.stage, train.GBTClassifier, []

    class Seen(booster):
        def fit(self, df):
            dealt.append(df.rdd.getNumPartitions())
            return super().fit(df)

    def staged(df, name):
        # One folder per part, as Spark packs small files of one folder into a few splits.
        parts = [stage(df.where(F.pmod(F.xxhash64(*df.columns[:1]), F.lit(6)) == i), name) for i in range(6)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        whole.staged_in = parts[0].staged_in
        return whole

    monkeypatch.setattr(train, "stage", staged)
    monkeypatch.setattr(train, "GBTClassifier", Seen)
    sets = FeatureSet(numbers=("tenure", "MonthlyCharges"), categories=("Contract",))
    monkeypatch.setattr(train, "release", lambda df: None)
    model = train.fit_model(people, sets, train.BoosterSettings(rounds=2, depth=2))
    assert train.predict_proba(model, people).count() == 400
    assert dealt == [4]
    monkeypatch.setattr(train, "MOST_ROWS_PER_TASK", 80)
    train.fit_model(people, sets, train.BoosterSettings(rounds=2, depth=2))
    assert dealt == [4, 5]


def test_rounds_are_dealt_over_the_cores_and_leave_nothing(spark, people, fitted, monkeypatch):
    monkeypatch.setattr(train, "ROWS_PER_TASK", 50)
    seen, stage = [], train.stage

    def staged(df, name):
        seen.append(stage(df.coalesce(1), name))
        return seen[-1]

    monkeypatch.setattr(train, "stage", staged)
    sets = FeatureSet(numbers=("tenure", "MonthlyCharges"), categories=("Contract",))
    model = train.fit_model(people, sets, train.BoosterSettings(rounds=2, depth=2))
    assert train.predict_proba(model, people).count() == 400
    assert len(seen) == 2
    for gone in seen:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist"):
            spark.read.parquet(gone.staged_in).count()


def test_prediction_columns(fitted):
    model, holdout = fitted
    scored = score.score_customers(model, holdout, ("customerID", "Contract"))
    raw = {r.customerID: r.score for r in train.predict_proba(model, holdout).collect()}
    for r in scored.collect():
        p = raw[r.customerID]
        assert r.churn_probability == pytest.approx(p, abs=5.1e-5)
        assert r.churn_prediction == int(p >= 0.5)
        assert r.risk_level == ("HIGH" if p >= 0.7 else "MEDIUM" if p >= 0.4 else "LOW")
        assert (S.ADVICE_CONTRACT in r.recommendations) == (r.Contract == "Month-to-month")


def test_scoring_is_one_narrow_stage(fitted):
    model, holdout = fitted
    plan = score.score_customers(model, holdout.sparkSession.createDataFrame(
        [tuple(customer("x").values())], S.CUSTOMERS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_unknown_category_scores_like_code_zero(fitted, make):
    model, _ = fitted
    first, odd = make.customers([customer("a", "Month-to-month")]), make.customers([customer("a", "Lifetime")])
    p = [train.predict_proba(model, df).first()["score"] for df in (first, odd)]
    assert p[0] == p[1]


def test_model_survives_saving(spark, fitted, tmp_path):
    model, holdout = fitted
    train.save_model(model, str(tmp_path / "m"))
    train.save_model(model, str(tmp_path / "m"))
    loaded = train.load_model(spark, str(tmp_path / "m"))
    assert sorted(rows(train.score_table(loaded, holdout, FEATURES))) == sorted(
        rows(train.score_table(model, holdout, FEATURES)))


def test_holdout_loss_ends_at_the_log_loss(fitted):
    model, holdout = fitted
    losses = rows(train.holdout_loss(model, holdout, FEATURES))
    assert [i for i, _ in losses] == list(range(1, QUICK.rounds + 1))
    final = evaluate.log_loss(train.score_table(model, holdout, FEATURES)).first()[0]
    assert losses[-1][1] == pytest.approx(final, rel=1e-9)


def test_attributions_add_up_to_the_log_odds(fitted):
    model, holdout = fitted
    phi = {r.customerID: r for r in explain.tree_attribution(model, holdout, FEATURES.names).collect()}
    scores = train.predict_proba(model, holdout).collect()
    assert len(phi) == len(scores)
    for r in scores:
        p = r.score
        found = phi[r.customerID]
        assert len(found.phi) == 12
        assert found.base + sum(found.phi) == pytest.approx(math.log(p / (1 - p)), abs=1e-9)


def expected(nodes, at, x, known):
    """Tree value when only the features in `known` are known."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    f, t = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    left, right = node["leftChild"], node["rightChild"]
    if f in known:
        return expected(nodes, left if x[f] <= t else right, x, known)
    a, b = nodes[left]["rawCount"], nodes[right]["rawCount"]
    return (a * expected(nodes, left, x, known) + b * expected(nodes, right, x, known)) / (a + b)


def test_attributions_equal_brute_force_shapley(spark, fitted):
    model, holdout = fitted
    trees, weights = explain.tree_nodes(spark, model)
    vectors = train.feature_vectors(model, holdout).select("customerID", vector_to_array("features").alias("x"))
    xs = {r.customerID: r.x for r in vectors.orderBy("customerID").limit(4).collect()}
    phi = {r.customerID: r.phi for r in explain.tree_attribution(model, holdout, FEATURES.names).collect()}
    for id, x in xs.items():
        want = [0.0] * 12
        for nodes, w in zip(trees, weights):
            used = sorted({n["split"]["featureIndex"] for n in nodes.values() if n["leftChild"] >= 0})
            for i in used:
                others = [f for f in used if f != i]
                for size in range(len(others) + 1):
                    weight = 1 / (len(used) * math.comb(len(others), size))
                    for subset in itertools.combinations(others, size):
                        gain = expected(nodes, 0, x, {*subset, i}) - expected(nodes, 0, x, set(subset))
                        want[i] += 2 * w * weight * gain
        assert phi[id] == pytest.approx(want, abs=1e-9)


def grown(rng, depth, width, at=0, nodes=None):
    """A random tree in the form of a saved one; thresholds fall on values that rows have."""
    nodes = {} if nodes is None else nodes
    leaf = depth == 0 or rng.random() < 0.1
    node = nodes[at] = {"id": at, "prediction": rng.uniform(-1, 1), "rawCount": 0, "leftChild": -1, "rightChild": -1}
    if leaf:
        node["rawCount"] = rng.randrange(1, 50)
        return nodes
    node["split"] = {"featureIndex": rng.randrange(width), "numCategories": -1,
                     "leftCategoriesOrThreshold": [rng.randrange(-3, 4)]}
    node["leftChild"] = len(nodes)
    grown(rng, depth - 1, width, len(nodes), nodes)
    node["rightChild"] = len(nodes)
    grown(rng, depth - 1, width, len(nodes), nodes)
    node["rawCount"] = nodes[node["leftChild"]]["rawCount"] + nodes[node["rightChild"]]["rawCount"]
    return nodes


@pytest.mark.parametrize("seed,depth", [(0, 1), (1, 3), (2, 5), (3, 8)])
def test_split_bits_against_all_subsets(seed, depth):
    """Also trees of more than 64 splits, features met several times on a path, and NaN."""
    rng, width = random.Random(seed), 4
    trees, weights = [grown(rng, depth, width) for _ in range(3)], [1.0, 0.5, 0.25]
    parsed = explain.parsed_trees(trees, weights)
    assert depth < 8 or max(len(t.splits) for t in parsed) > 64
    x = np.array([[rng.choice([-3, -1.5, 0, 2, 9, math.nan]) for _ in range(width)] for _ in range(12)])
    got = shapley.attribute_rows(x, [explain._compiled(t) for t in parsed])
    for row, phi in zip(x, got):
        for i in range(width):
            want = sum(
                2 * w * (expected(nodes, 0, row, {*subset, i}) - expected(nodes, 0, row, set(subset)))
                / (width * math.comb(width - 1, size))
                for nodes, w in zip(trees, weights) for size in range(width)
                for subset in itertools.combinations([f for f in range(width) if f != i], size)
            )
            assert phi[i] == pytest.approx(want, abs=1e-12)
    base = sum(2 * w * expected(nodes, 0, x[0], set()) for nodes, w in zip(trees, weights))
    assert explain.base_value(parsed) == pytest.approx(base, abs=1e-12)


def test_booster_is_exported_once(spark, fitted, monkeypatch):
    model, holdout = fitted
    exports, tree_nodes = [], explain.tree_nodes
    monkeypatch.setattr(explain, "tree_nodes", lambda *a: exports.append(1) or tree_nodes(*a))
    monkeypatch.setattr(train.booster_of(model), "explained_in", None, raising=False)
    first = explain.tree_attribution(model, holdout, FEATURES.names)
    again = explain.tree_attribution(model, holdout, FEATURES.names)
    assert sorted(rows(first)) == sorted(rows(again)) and exports == [1]


def test_importance(spark, fitted, tmp_path):
    model, holdout = fitted
    found = explain.attribution(model, holdout, FEATURES.names)
    long = explain.long_form(found, FEATURES.names)
    assert long.count() == 12 * holdout.count()
    table = explain.global_importance(found, FEATURES.names)
    values = rows(table)
    assert len(values) == 12 and {v[2] for v in values} == {"shap"}
    assert [v[1] for v in values] == sorted((v[1] for v in values), reverse=True)
    assert {v[0] for v in values[:3]} == {"Contract", "tenure", "MonthlyCharges"}
    explain.write_importance(table, str(tmp_path / "imp"))
    assert rows(explain.read_importance(spark, str(tmp_path / "imp"))) == [v[:2] for v in values]


def test_sampled_importance_and_stored_attributions(spark, fitted, tmp_path):
    model, holdout = fitted
    whole = explain.global_importance(explain.attribution(model, holdout, FEATURES.names), FEATURES.names)
    # a sample of at least as many rows is the whole table
    assert rows(explain.sampled_importance(model, holdout, FEATURES.names)) == [
        (f, pytest.approx(v), m) for f, v, m in rows(whole)]
    found = explain.attribution(model, holdout, FEATURES.names)
    explain.write_attributions(found, FEATURES.names, str(tmp_path / "phi"))
    stored = spark.read.parquet(str(tmp_path / "phi"))
    assert stored.columns == ["customerID", "feature", "phi", "method"]
    assert stored.count() == 12 * holdout.count()


def test_importance_file_with_other_headers(spark, tmp_path):
    (tmp_path / "i.csv").write_text(",0\ntenure,0.25\n")
    assert rows(explain.read_importance(spark, str(tmp_path / "i.csv"))) == [("tenure", 0.25)]


def test_gain_is_an_explicit_choice(fitted):
    model, holdout = fitted
    table = rows(explain.global_importance(
        explain.attribution(model, holdout, FEATURES.names, "gain"), FEATURES.names))
    assert {r[2] for r in table} == {"gain"}
    assert sum(r[1] for r in table) == pytest.approx(1.0)
    with pytest.raises(KeyError):
        explain.attribution(model, holdout, FEATURES.names, "other")


def test_stream_scores_each_record_once(spark, fitted, tmp_path):
    model, holdout = fitted
    arrived, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    batch = holdout.drop("is_test").orderBy("customerID").persist()
    half = batch.limit(30)
    half.write.parquet(arrived)
    for part in (None, batch.exceptAll(half)):
        if part is not None:
            part.write.mode("append").parquet(arrived)
        records = record_stream(spark, arrived, S.CUSTOMERS, files=1)
        score_stream(model, records, out, log).awaitTermination()
    got = sorted(rows(spark.read.parquet(out)))
    assert got == sorted(rows(score.score_customers(model, batch)))


def test_a_batch_of_one_file_is_scored_by_all_cores(spark, fitted, tmp_path, monkeypatch):
    model, holdout = fitted
    arrived, out, bad, log = (str(tmp_path / n) for n in ("in", "out", "bad", "log"))
    asked = holdout.drop("is_test")
    asked.coalesce(1).write.parquet(arrived)
    monkeypatch.setattr(scoring, "ROWS_PER_TASK", 10, raising=False)
    score_requests_stream(model, record_stream(spark, arrived, asked.schema, files=1), out, bad, log).awaitTermination()
    got = spark.read.parquet(out)
    assert len(got.inputFiles()) == 4
    want = score.score_customers(model, score_requests(asked, True))
    assert sorted(rows(got.select(*want.columns))) == sorted(rows(want))


def test_rejected_requests_have_their_own_sink(spark, fitted, tmp_path, monkeypatch):
    """A run that fails between the two sinks and is started again equals the batch."""
    model, holdout = fitted
    arrived, out, bad, log = (str(tmp_path / n) for n in ("in", "out", "bad", "log"))
    text = holdout.drop("is_test").withColumns({
        "tenure": F.when(F.col("tenure") % 5 == 0, "soon").otherwise(F.col("tenure").cast("string")),
        "SeniorCitizen": F.when(F.col("tenure") % 3 == 0, "Maybe").otherwise("Yes"),
    })
    text.repartition(3).write.parquet(arrived)

    def run():
        records = record_stream(spark, arrived, text.schema, files=1)
        score_requests_stream(model, records, out, bad, log).awaitTermination()

    unreadable, calls = scoring.unreadable_fields, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return unreadable(*args)

    monkeypatch.setattr(scoring, "unreadable_fields", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    # Batch 1 had begun: what a half-written batch leaves behind must not count twice.
    text.limit(0).select("customerID").write.parquet(f"{out}/batch=1")
    run()
    batch = text.withColumn("unreadable", unreadable(text))
    want = score.score_customers(model, score_requests(batch.where("size(unreadable) = 0").select(*text.columns), True))
    columns = want.columns
    assert sorted(rows(spark.read.parquet(out).select(*columns))) == sorted(rows(want))
    refused = spark.read.parquet(bad).select("customerID", "tenure", "unreadable")
    assert sorted(rows(refused)) == sorted(rows(batch.where("size(unreadable) > 0").select("customerID", "tenure", "unreadable")))
    assert {tuple(r[2]) for r in rows(refused)} == {("tenure",), ("SeniorCitizen",), ("SeniorCitizen", "tenure")}
    assert len(rows(spark.read.parquet(out).select("batch").distinct())) == 3
