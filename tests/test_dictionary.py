"""Label codes as tables, and missing numbers that trees can send either way."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import customer, rows
from retentia.operators.skew import attach_unique
from retentia.plans import dictionary, evaluate, explain, features, train


def test_codes_follow_the_global_order(spark, tmp_path):
    words = [f"w{random.Random(1).randrange(10**6)}" for _ in range(500)] + [f"v{i}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), ("Ä",)], "k string").repartition(5)
    tables = dictionary.fit_label_tables(df, ["k"], str(tmp_path / "t"))
    got = dict(rows(tables.table(spark, "k")))
    assert got == {w: i for i, w in enumerate(sorted({*words, "None", "", "Ä"}, key=str.encode))}


def test_same_codes_as_the_fitted_encoder(spark, tmp_path):
    df = spark.createDataFrame([("b", 3), ("a", None), ("b", 1), (None, 3)], "k string, n int")
    tables = dictionary.fit_label_tables(df, ["k", "n"], str(tmp_path / "t"))
    want = features.encode(df, features.fit_encoder(df, ["k", "n"]), ["k", "n"])
    assert sorted(rows(dictionary.encode_by_tables(df, tables))) == sorted(rows(want))


def test_unseen_class_in_a_table(spark, tmp_path):
    seen, new = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("z",), (None,)], "k string")
    tables = dictionary.fit_label_tables(seen, ["k"], str(tmp_path / "t"))
    assert sorted(rows(dictionary.encode_by_tables(new, tables))) == [(0,), (0,), (1,)]
    with pytest.raises(Exception, match="Unseen label of k"):
        dictionary.encode_by_tables(new, tables, strict=True).collect()


def test_many_classes_and_a_hot_one(spark, tmp_path):
    df = spark.range(300_000).selectExpr("if(id % 3 = 0, 'hot', concat('c', lpad(id, 7, '0'))) AS k", "id")
    tables = dictionary.fit_label_tables(df, ["k"], str(tmp_path / "t"))
    assert rows(tables.table(spark, "k").agg(F.count("*"), F.max("code"))) == [(200_001, 200_000)]
    coded = dictionary.encode_by_tables(df, tables)
    assert rows(coded.agg(F.count("*"), F.count_if(F.col("k") == 200_000))) == [(300_000, 100_000)]


def test_fitting_again_replaces_the_table(spark, tmp_path):
    for values in (["a", "b"], ["c"]):
        tables = dictionary.fit_label_tables(spark.createDataFrame([(v,) for v in values], "k string"), ["k"], str(tmp_path))
    assert rows(tables.table(spark, "k")) == [("c", 0)]


def test_hot_keys_are_dealt_over_tasks(spark):
    facts = spark.range(6000).selectExpr("if(id < 3000, 'hot', concat('k', id % 50)) AS k", "id").union(
        spark.createDataFrame([(None, -1), ("gone", -2)], "k string, id long"))
    lookup = spark.createDataFrame([("hot", 7)] + [(f"k{i}", i) for i in range(50)], "k string, v long")
    got = attach_unique(facts, lookup, "k", parts=4)
    assert sorted(rows(got), key=str) == sorted(rows(facts.join(lookup, "k", "left").select("k", "id", "v")), key=str)


@pytest.fixture(scope="module")
def blanked(make):
    """Customers whose charge is missing mostly when they left, and otherwise says nothing."""
    rng = random.Random(5)
    out = []
    for i in range(600):
        churn = int(rng.random() < 0.4)
        missing = rng.random() < (0.9 if churn else 0.05)
        charge = None if missing else round(rng.uniform(20, 120), 2)
        out.append(customer(f"c{i:03}", tenure=rng.randrange(73), charge=charge, churn=churn))
    return make.customers(out).repartition(2).persist()


def test_trees_learn_from_missing_numbers(blanked):
    test = F.crc32("customerID") % 4 == 0
    sets = features.FeatureSet(numbers=("tenure", "MonthlyCharges"), categories=())
    model = train.fit_model(blanked.where(~test), sets, train.BoosterSettings(rounds=8, depth=3, rate=0.3))
    assert features.places(model) == [0, 1, 1]
    held_out = blanked.where(test)
    assert evaluate.roc_auc(train.score_table(model, held_out, sets)).first()[0] > 0.85
    for method, total in (("shap", None), ("gain", 1.0)):
        phi = explain.attribution(model, held_out, sets.names, method).collect()
        assert {len(r.phi) for r in phi} == {2}
        assert total is None or sum(phi[0].phi) == pytest.approx(total)
    ranked = rows(explain.global_importance(explain.attribution(model, held_out, sets.names), sets.names))
    assert ranked[0][0] == "MonthlyCharges"


def test_complete_numbers_need_no_mark(blanked):
    sets = features.FeatureSet(numbers=("tenure", "MonthlyCharges"), categories=())
    prepared = features.fit_features(blanked.where("MonthlyCharges IS NOT NULL"), sets)
    assert features.places(prepared) == [0, 1]
    vectors = prepared.transform(blanked).select("features").collect()
    assert {len(v[0]) for v in vectors} == {2}
