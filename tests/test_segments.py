"""The segment summary folded batch by batch, and distinct counts from sketches."""

import random

import pytest

from conftest import customer, rows
from retentia.plans import distinct, reports, segments
from retentia.sources import files


@pytest.fixture(scope="module")
def people(make):
    rng = random.Random(11)
    out = [customer(f"c{i}", rng.choice(["One year", "Two year", "", None]), rng.choice(["DSL", "No", None]),
                    rng.choice([None, 0, 5, 72]), rng.choice([None, float("nan"), 19.99, 0.005, 1e6]), churn=rng.randrange(2))
           for i in range(120)]
    return make.customers(out).persist()


def test_batches_give_the_figures_of_one_build(spark, people, tmp_path):
    path = str(tmp_path)
    parts = people.randomSplit([1.0, 2.0, 1.0], 3)
    for i, part in enumerate(parts):
        assert segments.fold_batch(spark, path, part, f"b{i}")
        assert not segments.fold_batch(spark, path, part, f"b{i}")  # sent again
    assert sorted(rows(segments.stored_figures(spark, path))) == sorted(rows(reports.segment_summary(people)))


def test_states_merge_in_any_grouping(people):
    a, b, c = (segments.segment_state(p) for p in people.randomSplit([1.0, 1.0, 1.0], 5))
    whole = sorted(rows(segments.segment_state(people)))
    assert sorted(rows(segments.merged(a, segments.merged(b, c)))) == whole
    assert sorted(rows(segments.merged(c, a, b))) == whole
    assert rows(segments.merged(a.limit(0))) == []


def test_a_failed_batch_is_not_counted(spark, people, tmp_path, monkeypatch):
    path = str(tmp_path)
    segments.fold_batch(spark, path, people.where("customerID < 'c5'"), "one")
    with monkeypatch.context() as patch:
        patch.setattr(files, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            segments.fold_batch(spark, path, people.where("customerID >= 'c5'"), "two")
    assert segments.fold_batch(spark, path, people.where("customerID >= 'c5'"), "two")
    assert sorted(rows(segments.stored_figures(spark, path))) == sorted(rows(reports.segment_summary(people)))


@pytest.mark.parametrize("n", [0, 1, 50, 40_000])
def test_sketches_stay_within_their_bound(spark, n):
    facts = spark.range(n).selectExpr("concat('c', id) AS customerID", "id % 7 AS day").unionByName(
        spark.range(n).selectExpr("concat('c', id) AS customerID", "(id + 3) % 7 AS day")
    ).unionByName(spark.range(1).selectExpr("CAST(NULL AS string) AS customerID", "0L AS day"))
    stored = distinct.sketches(facts, ["day"])
    assert abs(distinct.distinct_estimate(stored).first()[0] - n) <= distinct.error_bound(n)
    for r in rows(distinct.distinct_estimate(stored, ["day"])):
        held = {i for i in range(n) if r[0] in (i % 7, (i + 3) % 7)}
        assert abs(r[1] - len(held)) <= distinct.error_bound(len(held))
