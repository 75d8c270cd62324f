import hashlib
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import customer, rows
from retentia.operators import sampling, spine
from retentia.operators.skew import join_unique
from retentia.operators.split import hash_split, stratified_split

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def by_hash(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_spine_has_max_tenure_1_rows(make):
    people = make.customers([customer("a", tenure=0), customer("b", tenure=3), customer("c", tenure=None)])
    got = rows(spine.billing_month_spine(people).select("customerID", "month_num").orderBy("customerID", "month_num"))
    assert got == [("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 1)]


def test_spine_fill(make):
    people = make.customers([customer("a", tenure=2), customer("b", tenure=1)])
    paid = make.transactions([("a", 2, 0.1, "x", 1), ("a", 2, 0.2, "x", 1), ("a", 9, 5.0, "x", 1),
                              ("ghost", 1, 7.0, "x", 1)])
    filled = spine.spine_fill(people, spine.monthly_amounts(paid))
    got = rows(filled.select("customerID", "month_num", "amount").orderBy("customerID", "month_num"))
    months = [("a", m, {2: 0.3, 9: 5.0}.get(m, 0.0)) for m in range(1, 10)]  # paid after the tenure
    assert got == [*months, ("b", 1, 0.0)]


def test_sample_is_repeatable_and_independent_of_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "customerID")
    first = {r[0] for r in sampling.fixed_size_sample(df, 100).collect()}
    again = {r[0] for r in sampling.fixed_size_sample(df.repartition(7), 100).collect()}
    assert first == again == set(by_hash(range(1000))[:100])
    assert sampling.fixed_size_sample(df, 5000).count() == 1000


def test_preview_and_fraction(spark):
    df = spark.range(500).withColumnRenamed("id", "customerID")
    assert [r[0] for r in sampling.preview(df.repartition(5)).collect()] == list(range(200))
    assert 50 < sampling.fraction_sample(df, 0.2).count() < 150


def test_top_features(spark):
    table = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, importance double")
    assert [r[0] for r in sampling.top_features(table, 2).collect()] == ["c", "a"]
    assert sampling.top_features(table, 0).count() == 0
    with pytest.raises(ValueError):
        sampling.top_features(table, -1)


@FEW
@given(labels=st.lists(st.sampled_from([0, 1, 1, None]), max_size=60),
       fraction=st.sampled_from([0.0, 0.2, 0.5, 1.0]))
def test_split_equals_brute_force(spark, labels, fraction):
    df = spark.createDataFrame(list(enumerate(labels)), "customerID long, Churn int")
    got = {r.customerID: r.is_test for r in stratified_split(df, fraction).collect()}
    want = dict.fromkeys(range(len(labels)))
    for label in (0, 1):
        ids = by_hash([i for i, l in enumerate(labels) if l == label])
        cut = math.ceil(round(fraction * len(ids), 9))
        want.update({i: int(n < cut) for n, i in enumerate(ids)})
    assert got == want


def test_split_with_many_rows_per_prefix(spark):
    # far more rows than hash prefixes, so the cut lies inside a prefix
    df = spark.range(200_000).select(F.col("id").alias("customerID"), (F.col("id") % 3 == 0).cast("int").alias("Churn"))
    got = stratified_split(df).groupBy("Churn").agg(F.count("*"), F.sum("is_test")).orderBy("Churn")
    assert rows(got) == [(0, 133333, 26667), (1, 66667, 13334)]


def test_hash_split_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "customerID")
    assert 3700 < hash_split(df).agg(F.sum("is_test")).first()[0] < 4300


def test_skewed_join_equals_plain_join(spark):
    rng = random.Random(1)
    keys = [7] * 2000 + [rng.randrange(3000) for _ in range(2000)] + [None, 99_999]
    facts = spark.createDataFrame(list(enumerate(keys)), "row long, k long").repartition(3)
    lookup = facts.where("k is not null and k <> 99999").groupBy("k").agg(
        F.count("*").alias("n_rows"), F.min("row").alias("first"))
    got = sorted(rows(join_unique(facts, lookup, "k", "row")))
    want = sorted(rows(facts.join(lookup, "k").select("row", "k", "first")))
    assert got == want and len(got) == 4000


def test_skewed_join_spreads_the_hot_key(spark):
    # 4,000 of 8,000 rows belong to key -1, the others to 2,000 keys
    k = F.when(F.col("id") % 2 == 0, -1).otherwise((F.col("id") / 4).cast("long"))
    facts = spark.range(8000).select(F.col("id").alias("row"), k.alias("k"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n_rows"), F.min("row").alias("first"))
    fixed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
             "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in fixed}
    try:
        for name, value in fixed.items():
            spark.conf.set(name, value)
        joined = join_unique(facts, lookup, "k", "row").where("k = -1")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 4000 and max(sizes) < 1500
