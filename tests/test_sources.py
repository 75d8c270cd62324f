import os

import pytest
from pyspark.sql import functions as F

from conftest import customer, rows
from retentia import schema as S
from retentia.plans import catalog, eda, reports
from retentia.sources import files, lookup, results, staging
from retentia.sources.requests import score_requests


@pytest.fixture(scope="module")
def inputs(make):
    raw = make.raw([
        customer("a", "One year", "DSL", total="10", churn="Yes"),
        customer("b", "One year", "No", total=" ", churn="No"),
        customer("c", None, "DSL", total="30.5", churn="No"),
    ])
    paid = make.transactions([("a", 1, 10.0, "x", 0), ("c", 1, 5.0, "x", 1)])
    return raw, paid, make.tickets([("a", "Billing", 1, 5)])


def test_tables_survive_a_round_trip_and_are_replaced(spark, inputs, tmp_path):
    for _ in range(2):
        stored = files.build_tables(*inputs, str(tmp_path))
    derived = files.derive_tables(*inputs)
    for name in S.TABLES:
        columns = derived[name].columns
        assert sorted(rows(stored[name].select(*columns)), key=str) == sorted(rows(derived[name]), key=str)
    assert rows(files.row_count_report(stored)) == [
        ("customers", 2), ("transactions", 2), ("support_tickets", 1), ("segment_summary", 1)]


def test_contract_filter_prunes_directories(spark, inputs, tmp_path):
    stored = files.build_tables(*inputs, str(tmp_path))
    plan = stored["customers"].where("Contract = 'One year'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Contract" in plan


def test_contracts_survive_as_they_were(spark, make, tmp_path):
    people = [customer(str(i), c, total="1") for i, c in enumerate(["", None, "1", "One year", "a/b=c%", " "])]
    empty = make.transactions([]), make.tickets([])
    for schemas in (None, {"customers": files.clean_customers(make.raw(people)).schema}):
        files.build_tables(make.raw(people), *empty, str(tmp_path))
        stored = files.read_tables(spark, str(tmp_path), ["customers"], schemas)["customers"]
        assert sorted(rows(stored.select("customerID", "Contract"))) == [
            ("0", ""), ("1", None), ("2", "1"), ("3", "One year"), ("4", "a/b=c%"), ("5", " ")]
        assert rows(stored.where("Contract = ''").select("customerID")) == [("0",)]
        assert rows(stored.where("Contract IS NULL").select("customerID")) == [("1",)]
        assert rows(stored.where("Contract IN ('1', 'x')").select("customerID")) == [("2",)]


def test_reader_during_a_write_sees_one_set(spark, make, tmp_path, monkeypatch):
    """Until the manifest is swapped everything is read from the old set, afterwards from the new one."""
    path, paid, asked = str(tmp_path), make.transactions([]), make.tickets([])
    files.build_tables(make.raw([customer("old", total="1")]), paid, asked, path)
    before = files.read_tables(spark, path)
    seen, publish = [], files.publish

    def watched(*args):
        seen.append([rows(files.read_tables(spark, path)[n].agg(F.count("*")))[0][0] for n in S.TABLES])
        publish(*args)

    monkeypatch.setattr(files, "publish", watched)
    two = make.raw([customer("new1", total="1"), customer("new2", "One year", "No", total="2")])
    files.build_tables(two, make.transactions([("new1", 1, 1.0, "x", 1)]), asked, path)
    assert seen == [[1, 0, 0, 1]]
    # A frame from before goes on reading its own files.
    assert rows(before["customers"].select("customerID")) == [("old",)]
    after = files.read_tables(spark, path)
    assert [after[n].count() for n in S.TABLES] == [2, 1, 0, 2]
    files.write_tables({"support_tickets": make.tickets([("new1", "Billing", 1, 5)])}, path)
    assert [files.read_tables(spark, path)[n].count() for n in S.TABLES] == [2, 1, 1, 2]


def test_a_failed_write_changes_nothing(spark, inputs, make, tmp_path):
    files.build_tables(*inputs, str(tmp_path))
    bad = make.tickets([("a", "Billing", 1, 5)]).withColumn("rating", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        files.build_tables(make.raw([customer("z", total="9")]), inputs[1], bad, str(tmp_path))
    assert sorted(rows(files.read_tables(spark, str(tmp_path))["customers"].select("customerID"))) == [("a",), ("c",)]


def test_old_sets_expire(spark, inputs, tmp_path):
    path = str(tmp_path)
    for _ in range(3):
        files.build_tables(*inputs, path)
    assert len(files.expire(spark, path, keep=1)) == 3  # two sets each, one of the old six is kept
    assert len(files.expire(spark, path, keep=0)) == 1 and files.expire(spark, path, keep=0) == []
    assert files.read_tables(spark, path)["customers"].count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_joins_without_moving_rows(spark, make, tmp_path):
    people = make.customers([customer(f"c{i}", "One year" if i % 2 else "Two year") for i in range(40)])
    many = [(f"c{i % 20}", 1, 1.0, "x", 1) for i in range(60)] + [("c3", 2, 2.0, "x", 0)] * 100 + [(None, 1, 5.0, "x", 1)]
    facts = make.transactions(many)
    kept = lookup.write_lookup(people, facts, str(tmp_path / "l"), 4)
    counts = F.count("*").alias("n"), F.sum("amount").alias("paid")
    want = people.select("customerID", "Contract").join(facts.groupBy("customerID").agg(*counts), "customerID")
    got = kept.per_customer(["Contract"], *counts)
    assert sorted(rows(got)) == sorted(rows(want))
    assert {r[0] for r in rows(kept.large_facts.select("customerID"))} == {"c3"}
    usual = kept.customers.join(kept.facts.groupBy("customerID").agg(*counts).hint("merge"), "customerID")
    usual.count()
    assert "Exchange" not in plan_of(usual) and "SortMergeJoin" in plan_of(usual)
    kept.drop()
    assert not (tmp_path / "l").exists() and not spark.catalog.tableExists(f"{kept.name}_facts")


def test_results_live_as_long_as_they_are_held(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(source)
    cache = results.ResultCache(spark)

    def build(folder):
        built.append(folder)
        spark.read.parquet(source).selectExpr("id * 2 AS id").write.parquet(folder)
        return spark.read.parquet(folder)

    with cache.get("double", [source], build) as first, cache.get("double", [source], build) as second:
        assert first.folder == second.folder and len(built) == 1
        spark.range(10, 12).write.mode("append").parquet(source)
        with cache.get("double", [source], build) as third:
            assert len(built) == 2 and third.value.count() == 5
            assert first.value.count() == 3  # still there for those who hold it
        first.release()
        first.release()
        assert os.path.exists(first.folder)
    assert not os.path.exists(built[0]) and os.path.exists(built[1])
    assert cache.folders() == [built[1]]
    cache.drop("double")
    assert not os.path.exists(built[1]) and cache.folders() == []


def test_a_failed_result_leaves_no_folder(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "in"))
    cache, made = results.ResultCache(spark), []

    def build(folder):
        made.append(folder)
        spark.range(1).write.parquet(folder)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        cache.get("x", [str(tmp_path / "in")], build)
    assert not os.path.exists(made[0]) and cache.folders() == []


def test_bucketed_facts_join_without_shuffle(spark, make, tmp_path):
    facts = make.transactions([(str(i % 5), 1, 1.0, "x", 1) for i in range(20)])
    for name in ("one", "two"):
        files.write_bucketed(facts, f"bucketed_{name}", str(tmp_path / name), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_one").join(spark.table("bucketed_two"), "customerID")
        assert joined.count() == 80
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("one", "two"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_schema_listing(spark, inputs):
    listed = rows(files.schema_listing(spark, files.derive_tables(*inputs)))
    assert listed[0] == ("customers", 1, "customerID", "string")
    assert len(listed) == 14 + 5 + 4 + 6


def test_cached_frame_is_read_from_memory(spark):
    df = files.cached(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and df.storageLevel.useDisk
    df.unpersist()


def test_staging_uses_the_folder_the_session_names(spark):
    staged = staging.stage(spark.range(5), "x")
    assert rows(staged.agg(F.sum("id"))) == [(10,)]
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert (named or staging.staging_root(spark)) in staged.inputFiles()[0]
    assert spark.sparkContext.getCheckpointDir()


def test_a_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())


def test_requests_are_filled_with_defaults(spark):
    asked = spark.createDataFrame([("a", 3, None), ("b", None, 50.0)],
                                  "customerID string, tenure int, MonthlyCharges double")
    got = {r.customerID: r for r in score_requests(asked).collect()}
    assert got["a"].asDict() == {"customerID": "a", **S.REQUEST_DEFAULTS, "tenure": 3}
    assert (got["b"].tenure, got["b"].MonthlyCharges) == (12, 50.0)
    assert score_requests(asked).columns[1:] == S.NUMERIC_FEATURES + S.CATEGORY_FEATURES


def test_requests_total_from_tenure_and_text_flag(spark):
    asked = spark.createDataFrame(
        [("a", 3, 20.0, None, "Yes"), ("b", None, 50.0, 7.0, "No"), ("c", 1, 1.0, 1.0, None), ("d", 1, 1.0, 1.0, "1")],
        "customerID string, tenure int, MonthlyCharges double, TotalCharges double, SeniorCitizen string")
    got = {r.customerID: (r.TotalCharges, r.SeniorCitizen) for r in score_requests(asked, True).collect()}
    assert got == {"a": (60.0, 1), "b": (7.0, 0), "c": (1.0, 0), "d": (1.0, 1)}


def test_unreadable_requests_are_marked(spark):
    asked = spark.createDataFrame(
        [("a", "twelve", "Yes"), ("b", "7", "maybe"), ("c", None, None), ("d", "8", "1")],
        "customerID string, tenure string, SeniorCitizen string")
    got = {r.customerID: (r.rejected, r.tenure, r.SeniorCitizen)
           for r in score_requests(asked, rejected="rejected").collect()}
    assert got == {"a": (True, 12, 1), "b": (True, 7, 0), "c": (False, 12, 0), "d": (False, 8, 1)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        score_requests(asked).collect()


def test_csv_files_with_differing_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("customerID,SeniorCitizen,tenure\na,1,60\n")
    (tmp_path / "b.csv").write_text("customerID,SeniorCitizen,tenure\nb,0,5\n")
    got = files.csv_scan(spark, str(tmp_path)).select("customerID", "SeniorCitizen", "tenure")
    assert sorted(rows(got)) == [("a", 1, 60), ("b", 0, 5)]
    (tmp_path / "c.csv").write_text("customerID,tenure,SeniorCitizen\nc,60,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.csv_scan(spark, str(tmp_path)).collect()


def test_contracts_that_look_like_numbers_stay_text(spark, make, tmp_path):
    people = make.customers([customer("a", "1"), customer("b", "02"), customer("c", None)])
    files.write_tables({"customers": people}, str(tmp_path))
    stored = files.read_tables(spark, str(tmp_path), ["customers"])["customers"]
    assert dict(stored.dtypes)["Contract"] == "string"
    assert {(r.customerID, r.Contract) for r in stored.collect()} == {("a", "1"), ("b", "02"), ("c", None)}


def test_infinite_charges_do_not_move_the_bins(make):
    charges = [10.0, 20.0, 30.0, float("inf"), float("-inf")]
    people = make.customers([customer(str(i), charge=c) for i, c in enumerate(charges)])
    assert sorted(rows(eda.histogram_by_class(people, bins=2))) == [("Retained", 0, 2), ("Retained", 1, 3)]


def test_named_queries_run_over_stored_tables(spark, inputs, tmp_path):
    tables = files.build_tables(*inputs, str(tmp_path))
    assert len(catalog.NAMED) == 10
    for name, query in catalog.NAMED.items():
        assert query.title and query.description
        assert catalog.run_named(name, tables).columns
    assert rows(catalog.run_named("churn_rate_overall", tables)) == [(2, 1, 50.0)]


def test_adhoc_sql(spark, inputs):
    files.register_views(files.derive_tables(*inputs))
    ask = lambda text: catalog.adhoc_sql(spark, text)
    assert rows(ask("SELECT Contract, COUNT(*) n FROM customers GROUP BY Contract ORDER BY n DESC, 1;")) == [
        (None, 1), ("One year", 1)]
    assert rows(ask("WITH a AS (SELECT customerid FROM transactions) SELECT count(*) FROM a -- note")) == [(2,)]
    assert rows(ask(
        "SELECT c.customerID, COUNT(t.rating) FROM customers c LEFT JOIN support_tickets t "
        "ON c.customerID = t.customerID GROUP BY c.customerID ORDER BY 1")) == [("a", 1), ("c", 0)]
    descending = ask("SELECT customerID FROM customers ORDER BY customerID DESC")
    assert [r[0] for r in descending.collect()] == ["c", "a"]
    for bad in ("SELEC 1", "SELECT nope FROM customers", "SELECT * FROM nowhere", "DROP VIEW customers",
                "INSERT INTO customers VALUES (1)", "SET x=1", "SHOW TABLES", ""):
        answer = ask(bad)
        assert answer.columns == ["error"] and answer.count() == 1
    assert spark.catalog.tableExists("customers")


def test_adhoc_sql_reads_the_given_tables_only(spark, inputs, tmp_path):
    tables = files.derive_tables(*inputs)
    spark.range(3).write.parquet(str(tmp_path / "p"))
    spark.range(2).write.mode("overwrite").option("path", str(tmp_path / "kept")).saveAsTable("kept_elsewhere")
    spark.range(2).createOrReplaceTempView("other_view")
    ask = lambda text: catalog.adhoc_sql(spark, text, tables)
    for bad in (
        f"SELECT * FROM parquet.`{tmp_path}/p`", "SELECT * FROM text.`/etc/hostname`",
        f"SELECT (SELECT count(*) FROM parquet.`{tmp_path}/p`) AS n FROM customers",
        "SELECT * FROM kept_elsewhere", "SELECT * FROM customers WHERE EXISTS (SELECT 1 FROM kept_elsewhere)",
        "WITH k AS (SELECT * FROM kept_elsewhere) SELECT * FROM customers, k", "SELECT * FROM other_view",
        "SELECT * FROM customers UNION ALL SELECT * FROM customers WHERE 1 IN (SELECT id FROM kept_elsewhere)",
        "SELECT 1) UNION ALL (SELECT 2", "SELECT 1; SELECT 2", "SELECT * FROM range(5)",
        "SELECT java_method('java.lang.Math', 'abs', 1)", "SELECT reflect('java.lang.Math', 'abs', 1)",
        "CREATE TABLE x AS SELECT 1", "EXPLAIN SELECT 1", "CACHE TABLE customers", "SELECT 1 /*", "TABLE kept_elsewhere",
    ):
        answer = ask(bad)
        assert answer.columns == ["error"] and answer.count() == 1, bad
    for good, want in (
        ("SELECT 1 AS x", [(1,)]), ("SELECT count(*) FROM (VALUES (1), (2)) v(x)", [(2,)]), ("TABLE support_tickets", [("a", "Billing", 1, 5)]),
        ("WITH customers AS (SELECT 7 AS x) SELECT x FROM customers", [(7,)]),
        ("SELECT customerID, (SELECT max(rating) FROM support_tickets) FROM customers WHERE customerID IN "
         "(SELECT customerID FROM transactions) ORDER BY 1", [("a", 5), ("c", 5)]),
        ("SELECT x FROM customers LATERAL VIEW explode(array(1, 2)) AS x WHERE customerID = 'a' ORDER BY x", [(1,), (2,)]),
    ):
        assert rows(ask(good)) == want, good
    assert rows(spark.sql("SELECT java_method('java.lang.Math', 'abs', -1)")) == [("1",)]  # only refused there
    spark.sql("DROP TABLE kept_elsewhere")


def test_derived_reports_match_over_sources(spark):
    from retentia.sources import orders

    source = orders.load(spark, "/root/testdata/sf0.001")
    as_of = source["orders"].agg(F.max("o_orderdate")).first()[0]
    by_default = reports.churn_by_contract(orders.customers(source))
    assert rows(by_default) == rows(reports.churn_by_contract(orders.customers(source, as_of=as_of)))
