
from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracles import ORACLES
from retentia import schema as S
from retentia.functions.advice import recommendations
from retentia.functions.bands import risk_band, threshold_class
from retentia.operators import sampling, spine
from retentia.operators.clean import clean_customers, coerce_numeric
from retentia.operators.split import hash_split, stratified_split
from retentia.plans import (
    catalog, dictionary, distinct, eda, evaluate, explain, features, kpi, reports, score, segments, train,
)
from retentia.sources import files, lookup, orders, requests
from retentia.sources.results import ResultCache
from retentia.sources.staging import new_folder, stage
from retentia.streaming import scoring


def _optional(name):
    """The module, or None where it or its package is absent; its own errors are raised."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as missing:
        if f"{name}.".startswith(f"{missing.name}."):
            return None
        raise


# Queries for training data, where their subpackage and the pipeline built on it are present.
llm = _optional("retentia.llm.registry")
corpus_pipeline = _optional("corpus_pipeline") if llm else None

FEATURES = features.FeatureSet(
    numbers=tuple(orders.TRAINING_NUMBERS), categories=tuple(orders.TRAINING_CATEGORIES)
)
SETTINGS = train.BoosterSettings()


def _sources(spark, sf):
    """Raw customers, transactions, support tickets."""
    source = orders.load(spark, sf)
    return orders.raw_customers(source), orders.transactions(source), orders.support_tickets(source)


_caches, _held = {}, {}


def _kept(name, spark, sf, build):
    """The result called `name`, built once per session and folder and anew when its input changes.

    Queries return frames that are read later, so the hold lasts until the next result
    takes its place.
    """
    cache = _caches.setdefault(spark.sparkContext.applicationId, ResultCache(spark))
    inputs = [f"{sf}/{source}.parquet" for source in orders.SOURCES]
    handle = cache.get(name, inputs, build)
    before = _held.get((id(cache), name, sf))
    _held[id(cache), name, sf] = handle
    if before is not None:
        before.release()
    return handle.value


def _stored(spark, sf):
    """The four tables, stored; the reports read them."""
    return _kept("tables", spark, sf, lambda folder: files.build_tables(*_sources(spark, sf), folder))


def _customers(spark, sf):
    return _stored(spark, sf)["customers"]


def _on_customers(report, **options):
    return lambda spark, sf: report(_customers(spark, sf), **options)


def _named(name):
    return lambda spark, sf: catalog.run_named(name, _stored(spark, sf))


# -- sources and generation --------------------------------------------------

def csv_ingest(spark, sf):
    """Raw customers through a CSV file, typed and cleaned."""
    folder = new_folder(spark, "csv")
    orders.raw_customers(orders.load(spark, sf)).write.csv(folder, header=True)
    return clean_customers(files.csv_scan(spark, folder))


def table_roundtrip(spark, sf):
    """All tables written and read back, then rows counted."""
    folder = new_folder(spark, "tables")
    return files.row_count_report(files.build_tables(*_sources(spark, sf), folder))


def spine_fill(spark, sf):
    tables = _stored(spark, sf)
    people = tables["customers"].select("customerID", "tenure")
    return spine.spine_fill(people, spine.monthly_amounts(tables["transactions"]))


def score_requests(spark, sf):
    """Customers read as requests: what they lack is filled with the defaults."""
    people = orders.raw_customers(
        orders.load(spark, sf),
        ("customerID", "SeniorCitizen", "tenure", "Contract", "MonthlyCharges", "TotalCharges"),
    )
    asked = people.withColumn("TotalCharges", coerce_numeric(F.col("TotalCharges")))
    return requests.score_requests(asked, total_from_tenure=True)


# -- reports ------------------------------------------------------------------

def adhoc_sql(spark, sf):
    files.register_views(_stored(spark, sf))
    return catalog.adhoc_sql(spark, """
        SELECT c.Contract, t.category, COUNT(*) AS tickets, SUM(t.resolved) AS resolved
        FROM customers c JOIN support_tickets t ON c.customerID = t.customerID
        WHERE c.Churn = 0
        GROUP BY c.Contract, t.category
        ORDER BY tickets DESC;
    """)


def kpi_record(spark, sf):
    """The nested record, unfolded to one row per contract."""
    record = kpi.kpi_record(_customers(spark, sf))
    return record.select(
        "total_customers", "churned", "retained", "churn_rate_pct", "avg_monthly",
        "revenue_at_risk", F.posexplode("by_contract").alias("position", "entry"),
    ).select("*", "entry.contract", "entry.total", "entry.churn_pct").drop("entry")


# -- features and evaluation on a rule score ---------------------------------

def _rule_scores(spark, sf):
    """Shorter tenure, higher score: whole hundredths, free of float noise."""
    points = F.greatest(F.lit(0), 100 - F.col("tenure")) / F.lit(100.0)
    return _customers(spark, sf).select(
        "customerID", F.col("Churn").alias("label"), points.alias("score")
    ).withColumn("pred", threshold_class(F.col("score")))


def _on_scores(report, **options):
    return lambda spark, sf: report(_rule_scores(spark, sf), **options)


def mean_abs_attribution(spark, sf):
    """Mean absolute value per feature of attributions in whole numbers."""
    people = _customers(spark, sf)
    values = F.expr("array(CAST(tenure - 50 AS double), CAST(SeniorCitizen - 1 AS double))")
    found = people.select("customerID", values.alias("phi"), F.lit("rule").alias("method"))
    return explain.global_importance(found, ["tenure", "SeniorCitizen"])


def label_encode(spark, sf):
    people = _customers(spark, sf)
    names = orders.TRAINING_CATEGORIES
    coded = features.encode(people, features.fit_encoder(people, names), names)
    return coded.select("customerID", *names)


def standardise(spark, sf):
    columns = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
    people = _customers(spark, sf).select("customerID", *columns)
    scaled = features.fit_scaler(people, columns).transform(people)
    values = vector_to_array("features")
    return scaled.select(
        "customerID", *[F.round(values[i], 6).alias(c) for i, c in enumerate(columns)]
    )


def risk_bands(spark, sf):
    return _rule_scores(spark, sf).select(
        "customerID", "score", risk_band(F.col("score")).alias("risk_level")
    )


def threshold_classes(spark, sf):
    return _rule_scores(spark, sf).select("customerID", "score", "pred")


def advice(spark, sf, scale=1):
    """One row per customer and piece of advice.

    Segment, region and priority stand for the values the rules look for.  Charges
    are divided by `scale`, so that not all of them are high.
    """
    def named(column, value, name):
        return F.when(F.col(column) == value, name).otherwise(F.col(column))

    people = _customers(spark, sf).withColumns({
        "Contract": named("Contract", "BUILDING", "Month-to-month"),
        "InternetService": named("InternetService", "EUROPE", "Fiber optic"),
        "PaymentMethod": named("PaymentMethod", "1-URGENT", "Electronic check"),
        "MonthlyCharges": F.col("MonthlyCharges") / scale,
    })
    score_ = F.greatest(F.lit(0), 100 - F.col("tenure")) / F.lit(100.0)
    return people.select("customerID", F.posexplode(recommendations(score_)).alias("position", "advice"))


# -- model --------------------------------------------------------------------

def _split(spark, sf):
    """Training table with its hold-out mark, stored."""
    def build(folder):
        rows = stage(orders.training(orders.load(spark, sf)), "training")
        split = stratified_split(rows)
        split.write.parquet(folder)
        return spark.read.schema(split.schema).parquet(folder)

    return _kept("split", spark, sf, build)


def _training_rows(spark, sf):
    return _split(spark, sf).where("is_test = 0").drop("is_test")


def _fitted(spark, sf):
    """Model and hold-out."""
    def build(folder):
        model = train.fit_model(_training_rows(spark, sf), FEATURES, SETTINGS)
        train.save_model(model, folder)
        return model

    return _kept(f"model-{SETTINGS.rounds}", spark, sf, build), _split(spark, sf).where("is_test = 1").drop("is_test")


def _for_scoring(spark, sf):
    """The fitted model and the whole training table."""
    return _fitted(spark, sf)[0], _split(spark, sf).drop("is_test")


def train_and_score(spark, sf):
    model, rows = _for_scoring(spark, sf)
    return score.score_customers(model, rows)


def holdout_loss(spark, sf):
    model, holdout = _fitted(spark, sf)
    return train.holdout_loss(model, holdout, FEATURES)


def model_evaluation(spark, sf):
    model, holdout = _fitted(spark, sf)
    return evaluate.evaluate_report(stage(train.score_table(model, holdout, FEATURES), "scores"))


def model_roundtrip(spark, sf):
    """Scores of the saved and reloaded model."""
    model, rows = _for_scoring(spark, sf)
    folder = new_folder(spark, "model")
    train.save_model(model, folder)
    return score.score_customers(train.load_model(spark, folder), rows)


def tree_attribution(spark, sf):
    model, rows = _for_scoring(spark, sf)
    found = explain.attribution(model, rows, FEATURES.names)
    return explain.long_form(found, FEATURES.names)


def feature_importance(spark, sf):
    model, rows = _for_scoring(spark, sf)
    return explain.global_importance(
        explain.attribution(model, rows, FEATURES.names), FEATURES.names
    )


def sampled_importance(spark, sf):
    """Importance from 500 training rows, the sample the operator stands for."""
    model, _ = _fitted(spark, sf)
    return explain.sampled_importance(model, _training_rows(spark, sf), FEATURES.names)


def attribution_roundtrip(spark, sf):
    """Stored attributions, added up per customer to the log-odds they explain."""
    model, rows = _for_scoring(spark, sf)
    folder = new_folder(spark, "attributions")
    found = explain.attribution(model, rows, FEATURES.names)
    explain.write_attributions(found, FEATURES.names, folder)
    return spark.read.parquet(folder).groupBy("customerID").agg(
        F.count("*").alias("features"), F.round(F.sum("phi"), 6).alias("phi")
    )


def gain_importance(spark, sf):
    model, rows = _for_scoring(spark, sf)
    return explain.global_importance(
        explain.attribution(model, rows, FEATURES.names, "gain"), FEATURES.names
    )


def top_features(spark, sf):
    """The five leading features, through the saved importance table."""
    folder = new_folder(spark, "importance")
    explain.write_importance(feature_importance(spark, sf), folder)
    return sampling.top_features(explain.read_importance(spark, folder), 5)


def score_stream(spark, sf):
    model, rows = _for_scoring(spark, sf)
    arrived, out, log = (new_folder(spark, n) for n in ("arrived", "scored", "progress"))
    rows.write.parquet(arrived)
    records = scoring.record_stream(spark, arrived, rows.schema)
    scoring.score_stream(model, records, out, log).awaitTermination()
    return spark.read.parquet(out)


# -- what must hold between model results, row by row --------------------------

def _probabilities(spark, sf):
    model, rows = _for_scoring(spark, sf)
    return model, rows, train.predict_proba(model, rows).select("customerID", "score")


def attributions_add_up(spark, sf):
    """Stored attributions and the base add up to each customer's log-odds."""
    model, rows, scores = _probabilities(spark, sf)
    folder = new_folder(spark, "attributions")
    explain.write_attributions(
        explain.attribution(model, rows, FEATURES.names), FEATURES.names, folder
    )
    _, base = explain.explainer(spark, model)
    total = spark.read.parquet(folder).groupBy("customerID").agg(
        F.count("*").alias("features"), F.sum("phi").alias("phi")
    )
    odds = F.log(F.col("score") / (1 - F.col("score")))
    return total.join(scores, "customerID").select(
        "customerID", "features", (F.abs(F.col("phi") + base - odds) < 1e-6).alias("adds_up")
    )


def predictions_follow(spark, sf):
    """Class, band and rounded probability follow from the score; the advice in full."""
    model, rows, scores = _probabilities(spark, sf)
    score_ = F.col("score")
    return score.score_customers(model, rows).join(scores, "customerID").select(
        "customerID",
        (F.abs(F.col("churn_probability") - score_) <= 0.00005 + 1e-9).alias("rounded"),
        (F.col("churn_prediction") == F.when(score_ >= 0.5, 1).otherwise(0)).alias("class_follows"),
        (F.col("risk_level") == F.when(score_ >= 0.7, "HIGH").when(score_ >= 0.4, "MEDIUM")
         .otherwise("LOW")).alias("band_follows"),
        F.array_join("recommendations", " | ").alias("advice"),
    )


def reloaded_agrees(spark, sf):
    """Probabilities of the saved and reloaded model equal those of the fitted one."""
    model, rows, scores = _probabilities(spark, sf)
    folder = new_folder(spark, "model")
    train.save_model(model, folder)
    again = train.predict_proba(train.load_model(spark, folder), rows, "again")
    return again.select("customerID", "again").join(scores, "customerID").select(
        "customerID", (F.abs(F.col("again") - F.col("score")) < 1e-12).alias("same")
    )


def loss_rounds(spark, sf):
    """A loss for each round; the last is the log-loss of the final scores."""
    model, holdout = _fitted(spark, sf)
    final = evaluate.log_loss(train.score_table(model, holdout, FEATURES)).scalar()
    return train.holdout_loss(model, holdout, FEATURES).select(
        "round", (F.col("log_loss") > 0).alias("positive"),
        F.when(F.col("round") == SETTINGS.rounds, F.abs(F.col("log_loss") - final) < 1e-6)
        .alias("final_agrees"),
    )


def gains_sum_to_one(spark, sf):
    gains = stage(gain_importance(spark, sf), "gains")
    total = gains.agg(F.sum("importance")).scalar()
    return gains.select("feature", "method", (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


def importance_ranks(spark, sf):
    """The stored list's leading five are the features with the largest importance."""
    full = stage(feature_importance(spark, sf), "importance")
    folder = new_folder(spark, "importance")
    explain.write_importance(full, folder)
    top = sampling.top_features(explain.read_importance(spark, folder), 5)
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    ranked = full.select(
        F.col("feature"), F.col("importance").alias("whole"), F.row_number().over(order).alias("rank")
    )
    return top.join(ranked, "feature").where(F.abs(F.col("importance") - F.col("whole")) < 1e-12).select("rank")


def importance_sample(spark, sf):
    """The training rows that the sampled importance looks at."""
    return sampling.fixed_size_sample(_training_rows(spark, sf), 500).select("customerID")


def evaluation_support(spark, sf):
    return model_evaluation(spark, sf).where("metric LIKE '%support'")


def request_chain(spark, sf):
    """Requests, one kind unreadable and one left open, filled and scored as a stream.

    A customer with a single order asks with a tenure of 'n/a', one with two orders
    names no total.  Each record is scored once, as the batch scores it.
    """
    model, rows = _for_scoring(spark, sf)
    defaults = {"SeniorCitizen": 0, "tenure": 12, "MonthlyCharges": 65.0, "TotalCharges": 780.0,
                "n_orders": 1, "recency": 0, "InternetService": "EUROPE", "Contract": "BUILDING",
                "PaymentMethod": "1-URGENT"}
    asked = rows.withColumns({
        "tenure": F.when(F.col("n_orders") == 1, "n/a").otherwise(F.col("tenure").cast("string")),
        "TotalCharges": F.when(F.col("n_orders") != 2, F.col("TotalCharges")),
    }).select("customerID", *FEATURES.names)
    arrived, out, log = (new_folder(spark, n) for n in ("arrived", "scored", "progress"))
    asked.write.parquet(arrived)

    def filled(records):
        return requests.score_requests(records, True, defaults, rejected="rejected")

    stream = filled(scoring.record_stream(spark, arrived, asked.schema))
    keep = ("customerID", "rejected")
    scoring.score_stream(model, stream, out, log, keep).awaitTermination()
    batch = score.score_customers(model, filled(spark.read.parquet(arrived)), keep).select(
        "customerID", F.col("churn_probability").alias("expected")
    )
    return spark.read.parquet(out).join(batch, "customerID").groupBy("customerID", "rejected").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("churn_probability") == F.col("expected")).alias("same"),
    )


def _without_totals(rows):
    """TotalCharges missing for nine of ten customers who left, and for nobody else."""
    known = (F.col("Churn") == 0) | (F.col("customerID") % 10 == 0)
    return rows.withColumn("TotalCharges", F.when(known, F.col("TotalCharges")))


AUC_FLOOR = 0.85


def missing_marks_learn(spark, sf):
    """A model of 20 rounds on totals that are missing for a reason: its area on the hold-out.

    Filling them with the mean alone would hide the reason.
    """
    hidden = _without_totals(_split(spark, sf))
    model = train.fit_model(
        hidden.where("is_test = 0").drop("is_test"), FEATURES, train.BoosterSettings(rounds=20)
    )
    scores = train.score_table(model, hidden.where("is_test = 1").drop("is_test"), FEATURES)
    area = evaluate.roc_auc(stage(scores, "scores")).scalar()
    return hidden.where("is_test = 1").agg(
        F.count("*").alias("n_test"), F.count_if(F.col("TotalCharges").isNull()).alias("n_missing")
    ).select("n_test", "n_missing", (area >= AUC_FLOOR).alias("above_floor"))


def _split_stream(spark, sf):
    """Scored and refused requests of a stream that stops after its first files and goes on later."""
    model, rows = _for_scoring(spark, sf)
    asked = rows.withColumns({
        "tenure": F.when(F.col("n_orders") == 1, "n/a").otherwise(F.col("tenure").cast("string")),
        "recency": F.when(F.col("customerID") % 7 == 0, "long ago").otherwise(F.col("recency").cast("string")),
    }).select("customerID", *FEATURES.names)
    defaults = {"SeniorCitizen": 0, "tenure": 12, "MonthlyCharges": 65.0, "TotalCharges": 780.0,
                "n_orders": 1, "recency": 0, "InternetService": "EUROPE", "Contract": "BUILDING",
                "PaymentMethod": "1-URGENT"}
    arrived, out, refused, log = (new_folder(spark, n) for n in ("arrived", "scored", "refused", "progress"))
    for even in (True, False):
        asked.where((F.col("customerID") % 2 == 0) == even).write.mode("append").parquet(arrived)
        records = scoring.record_stream(spark, arrived, asked.schema, files=2)
        scoring.score_requests_stream(model, records, out, refused, log, defaults=defaults).awaitTermination()
    return model, spark.read.parquet(out), spark.read.parquet(refused)


def stream_accepted(spark, sf):
    """Requests the stream scored, each once, as the batch scores its customer."""
    model, scored, _ = _split_stream(spark, sf)
    batch = score.score_customers(model, _split(spark, sf)).select(
        "customerID", F.col("churn_probability").alias("expected")
    )
    return scored.join(batch, "customerID").groupBy("customerID").agg(
        F.count("*").alias("n"), F.bool_and(F.col("churn_probability") == F.col("expected")).alias("same")
    )


def stream_rejected(spark, sf):
    """Requests the stream could not read, as they came, with the features at fault."""
    refused = _split_stream(spark, sf)[2]
    return refused.select("customerID", "tenure", F.array_join("unreadable", ", ").alias("unreadable"))


# -- tables kept for look-ups and updates -------------------------------------

def label_table(spark, sf):
    """Payers as text, numbered over their global order and stored as a table."""
    paid = _stored(spark, sf)["transactions"]
    tables = dictionary.fit_label_tables(paid, ["customerID"], new_folder(spark, "labels"))
    return tables.table(spark, "customerID")


def label_encode_table(spark, sf):
    """All payments coded by a table that has only seen the payers who once paid on time."""
    paid = _stored(spark, sf)["transactions"]
    tables = dictionary.fit_label_tables(
        paid.where("paid_on_time = 1"), ["customerID"], new_folder(spark, "labels")
    )
    return dictionary.encode_by_tables(paid.select("transaction_id", "customerID"), tables)


BUCKETS = 16


def lookup_payments(spark, sf):
    """Payments per customer, joined bucket by bucket."""
    tables = _stored(spark, sf)
    kept = _kept("lookup", spark, sf, lambda folder: lookup.write_lookup(
        tables["customers"], tables["transactions"], folder, BUCKETS))
    return kept.per_customer(
        ["Contract"], F.count("*").alias("payments"),
        F.expr("CAST(sum(CAST(amount AS decimal(18,2))) AS double) AS paid"),
    )


def contract_lookup(spark, sf):
    """Customers of two contracts, read from their directories only."""
    return _customers(spark, sf).where("Contract IN ('BUILDING', 'MACHINERY')").select(
        "customerID", "Contract", "tenure", "Churn"
    )


def segment_batches(spark, sf):
    """The segment summary from three batches of customers, the second one sent twice."""
    people, folder = _customers(spark, sf), new_folder(spark, "segments")
    for part in (0, 1, 1, 2):
        segments.fold_batch(spark, folder, people.where(F.col("customerID") % 3 == part), f"batch {part}")
    return segments.stored_figures(spark, folder)


def distinct_by_sketch(spark, sf):
    """Customers who paid, per contract month and over all, from sketches per month and payment method."""
    paid = _stored(spark, sf)["transactions"]
    stored = stage(distinct.sketches(paid, ["month_num", "payment_method"]), "sketches")
    found = distinct.distinct_estimate(stored, ["month_num"]).unionByName(
        distinct.distinct_estimate(stored).withColumn("month_num", F.lit(None).cast("int"))
    )
    exact = paid.groupBy("month_num").agg(F.count_distinct("customerID").alias("exact")).unionByName(
        paid.agg(F.count_distinct("customerID").alias("exact")).withColumn("month_num", F.lit(None).cast("int"))
    )
    bound = F.greatest(F.lit(1.0), F.col("exact") * distinct.error_bound(10**6) / 10**6)
    return found.join(exact, found["month_num"].eqNullSafe(exact["month_num"])).select(
        exact["month_num"], "exact", (F.abs(F.col("customers") - F.col("exact")) <= bound).alias("within_bound")
    )


def adhoc_refused(spark, sf):
    """What free SQL refuses, one row per text, beside one that it answers."""
    tables = _stored(spark, sf)
    texts = {
        "file": f"SELECT * FROM parquet.`{sf}/orders.parquet`",
        "brackets": "SELECT 1) UNION ALL (SELECT 2",
        "two": "SELECT 1; SELECT 2",
        "subquery": f"SELECT (SELECT count(*) FROM parquet.`{sf}/orders.parquet`) FROM customers",
        "command": "DROP VIEW customers",
        "answered": "SELECT count(*) AS n FROM customers",
    }
    out = None
    for name, text in texts.items():
        answer = catalog.adhoc_sql(spark, text, tables)
        refused = "error" in answer.columns
        row = answer.select(
            F.lit(name).alias("text"), F.lit(refused).alias("refused"),
            (F.lit(None) if refused else F.col("n")).cast("long").alias("n"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- inputs that reach every branch --------------------------------------------

def clean_blanks(spark, sf):
    """Cleaning where the totals of new customers are blank."""
    raw = orders.raw_customers(orders.load(spark, sf))
    blank = F.when(F.col("tenure") < 12, " ").otherwise(F.col("TotalCharges"))
    return clean_customers(raw.withColumn("TotalCharges", blank)).select("customerID", "TotalCharges")


def label_encode_unseen(spark, sf):
    """Contracts coded by an encoder that has not seen one of them."""
    people = _customers(spark, sf).select("customerID", "Contract")
    encoder = features.fit_encoder(people.where("Contract <> 'BUILDING'"), ["Contract"])
    return features.encode(people, encoder, ["Contract"])


def request_rejections(spark, sf):
    """Requests with unreadable tenures and without totals."""
    people = orders.raw_customers(orders.load(spark, sf), ("customerID", "tenure", "MonthlyCharges", "TotalCharges"))
    asked = people.select(
        "customerID", "MonthlyCharges",
        F.when(F.col("tenure") < 12, "twelve").otherwise(F.col("tenure").cast("string")).alias("tenure"),
        F.when(F.col("tenure") <= 60, coerce_numeric(F.col("TotalCharges"))).alias("TotalCharges"),
    )
    return requests.score_requests(asked, total_from_tenure=True, rejected="rejected").select(
        "customerID", "rejected", "tenure", "MonthlyCharges", "TotalCharges"
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: churn by contract on the smallest data."""
    source = orders.load(spark, "/root/testdata/sf0.001")
    return reports.churn_by_contract(orders.customers(source))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "customers": lambda s, sf: orders.customers(orders.load(s, sf)),
        "clean_customers": lambda s, sf: clean_customers(
            orders.raw_customers(orders.load(s, sf))
        ).select("customerID", "TotalCharges", "Churn", "SeniorCitizen"),
        "transactions": lambda s, sf: orders.transactions(orders.load(s, sf)),
        "support_tickets": lambda s, sf: orders.support_tickets(orders.load(s, sf)),
        "segment_summary": lambda s, sf: _stored(s, sf)["segment_summary"],
        "training": lambda s, sf: orders.training(orders.load(s, sf)),
        "csv_ingest": csv_ingest,
        "table_roundtrip": table_roundtrip,
        "row_count_report": lambda s, sf: files.row_count_report(
            files.derive_tables(*_sources(s, sf))
        ),
        "score_requests": score_requests,
        "billing_month_spine": lambda s, sf: spine.billing_month_spine(
            _customers(s, sf).select("customerID", "Contract", "tenure")
        ).drop("tenure"),
        "spine_fill": spine_fill,
        **{name: _named(name) for name in catalog.NAMED},
        "adhoc_sql": adhoc_sql,
        "kpi_bundle": _on_customers(kpi.kpi_bundle),
        "kpi_by_contract": _on_customers(kpi.kpi_by_contract),
        "kpi_record": kpi_record,
        "kpi_text": _on_customers(kpi.kpi_text),
        "contract_rate_raw": _on_customers(eda.contract_rate_raw),
        "rate_by_service": _on_customers(eda.mean_rate, key="InternetService"),
        "rate_by_payment": _on_customers(eda.mean_rate_rounded, key="PaymentMethod"),
        "share_of_total": _on_customers(eda.share_of_total),
        "histogram_by_class": _on_customers(eda.histogram_by_class),
        "sample_fixed": _on_customers(eda.charges_scatter),
        "preview": _on_customers(sampling.preview),
        "stratified_split": lambda s, sf: stratified_split(
            _customers(s, sf).select("customerID", "Churn")
        ),
        "hash_split": lambda s, sf: hash_split(_customers(s, sf).select("customerID", "Churn")),
        "mean_abs_attribution": mean_abs_attribution,
        "label_encode": label_encode,
        "standardise": standardise,
        "accuracy": _on_scores(evaluate.accuracy),
        "confusion_matrix": _on_scores(evaluate.confusion_matrix),
        "classification_report": _on_scores(evaluate.classification_report),
        "roc_curve": _on_scores(evaluate.roc_curve),
        "roc_curve_corners": _on_scores(evaluate.roc_curve, drop_collinear=True),
        "roc_auc": _on_scores(evaluate.roc_auc),
        "evaluate_report": lambda s, sf: evaluate.evaluate_report(stage(_rule_scores(s, sf), "scores")),
        "log_loss": lambda s, sf: evaluate.log_loss(_rule_scores(s, sf)).select(
            F.round("log_loss", 8).alias("log_loss")
        ),
        "risk_band": risk_bands,
        "threshold_class": threshold_classes,
        "recommendations": advice,
        "train_and_score": train_and_score,
        "holdout_loss": holdout_loss,
        "model_evaluation": model_evaluation,
        "model_roundtrip": model_roundtrip,
        "tree_attribution": tree_attribution,
        "feature_importance": feature_importance,
        "sampled_importance": sampled_importance,
        "attribution_roundtrip": attribution_roundtrip,
        "gain_importance": gain_importance,
        "top_features": top_features,
        "score_stream": score_stream,
        "attributions_add_up": attributions_add_up,
        "predictions_follow": predictions_follow,
        "reloaded_agrees": reloaded_agrees,
        "loss_rounds": loss_rounds,
        "gains_sum_to_one": gains_sum_to_one,
        "importance_ranks": importance_ranks,
        "importance_sample": importance_sample,
        "evaluation_support": evaluation_support,
        "request_chain": request_chain,
        "clean_blanks": clean_blanks,
        "label_encode_unseen": label_encode_unseen,
        "request_rejections": request_rejections,
        "sample_transactions": lambda s, sf: sampling.fixed_size_sample(
            _stored(s, sf)["transactions"], 1500, "transaction_id"
        ).select("transaction_id", "customerID"),
        "recommendations_scaled": lambda s, sf: advice(s, sf, 100),
        "missing_marks_learn": missing_marks_learn,
        "stream_accepted": stream_accepted,
        "stream_rejected": stream_rejected,
        "label_table": label_table,
        "label_encode_table": label_encode_table,
        "lookup_payments": lookup_payments,
        "contract_lookup": contract_lookup,
        "segment_batches": segment_batches,
        "distinct_by_sketch": distinct_by_sketch,
        "adhoc_refused": adhoc_refused,
        "stored_customers": _customers,
        "stored_transactions": lambda s, sf: _stored(s, sf)["transactions"],
        **(llm.QUERIES if llm else {}),
        **({"pipeline": corpus_pipeline.run} if corpus_pipeline else {}),
    }


def oracle_sql() -> dict[str, str]:
    found = {**ORACLES, **(llm.SQL if llm else {})}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
