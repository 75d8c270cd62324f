"""Named queries and free SQL over the four tables."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from retentia import schema as S
from retentia.plans import reports


@dataclass(frozen=True)
class NamedQuery:
    title: str
    description: str
    inputs: tuple
    build: Callable[..., DataFrame]

    def run(self, tables: dict) -> DataFrame:
        return self.build(*[tables[name] for name in self.inputs])


NAMED = {
    "churn_rate_overall": NamedQuery(
        "Churn rate of the whole base", "How many customers there are and what share left.",
        ("customers",), reports.churn_rate_overall),
    "churn_by_contract": NamedQuery(
        "Churn by contract", "Rate and average charge per contract type, worst first.",
        ("customers",), reports.churn_by_contract),
    "revenue_at_risk_by_service": NamedQuery(
        "Revenue lost by service", "Monthly charges of churned customers per internet service.",
        ("customers",), reports.revenue_at_risk_by_service),
    "top_risk_customers": NamedQuery(
        "Largest lost customers", "The ten churned customers who paid most per month.",
        ("customers",), reports.top_risk_customers),
    "churn_by_payment": NamedQuery(
        "Churn by payment method", "Rate per way of paying, worst first.",
        ("customers",), reports.churn_by_payment),
    "tenure_cohorts": NamedQuery(
        "Churn by tenure cohort", "Rate and charge for new through long-standing customers.",
        ("customers",), reports.tenure_cohorts),
    "senior_segments": NamedQuery(
        "Churn of senior citizens", "Seniors against everyone else.",
        ("customers",), reports.senior_segments),
    "tickets_vs_churn": NamedQuery(
        "Tickets and churn", "The twenty customers with most support tickets.",
        ("customers", "support_tickets"), reports.tickets_vs_churn),
    "segment_report": NamedQuery(
        "Segments", "Stored figures per contract and service with their rate.",
        ("segment_summary",), reports.segment_report),
    "transactions_by_churn": NamedQuery(
        "Payments by churn", "Average amount and late share of lost and kept customers.",
        ("customers", "transactions"), reports.transactions_by_churn),
}


def run_named(name: str, tables: dict) -> DataFrame:
    return NAMED[name].run(tables)


class Refused(Exception):
    """Free SQL that asks for something else than the given tables."""


# Functions that call classes by name, and so lead out of SQL.
_LEAVING = ("java_method", "reflect", "try_reflect")
# Sources without rows of their own, or with rows that stand in the text.
_PLAIN = ("OneRowRelation", "LocalRelation", "CTERelationRef")


def _in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same frame, run by another session of the application."""
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
        spark._jsparkSession, df._jdf.queryExecution().analyzed()
    )
    return DataFrame(rows, spark)


def _strangers(plan, known: set) -> list:
    """Sources of an analysed plan, its subqueries included, that are none of the known views."""
    kind = plan.nodeName()
    if kind == "View":
        name = plan.desc().identifier().table()
        return [] if plan.isTempView() and name in known else [name]
    below = [q.apply(i) for q in (plan.children(), plan.subqueries()) for i in range(q.size())]
    if plan.children().isEmpty() and kind not in _PLAIN:
        return [kind]
    return [name for part in below for name in _strangers(part, known)]


def _session_of_views(spark: SparkSession, tables: dict) -> SparkSession:
    """A session that knows the given tables and can read nothing by path."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.runSQLOnFiles", "false")
    jvm, state = apart._jvm, apart._jsparkSession.sessionState()
    for name in _LEAVING:
        state.functionRegistry().dropFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    for name, df in tables.items():
        _in_session(apart, df).createOrReplaceTempView(name)
    return apart


def adhoc_sql(spark: SparkSession, text: str, tables: dict | None = None) -> DataFrame:
    """Run one query over `tables`, by default the session's views of the four tables.

    The query is analysed in a session of its own, where the views are all there is: no
    file by its path, and no function that calls classes by name.  Tables of the shared
    catalog and generated rows are found in the analysed plan and refused.  The text must be
    one query by itself, so statements that change tables or settings, and text that
    only becomes a query in brackets, are refused too.  Whatever is refused, does not
    parse or names unknown things gives one row with the message in `error`; errors
    in the data surface when the result is used.
    """
    if tables is None:
        tables = {name: spark.table(name) for name in S.TABLES if spark.catalog.tableExists(name)}
    apart = _session_of_views(spark, tables)
    query = text.strip().rstrip(";")
    try:
        apart._jsparkSession.sessionState().sqlParser().parsePlan(query)  # one statement by itself
        found = apart.sql(f"SELECT * FROM (\n{query}\n)")  # one that returns rows
        strangers = _strangers(found._jdf.queryExecution().analyzed(), set(tables))
        if strangers:
            raise Refused(f"[NOT_A_GIVEN_TABLE] {', '.join(sorted(set(strangers)))}: only {', '.join(sorted(tables))} can be read")
        return _in_session(spark, found)
    except (ParseException, AnalysisException, Refused) as problem:
        return spark.createDataFrame([(str(problem),)], "error string")
