import pytest

from conftest import customer, rows
from retentia.plans import eda, kpi, reports


@pytest.fixture(scope="module")
def people(make):
    return make.customers([
        customer("a", "One year", "DSL", 5, 10.0, churn=1, payment="x", senior=1),
        customer("b", "One year", "No", 20, 20.0, churn=0, payment="x"),
        customer("c", "Two year", "DSL", 30, 30.0, churn=0, payment="y"),
        customer("d", "Two year", "DSL", 60, 40.01, churn=0, payment=None),
        customer("e", None, "Fiber optic", 60, 50.0, churn=1, payment="y"),
    ])


@pytest.fixture(scope="module")
def nobody(make):
    return make.customers([])


def test_overall(people, nobody):
    assert rows(reports.churn_rate_overall(people)) == [(5, 2, 40.0)]
    assert rows(reports.churn_rate_overall(nobody)) == [(0, None, None)]


def test_by_contract_keeps_the_null_group(people):
    assert rows(reports.churn_by_contract(people)) == [
        (None, 1, 1, 100.0, 50.0), ("One year", 2, 1, 50.0, 15.0), ("Two year", 2, 0, 0.0, 35.01)]


def test_by_payment(people):
    assert rows(reports.churn_by_payment(people)) == [
        ("x", 2, 1, 50.0), ("y", 2, 1, 50.0), (None, 1, 0, 0.0)]


def test_revenue_at_risk(people):
    assert rows(reports.revenue_at_risk_by_service(people)) == [
        ("Fiber optic", 1, 50.0, 50.0), ("DSL", 1, 10.0, 10.0)]


def test_top_k_breaks_ties_by_key(make):
    crowd = make.customers([customer(f"{i:02}", charge=70.0, churn=1) for i in range(30)])
    assert [r.customerID for r in reports.top_risk_customers(crowd).collect()] == [
        f"{i:02}" for i in range(10)]


def test_cohorts_and_seniors(people):
    assert [(r[0], r[1]) for r in reports.tenure_cohorts(people).collect()] == [
        ("0-12 months (New)", 1), ("48+ months (Loyal)", 2), ("13-24 months", 1), ("25-48 months", 1)]
    assert sorted(rows(reports.senior_segments(people))) == [
        ("Non-Senior", 4, 1, 25.0, 35.0), ("Senior", 1, 1, 100.0, 10.0)]


def test_seniors_are_grouped_by_the_flag(make):
    odd = make.customers([customer("a", senior=0), customer("b", senior=2), customer("c", senior=1)])
    assert [r[0] for r in reports.senior_segments(odd).collect()].count("Non-Senior") == 2


def test_tickets(people, make):
    tickets = make.tickets([("a", "Billing", 1, 5), ("a", "Billing", 0, 4), ("c", "General", 1, None),
                            ("ghost", "General", 1, 1)])
    assert rows(reports.tickets_vs_churn(people, tickets)) == [
        ("a", 1, "One year", 2, 4.5), ("c", 0, "Two year", 1, None), ("b", 0, "One year", 0, None),
        ("d", 0, "Two year", 0, None), ("e", 1, None, 0, None)]


def test_tickets_of_a_customer_listed_twice(make):
    twice = make.customers([customer("a"), customer("a")])
    tickets = make.tickets([("a", "Billing", 1, 5), ("a", "Billing", 1, 2)])
    assert rows(reports.tickets_vs_churn(twice, tickets)) == [("a", 0, "One year", 4, 3.5)]


def test_no_tickets_at_all(people, make):
    got = rows(reports.tickets_vs_churn(people, make.tickets([])))
    assert len(got) == 5 and all(r[3] == 0 and r[4] is None for r in got)


def test_transactions(people, make):
    paid = make.transactions([("a", 1, 10.0, "x", 0), ("a", 2, 11.0, "x", 0), ("b", 1, 5.0, "x", 1),
                              ("c", 1, 6.01, "x", 0), ("ghost", 1, 99.0, "x", 0)])
    assert sorted(rows(reports.transactions_by_churn(people, paid))) == [
        (0, 2, 2, 5.51, 50.0), (1, 1, 2, 10.5, 100.0)]
    assert rows(reports.transactions_by_churn(people, make.transactions([]))) == []


def test_segments_leave_out_null_keys(people):
    summary = reports.segment_summary(people)
    assert sorted(rows(summary)) == [
        ("One year", "DSL", 1, 1, 10.0, 5.0), ("One year", "No", 1, 0, 20.0, 20.0),
        ("Two year", "DSL", 2, 0, 35.01, 45.0)]
    assert rows(reports.segment_report(summary))[0] == ("One year", "DSL", 1, 1, 100.0, 10.0, 5.0)


def test_kpis(people, nobody):
    assert rows(kpi.kpi_bundle(people)) == [(5, 2, 3, 40.0, 30.0, 60.0)]
    assert rows(kpi.kpi_bundle(nobody)) == [(0, 0, 0, None, None, None)]
    assert rows(kpi.revenue_at_risk(people)) == [(60.0,)]
    assert rows(kpi.kpi_text(people)) == [("5", "2", "3", "40.0%", "$60")]


def test_nested_kpis_agree_with_the_flat_ones(people, nobody):
    record = kpi.kpi_record(people).first()
    assert tuple(record)[:6] == rows(kpi.kpi_bundle(people))[0]
    assert [tuple(e) for e in record.by_contract] == rows(kpi.kpi_by_contract(people))
    empty = kpi.kpi_record(nobody).first()
    assert (empty.total_customers, empty.retained, empty.by_contract) == (0, 0, [])


def test_exploratory_rates_leave_out_null_keys(people):
    assert sorted(rows(eda.contract_rate_raw(people))) == [
        ("One year", 1, 2, 50.0), ("Two year", 0, 2, 0.0)]
    assert sorted(rows(eda.mean_rate_rounded(people, "PaymentMethod"))) == [("x", 50.0), ("y", 50.0)]
    rates = dict(rows(eda.mean_rate(people, "InternetService")))
    assert rates == {"DSL": pytest.approx(100 / 3), "No": 0.0, "Fiber optic": 100.0}


def test_shares_add_up(people):
    got = {r.InternetService: r.share for r in eda.share_of_total(people).collect()}
    assert got == {"DSL": 0.25, "No": 0.0, "Fiber optic": 0.75}


def test_shares_without_any_churn(make):
    calm = make.customers([customer("a"), customer("b", service="No")])
    assert [r.share for r in eda.share_of_total(calm).collect()] == [None, None]


def test_histogram(make):
    values = [0.0, 0.1, 39.9, 40.0, 20.0, float("nan"), None]
    df = make.customers([customer(str(i), charge=v, churn=i % 2) for i, v in enumerate(values)])
    got = {(r.status, r.bin): r.n for r in eda.histogram_by_class(df).collect()}
    assert got == {("Retained", 0): 1, ("Churned", 0): 1, ("Retained", 39): 1, ("Churned", 39): 1,
                   ("Retained", 20): 1}


def test_histogram_of_one_value_and_of_nothing(make, nobody):
    same = make.customers([customer(str(i), charge=7.0) for i in range(3)])
    assert rows(eda.histogram_by_class(same)) == [("Retained", 0, 3)]
    assert rows(eda.histogram_by_class(nobody)) == []


def test_scatter_has_every_row_of_a_small_table(people):
    assert len(rows(eda.charges_scatter(people))) == 5
