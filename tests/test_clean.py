import pytest
from pyspark.errors import AnalysisException

from conftest import customer, rows
from retentia.operators.clean import clean_customers
from retentia.sources.files import csv_scan


def test_total_charges_are_coerced_and_missing_ones_dropped(make):
    texts = [" ", "", "nan", "1e3", " 5 ", "1d", "1f", None, "12.5", "-3", ".5", "abc", "0x1A", "1e400", "-Infinity", "infinite"]
    raw = make.raw([customer(str(i), total=t, churn="No") for i, t in enumerate(texts)])
    got = {r.customerID: r.TotalCharges for r in clean_customers(raw).collect()}
    assert got == {"3": 1000.0, "4": 5.0, "8": 12.5, "9": -3.0, "10": 0.5,
                   "14": float("-inf")}


def test_churn_is_one_only_for_yes(make):
    raw = make.raw([customer(str(i), total="1", churn=c) for i, c in enumerate(["Yes", "No", None, "yes"])])
    assert {r.customerID: r.Churn for r in clean_customers(raw).collect()} == {
        "0": 1, "1": 0, "2": 0, "3": 0}


def test_other_columns_pass_through(make):
    clean = clean_customers(make.raw([customer("a", total="1", churn="No")]).withColumnRenamed("gender", "x"))
    assert "x" in clean.columns and dict(clean.dtypes)["SeniorCitizen"] == "int"


def test_csv_is_read_by_column_name(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "extra,TotalCharges,customerID,tenure,MonthlyCharges,SeniorCitizen,Churn\n"
        "x, ,a,0,20.5,0,No\ny,41,b,2,20.5,1,Yes\n")
    scanned = csv_scan(spark, str(path))
    assert dict(scanned.dtypes) == dict(
        extra="string", TotalCharges="string", customerID="string", tenure="int",
        MonthlyCharges="double", SeniorCitizen="int", Churn="string")
    assert rows(clean_customers(scanned)) == [("y", 41.0, "b", 2, 20.5, 1, 1)]


def test_missing_input_fails_before_any_job(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        csv_scan(spark, str(tmp_path / "nothing.csv"))
