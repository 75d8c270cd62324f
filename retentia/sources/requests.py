"""Scoring requests: records in which any field may be left out."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from retentia import schema as S
from retentia.functions.bands import yes_flag


def field_types(defaults: dict = S.REQUEST_DEFAULTS) -> dict:
    """Types of the features; one that `schema` does not know has that of its default."""
    kinds = {n: T.DoubleType() if isinstance(d, float) else T.IntegerType() if isinstance(d, int)
             else T.StringType() for n, d in defaults.items()}
    return kinds | {f.name: f.dataType for f in S.CUSTOMERS.fields}


def unreadable_fields(records: DataFrame, defaults: dict = S.REQUEST_DEFAULTS) -> Column:
    """Names of the features whose given value their type cannot hold, as an array."""
    types, kinds = dict(records.dtypes), field_types(defaults)
    names = []
    for n in (n for n in defaults if n in types):
        readable = F.col(n).try_cast(kinds[n]).isNotNull()
        if n == "SeniorCitizen" and types[n] == "string":
            readable = readable | F.lower(F.trim(n)).isin("yes", "no")
        names.append(F.when(F.col(n).isNotNull() & ~readable, F.lit(n)))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def score_requests(
    records: DataFrame, total_from_tenure: bool = False, defaults: dict = S.REQUEST_DEFAULTS,
    rejected: str | None = None,
) -> DataFrame:
    """Records with every feature present, typed and in feature order.

    Missing columns and nulls take the default.  With `total_from_tenure` a
    missing TotalCharges becomes tenure * MonthlyCharges instead, and a textual
    SeniorCitizen (Yes/No) becomes 1/0.  Other columns, such as the key, stay.

    A value that its feature's type cannot hold, such as a tenure of 'twelve',
    fails the job.  With `rejected`, the name of a column to add, it only marks
    its record: true there, and the default in the value's place.
    """
    kinds = field_types(defaults)
    types = dict(records.dtypes)
    if rejected:
        text_flag = types.get("SeniorCitizen") == "string"
        given = [n for n in defaults if n in types and not (text_flag and n == "SeniorCitizen")]
        marked = F.size(unreadable_fields(records, defaults)) > 0
        records = records.select("*", marked.alias(rejected)).withColumns(
            {n: F.col(n).try_cast(kinds[n]) for n in given}
        )
        return score_requests(records, total_from_tenure, defaults)

    def filled(name):
        if name not in types:
            return F.lit(defaults[name]).cast(kinds[name])
        value = F.col(name)
        if name == "SeniorCitizen" and types[name] == "string":
            flag = F.when(value.isNotNull(), F.coalesce(value.try_cast("int"), yes_flag(value)))
            return F.coalesce(flag, F.lit(defaults[name]))
        return F.coalesce(value.cast(kinds[name]), F.lit(defaults[name]).cast(kinds[name]))

    features = {name: filled(name) for name in defaults}
    if total_from_tenure:
        given = F.col("TotalCharges").cast("double") if "TotalCharges" in types else F.lit(None)
        features["TotalCharges"] = F.coalesce(
            given, features["tenure"] * features["MonthlyCharges"]
        )
    others = [c for c in records.columns if c not in features]
    order = [c for c in S.NUMERIC_FEATURES + S.CATEGORY_FEATURES if c in features]
    order += [c for c in features if c not in order]
    return records.select(*others, *[features[c].alias(c) for c in order])
