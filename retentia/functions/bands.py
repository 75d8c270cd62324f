"""Labels derived from one value: cohort, segment, class name, risk band."""

from pyspark.sql import Column, functions as F

from retentia import schema as S


def tenure_cohort(tenure: Column) -> Column:
    """Cohort label; whatever no range holds (49+, negative, null) is loyal."""
    label = F
    for first, last, name in S.COHORTS:
        label = label.when(tenure.between(first, last), name)
    return label.otherwise(S.LOYAL)


def senior_label(flag: Column) -> Column:
    return F.when(flag == 1, "Senior").otherwise("Non-Senior")


def class_name(flag: Column) -> Column:
    """0/1 to a class name; any other value stays null."""
    label = F
    for value, name in S.CLASS_NAMES.items():
        label = label.when(flag == value, name)
    return label


def risk_band(prob: Column) -> Column:
    """Band of the unrounded probability, bounds included."""
    label = F
    for bound, name in S.RISK_BANDS:
        label = label.when(prob >= bound, name)
    return label.otherwise(S.LOWEST_RISK)


def threshold_class(prob: Column, threshold: float = S.CLASS_THRESHOLD) -> Column:
    return (prob >= threshold).cast("int")


def yes_flag(col: Column) -> Column:
    """1 for 'Yes', 0 for anything else, null included."""
    return F.coalesce(col == "Yes", F.lit(False)).cast("int")
