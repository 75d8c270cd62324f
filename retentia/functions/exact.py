"""Sums, ratios and averages that do not depend on row order.

Double sums change in the last digit with the order rows arrive in, which after
a retry or on another cluster size can move a rounded figure by 0.01.  Money is
therefore added up as decimal, and ratios are rounded in whole numbers: halves
go away from zero, at the exact tie.

Arguments are SQL expressions, aggregates included.
"""

from pyspark.sql import Column, functions as F


def money(amount: str) -> str:
    """SQL of an amount as a decimal; NaN becomes null.

    An amount that does not fit, 1e18 or more or infinite, fails the query: no
    amount is left out of a sum without notice.
    """
    return (
        f"CASE WHEN isnan({amount}) THEN NULL "
        f"WHEN abs(double({amount})) = double('Infinity') THEN raise_error('CAST of an infinite amount') "
        f"ELSE CAST({amount} AS decimal(24,6)) END"
    )


def rounded_ratio(num: str, den: str, places: int = 2) -> Column:
    """num / den to `places` decimals as a double; null where den is 0 or null.

    Both must be whole numbers or decimals.
    """
    scale, den = 10**places, f"nullif({den}, 0)"
    half_up = f"(abs({num}) * {2 * scale} + {den}) div ({den} * 2)"
    return F.expr(f"if({num} < 0, -1, 1) * ({half_up}) / {scale}.0D")


def percent(part: str, whole: str) -> Column:
    """part as a percentage of whole, two decimals."""
    return rounded_ratio(f"(({part}) * 100)", whole)


def share(part: str, whole: str) -> Column:
    """part / whole as a plain double, null for an empty whole."""
    return F.expr(f"try_divide(CAST({part} AS double), CAST({whole} AS double))")


def money_sum(amount: str) -> Column:
    return F.expr(f"CAST(round(sum({money(amount)}), 2) AS double)")


def money_avg(amount: str) -> Column:
    return rounded_ratio(f"sum({money(amount)})", f"count({money(amount)})")


def whole_avg(value: str) -> Column:
    """Average of a whole-number column, two decimals."""
    return rounded_ratio(f"sum({value})", f"count({value})")
