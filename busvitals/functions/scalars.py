"""Column functions. All JVM built-ins, so callers stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)


def healthiness(value: Column, mean: Column, std: Column, direction: str,
                tolerance: float = fv.TOLERANCE, decay: float = fv.DECAY) -> Column:
    """1 inside the tolerance band, decaying exponentially with the penalised deviation."""
    return healthiness_of_z(zscore(value, mean, std), direction, tolerance, decay)


def healthiness_of_z(z: Column, direction: str, tolerance: float = fv.TOLERANCE, decay: float = fv.DECAY) -> Column:
    excess = {"both": F.abs(z), "positive": z, "negative": -z}[direction] - F.lit(tolerance)
    # greatest() skips nulls, so a missing value is kept missing explicitly
    return F.when(z.isNotNull(), F.exp(-F.greatest(F.lit(0.0), excess) / F.lit(decay)))


def risk_category(health: Column) -> Column:
    expr = F.lit(fv.CATEGORIES[-1][0])
    for name, lower in reversed(fv.CATEGORIES[:-1]):
        expr = F.when(health >= lower, F.lit(name)).otherwise(expr)
    return F.when(health.isNotNull(), expr)


def category_index(category: Column) -> Column:
    """0 for the best category up to 4 for the worst; unknown names count as the middle one."""
    expr = F.lit(2)
    for i, (name, _) in enumerate(fv.CATEGORIES):
        expr = F.when(category == name, F.lit(i)).otherwise(expr)
    return expr


def trend_label(diff: Column) -> Column:
    """A missing difference (no earlier rows) is Stable; NaN sorts above every number, so it is tested first."""
    return (
        F.when(diff.isNull() | F.isnan(diff), F.lit("Stable"))
        .when(diff > fv.TREND_STEP, F.lit("Improving"))
        .when(diff < -fv.TREND_STEP, F.lit("Degrading"))
        .otherwise(F.lit("Stable"))
    )


def deviation_direction(z: Column) -> Column:
    return (
        F.when(z > 0.5, F.lit("above normal")).when(z < -0.5, F.lit("below normal")).otherwise(F.lit("within normal range"))
    )


def entropy_bits(values: Column) -> Column:
    """Shannon entropy (base 2) of the elements of an array; 0 for an empty one."""
    n = F.size(values)
    weighted = F.aggregate(
        F.array_distinct(values),
        F.lit(0.0),
        lambda acc, v: acc + _times_log2(n - F.size(F.array_remove(values, v))),
    )
    return F.when(n > 0, F.log2(n.cast("double")) - weighted / n).otherwise(F.lit(0.0))


def _times_log2(count: Column) -> Column:
    return count.cast("double") * F.log2(count.cast("double"))


def fixed_text(value: Column, digits: int, sign: bool = False) -> Column:
    """A number as fixed-point text, rounded half-even first because format_string rounds half-up."""
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", F.bround(value, digits))


def fill(template: Column, **texts: Column) -> Column:
    """Replace each ``{name}`` in a template column by the text column of that name."""
    for name, text in texts.items():
        template = F.replace(template, F.lit("{" + name + "}"), text)
    return template
