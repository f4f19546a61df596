"""Score arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.spec import SurveySpec

#: The place of a work that a list doesn't hold.
ABSENT_PLACE = 101


def rank_adjustment(place: Column, spec: SurveySpec) -> Column:
    """+5 at the first place, -5 at the hundredth, and a little less for a work that isn't placed."""
    middle = (spec.list_length + 1) / 2
    return F.lit(spec.max_adjustment) * (F.lit(middle) - F.coalesce(place, F.lit(ABSENT_PLACE))) / F.lit(middle - 1)


def adjusted_score(score: Column, place: Column, spec: SurveySpec) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + rank_adjustment(place, spec)))


def shrunk(n: Column, mean: Column, prior_mean: Column, spec: SurveySpec) -> Column:
    return (n * mean + F.lit(float(spec.prior)) * prior_mean) / (n + F.lit(spec.prior))


def composite(columns: dict[str, Column], spec: SurveySpec) -> Column:
    total = None
    for axis, weight in spec.weights:
        part = F.lit(weight) * columns[axis]
        total = part if total is None else total + part
    return total


def penalty(sd: Column, n: Column, spec: SurveySpec) -> Column:
    return F.lit(spec.z) * sd / F.sqrt(n.cast("double"))


def rounded(x: Column, places: int) -> Column:
    """A double rounded as DuckDB does: scaled as a double, then half away from zero; `round` of Spark rounds its shortest decimal form."""
    scale = F.lit(10.0**places)
    return F.round(x * scale) / scale
