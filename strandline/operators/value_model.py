"""The value model: benefits, payback and return as columns of one-row inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calculate(v: DataFrame) -> DataFrame:
    """Adds every line of the model; payback is null, not infinite, where the net is not positive."""
    c = F.col
    out = v.withColumn("searches", c("users") * c("queries_per_day") * c("working_days"))
    out = out.withColumn("assisted", c("searches") * c("adoption_pct") / 100).withColumn("minutes_saved", F.greatest(F.lit(0.0), c("manual_minutes") - c("assisted_minutes")))
    out = out.withColumn("hours_saved", c("assisted") * c("minutes_saved") / 60).withColumn("search_benefit", c("hours_saved") * c("cost_per_hour"))
    out = out.withColumn("downtime_benefit", c("events_per_year") * c("avoided_pct") / 100 * c("cost_per_event"))
    out = out.withColumn("audit_benefit", c("audits") * c("prep_hours") * c("reduction_pct") / 100 * c("cost_per_hour"))
    out = out.withColumn("benefit", c("search_benefit") + c("downtime_benefit") + c("audit_benefit")).withColumn("net", c("benefit") - c("run_cost"))
    out = out.withColumn("payback_months", F.when(c("net") > 0, c("build_cost") / c("net") * 12)).withColumn("first_year", c("net") - c("build_cost"))
    return out.withColumn("roi_pct", F.when(c("build_cost") + c("run_cost") > 0, c("net") / (c("build_cost") + c("run_cost")) * 100))


def sensitivity(v: DataFrame, field: str, factors: tuple[float, ...] = (0.5, 1.0, 2.0), most: float = 100.0) -> DataFrame:
    """The model under multiples of one assumption, which stays at its most."""
    each = v.withColumn("factor", F.explode(F.array(*(F.lit(f) for f in factors))))
    return calculate(each.withColumn(field, F.least(F.lit(most), F.col(field) * F.col("factor"))))
