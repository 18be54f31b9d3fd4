"""Set-based operators on records: de-duplication, history, revisions, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import join_groups, shared_table


def best_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


#: Rows that a task of ``numbered`` sorts.
NUMBERED_ROWS = 1 << 20


def numbered(rows: DataFrame, by: str, order: list[Column], name: str, keep: list[str]) -> DataFrame:
    """``keep`` and the row number ``name`` within ``by``, counted from 1, for groups of any size.

    Ranges of ``by`` and ``order`` are sorted apart and stored; a row's number is its place in
    its range after the rows of its group in the ranges before. Equal rows are numbered in any order.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // NUMBERED_ROWS + 1)
    ranges = rows.repartitionByRange(tasks, F.col(by).asc_nulls_first(), *order).sortWithinPartitions(F.col(by).asc_nulls_first(), *order)
    # The id counts up from the partition's number times 2^33; keep it as one so that both halves agree.
    stored = shared_table(ranges.select(*dict.fromkeys([by, *keep]), F.monotonically_increasing_id().alias("_at")), "numbered")
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (before - F.col("_first") + 1).alias("_shift"))  # one row a range and group
    joined = stored.join(F.broadcast(offsets), (part == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*keep, (F.col("_at") + F.col("_shift")).alias(name))


#: Members of a group that one row meets at a time, and pairs that a task lists.
SIBLING_BLOCK, SIBLING_PAIRS = 1024, 1 << 26


def siblings(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, sibling): other rows that agree on all keys, where null agrees with null.

    The pairs are the square of a group. Members go to blocks of about ``SIBLING_BLOCK`` ids,
    dealt over all tasks; each member meets a block as one array, which is unfolded there.
    """
    # Nulls inside a struct are equal, so one equality compares all keys.
    of = rows.select(F.col(id_col).alias("id"), F.struct(*keys).alias("_key")).filter("id is not null")
    groups = of.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.monotonically_increasing_id())
    groups = shared_table(groups, "sibling-groups")
    pairs = groups.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * 2, int(pairs / SIBLING_PAIRS) + 1)
    placed = shared_table(join_groups(of, groups, "_key", "_n").select("_group", "id", F.ceil(F.col("_n") / SIBLING_BLOCK).alias("_of")), "sibling-members")
    blocks = placed.groupBy("_group", F.pmod(F.xxhash64("id"), F.col("_of")).alias("_block")).agg(F.collect_list("id").alias("_others"))
    each = placed.select("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("_block"), "id")
    met = each.repartition(tasks, "_group", "_block").join(blocks.repartition(tasks, "_group", "_block"), ["_group", "_block"])
    return met.select("id", F.explode("_others").alias("sibling")).filter("id <> sibling")


def two_routes(links: DataFrame, anchor: str, via: str, evidence: str, k: int) -> DataFrame:
    """(anchor, evidence, route, mentions): the first ``k`` of each anchor by route, most mentions and evidence.

    Route 0 is evidence that a link names with the anchor, route 1 what a link names with any
    ``via`` of the anchor; the better route and the most mentions of both count. Route 0 goes
    first, so where an anchor has ``k`` of it, route 1 is counted for that evidence only, from the
    evidence's links; other anchors get all of route 1. Null anchors and evidence are values.
    """
    pair = [anchor, evidence]
    direct = shared_table(links.groupBy(*pair).agg(F.count(F.lit(1)).alias("mentions")), "direct")
    full = direct.groupBy(F.col(anchor).alias("_anchor")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("_anchor")
    own = links.filter(F.col(via).isNotNull()).select(F.col(anchor).alias("_own"), F.col(via).alias("_via")).distinct()
    mine = F.col(anchor).eqNullSafe(F.col("_anchor"))
    few = own.join(full, F.col("_own").eqNullSafe(F.col("_anchor")), "left_anti").select(F.col("_own").alias(anchor), F.col("_via").alias(via))
    whole = few.join(links.select(via, evidence), via).groupBy(*pair).agg(F.count(F.lit(1)).alias("mentions"))
    # Links of one evidence are few; a via counts as often as the evidence names it.
    named = links.filter(F.col(via).isNotNull()).groupBy(F.col(evidence).alias("_evidence"), F.col(via).alias("_named")).agg(F.count(F.lit(1)).alias("_c"))
    asked = direct.join(full, mine, "left_semi").select(*pair).join(named, F.col(evidence).eqNullSafe(F.col("_evidence")))
    known = asked.join(own, F.col(anchor).eqNullSafe(F.col("_own")) & (F.col("_named") == F.col("_via")), "left_semi")
    some = known.groupBy(*pair).agg(F.sum("_c").alias("mentions"))
    legs = [direct.withColumn("route", F.lit(0)), whole.withColumn("route", F.lit(1)), some.withColumn("route", F.lit(1))]
    g = legs[0].unionByName(legs[1]).unionByName(legs[2]).groupBy(*pair).agg(F.min("route").alias("route"), F.max("mentions").alias("mentions"))
    w = Window.partitionBy(anchor).orderBy("route", F.desc("mentions"), evidence)
    return g.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def counters(links: DataFrame, key: str, document: str, system: str) -> DataFrame:
    """Mentions, distinct documents and distinct systems of each key."""
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(document).alias("documents"), F.countDistinct(system).alias("systems"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: list[int]) -> DataFrame:
    """Percentiles by nearest rank: the value at place round(p / 100 * (n - 1)), halves to even, counted from 0.

    Values are counted first, so only distinct values of a group are ranked.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value)))
    at = lambda p: F.bround(F.lit(p) / 100 * (F.col("n") - 1))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in shares), F.max(value).alias("max"))


def anti_outstanding(raised: DataFrame, acknowledged: DataFrame, key: str, at: str) -> DataFrame:
    """The first alert of each key after its last acknowledgement: one outstanding alert a key."""
    last = acknowledged.groupBy(key).agg(F.max(at).alias("_ack"))
    live = raised.join(last, key, "left").filter(F.col("_ack").isNull() | (F.col(at) > F.col("_ack"))).drop("_ack")
    return live


def revision_levels(rows: DataFrame, series: str, order: list[Column]) -> DataFrame:
    """Dense level of each revision in its series, oldest first."""
    return rows.withColumn("level", F.dense_rank().over(Window.partitionBy(series).orderBy(*order)))


def supersede(rows: DataFrame, series: str, id_col: str, date_col: str) -> DataFrame:
    """Adds superseded_by, valid_to and is_current by the next level of the series.

    All rows of one date are one level; those of the newest stay current. The others
    point at the smallest id of the next level and end where it begins.
    """
    levels = rows.groupBy(series, date_col).agg(F.min(id_col).alias("_first"))
    w = Window.partitionBy(series).orderBy(date_col)
    following = levels.select(F.col(series).alias("_series"), F.col(date_col).alias("_date"), F.lead("_first").over(w).alias("superseded_by"), F.lead(date_col).over(w).alias("valid_to"))
    joined = rows.join(following, F.col(series).eqNullSafe(F.col("_series")) & F.col(date_col).eqNullSafe(F.col("_date")), "left").drop("_series", "_date")
    return joined.withColumn("is_current", F.col("superseded_by").isNull())


def revision_rank(label: Column) -> Column:
    """struct(scheme, value): numbers 0, one or two letters 1 in base 26, else null."""
    s = F.upper(F.trim(label))
    letters = F.when(F.length(s) == 1, F.ascii(s) - 64).otherwise((F.ascii(s) - 64) * 26 + F.ascii(F.substring(s, 2, 1)) - 64)
    rank = lambda scheme, v: F.struct(F.lit(scheme).alias("scheme"), v.cast("int").alias("value"))
    return F.when(s.rlike(r"^\d+$"), rank(0, s)).when(s.rlike("^[A-Z]{1,2}$"), rank(1, letters))


def mtbf(events: DataFrame, key: str, date_col: str, least: int = 3) -> DataFrame:
    """Mean of the positive gaps in days between dated events, from ``least`` events on; else null."""
    gap = F.datediff(F.col(date_col), F.lag(date_col).over(Window.partitionBy(key).orderBy(date_col)))
    g = events.filter(F.col(date_col).isNotNull()).withColumn("_gap", gap)
    mean = F.avg(F.when(F.col("_gap") > 0, F.col("_gap")))
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.when(F.count(F.lit(1)) >= least, mean).alias("mtbf_days"))


def islands(rows: DataFrame, by: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Numbers runs of intervals whose distance from all before is at most ``gap``."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def set_scores(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """Micro precision, recall and F1 over boolean columns, 4 decimals, null on zero denominators."""
    t = rows.agg(
        F.count_if(F.col(expected) & F.col(found)).alias("tp"), F.count_if(~F.col(expected) & F.col(found)).alias("fp"), F.count_if(F.col(expected) & ~F.col(found)).alias("fn")
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return t.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.try_divide(2 * p * r, p + r), 4)})


def worst(rows: DataFrame, by: list[str], state: str, severity: dict[str, int]) -> DataFrame:
    """The most severe state of each group; ties go to the state first by name."""
    rank = F.create_map(*(F.lit(x) for kv in severity.items() for x in kv))
    return rows.groupBy(*by).agg(F.min_by(state, F.struct(-F.coalesce(F.try_element_at(rank, F.col(state)), F.lit(-1)), F.col(state))).alias("state"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time: union and one window.

    Of several right rows at one time the largest value counts.
    """
    l = left.withColumn("_at", F.col(left_at)).withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(key, F.col(right_at).alias("_at"), F.col(value).alias(f"_{value}")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side", f"_{value}").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(f"_{value}", ignorenulls=True).over(w)).filter("_side = 1").drop("_at", "_side", f"_{value}")
