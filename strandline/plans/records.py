"""Queries on records: assets, history, revisions, compliance, alerts, metrics, graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.vocab import CAUSE_HALF_LIFE_YEARS, CAUSE_KIND_WEIGHTS, CAUSE_SIBLING_WEIGHT, CAUSE_UNDATED
from strandline.operators import graph as G
from strandline.operators import relational as R
from strandline.plans.tables import table

TODAY = "1998-12-31"


def asset_counters(spark, sf):
    links = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey")
    return R.counters(links, "l_partkey", "l_orderkey", "l_suppkey")


def asset_stats_filtered_counts(spark, sf):
    p = table(spark, sf, "part")
    return p.agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(F.expr("p_size > 25")).alias("large"), F.coalesce(F.sum("p_size"), F.lit(0)).alias("size_sum"),
        F.round(F.try_divide(100.0 * F.count_if(F.expr("p_size > 25")), F.count(F.lit(1))), 1).alias("large_pct"),
    )


asset_stats_filtered_counts.sql = """SELECT count(*) AS assets, count(*) FILTER (p_size > 25) AS large, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS size_sum,
  round(100.0 * count(*) FILTER (p_size > 25) / nullif(count(*), 0), 1) AS large_pct FROM part"""
asset_counters.sql = "SELECT l_partkey, count(*) AS mentions, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_suppkey) AS systems FROM lineitem GROUP BY 1"


def class_top20(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


class_top20.sql = "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20"


def list_assets(spark, sf):
    """Conjunctive optional filters with paging in a total order."""
    c = table(spark, sf, "customer")
    out = c.filter(F.col("c_name").ilike("%1%") & (F.col("c_mktsegment") == F.lit("BUILDING")) & (F.col("c_acctbal") > 0))
    return out.orderBy("c_name", "c_custkey").offset(5).limit(20).select("c_custkey", "c_name", "c_acctbal")


list_assets.sql = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 20 OFFSET 5"


def distinct_on_best(spark, sf):
    best = R.best_per_key(table(spark, sf, "lineitem"), ["l_partkey"], [F.col("l_extendedprice").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


distinct_on_best.sql = "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_partkey, l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber"


def latest_per_key(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").cast("date").alias("on"))


latest_per_key.sql = "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, CAST(max(o_orderdate) AS DATE) AS \"on\" FROM orders GROUP BY 1"


def mtbf_by_customer(spark, sf):
    events = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return R.mtbf(events, "o_custkey", "day").select("o_custkey", "events", F.round("mtbf_days", 6).alias("mtbf_days"))


mtbf_by_customer.sql = """WITH g AS (SELECT o_custkey, CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS gap FROM orders)
  SELECT o_custkey, count(*) AS events, CASE WHEN count(*) >= 3 THEN round(avg(gap) FILTER (gap > 0), 6) END AS mtbf_days FROM g GROUP BY 1"""


def downtime_summary(spark, sf):
    """Sum and mean over the corrective subset, or over all rows where there is none."""
    rows = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderpriority") == F.lit("1-URGENT")).alias("corrective"), "o_totalprice")
    g = rows.groupBy("o_custkey").agg(F.count_if("corrective").alias("n"), F.sum(F.when(F.col("corrective"), F.col("o_totalprice"))).alias("a"), F.sum("o_totalprice").alias("b"), F.count(F.lit(1)).alias("m"))
    some = F.col("n") > 0
    return g.select("o_custkey", F.round(F.when(some, F.col("a")).otherwise(F.col("b")), 2).alias("total"), F.round(F.when(some, F.col("a") / F.col("n")).otherwise(F.col("b") / F.col("m")), 6).alias("mean"))


downtime_summary.sql = """SELECT o_custkey, round(CASE WHEN count(*) FILTER (c) > 0 THEN sum(p) FILTER (c) ELSE sum(p) END, 2) AS total,
  round(CASE WHEN count(*) FILTER (c) > 0 THEN avg(p) FILTER (c) ELSE avg(p) END, 6) AS mean FROM (SELECT o_custkey, o_orderpriority = '1-URGENT' AS c, o_totalprice AS p FROM orders) GROUP BY 1"""


def _causes(spark, sf):
    """Evidence rows: mechanism, asset, kind, own or sibling, years ago, reference."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "incident").when(F.col("o_orderpriority").startswith("2"), "work_order").otherwise("inspection")
    years = F.greatest(F.lit(0.0), F.datediff(F.lit(TODAY).cast("date"), F.to_date("o_orderdate")) / 365.25)
    return o.select("o_custkey", F.col("o_orderstatus").alias("mechanism"), kind.alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("sibling"), years.alias("years"), "o_orderkey")


def _scored(spark, sf):
    kinds = F.create_map(*(F.lit(x) for kv in CAUSE_KIND_WEIGHTS.items() for x in kv))
    recency = F.coalesce(F.pow(F.lit(0.5), F.col("years") / CAUSE_HALF_LIFE_YEARS), F.lit(CAUSE_UNDATED))
    one = kinds[F.col("kind")] * F.when(F.col("sibling"), CAUSE_SIBLING_WEIGHT).otherwise(1.0) * recency
    g = _causes(spark, sf).groupBy("o_custkey", "mechanism").agg(F.sum(one).alias("base"), F.countDistinct("o_orderkey").alias("refs"), F.countDistinct("kind").alias("kinds"), F.count_if(~F.col("sibling")).alias("own"))
    score = F.col("base") * (1 + 0.25 * (F.col("refs") - 1)) * F.when(F.col("kinds") > 1, 1.15).otherwise(1.0)
    return g.withColumn("score", score)


def cause_ranking_decay(spark, sf):
    ranked = _scored(spark, sf).filter("refs >= 2")
    w = Window.partitionBy("o_custkey").orderBy(F.round("score", 9).desc(), F.col("refs").desc(), "mechanism")
    return ranked.select("o_custkey", "mechanism", F.round("score", 6).alias("score"), "refs", "kinds", F.row_number().over(w).cast("long").alias("rank"))


_CAUSE_SQL = f"""WITH e AS (SELECT o_custkey, o_orderstatus AS mechanism, CASE WHEN o_orderpriority LIKE '1%' THEN 'incident' WHEN o_orderpriority LIKE '2%' THEN 'work_order' ELSE 'inspection' END AS kind,
  o_orderkey % 3 = 0 AS sibling, greatest(0.0, (DATE '{TODAY}' - CAST(o_orderdate AS DATE)) / 365.25) AS years, o_orderkey FROM orders),
 g AS (SELECT o_custkey, mechanism, sum(CASE kind WHEN 'incident' THEN 1.0 WHEN 'work_order' THEN 0.7 ELSE 0.5 END::DOUBLE * CASE WHEN sibling THEN 0.6 ELSE 1.0 END::DOUBLE * pow(0.5, years / 5.0)) AS base,
  count(DISTINCT o_orderkey) AS refs, count(DISTINCT kind) AS kinds, count(*) FILTER (NOT sibling) AS own FROM e GROUP BY 1, 2),
 s AS (SELECT *, base * (1 + 0.25::DOUBLE * (refs - 1)) * CASE WHEN kinds > 1 THEN 1.15::DOUBLE ELSE 1.0 END AS score FROM g)"""
cause_ranking_decay.sql = f"""{_CAUSE_SQL} SELECT o_custkey, mechanism, round(score, 6) AS score, refs, kinds,
  row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 9) DESC, refs DESC, mechanism) AS rank FROM s WHERE refs >= 2"""


def cause_share_confidence(spark, sf):
    """Share of the leading cause, less if none is on the asset or it has one reference, at most 0.95."""
    g = _scored(spark, sf).groupBy("o_custkey").agg(F.sum("score").alias("total"), F.max_by(F.struct("score", "own", "refs"), F.struct(F.round("score", 9), "mechanism")).alias("lead"))
    c = F.col("lead.score") / F.col("total") * F.when(F.col("lead.own") == 0, 0.7).otherwise(1.0) * F.when(F.col("lead.refs") < 2, 0.6).otherwise(1.0)
    return g.select("o_custkey", F.round(F.least(F.lit(0.95), c), 6).alias("confidence"))


cause_share_confidence.sql = f"""{_CAUSE_SQL}, l AS (SELECT o_custkey, sum(score) AS total, arg_max({{'score': score, 'own': own, 'refs': refs}}, (round(score, 9), mechanism)) AS lead FROM s GROUP BY 1)
  SELECT o_custkey, round(least(0.95, lead.score / total * CASE WHEN lead.own = 0 THEN 0.7::DOUBLE ELSE 1.0 END * CASE WHEN lead.refs < 2 THEN 0.6::DOUBLE ELSE 1.0 END), 6) AS confidence FROM l"""


def sibling_null_safe(spark, sf):
    place = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 2).alias("place")
    return R.siblings(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", place), "c_custkey", ["c_nationkey", "c_mktsegment", "place"])


sibling_null_safe.sql = """WITH s AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 END AS place FROM customer)
  SELECT a.c_custkey AS id, b.c_custkey AS sibling FROM s a JOIN s b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.place IS NOT DISTINCT FROM b.place AND a.c_custkey <> b.c_custkey"""


def sibling_history_union(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("incident").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("on"), F.col("o_totalprice").alias("cost"))
    li = table(spark, sf, "lineitem").select(F.lit("work_order").alias("kind"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("on"), "l_linenumber")
    return o.unionByName(li, allowMissingColumns=True)


sibling_history_union.sql = """SELECT 'incident' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS "on", o_totalprice AS cost, NULL::INTEGER AS l_linenumber FROM orders
  UNION ALL SELECT 'work_order', l_orderkey, CAST(l_shipdate AS DATE), NULL, l_linenumber FROM lineitem"""


def timeline_nulls_last(spark, sf):
    rows = sibling_history_union(spark, sf).withColumn("on", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("on")))
    return R.numbered(rows, "kind", [F.col("on").asc_nulls_last(), F.col("id"), F.col("l_linenumber").asc_nulls_first()], "place", ["kind", "id", "on"])


timeline_nulls_last.sql = f"""WITH u AS ({sibling_history_union.sql}), t AS (SELECT kind, id, CASE WHEN id % 7 = 0 THEN NULL ELSE "on" END AS "on", l_linenumber FROM u)
  SELECT kind, id, "on", row_number() OVER (PARTITION BY kind ORDER BY "on" ASC NULLS LAST, id, l_linenumber NULLS FIRST) AS place FROM t"""


def revision_levels(spark, sf):
    return R.revision_levels(table(spark, sf, "orders"), "o_custkey", [F.to_date("o_orderdate")]).select("o_orderkey", "o_custkey", F.col("level").cast("long").alias("level"))


revision_levels.sql = "SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS level FROM orders"


def supersession_chain(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("valid_from"))
    return R.supersede(o, "o_custkey", "o_orderkey", "valid_from")


supersession_chain.sql = """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS valid_from FROM orders), l AS (SELECT o_custkey, valid_from, min(o_orderkey) AS f FROM o GROUP BY ALL),
  n AS (SELECT *, lead(f) OVER w AS superseded_by, lead(valid_from) OVER w AS valid_to FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from))
  SELECT o.*, superseded_by, valid_to, superseded_by IS NULL AS is_current FROM o JOIN n USING (o_custkey, valid_from)"""


def revision_conflict(spark, sf):
    """Series whose labels mix schemes, or do not rank: all their members stay current."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "DRAFT").when(F.col("o_orderkey") % 5 == 0, "B").otherwise(F.col("o_orderkey").cast("string")).alias("label"))
    r = o.withColumn("r", R.revision_rank(F.col("label")))
    g = r.groupBy("o_custkey").agg(F.countDistinct("r.scheme").alias("schemes"), F.count_if(F.expr("r is null")).alias("unranked"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("members"))
    return g.filter("schemes > 1 or unranked > 0").select("o_custkey", "schemes", "unranked", "members")


revision_conflict.sql = """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'DRAFT' WHEN o_orderkey % 5 = 0 THEN 'B' ELSE CAST(o_orderkey AS VARCHAR) END AS label FROM orders),
  r AS (SELECT *, CASE WHEN regexp_full_match(label, '[0-9]+') THEN 0 WHEN regexp_full_match(label, '[A-Z]{1,2}') THEN 1 END AS scheme FROM o)
  SELECT o_custkey, count(DISTINCT scheme) AS schemes, count(*) FILTER (scheme IS NULL) AS unranked, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM r GROUP BY 1 HAVING schemes > 1 OR unranked > 0"""


def adjacent_level_pairs(spark, sf):
    levels = R.revision_levels(table(spark, sf, "orders"), "o_custkey", [F.to_date("o_orderdate")])
    return G.adjacent_pairs(levels.select("o_custkey", "o_orderkey", "level"), "o_custkey", "o_orderkey")


adjacent_level_pairs.sql = """WITH l AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS level FROM orders)
  SELECT a.o_custkey, a.o_orderkey AS newer, b.o_orderkey AS older FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.level = b.level + 1"""


def valid_as_of(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 4 != 0, F.to_date("l_shipdate")).alias("valid_from"),
        F.when(F.col("l_linenumber") % 3 != 0, F.date_add(F.to_date("l_shipdate"), 90)).alias("valid_to"),
    )
    return G.valid_on(li, F.lit("1996-06-30").cast("date"))


valid_as_of.sql = """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_shipdate AS DATE) END AS valid_from, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) + 90 END AS valid_to FROM lineitem)
  SELECT * FROM l WHERE (valid_from IS NULL OR valid_from <= DATE '1996-06-30') AND (valid_to IS NULL OR valid_to >= DATE '1996-06-30')"""


def interval_due_overdue(spark, sf):
    """State of a periodic duty by its last evidence: satisfied, due within the grace period, or overdue."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last"))
    every = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 4 * 6 + 6).cast("int").alias("months"))
    due = F.add_months("last", F.col("months"))
    state = F.when(F.col("last").isNull(), "missing").when(due >= F.lit(TODAY).cast("date"), "satisfied").when(F.date_add(due, 30) >= F.lit(TODAY).cast("date"), "in_grace").otherwise("overdue")
    return every.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", due.alias("due"), state.alias("state"))


_DUE = f"""SELECT c_custkey, CAST(last + to_months(months) AS DATE) AS due, CASE WHEN last IS NULL THEN 'missing' WHEN CAST(last + to_months(months) AS DATE) >= DATE '{TODAY}' THEN 'satisfied'
  WHEN CAST(last + to_months(months) AS DATE) + 30 >= DATE '{TODAY}' THEN 'in_grace' ELSE 'overdue' END AS state
  FROM (SELECT c_custkey, CAST(c_custkey % 4 * 6 + 6 AS INTEGER) AS months, last FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
interval_due_overdue.sql = _DUE


def coverage_of_decidable(spark, sf):
    s = interval_due_overdue(spark, sf)
    decidable = F.count_if(F.expr("state <> 'missing'"))
    return s.agg(
        F.count_if(F.expr("state = 'satisfied'")).alias("satisfied"), F.count_if(F.expr("state = 'in_grace'")).alias("in_grace"), F.count_if(F.expr("state = 'overdue'")).alias("overdue"),
        F.count_if(F.expr("state = 'missing'")).alias("missing"), F.round(F.try_divide(100.0 * F.count_if(F.expr("state = 'satisfied'")), decidable), 1).alias("coverage"),
    )


coverage_of_decidable.sql = f"""SELECT count(*) FILTER (state = 'satisfied') AS satisfied, count(*) FILTER (state = 'in_grace') AS in_grace, count(*) FILTER (state = 'overdue') AS overdue, count(*) FILTER (state = 'missing') AS missing,
  round(100.0 * count(*) FILTER (state = 'satisfied') / nullif(count(*) FILTER (state <> 'missing'), 0), 1) AS coverage FROM ({_DUE})"""


def control_coverage_stale(spark, sf):
    """Controls and the age of their evidence: no control, no evidence, stale or covered. Evidence is known some days late, or not filed."""
    li = table(spark, sf, "lineitem")
    filed = (F.datediff(F.lit(TODAY).cast("date"), F.to_date("l_shipdate")) > F.col("l_suppkey") % 200) & (F.col("l_suppkey") % 11 != 0)
    ev = li.filter("l_suppkey % 13 <> 1").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("controls"), F.to_date(F.max(F.when(filed, F.col("l_shipdate")))).alias("last"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 + 1).alias("months")).join(ev, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    stale = F.datediff(F.lit(TODAY).cast("date"), "last") > F.col("months") * 30
    return s.select("s_suppkey", F.coalesce("controls", F.lit(0)).alias("controls"), "last", F.when(F.coalesce("controls", F.lit(0)) == 0, "no_control").when(F.col("last").isNull(), "no_evidence").when(stale, "stale").otherwise("covered").alias("state"))


control_coverage_stale.sql = f"""SELECT s_suppkey, coalesce(controls, 0) AS controls, last, CASE WHEN coalesce(controls, 0) = 0 THEN 'no_control' WHEN last IS NULL THEN 'no_evidence' WHEN DATE '{TODAY}' - last > (s_suppkey % 5 + 1) * 30 THEN 'stale' ELSE 'covered' END AS state
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS controls, CAST(max(l_shipdate) FILTER (DATE '{TODAY}' - CAST(l_shipdate AS DATE) > l_suppkey % 200 AND l_suppkey % 11 <> 0) AS DATE) AS last FROM lineitem WHERE l_suppkey % 13 <> 1 GROUP BY 1) ON s_suppkey = l_suppkey"""


def stale_after_change(spark, sf):
    """Orders with later changes of their customer: how many rows changed later, and the newest. One window, no self-join."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("changed"))
    later = Window.partitionBy("o_custkey").orderBy(F.unix_date("changed"))
    whole = Window.partitionBy("o_custkey")
    n = o.select("o_orderkey", (F.count(F.lit(1)).over(whole) - F.count(F.lit(1)).over(later.rangeBetween(Window.unboundedPreceding, 0))).alias("changes"), F.max("changed").over(whole).alias("newest"))
    return n.filter("changes > 0")


stale_after_change.sql = """SELECT a.o_orderkey, count(*) AS changes, max(CAST(b.o_orderdate AS DATE)) AS newest FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) < CAST(b.o_orderdate AS DATE) GROUP BY 1"""


def applicable_first_asset(spark, sf):
    """Requirements with a class apply to all its assets, those without to the first asset only."""
    req = spark.sql("SELECT * FROM VALUES ('r1', 'Brand#11'), ('r2', CAST(NULL AS STRING)), ('r3', 'Brand#55') AS t(req_id, brand)")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    by_class = req.filter("brand is not null").join(p, F.col("brand") == F.col("p_brand")).select("req_id", "p_partkey")
    first = p.agg(F.min("p_partkey").alias("p_partkey"))
    return by_class.unionByName(req.filter("brand is null").select("req_id").join(F.broadcast(first)))


applicable_first_asset.sql = """WITH r(req_id, brand) AS (VALUES ('r1', 'Brand#11'), ('r2', NULL), ('r3', 'Brand#55'))
  SELECT req_id, p_partkey FROM r JOIN part ON brand = p_brand UNION ALL SELECT req_id, (SELECT min(p_partkey) FROM part) FROM r WHERE brand IS NULL"""


def _edges(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("SUPPLIES_FROM").alias("type"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("type"))
    return n.unionByName(s).unionByName(c)


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SUPPLIES_FROM' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' FROM customer)"""


def khop_neighbourhood(spark, sf):
    anchors = spark.sql("SELECT * FROM VALUES ('s1'), ('r2'), ('zz') AS t(node)")
    return G.khop(_edges(spark, sf), anchors, 2).select("anchor", "node", F.col("distance").cast("long").alias("distance"))


khop_neighbourhood.sql = f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT node AS anchor, node, 0 AS d FROM (VALUES ('s1'), ('r2'), ('zz')) AS t(node)
  UNION SELECT anchor, dst, d + 1 FROM w JOIN b ON node = src WHERE d < 2) SELECT anchor, node, CAST(min(d) AS BIGINT) AS distance FROM w GROUP BY 1, 2"""


def edge_type_counts(spark, sf):
    return G.counts_by_type(_edges(spark, sf))


edge_type_counts.sql = f"WITH {_EDGES} SELECT type, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY 1"


def anchor_found_missing(spark, sf):
    wanted = spark.sql("SELECT * FROM VALUES (1L), (3L), (999999L) AS t(s_suppkey)")
    return G.anchors_found(wanted, table(spark, sf, "supplier"), "s_suppkey")


anchor_found_missing.sql = "SELECT w AS s_suppkey, w IN (SELECT s_suppkey FROM supplier) AS found FROM (VALUES (1::BIGINT), (3), (999999)) AS t(w)"


def route_ranked_evidence(spark, sf):
    """Two routes to the same evidence: the better route and the most mentions win; then a total order, cut at 30 an anchor."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return R.two_routes(li, "l_suppkey", "l_partkey", "l_orderkey", 30).select("l_suppkey", "l_orderkey", "route", "mentions")


route_ranked_evidence.sql = """WITH d AS (SELECT l_suppkey, l_orderkey, 0 AS route, count(*) AS mentions FROM lineitem GROUP BY 1, 2),
  p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), v AS (SELECT p.l_suppkey, l.l_orderkey, 1 AS route, count(*) AS mentions FROM p JOIN lineitem l USING (l_partkey) GROUP BY 1, 2),
  g AS (SELECT l_suppkey, l_orderkey, min(route) AS route, max(mentions) AS mentions FROM (SELECT * FROM d UNION ALL SELECT * FROM v) GROUP BY 1, 2)
  SELECT l_suppkey, l_orderkey, route, mentions FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY route, mentions DESC, l_orderkey) AS r FROM g) WHERE r <= 30"""


def open_actions_chain(spark, sf):
    """Open actions of an asset and its siblings: asset, event, action, distinct."""
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")
    li = table(spark, sf, "lineitem").filter("coalesce(upper(trim(l_linestatus)), '') <> 'F'").select("l_orderkey", "l_suppkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "o_orderkey", "l_suppkey").distinct()


open_actions_chain.sql = """SELECT DISTINCT c_custkey, o_orderkey, l_suppkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND coalesce(upper(trim(l_linestatus)), '') <> 'F'"""


def dedup_outstanding(spark, sf):
    """Alerts not acknowledged since: purchases acknowledge what a user's errors raised."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    live = R.anti_outstanding(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "user_id", "ts")
    return R.best_per_key(live, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


dedup_outstanding.sql = """WITH a AS (SELECT user_id, max(ts) AS ack FROM events WHERE event_type = 'purchase' GROUP BY 1),
  l AS (SELECT e.* FROM events e LEFT JOIN a USING (user_id) WHERE event_type = 'error' AND (ack IS NULL OR ts > ack)) SELECT DISTINCT ON (user_id) user_id, event_id FROM l ORDER BY user_id, ts, event_id"""


def unembedded_left_anti(spark, sf):
    """Texts without a vector of one model; the label stands for the model."""
    have = table(spark, sf, "embeddings").filter("label = 1").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(have, "doc_id", "left_anti")


unembedded_left_anti.sql = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)"


def worst_state_rollup(spark, sf):
    """The worst state of each user and day; states without a known severity rank last."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return R.worst(e, ["user_id", "day"], "event_type", {"click": 1, "signup": 1, "purchase": 3, "error": 4})


worst_state_rollup.sql = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(event_type, (CASE event_type WHEN 'click' THEN -1 WHEN 'signup' THEN -1 WHEN 'purchase' THEN -3 WHEN 'error' THEN -4 ELSE 1 END, event_type)) AS state FROM events GROUP BY 1, 2"


def nearest_rank_percentiles(spark, sf):
    return R.nearest_rank(table(spark, sf, "events").withColumn("all", F.lit("all")), ["all"], "value", [50, 95])


_RANKED = """SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})"""
nearest_rank_percentiles.sql = f"""SELECT 'all' AS "all", max(n) AS n, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS max FROM ({_RANKED.format(by="1", rows="SELECT value FROM events WHERE value IS NOT NULL")})"""


def latency_by_leg(spark, sf):
    return R.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [50, 95])


latency_by_leg.sql = f"""SELECT event_type, max(n) AS n, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS max FROM ({_RANKED.format(by="event_type", rows="SELECT event_type, value FROM events WHERE value IS NOT NULL")}) GROUP BY 1"""


def set_precision_recall(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.set_scores(rows.select((F.col("quality") == 1).alias("e"), (F.col("n_chars") > 1000).alias("f")), "e", "f")


set_precision_recall.sql = """WITH t AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND NOT n_chars > 1000) AS fn FROM labels JOIN documents USING (doc_id)),
  r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS q FROM t) SELECT tp, fp, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(2 * p * q / nullif(p + q, 0), 4) AS f1 FROM r"""


def content_hash_dedup(spark, sf):
    from strandline.functions.text import document_id

    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), document_id(F.col("text").cast("binary")).alias("uid"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))


content_hash_dedup.sql = "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, 'doc_' || substr(sha256(text), 1, 24) AS uid, count(*) AS copies FROM documents GROUP BY 1, 3"


def json_props_extract(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.countDistinct("k").alias("k_kinds"))


json_props_extract.sql = "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_kinds FROM events GROUP BY 1"


def conversation_turn_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.length(F.lead("text").over(w)).alias("next_chars"))
    return t.filter("next_role is not null")


conversation_turn_pairs.sql = "SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, length(lead(text) OVER w) AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_role IS NOT NULL"


def rollup_by_region_type(spark, sf):
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    joined = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


rollup_by_region_type.sql = "SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"


def as_of_join(spark, sf):
    """Each error with the value of the user's last purchase before it."""
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return R.as_of(left, right, "user_id", "ts", "ts", "value").select("event_id", "user_id", "value")


as_of_join.sql = "SELECT l.event_id, l.user_id, r.value FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"


def duplicate_upload_antijoin(spark, sf):
    """Odd documents and all turns as uploads, even documents as the store: contents not stored yet, one row a content."""
    h = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("h")
    docs = table(spark, sf, "documents")
    new = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), h).unionAll(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), h))
    return new.join(docs.filter("doc_id % 2 = 0").select(h).distinct(), "h", "left_anti").groupBy("h").agg(F.min("id").alias("id"))


duplicate_upload_antijoin.sql = """WITH u AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT conv_id, sha256(coalesce(text, '')) FROM conversations)
  SELECT h, min(id) AS id FROM u WHERE h NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1"""


def precedent_similarity(spark, sf):
    """Weighted similarity of every labelled vector with a target: semantic, mechanism, structural, documentary; floor 0.35."""
    from strandline.functions.vocab import PRECEDENT_FLOOR, PRECEDENT_WEIGHTS
    from strandline.operators.retrieval import cosine

    v = table(spark, sf, "embeddings")
    target = v.filter("vec_id = 0").select(F.col("embedding").alias("tv"), F.col("label").alias("tl"))
    sig = v.filter("vec_id > 0").join(F.broadcast(target)).select(
        "vec_id", F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("tv"))).alias("semantic"), F.when(F.col("label") == F.col("tl"), 1.0).otherwise(0.0).alias("mechanism"),
        F.when(F.col("vec_id") % 10 == 0, 1.0).when(F.col("vec_id") % 10 < 3, 0.8).when(F.col("vec_id") % 10 < 6, 0.4).otherwise(0.0).alias("structural"),
        F.when(F.col("vec_id") % 7 == 0, 1.0).when(F.col("vec_id") % 7 < 3, 0.6).otherwise(0.0).alias("documentary"),
    )
    total = sum((F.col(k) * w for k, w in PRECEDENT_WEIGHTS.items()), F.lit(0.0))
    return sig.withColumn("similarity", F.round(total, 6)).filter(F.col("similarity") >= PRECEDENT_FLOOR).select("vec_id", "similarity")


precedent_similarity.sql = """SELECT * FROM (SELECT e.vec_id, round(0.4::DOUBLE * greatest(0.0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))) + 0.3::DOUBLE * CASE WHEN e.label = t.label THEN 1 ELSE 0 END
  + 0.2::DOUBLE * CASE WHEN e.vec_id % 10 = 0 THEN 1.0 WHEN e.vec_id % 10 < 3 THEN 0.8 WHEN e.vec_id % 10 < 6 THEN 0.4 ELSE 0 END + 0.1::DOUBLE * CASE WHEN e.vec_id % 7 = 0 THEN 1.0 WHEN e.vec_id % 7 < 3 THEN 0.6 ELSE 0 END, 6) AS similarity
  FROM embeddings e, embeddings t WHERE t.vec_id = 0 AND e.vec_id > 0) WHERE similarity >= 0.35"""


def run_diff_noise_floor(spark, sf):
    """Two runs' metrics compared: better, worse or unchanged beyond a noise floor, by the metric's direction."""
    rows = spark.sql("""SELECT * FROM VALUES ('recall', true, 0.95D, 0.956D), ('precision', true, 0.42D, 0.47D), ('p95', false, 4.0D, 6.5D), ('gone', true, 0.5D, CAST(NULL AS DOUBLE)) AS t(metric, higher, a, b)""")
    d = F.col("b") - F.col("a")
    verdict = F.when(d.isNull(), "missing").when(F.abs(d) <= 0.02, "unchanged").when((d > 0) == F.col("higher"), "better").otherwise("worse")
    return rows.select("metric", F.round(d, 6).alias("delta"), verdict.alias("verdict"))


run_diff_noise_floor.sql = "SELECT * FROM (VALUES ('recall', 0.006::DOUBLE, 'unchanged'), ('precision', 0.05, 'better'), ('p95', 2.5, 'worse'), ('gone', NULL, 'missing')) AS t(metric, delta, verdict)"


def first_existing_tag(spark, sf):
    """The first tag of each list that exists, case aside; null rather than a new asset."""
    rows = spark.sql("SELECT * FROM VALUES ('x', array('nope', 'SUPPLIER#000000003', 'Supplier#000000001')), ('y', array('none')), ('z', array('supplier#000000002')) AS t(id, tags)")
    each = rows.select("id", F.posexplode("tags").alias("pos", "tag"))
    hit = each.join(table(spark, sf, "supplier").select("s_suppkey", F.lower("s_name").alias("n")), F.lower("tag") == F.col("n"))
    first = hit.groupBy("id").agg(F.min_by("s_suppkey", "pos").alias("s_suppkey"))
    return rows.select("id").join(first, "id", "left")


first_existing_tag.sql = """WITH t(id, pos, tag) AS (VALUES ('x', 0, 'nope'), ('x', 1, 'SUPPLIER#000000003'), ('x', 2, 'Supplier#000000001'), ('y', 0, 'none'), ('z', 0, 'supplier#000000002'))
  SELECT id, arg_min(s_suppkey, pos) AS s_suppkey FROM t LEFT JOIN supplier ON lower(tag) = lower(s_name) GROUP BY id"""

# Days compare as text on both sides.
_DAYS = {
    "latest_per_key": ["on"], "sibling_history_union": ["on"], "timeline_nulls_last": ["on"], "supersession_chain": ["valid_from", "valid_to"], "valid_as_of": ["valid_from", "valid_to"],
    "interval_due_overdue": ["due"], "control_coverage_stale": ["last"], "stale_after_change": ["newest"],
}


def _with_text_days(f, days: list[str]):
    def query(spark, sf):
        return f(spark, sf).withColumns({d: F.col(d).cast("string") for d in days})

    query.__name__, query.__module__ = f.__name__, f.__module__
    query.sql = f"SELECT * REPLACE ({', '.join(f'CAST({chr(34)}{d}{chr(34)} AS VARCHAR) AS {chr(34)}{d}{chr(34)}' for d in days)}) FROM ({f.sql})"
    return query


_ALL = [v for v in list(globals().values()) if callable(v) and hasattr(v, "sql")]
_ALL = [_with_text_days(f, _DAYS[f.__name__]) if f.__name__ in _DAYS else f for f in _ALL]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {f.__name__: f.sql for f in _ALL}
