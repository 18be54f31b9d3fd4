"""Catalogue views behind the public operations: listings, lineage, notifications, feedback, jobs, graph sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import relational as R
from strandline.plans.tables import table


def list_documents(spark, sf):
    """Newest first by id, filtered by kind, with the total beside every row of the page."""
    d = table(spark, sf, "documents").filter("lang = 'en'")
    total = d.agg(F.count(F.lit(1)).alias("total"))
    page = d.select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).offset(10).limit(20)
    return page.join(F.broadcast(total))


list_documents.sql = "SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 20 OFFSET 10"


def document_lineage(spark, sf):
    """Each order with its predecessor, its successor and the length of its series."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("predecessor"), F.lead("o_orderkey").over(w).alias("successor"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("series"))


document_lineage.sql = """SELECT o_orderkey, lag(o_orderkey) OVER w AS predecessor, lead(o_orderkey) OVER w AS successor, count(*) OVER (PARTITION BY o_custkey) AS series
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)"""


def chunk_mentions(spark, sf):
    """Lines of orders with their part, kept where the part is gone, by place in the order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf, "part").filter("p_size > 20").select("p_partkey", "p_name")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return li.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", F.row_number().over(w).cast("long").alias("place"), "l_partkey", "p_name")


chunk_mentions.sql = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, l_partkey, p_name
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey"""


def list_notifications(spark, sf):
    """Unacknowledged alerts with the asset they are on, where there is one."""
    e = table(spark, sf, "events").filter("event_type = 'error' and value > 20").select("event_id", "user_id", "value")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    severity = F.when(F.col("value") > 50, "high").when(F.col("value") > 30, "medium").otherwise("low")
    return e.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_name", severity.alias("severity"))


list_notifications.sql = "SELECT event_id, c_name, CASE WHEN value > 50 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'error' AND value > 20"


def acknowledge_once(spark, sf):
    """The first acknowledgement of each user counts; how many came after it."""
    a = table(spark, sf, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_ack"), (F.count(F.lit(1)) - 1).alias("already"))
    return a


acknowledge_once.sql = "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_ack, count(*) - 1 AS already FROM events WHERE event_type = 'purchase' GROUP BY 1"


def feedback_summary(spark, sf):
    f = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "up").otherwise("down").alias("verdict"), F.when(F.col("toxic") == 1, "wrong_asset").alias("reason"))
    return f.groupBy("verdict", F.coalesce("reason", F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


feedback_summary.sql = "SELECT CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS verdict, CASE WHEN toxic = 1 THEN 'wrong_asset' ELSE 'unspecified' END AS reason, count(*) AS n FROM labels GROUP BY ALL"


def job_status_rollup(spark, sf):
    """An order is a job, its lines are files: succeeded, partial or failed by how many went through."""
    j = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("l_returnflag") != "R").alias("good"))
    status = F.when(F.col("good") == F.col("files"), "succeeded").when(F.col("good") > 0, "partial").otherwise("failed")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("files").alias("files"))


job_status_rollup.sql = """SELECT CASE WHEN good = files THEN 'succeeded' WHEN good > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) AS jobs, CAST(sum(files) AS BIGINT) AS files
  FROM (SELECT l_orderkey, count(*) AS files, count(*) FILTER (l_returnflag <> 'R') AS good FROM lineitem GROUP BY 1) GROUP BY 1"""


def requirement_counts(spark, sf):
    """Counts by standard with the share quoted word for word."""
    p = table(spark, sf, "part")
    return p.filter(F.col("p_brand").ilike("%brand%")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") < 10).alias("verbatim"))


requirement_counts.sql = "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size < 10) AS verbatim FROM part WHERE p_brand ILIKE '%brand%' GROUP BY 1"


def node_merge(spark, sf):
    """Upsert of nodes: a new value wins where it is there, other values stay."""
    old = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("place"))
    new = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lower("s_name")).alias("label"), F.when(F.col("s_suppkey") % 5 == 0, 99).alias("place"))
    return G.merge_nodes(old, new, "s_suppkey")


node_merge.sql = """WITH o AS (SELECT s_suppkey, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS place FROM supplier),
  n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) END AS label, CASE WHEN s_suppkey % 5 = 0 THEN 99 END AS place FROM supplier)
  SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(n.label, o.label) AS label, coalesce(n.place, o.place) AS place FROM o FULL JOIN n USING (s_suppkey)"""


def edge_evidence(spark, sf):
    """Edges with their evidence ids exploded to passages; an id without a passage stays away."""
    e = table(spark, sf, "labels").select((F.col("doc_id") % 7).alias("edge"), F.array("doc_id", -F.col("doc_id") - 1).alias("evidence"))
    ids = e.select("edge", F.explode("evidence").alias("doc_id")).distinct()
    return ids.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("edge", "lang").agg(F.count(F.lit(1)).alias("passages"))


edge_evidence.sql = "SELECT l.doc_id % 7 AS edge, lang, count(DISTINCT l.doc_id) AS passages FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2"


def conflict_series(spark, sf):
    """Series with two revisions of one day, members in order."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    g = o.groupBy("o_custkey", "day").agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"))
    return g.filter(F.size("members") > 1).select("o_custkey", F.array_join("members", ",").alias("members"))


conflict_series.sql = "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1"


def best_candidate(spark, sf):
    """The best scored candidate of each mention; the first by name among equals."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.round("l_discount", 2).alias("score"))
    return R.best_per_key(li, ["l_orderkey"], [F.col("score").desc(), F.col("l_partkey")])


best_candidate.sql = "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, round(l_discount, 2) AS score FROM lineitem ORDER BY l_orderkey, round(l_discount, 2) DESC, l_partkey"

_HERE = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", "") == __name__ and hasattr(v, "sql")]
QUERIES = {f.__name__: f for f in _HERE}
SQL = {f.__name__: f.sql for f in _HERE}
