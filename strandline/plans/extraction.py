"""Queries on mentions, fields, questions, sets and boxes, over whole tables. Notes are put together from columns, by one expression on both sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import extract as E
from strandline.functions import vocab as V
from strandline.operators import documents as D
from strandline.plans.tables import table

#: A maintenance note of every order, in SQL that both engines read alike.
NOTE = """'WO-' || o_orderkey || ' on P-' || (100 + o_custkey % 900) || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END || ' raised 20' || (10 + o_custkey % 14) || '-0' || (1 + o_orderkey % 9) || '-1' || (o_orderkey % 9)
 || ', closed ' || (10 + o_orderkey % 25) || '/' || (10 + o_custkey % 4) || '/2024; vibration ' || (o_orderkey % 70) || '.5 mm at ' || (1000 + o_custkey % 500) || ' rpm, see SOP ' || (4000 + o_custkey % 100) || ' clause 4.' || (o_orderkey % 8)
 || CASE WHEN o_orderkey % 4 = 0 THEN ', floc: CDU1-P-' || (100 + o_custkey % 50) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ', seal leak and running hot' ELSE '' END"""
#: A question of every part.
QUESTION = """CASE p_partkey % 6 WHEN 0 THEN 'What is the current pressure of ' WHEN 1 THEN 'Which revision is current for the pressure of ' WHEN 2 THEN 'Total cost of ' WHEN 3 THEN 'Top bad actor near ' WHEN 4 THEN 'Average vibration in 2019 of '
 ELSE 'Trend of live level over time of ' END || p_name"""


def _notes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr(NOTE).alias("note"))


_NOTES = f"(SELECT o_orderkey, o_custkey, {NOTE} AS note FROM orders)"
_PLAIN_REF = V.REFERENCE.replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z])", "")


def document_references(spark, sf):
    """References of every note, canonical and in order."""
    return _notes(spark, sf).select("o_orderkey", F.array_join(E.references(F.col("note")), "|").alias("refs"))


document_references.sql = f"""SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(note, '{_PLAIN_REF}'), lambda x: regexp_replace(replace(x, ' ', '-'), '^([A-Z]+)-?([0-9])', '\\1-\\2')), '|') AS refs FROM {_NOTES}"""


def clause_mentions(spark, sf):
    """How often each clause is cited, and by how many customers' notes."""
    c = _notes(spark, sf).select("o_custkey", F.explode(E.clauses(F.col("note"))).alias("clause"))
    return c.groupBy("clause").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


clause_mentions.sql = f"SELECT clause, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT o_custkey, unnest(regexp_extract_all(note, 'clause ([0-9]+(?:\\.[0-9]+)*)', 1)) AS clause FROM {_NOTES}) GROUP BY 1"


def note_quantities(spark, sf):
    """Values with a unit, one row each; a bare number is no quantity."""
    q = _notes(spark, sf).select("o_orderkey", F.posexplode(E.quantities(F.col("note"))).alias("pos", "q"))
    return q.select("o_orderkey", "pos", "q.value", "q.unit")


note_quantities.sql = """WITH q AS (SELECT o_orderkey, 0 AS place, CAST(100 + o_custkey % 900 AS DOUBLE) AS value, 'A' AS unit FROM orders WHERE o_custkey % 3 = 0
  UNION ALL SELECT o_orderkey, 1, CAST((o_orderkey % 70) || '.5' AS DOUBLE), 'mm' FROM orders UNION ALL SELECT o_orderkey, 2, CAST(1000 + o_custkey % 500 AS DOUBLE), 'rpm' FROM orders)
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1 AS pos, value, unit FROM q"""


def text_quantities(spark, sf):
    """Quantities of all whole documents, by unit in lower case."""
    q = table(spark, sf, "documents").select(F.explode(E.quantities(F.col("text"))).alias("q"))
    found = q.groupBy(F.lower("q.unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("texts")).crossJoin(found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("quantities")))


_PLAIN_QUANTITY = V.QUANTITY.replace("(?i)(?<![A-Za-z0-9.])", "(?i)(?:^|[^A-Za-z0-9.])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)")
text_quantities.sql = f"SELECT count(*) AS texts, CAST(coalesce(sum(len(regexp_extract_all(text, '{_PLAIN_QUANTITY}'))), 0) AS BIGINT) AS quantities FROM documents"


def note_dates(spark, sf):
    """Dates of every note by pattern, impossible ones left out, and the first of them."""
    return _notes(spark, sf).select(
        "o_orderkey", F.array_join(F.transform(E.dates(F.col("note")), lambda x: x.cast("string")), "|").alias("dates"), E.first_date(F.lit("no date"), F.col("note")).cast("string").alias("first")
    )


note_dates.sql = f"""SELECT o_orderkey, concat_ws('|', a, b) AS dates, a AS first FROM (SELECT o_orderkey, CAST(CAST(strptime(regexp_extract(note, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '%Y-%m-%d') AS DATE) AS VARCHAR) AS a, CAST(CAST(try_strptime(regexp_extract(note, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), '%d/%m/%Y') AS DATE) AS VARCHAR) AS b FROM {_NOTES})"""


def functional_location_groups(spark, sf):
    """Each functional location with the canonical assets that notes name beside it."""
    f = _notes(spark, sf).select(F.explode(E.functional_locations(F.col("note"))).alias("fl_tag"), F.regexp_extract("note", r" on (P-\d+[AB])", 1).alias("tag"))
    return f.groupBy("fl_tag").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"), F.count(F.lit(1)).alias("mentions"))


functional_location_groups.sql = f"""SELECT 'CDU1-P-' || (100 + o_custkey % 50) AS fl_tag, string_agg(DISTINCT 'P-' || (100 + o_custkey % 900) || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END, '|' ORDER BY 'P-' || (100 + o_custkey % 900) || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END) AS tags, count(*) AS mentions FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1"""


def masked_notes(spark, sf):
    """Tags left in notes once references are masked: SOP 4412 is no pump."""
    m = _notes(spark, sf).select("o_orderkey", F.regexp_extract_all(E.masked(F.col("note")), F.lit(r"\b(?:SOP|WO|P)[- ]\d+[AB]?\b"), 0).alias("t"))
    return m.select("o_orderkey", F.array_join("t", "|").alias("tags"))


masked_notes.sql = """SELECT o_orderkey, concat_ws('|', CASE WHEN length(CAST(o_orderkey AS VARCHAR)) = 1 THEN 'WO-' || o_orderkey END, 'P-' || (100 + o_custkey % 900) || CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'P-' || (100 + o_custkey % 50) END) AS tags FROM orders"""


def note_failures(spark, sf):
    """Failure phrases and early signs of every note against a failure code."""
    n = _notes(spark, sf).withColumn("p", D.failure_terms(F.col("note"))).withColumn("best", D.best_failure(F.col("p")))
    code = F.when(F.col("o_custkey") % 2 == 0, "ELP").otherwise("VIB")
    return n.select("o_orderkey", F.array_join("p", "|").alias("phrases"), F.col("best").alias("mode"), D.coded_against_narrative(code, F.col("best")).alias("verdict"), F.array_join(D.cues(F.col("note")), "|").alias("cues"))


note_failures.sql = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'seal leak|running hot' ELSE '' END AS phrases, CASE WHEN o_orderkey % 5 = 0 THEN 'ELP' END AS mode,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'no_text_evidence' WHEN o_custkey % 2 = 0 THEN 'agree' ELSE 'disagree' END AS verdict, CASE WHEN o_orderkey % 5 = 0 THEN 'running hot' ELSE '' END AS cues FROM orders"""


def text_doc_types(spark, sf):
    """Document type of every page and document, and whether records are extracted from it."""
    both = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")))
    t = both.select(D.classify(F.col("text")).alias("doc_type"))
    return t.groupBy("doc_type", E.extractable(F.col("doc_type")).alias("extractable")).agg(F.count(F.lit(1)).alias("n"))


def status_lines(spark, sf):
    """Severity lines reduced to their leading token."""
    line = F.concat("o_orderpriority", F.lit(" -- 22 hours, "), "o_orderstatus")
    return table(spark, sf, "orders").groupBy(E.status(line).alias("status"), E.status(F.concat(F.lit(" "), "o_orderstatus", F.lit(" , x"))).alias("short")).agg(F.count(F.lit(1)).alias("n"))


status_lines.sql = "SELECT upper(split_part(regexp_replace(o_orderpriority || ' -- 22', '\\s+-+\\s+|,', chr(1), 'g'), chr(1), 1)) AS status, upper(o_orderstatus) AS short, count(*) AS n FROM orders GROUP BY ALL"


def upload_names(spark, sf):
    """Stored name, title and its plain form of every page, uploaded under a path made of its address."""
    name = F.concat(F.lit("C:\\up/../"), F.regexp_replace("url", "/", "_"), F.lit("?.html"))
    p = table(spark, sf, "pages").select("page_id", E.safe_filename(name).alias("name"))
    return p.select("page_id", "name", E.title(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page "), "page_id")), F.col("name")).alias("title"), E.plain_title(F.col("name")).alias("plain"))


upload_names.sql = """WITH n AS (SELECT page_id, regexp_replace(replace(url, '/', '_'), '[<>:"|?*]', '', 'g') || '.html' AS name FROM pages)
  SELECT page_id, name, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE trim(replace(replace(left(name, length(name) - 5), '_', ' '), '-', ' ')) END AS title, trim(regexp_replace(lower(name), '[_\\-\\s]+', ' ', 'g')) AS plain FROM n"""


def fenced_replies(spark, sf):
    """Replies with and without a code fence come out alike."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.md5(E.without_fence(raw)).alias("digest"))


fenced_replies.sql = "SELECT conv_id, turn, md5(trim(text)) AS digest FROM conversations"


def expanded_abbreviations(spark, sf):
    """Abbreviations in a line made for each part, written out."""
    line = F.concat(F.lit("Brg temp, S/D of "), F.col("p_brand"), F.lit(" (RCA/vib) wo"), F.col("p_partkey") % 3, F.lit(" pm"))
    return table(spark, sf, "part").select("p_partkey", E.expanded(line).alias("line"))


expanded_abbreviations.sql = "SELECT p_partkey, 'bearing temperature, shutdown of ' || p_brand || ' (RCA/vib) wo' || (p_partkey % 3) || ' preventive maintenance' AS line FROM part"


def live_state_gate(spark, sf):
    """Questions of parts: does one ask for a live reading, and what does it want summed up."""
    q = table(spark, sf, "part").select("p_partkey", F.expr(QUESTION).alias("q"))
    return q.select("p_partkey", E.asks_for_live_state(F.col("q")).alias("live"), E.aggregation(F.col("q")).alias("wants"))


_RE2 = lambda p: p.replace("(?i)", "").replace("'", "''")
live_state_gate.sql = f"""WITH q AS (SELECT p_partkey, {QUESTION} AS q FROM part) SELECT p_partkey, regexp_matches(q, '{_RE2(V.LIVE_MARKER)}', 'i') AND NOT regexp_matches(q, '{_RE2(V.DOCUMENTARY)}', 'i') AND regexp_matches(q, '{_RE2(V.MEASUREMENT)}', 'i') AS live,
  CASE p_partkey % 6 WHEN 2 THEN 'sum' WHEN 3 THEN 'rank' WHEN 4 THEN 'average' WHEN 5 THEN 'trend' ELSE 'count' END AS wants FROM q"""


def sub_question_dedupe(spark, sf):
    """Four restatements of each part's question: short, repeated and unchanged ones go."""
    q = table(spark, sf, "part").select("p_partkey", F.expr(QUESTION).alias("q"))
    parts = F.array(F.upper("q"), F.lit("why so"), F.lit("Where does it leak most ?"), F.lit("where does it leak most"), F.lit(""), F.concat(F.col("q"), F.lit(" and others")))
    return q.select("p_partkey", F.array_join(E.distinct_parts(parts, F.col("q")), "|").alias("parts"))


sub_question_dedupe.sql = f"SELECT p_partkey, 'Where does it leak most ?|' || {QUESTION} || ' and others' AS parts FROM part"


def iso_days(spark, sf):
    """Dates given as text, cut to ten characters; other spellings are null."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf, "orders").select("o_orderkey", E.iso_day(raw).cast("string").alias("day"))


iso_days.sql = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"


def reranker_shares(spark, sf):
    """Logits from balances on a scale from 0 to 1, and the cache key of each pair."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", E.reranker_share(F.col("c_acctbal") / 400).alias("share"), E.rerank_key(F.lit("m"), F.col("c_name"), F.col("c_mktsegment")).alias("key"))


reranker_shares.sql = "SELECT c_custkey, round((least(greatest(c_acctbal / 400, -12.0::DOUBLE), 12.0::DOUBLE) + 12) / 24, 4) AS share, sha256('m' || chr(0) || c_name || chr(0) || c_mktsegment) AS key FROM customer"


def worth_extracting_chunks(spark, sf):
    """Chunks that pass the gate before an expensive call."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "prose").otherwise("table")
    n = _notes(spark, sf)
    return n.select("o_orderkey", E.worth_extracting(kind, F.col("note"), F.size(D.failure_terms(F.col("note"))) > 0).alias("worth"))


worth_extracting_chunks.sql = f"SELECT o_orderkey, o_orderkey % 2 = 0 AND length(note) >= 120 AND o_orderkey % 5 = 0 AS worth FROM {_NOTES}"


def merged_boxes(spark, sf):
    """Box, confidence and method of chunks merged from lines: no box over a page break, the weakest confidence, one method or mixed."""
    b = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 2).alias("page"), (F.col("l_linenumber") * 10.0).alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_linenumber") * 10.0 + 8).alias("x1"), (F.col("l_quantity") + 5).alias("y1"),
        (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("method"),
    )
    one = F.countDistinct("page") == 1
    g = b.groupBy("l_orderkey").agg(
        F.when(one, F.min("x0")).alias("x0"), F.when(one, F.min("y0")).alias("y0"), F.when(one, F.max("x1")).alias("x1"), F.when(one, F.max("y1")).alias("y1"), F.round(F.min("confidence"), 4).alias("confidence"),
        F.when(F.countDistinct("method") > 1, "mixed").otherwise(F.max("method")).alias("method"),
    )
    return g


merged_boxes.sql = """SELECT l_orderkey, CASE WHEN p = 1 THEN x0 END AS x0, CASE WHEN p = 1 THEN y0 END AS y0, CASE WHEN p = 1 THEN x1 END AS x1, CASE WHEN p = 1 THEN y1 END AS y1, confidence, CASE WHEN m > 1 THEN 'mixed' ELSE method END AS method FROM (
  SELECT l_orderkey, count(DISTINCT l_suppkey % 2) AS p, min(l_linenumber * 10.0::DOUBLE) AS x0, min(l_quantity) AS y0, max(l_linenumber * 10.0::DOUBLE + 8) AS x1, max(l_quantity + 5) AS y1, round(min(1 - l_discount), 4) AS confidence,
    count(DISTINCT nullif(l_returnflag, 'N')) AS m, max(nullif(l_returnflag, 'N')) AS method FROM lineitem GROUP BY 1)"""


def metadata_merge(spark, sf):
    """Two property maps merged, the right one wins; hidden keys left out."""
    left = F.from_json("props", "map<string,string>")
    right = F.create_map(F.lit("k"), F.when(F.col("event_type") == "error", "e").otherwise(F.get_json_object("props", "$.k")), F.lit("type"), F.col("event_type"), F.lit("chunk_id"), F.lit("x"))
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
    shown = F.map_filter(merged, lambda k, v: k != "chunk_id")
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda x: F.concat_ws("=", x["key"], x["value"]))), "|").alias("props"))


metadata_merge.sql = "SELECT event_id, 'k=' || CASE WHEN event_type = 'error' THEN 'e' ELSE json_extract_string(props, '$.k') END || '|type=' || event_type AS props FROM events"


def asset_link_aggregate(spark, sf):
    """Mentions, evidence chunks and the first page and score of each document's assets."""
    li = table(spark, sf, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return li.groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("asset")).agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("l_orderkey").alias("chunks"), F.min_by("l_linenumber", order).alias("page"), F.min_by("l_quantity", order).alias("score")
    )


asset_link_aggregate.sql = "SELECT l_suppkey, l_partkey % 50 AS asset, count(*) AS mentions, count(DISTINCT l_orderkey) AS chunks, arg_min(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS page, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS score FROM lineitem GROUP BY ALL"


def drawing_list(spark, sf):
    """Per drawing: detections, linked ones, distinct assets above a confidence."""
    li = table(spark, sf, "lineitem")
    linked = F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("detections"), F.count(linked).alias("linked"), F.countDistinct(F.when(F.col("l_discount") < 0.05, F.col("l_partkey"))).alias("sure_assets"))


drawing_list.sql = "SELECT l_suppkey, count(*) AS detections, count(CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS linked, count(DISTINCT l_partkey) FILTER (l_discount < 0.05) AS sure_assets FROM lineitem GROUP BY 1"


def detection_filter(spark, sf):
    """Detections of a kind and confidence with their asset if known, and how many of a kind are unlinked."""
    d = table(spark, sf, "lineitem").filter((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.04))
    p = table(spark, sf, "part").filter("p_size < 25").select("p_partkey", "p_name")
    return d.join(p, d.l_partkey == p.p_partkey, "left").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_name").isNull()).alias("unlinked"))


detection_filter.sql = "SELECT l_returnflag, count(*) AS n, count(*) FILTER (p_name IS NULL) AS unlinked FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey WHERE l_linestatus = 'F' AND l_discount >= 0.04 GROUP BY 1"


def coalesced_key_join(spark, sf):
    """Assets found by their tag, or by its normalised form where the tag is missing."""
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.format_string("Customer#%09d", "o_custkey")).alias("tag"), F.format_string("CUSTOMER#%09d", (F.col("o_custkey") + 1)).alias("normalised"))
    c = table(spark, sf, "customer").select("c_custkey", F.upper("c_name").alias("k"))
    return d.join(c, F.upper(F.coalesce("tag", "normalised")) == F.col("k"), "left").select("o_orderkey", "c_custkey")


coalesced_key_join.sql = "SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer ON upper(c_name) = 'CUSTOMER#' || lpad(CAST(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE o_custkey + 1 END AS VARCHAR), 9, '0')"


def tag_or_alias_lookup(spark, sf):
    """One asset for each surface form: by tag first, else by alias, distinct."""
    want = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("surface")).distinct()
    p = table(spark, sf, "part")
    by_tag, by_alias = p.select(F.col("p_partkey").alias("surface"), "p_partkey"), p.select((F.col("p_partkey") + 7).alias("surface"), "p_partkey")
    both = want.join(by_tag, "surface").withColumn("by", F.lit(0)).union(want.join(by_alias, "surface").withColumn("by", F.lit(1))).distinct()
    return both.groupBy("surface").agg(F.min_by("p_partkey", F.struct("by", "p_partkey")).alias("p_partkey"))


tag_or_alias_lookup.sql = "WITH w AS (SELECT DISTINCT l_partkey * 2 AS surface FROM lineitem) SELECT surface, coalesce(a.p_partkey, b.p_partkey) AS p_partkey FROM w LEFT JOIN part a ON a.p_partkey = surface LEFT JOIN part b ON b.p_partkey + 7 = surface WHERE a.p_partkey IS NOT NULL OR b.p_partkey IS NOT NULL"


def trigger_union(spark, sf):
    """Triggers of three sources, padded with nulls, as one stream of candidates."""
    o = table(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.lit("work_order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset"))
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("asset"), F.col("value"))
    p = table(spark, sf, "part").filter("p_size = 1").select(F.lit("inspection").alias("kind"), F.col("p_partkey").alias("id"))
    return o.unionByName(e, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


trigger_union.sql = "SELECT 'work_order' AS kind, o_orderkey AS id, o_custkey AS asset, NULL::DOUBLE AS value FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 'event', event_id, user_id, value FROM events WHERE event_type = 'error' UNION ALL SELECT 'inspection', p_partkey, NULL, NULL FROM part WHERE p_size = 1"


def shared_procedure_join(spark, sf):
    """Documents and labels: mechanisms in common between each part's brand letters and its type."""
    p = table(spark, sf, "part").select("p_partkey", F.array_distinct(F.split(F.upper("p_brand"), "")).alias("a"), F.array_distinct(F.split(F.upper("p_type"), "")).alias("b"))
    return p.filter(F.arrays_overlap("a", "b")).select("p_partkey", F.size(F.array_intersect("a", "b")).alias("shared"))


shared_procedure_join.sql = "SELECT * FROM (SELECT p_partkey, len(list_intersect(list_distinct(string_split(upper(p_brand), '')), list_distinct(string_split(upper(p_type), '')))) AS shared FROM part) WHERE shared > 0"


def tags_in_both(spark, sf):
    """INTERSECT of shipped and returned parts by supplier."""
    li = table(spark, sf, "lineitem")
    return li.filter("l_returnflag = 'N'").select("l_suppkey", "l_partkey").intersect(li.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey"))


tags_in_both.sql = "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'"


def tags_only_shipped(spark, sf):
    """EXCEPT, and with counts kept EXCEPT ALL."""
    li = table(spark, sf, "lineitem")
    a, b = li.filter("l_returnflag = 'N'").select("l_suppkey", "l_linenumber"), li.filter("l_returnflag = 'R'").select("l_suppkey", "l_linenumber")
    once = a.subtract(b).withColumn("how", F.lit("distinct"))
    return once.union(a.exceptAll(b).withColumn("how", F.lit("all")))


tags_only_shipped.sql = """WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
  SELECT *, 'distinct' AS how FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'all' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"""


def cube_by_status(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


cube_by_status.sql = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INTEGER AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


def grouping_sets_by_status(spark, sf):
    li = table(spark, sf, "lineitem")
    sets = [[li.l_returnflag, li.l_linenumber], [li.l_linestatus], []]
    return li.groupingSets(sets, li.l_returnflag, li.l_linenumber, li.l_linestatus).agg(F.count(F.lit(1)).alias("n"))


grouping_sets_by_status.sql = "SELECT l_returnflag, l_linenumber, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())"


def range_frame_week(spark, sf):
    """Events of a user in the seven days up to each, by a range frame."""
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-7 * 86400 * 1_000_000, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.max("value").over(w), 2).alias("peak"))


range_frame_week.sql = "SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 2) AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)"


def evidence_counts(spark, sf):
    """Counts by kind of evidence for every asset, zeros too."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("work_orders"), F.count_if(F.col("o_orderstatus") != "F").alias("open_orders"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent")
    )
    c = table(spark, sf, "customer").select("c_custkey")
    kinds = ["work_orders", "open_orders", "years", "urgent"]
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


evidence_counts.sql = "SELECT c_custkey, count(o_orderkey) AS work_orders, count(*) FILTER (o_orderstatus <> 'F') AS open_orders, count(DISTINCT year(o_orderdate)) AS years, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"


def missing_evidence(spark, sf):
    """What each asset lacks, by absence rules over its counts."""
    e = evidence_counts(spark, sf)
    rules = F.array_compact(F.array(F.when(F.col("work_orders") == 0, "no work orders"), F.when(F.col("urgent") == 0, "no incidents"), F.when(F.col("years") < 3, "short history"), F.when(F.col("open_orders") > F.col("work_orders") / 2, "mostly open")))
    return e.select("c_custkey", F.array_join(rules, "|").alias("missing"))


missing_evidence.sql = f"SELECT c_custkey, concat_ws('|', CASE WHEN work_orders = 0 THEN 'no work orders' END, CASE WHEN urgent = 0 THEN 'no incidents' END, CASE WHEN years < 3 THEN 'short history' END, CASE WHEN open_orders > work_orders / 2 THEN 'mostly open' END) AS missing FROM ({evidence_counts.sql})"


def durations(spark, sf):
    """Milliseconds from a user's event to the next, null at the end."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", ((F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000).cast("long").alias("ms"))


durations.sql = "SELECT event_id, ((epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


_ALL = [v for v in list(globals().values()) if callable(v) and hasattr(v, "sql")]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {f.__name__: f.sql for f in _ALL}
