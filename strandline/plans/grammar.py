"""Queries on literal fixtures and texts: tags, records, classes, geometry, value model, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import tags as T
from strandline.functions import vocab
from strandline.functions.text import contains_quote, multi_format_date
from strandline.operators import documents as D
from strandline.operators import geometry as X
from strandline.operators import value_model as V
from strandline.plans.tables import table
from strandline.runtime import shared_table
from strandline.streaming import queries as S

_TAGS = [
    "P-101B", "P101B", "P 101 B", "10-P-101-B", "P-101-B", "p-101b", "  P-101B ", "P_101_B", "P/101/B", "CDU1-PUMP-101B", "Pump 101 B", "P-0101B", "HX-204", "PIC-101", "10LAC20AP001",
    '6"-P-1501-A1A', "TK-201", "the B pump", "P-101A", "P-102B", "P-101",
]
_EXPECTED = [
    # surface, canonical, kind, block
    *((s, "P-101B", "equipment", "equipment|P|101") for s in _TAGS[:12]), ("HX-204", "E-204", "equipment", "equipment|E|204"), ("PIC-101", "PIC-101", "instrument", "instrument|PIC|101"),
    ("10LAC20AP001", "10LAC20AP001", "kks", "kks|LAC|001"), ('6"-P-1501-A1A', '6"-P-1501-A1A', "line", "line|P|1501"), ("TK-201", "TK-201", "equipment", "equipment|TK|201"),
    ("the B pump", "THE-B-P", "unparsed", "unparsed|THEBP"), ("P-101A", "P-101A", "equipment", "equipment|P|101"), ("P-102B", "P-102B", "equipment", "equipment|P|102"), ("P-101", "P-101", "equipment", "equipment|P|101"),
]


def _rows(rows) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _tags(spark):
    return spark.createDataFrame([(t,) for t in _TAGS], "surface string")


#: Spellings of a tag for every order, and what they stand for.
_SPELLED = """CASE o_orderkey % 9 WHEN 0 THEN 'P-' || n || 'B' WHEN 1 THEN 'p ' || n || ' a' WHEN 2 THEN '10-P-' || n || '-B' WHEN 3 THEN 'Pump ' || n || ' B' WHEN 4 THEN 'HX-' || n WHEN 5 THEN 'PIC-' || n WHEN 6 THEN 'TK-0' || n WHEN 7 THEN 'the B pump' ELSE ' Ｐ＿' || n || '/B ' END"""
_MEANT = """SELECT o_orderkey, surface, kind, CASE WHEN kind = 'unparsed' THEN 'THE-B-P' ELSE cls || '-' || n || sfx END AS canonical, CASE WHEN kind = 'unparsed' THEN 'unparsed|THEBP' ELSE kind || '|' || cls || '|' || n END AS block, sfx FROM (
  SELECT *, CASE o_orderkey % 9 WHEN 4 THEN 'E' WHEN 5 THEN 'PIC' WHEN 6 THEN 'TK' ELSE 'P' END AS cls, CASE o_orderkey % 9 WHEN 5 THEN 'instrument' WHEN 7 THEN 'unparsed' ELSE 'equipment' END AS kind,
    CASE WHEN o_orderkey % 9 = 1 THEN 'A' WHEN o_orderkey % 9 IN (0, 2, 3, 8) THEN 'B' ELSE '' END AS sfx FROM (SELECT o_orderkey, n, {spelled} AS surface FROM (SELECT o_orderkey, 100 + o_custkey % 900 AS n FROM orders)))""".format(spelled=_SPELLED)


def _spelled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (100 + F.col("o_custkey") % 900).alias("n")).select("o_orderkey", F.expr(_SPELLED).alias("surface"))


def _parsed(spark, sf):
    """Canonical tag, kind and block of every order's spelling; each distinct spelling is parsed once."""
    rows = _spelled(spark, sf)
    t = T.with_tag(rows.select("surface").distinct(), "surface", "t")
    known = shared_table(t.select("surface", T.canonical(F.col("t")).alias("canonical"), "t.kind", T.blocking_key(F.col("t")).alias("block")), "tags")
    return rows.join(known, "surface")


def tag_parse(spark, sf):
    return _parsed(spark, sf).select("o_orderkey", "surface", "canonical", "kind", "block")


tag_parse.sql = f"SELECT o_orderkey, surface, canonical, kind, block FROM ({_MEANT})"


def tag_normalise(spark, sf):
    return _spelled(spark, sf).select("o_orderkey", T.normalise(F.col("surface")).alias("normalised"))


tag_normalise.sql = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'P-' || n || 'B' WHEN 1 THEN 'P-' || n || '-A' WHEN 2 THEN '10-P-' || n || '-B' WHEN 3 THEN 'P-' || n || '-B' WHEN 4 THEN 'E-' || n WHEN 5 THEN 'PIC-' || n WHEN 6 THEN 'TK-' || n WHEN 7 THEN 'THE-B-P'
  ELSE 'P-' || n || '-B' END AS normalised FROM (SELECT o_orderkey, 100 + o_custkey % 900 AS n FROM orders)"""


def block_letters(spark, sf):
    """Blocks of assets that differ in their item letter only, and how many spellings each asset has."""
    p = _parsed(spark, sf).filter("kind = 'equipment'")
    return p.groupBy("block").agg(F.countDistinct("canonical").alias("assets"), F.countDistinct("surface").alias("spellings"), F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("tags"))


block_letters.sql = f"SELECT block, count(DISTINCT canonical) AS assets, count(DISTINCT surface) AS spellings, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS tags FROM ({_MEANT}) WHERE kind = 'equipment' GROUP BY 1"

_PAIRS = [
    ("P-101A", "P-101B", "SIBLING", 0.30, "link_sibling"), ("P-101B", "P-102B", "DIFFERENT", 0.10, "separate"), ("P-101B", "PIC-101", "DIFFERENT", 0.05, "separate"),
    ("P-101B", "Pump 101 B", "SAME", 0.97, "merge"), ("10-P-101B", "P-101B", "SAME", 0.85, "needs_review"), ("10-P-101B", "20-P-101B", "DIFFERENT", 0.15, "separate"),
]


def tag_pair_decision(spark, sf):
    pairs = spark.createDataFrame([p[:2] for p in _PAIRS], "a string, b string")
    surfaces = pairs.select(F.explode(F.array("a", "b")).alias("surface")).distinct()
    known = shared_table(T.with_tag(surfaces, "surface"), "tags")  # each surface is parsed once
    t = pairs.join(known.toDF("a", "ta"), "a").join(known.toDF("b", "tb"), "b")
    t = t.withColumn("m", T.score_pair(F.col("ta"), F.col("tb")))
    return t.select("a", "b", "m.relation", "m.score", T.decide(F.col("m")).alias("action"))


tag_pair_decision.sql = f"SELECT a, b, relation, score::DOUBLE AS score, action FROM (VALUES {_rows(_PAIRS)}) AS t(a, b, relation, score, action)"


def entity_resolution(spark, sf):
    """Every distinct spelling resolved: merged, linked as a sibling, kept apart or sent to review."""
    return D.resolve(_spelled(spark, sf).select("surface").distinct(), "surface")


entity_resolution.sql = f"""WITH s AS (SELECT DISTINCT surface, canonical, kind, block, nullif(sfx, '') AS sfx FROM ({_MEANT})),
  b AS (SELECT block, count(DISTINCT sfx) AS letters FROM s GROUP BY 1) SELECT surface, canonical, block, CASE WHEN kind = 'equipment' AND sfx IS NULL AND letters > 0 THEN 'needs_review' WHEN letters > 1 THEN 'link_sibling' WHEN kind = 'unparsed' THEN 'separate' ELSE 'merge' END AS action FROM s JOIN b USING (block)"""


def sibling_pairs(spark, sf):
    """Assets that differ in their item letter only, from the spellings of all orders."""
    return D.sibling_pairs(tag_parse(spark, sf).select("canonical", "kind", "block").distinct(), "canonical")


sibling_pairs.sql = f"""WITH t AS (SELECT DISTINCT canonical, block FROM ({_MEANT}) WHERE sfx <> '') SELECT a.canonical AS a, b.canonical AS b FROM t a JOIN t b USING (block) WHERE a.canonical < b.canonical"""


def instrument_decode(spark, sf):
    """What the letters of every part's instrument mean."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'PIC' WHEN 1 THEN 'LSHH' ELSE 'XQ9' END").alias("letters"))
    return rows.select("p_partkey", T.instrument_function(F.col("letters")).alias("meaning"))


instrument_decode.sql = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Pressure Indicate Control' WHEN 1 THEN 'Level Switch High High' END AS meaning FROM part"

#: The head of a document for every order, and far below it another phrase.
_HEAD = """CASE o_orderkey % 7 WHEN 0 THEN 'INCIDENT REPORT, see work order ' || o_custkey WHEN 1 THEN 'Standard Operating Procedure for P-101' WHEN 2 THEN rpad('', 700, 'x') || ' permit to work' WHEN 3 THEN 'nothing' WHEN 4 THEN 'P&ID of unit 3'
  WHEN 5 THEN rpad('Datasheet', 620, '.') || ' hazop and api 610' END"""


def doc_classification(spark, sf):
    """Type of every page, document and order head by its heaviest phrase, and whether records are extracted from it."""
    from strandline.functions.extract import extractable

    text = table(spark, sf, "documents").select(F.lit("documents").alias("source"), "text").unionAll(table(spark, sf, "pages").select(F.lit("pages"), "html"))
    t = text.unionAll(table(spark, sf, "orders").select(F.lit("orders"), F.expr(_HEAD))).select("source", D.classify(F.col("text")).alias("doc_type"))
    return t.groupBy("source", "doc_type", extractable(F.col("doc_type")).alias("extractable")).agg(F.count(F.lit(1)).alias("n"))


def _rated_sql() -> str:
    out = []
    for n, (kind, weight, phrases) in enumerate(vocab.KEYWORD_RULES):
        at = "least(" + ", ".join(f"nullif(strpos(low, '{p}'), 0)" for p in (*phrases, phrases[0])) + ")"
        out.append(f"{{w: CASE WHEN {at} <= {vocab.TITLE_WINDOW} THEN {weight}::DOUBLE WHEN {at} IS NOT NULL THEN {weight}::DOUBLE * {vocab.REFERENCE_PENALTY}::DOUBLE ELSE 0::DOUBLE END, n: {-n}, k: '{kind}'}}")
    return "[" + ", ".join(out) + "]"


doc_classification.sql = f"""WITH t AS (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'orders', {_HEAD} FROM orders), l AS (SELECT source, lower(coalesce(text, '')) AS low FROM t),
  r AS (SELECT source, list_max({_rated_sql()}) AS b FROM l) SELECT source, CASE WHEN b.w > 0 THEN b.k ELSE 'unknown' END AS doc_type, CASE WHEN b.w > 0 THEN b.k ELSE 'unknown' END IN ('incident_report', 'moc') AS extractable, count(*) AS n FROM r GROUP BY ALL"""


def header_synonym_map(spark, sf):
    rows = spark.createDataFrame([("WO-1", "P-101B", " CLOSED ", "9", "z"), ("WO-2", "E-204", "", "x", None)], "`Work Order` string, Equipment string, State string, Downtime string, Foo string")
    m = D.map_headers(rows)
    return m.select("wo_id", "asset_tag", "status", F.try_to_number("downtime_hours", F.lit("999")).cast("double").alias("downtime_hours"), F.to_json("extra").alias("extra"))


header_synonym_map.sql = """SELECT wo_id, asset_tag, status, d::DOUBLE AS downtime_hours, extra FROM (VALUES ('WO-1', 'P-101B', 'CLOSED', 9, '{"Foo":"z"}'), ('WO-2', 'E-204', NULL, NULL, '{}')) AS t(wo_id, asset_tag, status, d, extra)"""

#: Seven spellings of an order's day, the last no date.
_SPELLED_DAY = {0: ("yyyy-MM-dd", "%Y-%m-%d"), 1: ("dd/MM/yyyy", "%d/%m/%Y"), 2: ("dd-MM-yyyy", "%d-%m-%Y"), 3: ("d MMM yyyy", "%-d %b %Y"), 4: ("d-MMM-yyyy", "%-d-%b-%Y"), 5: ("yyyy/MM/dd", "%Y/%m/%d")}


def multi_format_dates(spark, sf):
    """Days of all orders in six spellings come back as the same day; anything else is null."""
    raw = F.lit("not a date")
    for k, (form, _) in _SPELLED_DAY.items():
        raw = F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", form)).otherwise(raw)
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", multi_format_date(F.col("raw")).cast("string").alias("day"))


multi_format_dates.sql = f"""SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, (_, f) in _SPELLED_DAY.items())} ELSE 'not a date' END AS raw, CASE WHEN o_orderkey % 7 < 6 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"""


def record_routing(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "c").alias("cml"), F.when(F.col("l_orderkey") % 2 == 0, "w").alias("wo"), F.when(F.col("l_orderkey") % 3 == 0, "i").alias("inc"))
    kind = D.route(F.col("cml"), F.lit(None), F.col("wo"), F.col("inc"))
    return li.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


record_routing.sql = "SELECT CASE WHEN l_linenumber = 1 THEN 'inspection' WHEN l_orderkey % 2 = 0 THEN 'work_order' WHEN l_orderkey % 3 = 0 THEN 'incident' ELSE 'unrouted' END AS kind, count(*) AS n FROM lineitem GROUP BY 1"


def record_chunks(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", D.record_chunks(p, [("p_name", "Name"), ("p_brand", "Brand"), ("p_type", "Type"), ("p_size", "Size")]).alias("chunk"))


record_chunks.sql = "SELECT p_partkey, concat_ws('; ', 'Name: ' || p_name, 'Brand: ' || p_brand, 'Type: ' || p_type, 'Size: ' || p_size) AS chunk FROM part"


def chunk_windows(spark, sf):
    """Prose chunks of all texts (a sequential fold, tested against a plain version)."""
    c = D.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("id", "ordinal", F.length("chunk").alias("chars"))


def citation_validity(spark, sf):
    """Every document cites a snippet, even ones their own, odd ones that of the document before: is it in their text?"""
    d = table(spark, sf, "documents")
    cited = d.select((F.col("doc_id") - F.col("doc_id") % 2).alias("source_id"), "doc_id", "text")
    snippets = d.select(F.col("doc_id").alias("source_id"), F.substring("text", 1, 120).alias("snippet"))
    return cited.join(snippets, "source_id", "left").select("doc_id", contains_quote(F.coalesce("text", F.lit("")), F.col("snippet")).alias("valid"))


_SQ = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
citation_validity.sql = f"SELECT d.doc_id, coalesce({_SQ.format('substr(s.text, 1, 120)')} <> '' AND contains({_SQ.format('d.text')}, {_SQ.format('substr(s.text, 1, 120)')}), false) AS valid FROM documents d LEFT JOIN documents s ON s.doc_id = d.doc_id - d.doc_id % 2"


def groundedness_ratio(spark, sf):
    """Claims whose citation was verified in the cited text, by language."""
    c = citation_validity(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return c.groupBy("lang").agg(F.count_if("valid").alias("verbatim"), F.count(F.lit(1)).alias("claims"), F.round(F.try_divide(F.count_if("valid"), F.count(F.lit(1))), 4).alias("groundedness"))


groundedness_ratio.sql = f"SELECT lang, count(*) FILTER (valid) AS verbatim, count(*) AS claims, round(count(*) FILTER (valid) / nullif(count(*), 0), 4) AS groundedness FROM ({citation_validity.sql}) JOIN documents USING (doc_id) GROUP BY 1"

# Shapes of every order's page, made from its lines by one expression on both sides.
_BOXES = "l_orderkey AS page, l_linenumber AS box_id, l_linenumber * 50e0 AS x0, 10e0 AS y0, l_linenumber * 50e0 + 40 AS x1, 90e0 AS y1"
_POINTS = "l_orderkey AS page, l_linenumber AS point_id, l_quantity * 7 AS x, (l_suppkey % 90 + 8) * 1e0 AS y"
_LINES = "l_orderkey AS page, l_linenumber AS line_id, l_partkey % 5 * 60e0 AS x0, 0.5e0 + l_linenumber % 3 AS y0, l_partkey % 5 * 60e0 + 50 + l_linenumber AS x1, 0.5e0 + l_linenumber % 3 AS y1"
_SYMBOLS = "l_orderkey AS page, l_linenumber AS symbol_id, l_linenumber * 50e0 AS x0, 0e0 AS y0, l_linenumber * 50e0 + 8 AS x1, 8e0 AS y1"


def _shapes(spark, sf, columns: str):
    return table(spark, sf, "lineitem").selectExpr(*columns.split(", "))


def bubble_contains_tag(spark, sf):
    return X.containing(_shapes(spark, sf, _BOXES), _shapes(spark, sf, _POINTS))


bubble_contains_tag.sql = f"SELECT b.page, box_id, point_id FROM (SELECT {_BOXES} FROM lineitem) b JOIN (SELECT {_POINTS} FROM lineitem) p ON b.page = p.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"


def line_merge_islands(spark, sf):
    lines = _shapes(spark, sf, _LINES).select("page", F.col("y0").alias("y"), "x0", "x1")
    return X.merge_lines(lines).select("page", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "y", "parts")


line_merge_islands.sql = f"""WITH l AS (SELECT page, floor(y0 / 4.0) AS bin, y0, x0, x1 FROM (SELECT {_LINES} FROM lineitem)),
  n AS (SELECT *, CASE WHEN max(x1) OVER w IS NULL OR x0 > max(x1) OVER w + 6 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY page, bin ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY page, bin ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n)
  SELECT page, round(min(x0), 3)::DOUBLE AS x0, round(max(x1), 3)::DOUBLE AS x1, round(avg(y0), 3)::DOUBLE AS y, count(*) AS parts FROM i GROUP BY page, bin, island"""


def line_connections(spark, sf):
    return X.connections(_shapes(spark, sf, _LINES), _shapes(spark, sf, _SYMBOLS))


line_connections.sql = f"""WITH l AS (SELECT {_LINES} FROM lineitem), b AS (SELECT {_SYMBOLS} FROM lineitem),
  e AS (SELECT page, line_id, x0 AS x, y0 AS y FROM l UNION ALL SELECT page, line_id, x1, y1 FROM l), t AS (SELECT DISTINCT e.page, line_id, symbol_id FROM e JOIN b ON e.page = b.page AND x BETWEEN x0 - 6 AND x1 + 6 AND y BETWEEN y0 - 6 AND y1 + 6)
  SELECT p.page, p.symbol_id AS a, q.symbol_id AS b, min(p.line_id) AS line_id FROM t p JOIN t q ON p.page = q.page AND p.line_id = q.line_id AND p.symbol_id < q.symbol_id GROUP BY 1, 2, 3"""

_INPUT = {
    "users": 120, "queries_per_day": 4, "working_days": 240, "adoption_pct": 60, "manual_minutes": 18, "assisted_minutes": 3, "cost_per_hour": 900, "events_per_year": 6,
    "avoided_pct": 10, "cost_per_event": 4000000, "audits": 4, "prep_hours": 160, "reduction_pct": 40, "build_cost": 9000000, "run_cost": 3000000,
}


def _input(spark):
    return spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in _INPUT.items()))


def value_model(spark, sf):
    m = V.calculate(_input(spark))
    return m.select("searches", "hours_saved", "benefit", "net", "first_year", F.round("payback_months", 6).alias("payback_months"), F.round("roi_pct", 6).alias("roi_pct"))


_VIN = "SELECT " + ", ".join(f"{v}::DOUBLE AS {k}" for k, v in _INPUT.items())
_VSQL = """, s AS (SELECT *, users * queries_per_day * working_days AS searches FROM v), h AS (SELECT *, searches * adoption_pct / 100 * greatest(0, manual_minutes - assisted_minutes) / 60 AS hours_saved FROM s),
  b AS (SELECT *, hours_saved * cost_per_hour + events_per_year * avoided_pct / 100 * cost_per_event + audits * prep_hours * reduction_pct / 100 * cost_per_hour AS benefit FROM h), n AS (SELECT *, benefit - run_cost AS net FROM b)"""
value_model.sql = f"WITH v AS ({_VIN}){_VSQL} SELECT searches, hours_saved, benefit, net, net - build_cost AS first_year, round(CASE WHEN net > 0 THEN build_cost / net * 12 END, 6) AS payback_months, round(net / (build_cost + run_cost) * 100, 6) AS roi_pct FROM n"


def value_sensitivity(spark, sf):
    return V.sensitivity(_input(spark), "adoption_pct").select("factor", "adoption_pct", F.round("net", 2).alias("net"))


value_sensitivity.sql = f"WITH u AS ({_VIN}), v AS (SELECT u.* REPLACE (least(100.0, adoption_pct * factor) AS adoption_pct), factor FROM u, (VALUES (0.5::DOUBLE), (1.0), (2.0)) AS f(factor)){_VSQL} SELECT factor, adoption_pct, round(net, 2) AS net FROM n"


def _stream(spark, sf):
    events = table(spark, sf, "events")
    return S.source(spark, f"{sf}/events.parquet", events.schema)


def stream_event_windows(spark, sf):
    """Hourly windows over the event stream; complete mode, so the last state holds every window."""
    out = S.drain(S.windowed(_stream(spark, sf)).withColumn("total", F.round("total", 2)), "update")
    best = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "n").alias("b"))
    return best.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "b.n", "b.total")


stream_event_windows.sql = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def stream_alert_dedup(spark, sf):
    """Errors raise, purchases acknowledge: alerts that were outstanding at no earlier one."""
    return S.drain(S.outstanding(_stream(spark, sf), "user_id", "error", "purchase"))


stream_alert_dedup.sql = """WITH e AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase'))
  SELECT user_id AS key, event_id FROM e WHERE event_type = 'error' AND (before IS NULL OR before = 'purchase')"""


def stream_content_dedup(spark, sf):
    pages = table(spark, sf, "pages")
    stream = S.source(spark, f"{sf}/pages.parquet", pages.schema)
    return S.drain(S.by_content(stream, "html").select("content_hash"))


stream_content_dedup.sql = "SELECT DISTINCT sha256(html) AS content_hash FROM pages"


def stream_sessions(spark, sf):
    """Sessions by a 30 minute gap; the batch form of the same function checks the stream's state."""
    out = S.sessions(table(spark, sf, "events"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


stream_sessions.sql = """WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
  SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1"""


def event_replay(spark, sf):
    return S.replay(table(spark, sf, "events")).select("event_id", "event_type")


event_replay.sql = "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"

_HERE = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", "") == __name__ and hasattr(v, "sql")]
QUERIES = {f.__name__: f for f in [*_HERE, chunk_windows]}
SQL = {f.__name__: f.sql for f in _HERE}
