"""Queries of the read path: legs, fusion, relevance, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.terms import terms
from strandline.functions.text import contains_quote, jaccard, sentences
from strandline.functions.vocab import EQUIPMENT_CLASSES, ISA_FIRST, ISA_SUCCEEDING, RRF_K, STOPWORDS
from strandline.operators import retrieval as R
from strandline.plans.tables import table
from strandline.runtime import shared_path

# The SQL side repeats the term rule for pieces that are no tags: spaced tags joined, cut, edges off, no stopwords, two characters or more, plural s off.
_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
_FIRST, _LATER = "".join(ISA_FIRST), "".join(ISA_SUCCEEDING)


def _terms_sql(text: str) -> str:
    apart = rf"regexp_replace(coalesce({text}, ''), '(?i)\b({'|'.join(STOPWORDS)})\s+([0-9]{{2,5}})', '\1 ' || chr(1) || ' \2', 'g')"
    whole = rf"regexp_replace({apart}, '(?i)\b({'|'.join(EQUIPMENT_CLASSES)}|[{_FIRST}][{_LATER}]{{0,3}})\s+([0-9]{{2,5}})(?:\s*([A-Za-z]))?\b', '\1-\2\3', 'g')"
    pieces = rf"""list_transform(string_split_regex({whole}, '[^A-Za-z0-9"''’\-‐-―_/.]+'), lambda p: lower(regexp_replace(p, '^[\-_.''"’]+|[\-_.''"’]+$', '', 'g')))"""
    words = f"list_filter({pieces}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
    return (
        f"list_transform({words}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' AND w NOT LIKE '%is' "
        "THEN substr(w, 1, length(w) - 1) ELSE w END)"
    )


QUESTIONS = [(1, "the and thand reing ention"), (2, "what caused erth onth anea"), (3, "how many ing tion ble"), (4, "compare onre versus ention und der")]
_Q_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS q(qid, question)"
_TERMS = f"""toks AS (SELECT doc_id AS id, unnest(t) AS term, len(t) AS length FROM (SELECT doc_id, {_terms_sql("text")} AS t FROM documents)),
post AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM toks GROUP BY ALL),
stats AS (SELECT greatest(count(*), 1) AS n, greatest(sum(len({_terms_sql("text")})) / greatest(count(*), 1), 1.0) AS avg FROM documents),
asked AS (SELECT DISTINCT qid, unnest({_terms_sql("question")}) AS term FROM {_Q_SQL}),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_BM25 = """sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg)))"""
_SCORED = f"""scored AS (SELECT qid, id, {_BM25} AS score, count(*) AS matched_terms FROM post JOIN df USING (term) JOIN asked USING (term) CROSS JOIN stats {{filter}} GROUP BY qid, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored)"""


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid int, question string")


def bm25_topk(spark, sf):
    out = R.bm25(table(spark, sf, "documents"), "doc_id", "text", questions(spark), 50)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "matched_terms", F.col("rank").cast("long").alias("rank"))


def bm25_doc_filter(spark, sf):
    out = R.bm25(table(spark, sf, "documents"), "doc_id", "text", questions(spark), 20, allowed=F.col("lang") == "en")
    return out.select("qid", "id", F.round("score", 6).alias("score"), "matched_terms", F.col("rank").cast("long").alias("rank"))


def bm25_from_index(spark, sf):
    """``bm25_topk`` from an index that is written first; questions read their terms' folders only."""
    path = shared_path(spark, "index")
    R.write_index(table(spark, sf, "documents"), path, "doc_id", "text")
    out = R.bm25_indexed(spark, path, questions(spark), 50)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "matched_terms", F.col("rank").cast("long").alias("rank"))


def tag_terms(spark, sf):
    """Terms of a note of every order that are tags or references, in order."""
    from strandline.plans.extraction import NOTE

    note = F.concat(F.expr(NOTE), F.lit("; p "), 100 + F.col("o_custkey") % 900, F.lit(" b and Pumps"))
    t = table(spark, sf, "orders").select("o_orderkey", terms(note).alias("t"))
    return t.select("o_orderkey", F.array_join(F.filter("t", lambda x: x.rlike(r"^(wo|sop|p|pump)\b")), "|").alias("terms"))


def lexical_corpus_stats(spark, sf):
    return R.corpus_stats(table(spark, sf, "documents"), "text")


_WANTED = ["ention", "thand", "und", "qqqq", "erth", "zzzz"]


def document_frequency_zero_filled(spark, sf):
    wanted = spark.createDataFrame([(w,) for w in _WANTED], "term string")
    return R.document_frequencies(table(spark, sf, "documents"), "doc_id", "text", wanted)


_NOUNS = [(1, "Failures of the Thand pump at Barauni and Haldia"), (2, "Ention near Erth"), (3, "Where is Kandla terminal, Onea")]


def unknown_terms_antijoin(spark, sf):
    return R.unknown_terms(table(spark, sf, "documents"), "doc_id", "text", spark.createDataFrame(_NOUNS, "qid int, question string"))


def _queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def vector_topk_cosine(spark, sf):
    out = R.dense(table(spark, sf, "embeddings"), "vec_id", "embedding", _queries(spark, sf), 25)
    return out.select("qid", "id", F.round("score", 6).alias("score"))


def vector_best_per_group(spark, sf):
    rows = table(spark, sf, "embeddings").join(F.broadcast(_queries(spark, sf)))
    rows = rows.select("qid", "label", R.cosine(F.col("embedding"), F.col("vector")).alias("c"))
    return rows.groupBy("qid", "label").agg(F.round(F.max("c"), 6).alias("best"))


def _all_queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def vector_topk_cosine_whole(spark, sf):
    """Neighbours of every row whose id is divisible by 100, however many there are."""
    out = R.dense_blocks(table(spark, sf, "embeddings"), "vec_id", "embedding", _all_queries(spark, sf), 25)
    return out.select("qid", "id", F.round("score", 6).alias("score"))


def vector_best_per_group_whole(spark, sf):
    out = R.best_per_group_blocks(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", _all_queries(spark, sf))
    return out.select("qid", F.col("label").cast("int").alias("label"), F.round("best", 6).alias("best"))


def _legs(spark, sf, k=50):
    """Lexical, dense and label legs for the questions; the first question's dense leg uses vector 1 and so on."""
    q = questions(spark)
    lexical = R.bm25(table(spark, sf, "documents"), "doc_id", "text", q, k).select("qid", F.lit("lexical").alias("leg"), "id", "rank")
    vectors = table(spark, sf, "embeddings")
    own = vectors.filter("vec_id between 1 and 4").select(F.col("vec_id").cast("int").alias("qid"), F.col("embedding").alias("vector"))
    dense = R.dense(vectors, "vec_id", "embedding", own, k).select("qid", F.lit("dense").alias("leg"), "id", "rank")
    labels = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 + 1).cast("int").alias("qid"))
    graph = R.top(labels, ["qid"], [F.col("id")], k).select("qid", F.lit("graph").alias("leg"), "id", "rank")
    return q, lexical.unionByName(dense).unionByName(graph)


_LEGS_SQL = f"""WITH {_TERMS}, {_SCORED.format(filter="")},
lex AS (SELECT qid, 'lexical' AS leg, id, rank FROM ranked WHERE rank <= 50),
own AS (SELECT CAST(vec_id AS INTEGER) AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id BETWEEN 1 AND 4),
den AS (SELECT qid, 'dense' AS leg, id, rank FROM (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) DESC, vec_id) AS rank FROM embeddings CROSS JOIN own) WHERE rank <= 50),
gra AS (SELECT qid, 'graph' AS leg, id, rank FROM (SELECT CAST(doc_id % 4 + 1 AS INTEGER) AS qid, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS rank FROM labels WHERE quality = 1) WHERE rank <= 50),
legs AS (SELECT * FROM lex UNION ALL SELECT * FROM den UNION ALL SELECT * FROM gra)"""
_FUSE_SQL = """fused AS (SELECT qid, id, sum(weight / (60 + rank)) AS score, count(DISTINCT leg) AS n_legs, min(rank) AS best_rank,
  array_to_string(list_sort(list_distinct(list(string_split(leg, ':')[1]))), '+') AS retrievers FROM weighted GROUP BY qid, id)
SELECT qid, id, round(score, 7) AS score, n_legs, retrievers FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, n_legs DESC, best_rank, id) AS r FROM fused) WHERE r <= 25"""


def _fused(legs):
    return R.fuse(legs, 25).select("qid", "id", F.round("score", 7).alias("score"), "n_legs", "retrievers")


def rrf_fusion(spark, sf):
    return _fused(_legs(spark, sf)[1].withColumn("weight", F.lit(1.0)))


def rrf_intent_weighted(spark, sf):
    q, legs = _legs(spark, sf)
    intents = q.select("qid", R.intent(F.col("question"))["intent"].alias("intent"))
    return _fused(legs.join(F.broadcast(intents), "qid").withColumn("weight", R.leg_weight(F.col("leg"), F.col("intent"))))


def rrf_subquestion_discount(spark, sf):
    _, legs = _legs(spark, sf)
    sub = legs.filter("leg <> 'graph' and rank <= 25").withColumn("leg", F.concat("leg", F.lit(":sub1"))).withColumn("id", F.col("id") + 1)
    both = legs.unionByName(sub).withColumn("weight", R.leg_weight(F.col("leg"), F.lit("lookup")))
    return _fused(both)


def hydrate_ranked(spark, sf):
    hits = R.bm25(table(spark, sf, "documents"), "doc_id", "text", questions(spark), 8).select("qid", "id", "rank")
    # Eight rows a question: a bounded side, so the texts stay where they are.
    got = table(spark, sf, "documents").join(F.broadcast(hits), F.col("doc_id") == F.col("id"))
    return got.select("qid", "id", F.concat(F.lit("C"), "rank").alias("marker"), "lang", F.substring("text", 1, 80).alias("preview"))


_ANSWERS = [(1, "thand reing was ention"), (2, "nothing of it"), (3, "tions and blet"), (4, "onre")]


def idf_weighted_relevance(spark, sf):
    q = questions(spark).join(spark.createDataFrame(_ANSWERS, "qid int, answer string"), "qid")
    wanted = q.select(F.explode(terms(F.col("question"))).alias("term"))
    df = R.document_frequencies(table(spark, sf, "documents"), "doc_id", "text", wanted)
    most = df.agg(F.max("df").alias("most"))
    idf = df.join(F.broadcast(most)).agg(F.map_from_entries(F.collect_list(F.struct("term", R.idf_weight(F.col("df"), F.col("most"))))).alias("idf"))
    q = q.withColumns({"asked": F.array_distinct(terms(F.col("question"))), "given": terms(F.col("answer"))})
    scored = R.relevance(F.col("asked"), F.col("given"), F.col("idf"))
    return q.join(F.broadcast(idf)).select("qid", F.round(scored, 6).alias("relevance"))


def sentence_scoring(spark, sf):
    """Sentences by their overlap with the first question; deterministic top 20."""
    words = F.array(*(F.lit(t) for t in ["thand", "reing", "ention"]))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    overlap = F.size(F.array_intersect(F.array_distinct(terms(F.col("sentence"))), words))
    scored = rows.withColumn("overlap", overlap).filter("overlap > 0").withColumn("score", 2 * F.col("overlap") / 3 + 0.6 * F.col("overlap") / F.sqrt(F.size(terms(F.col("sentence")))))
    return scored.orderBy(F.round("score", 9).desc(), "doc_id", "pos").limit(20).select("doc_id", F.round("score", 6).alias("score"), "sentence")


def jaccard_overlap(spark, sf):
    """Term-set similarity of conversation turns with the turn before; a pair a turn, found by a window."""
    from pyspark.sql import Window

    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(terms(F.col("text"))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("p", before).filter("p is not null").select("conv_id", "turn", F.round(jaccard(F.col("p"), F.col("t")), 6).alias("jaccard"))


def verbatim_containment(spark, sf):
    """Texts that quote a benchmark item word for word, white space and case aside."""
    from strandline.operators.documents import quoted

    return quoted(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


#: A question about every part, one in eight without any rule.
_ASKED = """CASE p_partkey % 8 WHEN 0 THEN 'How many seal failures of ' WHEN 1 THEN 'How do I isolate the ' WHEN 2 THEN 'Why does it keep tripping, ' WHEN 3 THEN 'Compare A and ' WHEN 4 THEN 'What is downstream of ' WHEN 5 THEN 'Who made '
 WHEN 6 THEN 'what permit is needed, and how many, for ' ELSE 'Root cause versus ' END || p_name"""


def intent_routing(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_ASKED).alias("question")).withColumn("i", R.intent(F.col("question")))
    return rows.select("p_partkey", "i.intent", "i.confidence")


def _intent_sql() -> str:
    from strandline.functions.vocab import DEFAULT_INTENT, INTENT_RULES

    pick = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(q, '{p.replace('(?i)', '')}', 'i') THEN {v!r}" for p, v in ((r[2], r[k]) for r in INTENT_RULES)) + f" ELSE {DEFAULT_INTENT[k]!r} END"
    return f"SELECT p_partkey, {pick(0)} AS intent, CAST({pick(1)} AS DOUBLE) AS confidence FROM (SELECT p_partkey, {_ASKED} AS q FROM part)"


def confidence_score(spark, sf):
    grid = """SELECT a.id AS top_id, top_score, scale, documents, relevance, missing, live FROM
      (VALUES (1, 0.0, 'fusion'), (2, 0.03, 'fusion'), (3, 0.8, 'reranker'), (4, 1.4, 'reranker'), (5, 6.0, 'fusion')) AS a(id, top_score, scale),
      (VALUES (0), (1), (3), (6)) AS b(documents), (VALUES (0.1D), (0.5D), (1.0D)) AS c(relevance), (VALUES (false, false), (true, false), (false, true)) AS d(missing, live)"""
    c = R.confidence(
        F.col("top_score").cast("double"), F.col("scale"), F.col("documents"), F.lit(2), F.lit(3), F.lit(4), F.col("relevance"), F.col("documents"), F.lit(6), F.col("documents"),
        F.col("missing"), F.lit(False), F.col("live"), F.lit(True),
    )
    return spark.sql(grid).withColumn("c", c).select("top_id", "documents", F.col("relevance").cast("double").alias("relevance"), "missing", "live", "c.score", "c.mode", "c.gate")


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_doc_filter, lexical_corpus_stats, document_frequency_zero_filled, unknown_terms_antijoin, vector_topk_cosine, vector_best_per_group, vector_topk_cosine_whole, vector_best_per_group_whole, rrf_fusion, rrf_intent_weighted,
    bm25_from_index, tag_terms, rrf_subquestion_discount, hydrate_ranked, idf_weighted_relevance, sentence_scoring, jaccard_overlap, verbatim_containment, intent_routing, confidence_score,
)}

_WANTED_SQL = "(VALUES " + ", ".join(f"('{w}')" for w in _WANTED) + ") AS w(term)"
_NOUN_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _NOUNS) + ") AS q(qid, question)"
_SQUASH = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
SQL = {
    "bm25_topk": f"WITH {_TERMS}, {_SCORED.format(filter='')} SELECT qid, id, round(score, 6) AS score, matched_terms, rank FROM ranked WHERE rank <= 50",
    "bm25_from_index": f"WITH {_TERMS}, {_SCORED.format(filter='')} SELECT qid, id, round(score, 6) AS score, matched_terms, rank FROM ranked WHERE rank <= 50",
    "tag_terms": """SELECT o_orderkey, 'wo-' || o_orderkey || '|p-' || (100 + o_custkey % 900) || CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END || '|sop' || CASE WHEN o_orderkey % 4 = 0 THEN '|p-' || (100 + o_custkey % 50) ELSE '' END || '|p-' || (100 + o_custkey % 900) || 'b|pump' AS terms FROM orders""",
    "bm25_doc_filter": f"WITH {_TERMS}, {_SCORED.format(filter='WHERE id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT qid, id, round(score, 6) AS score, matched_terms, rank FROM ranked WHERE rank <= 20",
    "lexical_corpus_stats": f"SELECT count(*) AS chunks, CAST(sum(len({_terms_sql('text')})) AS BIGINT) AS tokens, round(sum(len({_terms_sql('text')})) / greatest(count(*), 1), 2) AS avgdl FROM documents",
    "document_frequency_zero_filled": f"SELECT term, (SELECT count(*) FROM documents WHERE list_contains({_terms_sql('text')}, w.term)) AS df FROM {_WANTED_SQL}",
    "unknown_terms_antijoin": f"""WITH words AS (SELECT DISTINCT qid, unnest(regexp_extract_all(question, '\\b([A-Z][a-z]{{3,}})\\b', 1)) AS surface FROM {_NOUN_SQL}),
      known AS (SELECT DISTINCT unnest({_terms_sql('text')}) AS term FROM documents), t AS (SELECT qid, surface, ({_terms_sql('surface')})[1] AS term FROM words)
      SELECT qid, string_agg(surface, ',' ORDER BY surface) AS unknown FROM t WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM known) GROUP BY qid""",
    "vector_topk_cosine": """SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM
      (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 3)) WHERE r <= 25""",
    "vector_best_per_group": """SELECT q.vec_id AS qid, e.label, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS best
      FROM embeddings e, embeddings q WHERE q.vec_id < 3 GROUP BY ALL""",
    "vector_topk_cosine_whole": """SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM
      (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 25""",
    "vector_best_per_group_whole": """SELECT q.vec_id AS qid, e.label, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS best
      FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY ALL""",
    "rrf_fusion": f"{_LEGS_SQL}, weighted AS (SELECT *, 1.0::DOUBLE AS weight FROM legs), {_FUSE_SQL}",
    "rrf_intent_weighted": f"""{_LEGS_SQL}, weighted AS (SELECT *, CAST(CASE qid WHEN 1 THEN CASE leg WHEN 'lexical' THEN 1.5 WHEN 'dense' THEN 1.0 ELSE 0.6 END
      WHEN 2 THEN CASE leg WHEN 'lexical' THEN 0.8 WHEN 'dense' THEN 1.0 ELSE 1.5 END WHEN 3 THEN CASE leg WHEN 'lexical' THEN 0.6 WHEN 'dense' THEN 0.4 ELSE 1.8 END
      ELSE CASE leg WHEN 'lexical' THEN 1.0 WHEN 'dense' THEN 1.0 ELSE 1.2 END END AS DOUBLE) AS weight FROM legs), {_FUSE_SQL}""",
    "rrf_subquestion_discount": f"""{_LEGS_SQL}, all_legs AS (SELECT * FROM legs UNION ALL SELECT qid, leg || ':sub1', id + 1, rank FROM legs WHERE leg <> 'graph' AND rank <= 25),
      weighted AS (SELECT *, CAST(CASE string_split(leg, ':')[1] WHEN 'lexical' THEN 1.5 WHEN 'dense' THEN 1.0 ELSE 0.6 END * CASE WHEN contains(leg, ':sub') THEN 0.6 ELSE 1 END AS DOUBLE) AS weight FROM all_legs), {_FUSE_SQL}""",
    "hydrate_ranked": f"WITH {_TERMS}, {_SCORED.format(filter='')} SELECT qid, id, 'C' || rank AS marker, lang, substr(text, 1, 80) AS preview FROM ranked JOIN documents ON doc_id = id WHERE rank <= 8",
    "idf_weighted_relevance": f"""WITH q AS (SELECT qid, question, answer FROM {_Q_SQL} JOIN (VALUES {", ".join(f"({i}, '{a}')" for i, a in _ANSWERS)}) AS a(qid, answer) USING (qid)),
      qt AS (SELECT DISTINCT qid, unnest({_terms_sql('question')}) AS term FROM q), toks AS (SELECT doc_id, unnest(list_distinct({_terms_sql('text')})) AS term FROM documents),
      df AS (SELECT w.term, count(toks.term) AS df FROM (SELECT DISTINCT term FROM qt) w LEFT JOIN toks USING (term) GROUP BY w.term),
      wt AS (SELECT term, CASE WHEN df = 0 THEN 4.0 ELSE least(4.0, 1 + ln(((SELECT max(df) FROM df) + 1) / df)) END AS w FROM df),
      ans AS (SELECT qid, unnest({_terms_sql('answer')}) AS a FROM q)
      SELECT q.qid, round(CASE WHEN sum(w) IS NULL THEN 1.0 ELSE coalesce(sum(w) FILTER (EXISTS (SELECT 1 FROM ans WHERE ans.qid = q.qid AND (a = qt.term OR (length(a) >= 4 AND length(qt.term) >= 4 AND (starts_with(a, qt.term) OR starts_with(qt.term, a)))))), 0) / sum(w) END, 6) AS relevance
      FROM q LEFT JOIN qt USING (qid) LEFT JOIN wt USING (term) GROUP BY q.qid""",
    "jaccard_overlap": f"""WITH t AS (SELECT conv_id, turn, list_distinct({_terms_sql('text')}) AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
      SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(p, t)) / len(list_distinct(list_concat(p, t))) END, 6) AS jaccard FROM p WHERE p IS NOT NULL""",
    "verbatim_containment": f"SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE {_SQUASH.format('b.text')} <> '' AND contains({_SQUASH.format('d.text')}, {_SQUASH.format('b.text')})",
    "intent_routing": _intent_sql(),
    "confidence_score": """WITH g AS (SELECT a.id AS top_id, top_score, scale, documents, CAST(relevance AS DOUBLE) AS relevance, missing, live FROM
      (VALUES (1, 0.0, 'fusion'), (2, 0.03, 'fusion'), (3, 0.8, 'reranker'), (4, 1.4, 'reranker'), (5, 6.0, 'fusion')) AS a(id, top_score, scale),
      (VALUES (0), (1), (3), (6)) AS b(documents), (VALUES (0.1), (0.5), (1.0)) AS c(relevance), (VALUES (false, false), (true, false), (false, true)) AS d(missing, live)),
      s AS (SELECT *, 0.3 * round(CASE WHEN top_score <= 0 THEN 0 WHEN scale = 'reranker' THEN least(1.0, top_score) ELSE least(1.0, top_score::DOUBLE / (top_score::DOUBLE + 4.0) * 2.0) END, 4)
        + 0.15 * 0.75 + 0.25 * relevance + 0.1 * round(CASE WHEN documents = 0 THEN 0.0 WHEN documents = 1 THEN 0.25 ELSE least(1.0, least(1.0, 0.4 + 0.2 * (documents - 1)) + 0.2) END, 4)
        + 0.1 * round(documents / 6.0::DOUBLE, 4) + 0.1 * CASE WHEN documents > 0 THEN 1.0 ELSE 0.4 END AS plain,
        CASE WHEN missing THEN 'unknown_asset' WHEN relevance < 0.34 THEN 'answer_off_topic' WHEN live THEN 'live_state_unavailable' END AS gate FROM g),
      k AS (SELECT *, CASE WHEN gate IS NOT NULL THEN least(plain, 0.35) ELSE plain END AS total FROM s)
      SELECT top_id, documents, relevance, missing, live, round(CAST(total AS DOUBLE), 4) AS score, CASE WHEN total >= 0.75 THEN 'answer' WHEN total >= 0.5 THEN 'answer_with_caveat' ELSE 'abstain_and_route' END AS mode, gate FROM k""",
}
