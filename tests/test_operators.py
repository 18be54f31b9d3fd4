"""Operators on small fixtures."""

import io
import zipfile

from pyspark.sql import functions as F

from strandline.functions import tags as T
from strandline.functions.text import covers, sentences, stem, uuid5
from strandline.operators import relational as R
from strandline.operators import retrieval as Q
from strandline.runtime import join_groups, shared_table
from strandline.sources import files as S


def test_thirteen_spellings_are_one_tag(spark):
    spellings = ["P-101B", "P101B", "P 101 B", "10-P-101-B", "P-101-B", "P‑101‑B", "p-101b", "  P-101B  ", "P_101_B", "P/101/B", "CDU1-PUMP-101B", "Pump 101 B", "P-0101B"]
    t = T.with_tag(spark.createDataFrame([(s,) for s in spellings], "s string"), "s")
    got = t.select(T.canonical(F.col("tag")).alias("c"), T.blocking_key(F.col("tag")).alias("b")).distinct().collect()
    assert [tuple(r) for r in got] == [("P-101B", "equipment|P|101")]


def test_jaro_winkler(spark):
    r = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", "A")], "a string, b string").select(F.round(T.jaro_winkler("a", "b"), 3)).collect()
    assert [x[0] for x in r] == [0.961, 0.813, 0.0]


def test_stem_and_covers(spark):
    r = spark.sql("SELECT 'bearings' a, 'gas' b, 'status' c, 'glass' d").select(*(stem(F.col(c)) for c in "abcd"), covers(F.lit("vibration"), F.lit("vibr")), covers(F.lit("sea"), F.lit("seal"))).first()
    assert tuple(r) == ("bearing", "gas", "status", "glass", True, False)


def test_sentences_keep_length_window(spark):
    text = "Too short. This sentence is certainly long enough to be\nkept as evidence here. End."
    assert spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t"))).first()[0] == ["This sentence is certainly long enough to be kept as evidence here."]


def test_uuid5(spark):
    import uuid

    got = spark.range(1).select(uuid5(uuid.NAMESPACE_URL.hex, F.lit("strandline"))).first()[0]
    assert got == uuid.uuid5(uuid.NAMESPACE_URL, "strandline").hex


def test_gates_keep_the_first(spark):
    c = Q.confidence(*(F.lit(x) for x in (0.9, "reranker", 3, 2, 4, 4, 0.1, 3, 3, 2, True, True, True, True)))
    r = spark.range(1).select(c.alias("c")).select("c.*").first()
    assert (r["score"], r["mode"], r["gate"]) == (0.35, "abstain_and_route", "unknown_asset")


def test_reranker_shares_next_to_the_middle_of_two_steps(spark, duck):
    from strandline.functions.extract import reranker_share

    balances = [-273.12, 4381.92, -912.48, -486.24, 4535.52, 0.0, 9999.0, -9999.0]
    got = spark.createDataFrame([(b,) for b in balances], "b double").select(reranker_share(F.col("b") / 400)).collect()
    sql = "SELECT round((least(greatest(b / 400, -12.0::DOUBLE), 12.0::DOUBLE) + 12) / 24, 4) FROM (SELECT unnest(?::DOUBLE[]) AS b)"
    assert [r[0] for r in got] == [r[0] for r in duck.execute(sql, [balances]).fetchall()]
    assert [r[0] for r in got][:3] == [0.4716, 0.9565, 0.4049]
    assert spark.range(1).select(reranker_share(F.lit(None).cast("double"))).first()[0] == 0.0


def test_diverse_choice(spark):
    arr = F.array(*(F.array(*map(F.lit, x)) for x in (["a", "b", "c"], ["a", "b", "c"], ["d"], ["e"], ["f"], ["g"])))
    from strandline.functions.text import jaccard

    got = spark.range(1).select(Q.diverse(arr, lambda x, y: jaccard(x, y))).first()[0]
    assert got == [["a", "b", "c"], ["d"], ["e"], ["f"]]


def test_revision_ranks(spark):
    rows = spark.createDataFrame([("3",), ("A",), ("ab",), ("DRAFT",), ("",), (None,), ("2019-07",)], "r string")
    got = [r["k"] and tuple(r["k"]) for r in rows.select(R.revision_rank(F.col("r")).alias("k")).collect()]
    assert got == [(0, 3), (1, 1), (1, 28), None, None, None, None]


def test_join_groups_with_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 700).cast("string")).alias("k"))
    groups = shared_table(rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "g")
    left = join_groups(rows, groups, "k", "n", "left")
    assert left.count() == 3000
    assert left.filter("k = 'hot'").select("first", "n").distinct().collect() == [(0, 1000)]
    assert left.filter("k is null").filter("first is not null").count() == 0
    assert join_groups(rows, groups, "k", "n").count() == rows.filter("k is not null").count()


def test_text_blocks_carry_headings(spark):
    md = "# Top\nintro\n## Part A\nbody\n### Deep\nx\n## Part B\ny"
    got = S.text_blocks(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("line_no").collect()
    assert {r["line"]: r["section"] for r in got if not r["line"].startswith("#")} == {"intro": "Top", "body": "Top > Part A", "x": "Top > Part A > Deep", "y": "Top > Part B"}


def test_tables_and_docx(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# export\nWork Order;Equipment;State;Foo\nWO-1;P-101B;CLOSED;z\n")
    r = S.records_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r["wo_id"], r["asset_tag"], r["status"], r["extra"]) == ("WO-1", "P-101B", "CLOSED", {"Foo": "z"})
    (tmp_path / "b.json").write_text('{"records": [{"wo": "WO-9", "tag": "E-204"}]}')
    assert S.records_json(spark, str(tmp_path / "b.json")).select("wo_id", "asset_tag").first() == ("WO-9", "E-204")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Hi</w:t></w:r></w:p></w:body></w:document>')
    files = spark.createDataFrame([("x.docx", bytearray(out.getvalue())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    got = {(r["path"], r["style"], r["text"]) for r in S.docx_paragraphs(files).collect()}
    assert ("x.docx", "Heading1", "Hi") in got and any(p == "bad.docx" and s == "warning" for p, s, _ in got)


def test_refused_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine")
    (tmp_path / "b.txt").write_text("fine")
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "d.pdf").write_text("not a pdf")
    (tmp_path / "e.txt").write_text("")
    f = S.binary(spark, str(tmp_path))
    assert S.accept(f, spark.createDataFrame([], "content_hash string")).count() == 1
    known = f.select(F.sha2("content", 256).alias("content_hash")).filter(F.col("content_hash").isNotNull())
    assert S.accept(f, known).count() == 0


def test_terms_keep_tags_and_references(spark):
    from strandline.functions.terms import Terms, tag_of

    of = Terms()
    assert of("Pump P-101B, P 101 B and the 101 b; see SOP-4412 of 10LAC20AP001") == ["pump", "p-101b", "p-101b", "101", "see", "sop-4412", "10lac20ap001"]
    assert of("PIC 101 trips; it 42 classes of bus") == ["pic-101", "trip", "42", "classe", "bus"]
    assert of(None) == of("") == of(" -- ") == []
    surfaces = ["P-101B", "p_101_b", "Pump-0101-B", "HX/204", "PIC-101", "10LAC20AP001", '6"-P-1501-A1A', "the-B-pump", "Ｐ－101B", "2024-01-02", "10-P-101-B", "CDU1-P-101", "TK-201", "101", "XQ9"]
    t = T.with_tag(spark.createDataFrame([(s,) for s in surfaces], "surface string"), "surface", "t")
    for r in t.select("surface", "t.kind", T.canonical(F.col("t")).alias("c")).collect():
        assert tag_of(r["surface"]) == (None if r["kind"] == "unparsed" else r["c"]), r["surface"]


def test_supersession_is_by_level(spark):
    rows = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 20), ("s", 4, 30), ("s", 5, 30), ("x", 6, None)], "series string, id long, day int")
    got = {r["id"]: (r["superseded_by"], r["valid_to"], r["is_current"]) for r in R.supersede(rows, "series", "id", "day").collect()}
    assert got == {1: (3, 20, False), 2: (3, 20, False), 3: (4, 30, False), 4: (None, None, True), 5: (None, None, True), 6: (None, None, True)}


def test_quotes_anywhere_in_a_text(spark, monkeypatch):
    from strandline.operators import documents

    docs = spark.createDataFrame([(1, "He said two plus\n two is FOUR."), (2, "two plus"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "plus two is fo"), (8, "two plus"), (9, ""), (10, None), (11, "e"), (8, "two  plus")], "item_id long, text string")
    want = {(1, 7), (1, 8), (2, 8), (1, 11)}
    for size in (4 << 20, 5):
        monkeypatch.setattr(documents, "QUOTE_BYTES", size)
        got = [tuple(r) for r in documents.quoted(docs, "doc_id", "text", items, "item_id", "text").collect()]
        assert set(got) == want and len(got) == len(want)


def test_cleaned_fields(spark):
    from strandline.functions import extract as E

    row = spark.range(1).select(
        E.safe_filename(F.lit("C:\\a\\..\\b?:<x>.pdf .")).alias("a"), E.safe_filename(F.lit("../..")).alias("b"), E.status(F.lit(" moderate -- 22 hours")).alias("c"), E.status(F.lit(" , x")).alias("d"),
        E.title(F.lit(None), F.lit("my_file-2.tar.gz")).alias("e"), E.expanded(F.lit("WO: vib/temp, s/d. pump")).alias("f"), E.without_fence(F.lit("```json\n{}\n```")).alias("g"),
        F.array_join(E.references(F.lit("SOP4412, wo 12, OISD-STD-105; XSOP-1 API a")), "|").alias("h"), E.first_date(F.lit("x"), F.lit("31/02/2024 and 5 Mar 2021")).cast("string").alias("i"),
    ).first()
    assert tuple(row) == ("bx.pdf", "unnamed", "MODERATE", None, "my file 2.tar", "work order: vib/temp, shutdown. pump", "{}", "SOP-4412|OISD-STD-105", "2021-03-05")


def test_siblings_of_one_group_are_dealt_over_tasks(spark):
    rows = spark.range(0, 2100, 1, 1).select("id", F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))
    got = R.siblings(rows, "id", ["a", "b"])
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2100 * 2099 and max(sizes) < 0.7 * sum(sizes)


def test_siblings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "SIBLING_BLOCK", 3)
    data = [(i, None if i % 5 == 0 else f"k{i % 4}", None if i % 3 == 0 else i % 2) for i in range(60)] + [(None, "k1", 1), (7, "k1", 0), (7, "k3", 1)]
    got = sorted(tuple(r) for r in R.siblings(spark.createDataFrame(data, "id long, a string, b long"), "id", ["a", "b"]).collect())
    assert got == sorted((x[0], y[0]) for x in data for y in data if x[1:] == y[1:] and None not in (x[0], y[0]) and x[0] != y[0])


def test_numbers_in_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(R, "NUMBERED_ROWS", 40)
    data = [(None if i % 11 == 0 else "ab"[i % 2], None if i % 7 == 0 else i % 13, i // 2, "x") for i in range(500)]
    rows = spark.createDataFrame(data, "k string, on int, id long, v string").repartition(5)
    got = R.numbered(rows, "k", [F.col("on").asc_nulls_last(), F.col("id")], "place", ["id", "on", "k"])
    want = []
    for k in (None, "a", "b"):
        mine = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want += [(r[2], r[1], k, n + 1) for n, r in enumerate(mine)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_timeline_sorts_no_kind_in_one_task(spark):
    from conftest import SF_DIR

    from strandline.plans import records

    plan = records.timeline_nulls_last(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # a window over a kind would sort all its rows in one task


def test_document_types_in_one_walk(spark):
    from strandline.functions import vocab as V
    from strandline.operators.documents import classify

    def plain(text):
        low, rated = (text or "").lower(), []
        for n, (kind, weight, phrases) in enumerate(V.KEYWORD_RULES):
            at = min((low.find(p) + 1 for p in phrases if p in low), default=None)
            rated.append((0.0 if at is None else weight if at <= V.TITLE_WINDOW else weight * V.REFERENCE_PENALTY, -n, kind))
        best = max(rated)
        return best[2] if best[0] > 0 else "unknown"

    every = [p for _, _, phrases in V.KEYWORD_RULES for p in phrases]
    texts = [None, "", "é" * 5 + "Work Order No", "x" * 599 + "hazop", "x" * 600 + "hazop", "x" * 600 + "HAZOP and p&id", "İ" * 599 + "moc no", *every, *(f"{'é' * 595}{a}. {b}" for a, b in zip(every, every[7:]))]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", classify(F.col("t")).alias("k"))
    assert {r["n"]: r["k"] for r in rows.collect()} == {n: plain(t) for n, t in enumerate(texts)}
    assert rows._jdf.queryExecution().executedPlan().toString().count("instr(") == 0


def _most_rows(frame):
    """The most rows that any step of the plan made, from the metrics of the last run."""
    frame.collect()
    todo, most = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_two_routes_over_a_common_part(spark):
    # Every line names part 1: as many pairs by part as lines times suppliers.
    links = spark.range(2000).select((F.col("id") % 40).alias("s"), F.lit(1).alias("p"), F.col("id").alias("o"))
    got = R.two_routes(links, "s", "p", "o", 30)
    assert _most_rows(got) <= 4000
    assert {(r["s"], r["o"], r["route"], r["mentions"]) for r in got.collect()} == {(s, s + 40 * n, 0, 1) for s in range(40) for n in range(30)}


def test_two_routes_against_a_plain_count(spark):
    import random
    from collections import Counter

    rnd = random.Random(3)
    pick = lambda n: rnd.choice([None, *range(n)])
    data = [(pick(4) if rnd.random() < 0.7 else rnd.randrange(4, 40), pick(9), pick(60)) for _ in range(700)]
    direct, parts = Counter((s, o) for s, _, o in data), {(s, p) for s, p, _ in data}
    via = Counter((s, o) for s, p in parts for _, q, o in data if p is not None and p == q)
    for k in (1, 20, 30, 50):
        want = []
        for s in {s for s, _ in via | direct}:
            rated = sorted((0 if x in direct else 1, -max(direct[x], via[x]), x[1] is not None, x[1] or 0) for x in via | direct if x[0] == s)
            want += [(s, o if there else None, route, -n) for route, n, there, o in rated[:k]]
        got = R.two_routes(spark.createDataFrame(data, "s long, p long, o long"), "s", "p", "o", k).select("s", "o", "route", "mentions")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_terms_remember_a_bounded_number_of_bytes():
    from strandline.functions import terms

    of = terms.Terms()
    words = [f"w{'abcdefghij'[i % 10]}x{i:06d}" for i in range(300_000)] + ["y" * 4_000_000 + str(i) for i in range(9)]
    most = 0
    for n in range(0, len(words), 1000):
        part = words[n : n + 1000]
        assert of(" ".join(part)) == [terms.term_of(w) for w in part if terms.term_of(w)]
        most = max(most, sum(2 * len(w) + terms.PIECE_BYTES for d in (of.known, getattr(of, "older", {})) for w in d) if n % 20_000 == 0 or n >= 299_000 else 0)
    assert most <= terms.CACHE_BYTES + 2 * 8_000_500


def test_listed_terms_leave_a_worker_in_slices():
    import pyarrow as pa

    texts = [f"alpha beta{i % 7} gamma " * 40 for i in range(5000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = list(Q._listed(None)(iter([batch])))
    assert len(out) > 3 and sum(b.num_rows for b in out) == len(texts)
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in got] == list(range(len(texts))) and got[3] == {"id": 3, "length": 120, "terms": ["alpha", "beta3", "gamma"], "tf": [40, 40, 40]} and got[-1]["length"] == 0
