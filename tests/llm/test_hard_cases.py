"""Plain versions of the operators against the operators, and the cases that once lost data."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard_join, packing, textkit, tokens, toxicity, warc


def plain_items(text, items):
    """(item number, fewest edits) by a plain scan: an alignment of every item with the whole normalised text."""
    norm = lambda t: re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (t or "").encode().lower()).strip(b" ")
    text, out = norm(text), []
    for k, item in enumerate(items):
        item = norm(item)
        if not item:
            continue
        if len(item) < 24:
            if b" " + item + b" " in b" " + text + b" ":
                out.append((k, 0))
            continue
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        if min(row) <= len(item) // 10:
            out.append((k, min(row)))
    return out


def test_decontamination_against_a_plain_scan(spark, monkeypatch):
    rng = random.Random(11)
    words = ["stone", "river", "the", "of", "quick", "metal", "a", "seventeen", "owl"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = ["what is two plus two?", "owl", "a a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "... !", *(make(n) for n in (4, 5, 6, 7, 8, 8, 9, 10, 12, 14, 20))]
    items += [x[:n] for x, n in ((make(12), 24), (make(12), 29), (make(12), 30), (make(12), 31), (make(12), 39), (make(12), 40), (make(12), 41))]
    texts = [None, "", "What is two plus  two", "whatis two plus two", "a" * 90, "growl", "Owl!"]
    for _ in range(70):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 1 + len(item) // 9)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["x"], [item[at], "y"]])
        texts.append(f"{make(rng.randint(0, 9))} {''.join(item)} {make(rng.randint(0, 9))}")
    want = {(i, k): e for i, t in enumerate(texts) for k, e in plain_items(t, items)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and {len(items[k]) < 24 for _, k in want} == {True, False}
    # many blocks, in several passes, and shared q-grams in many pieces
    found = {i for i, _ in want}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - found
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    all_items = decontaminate.Items(list(range(len(items))), items)
    assert {(i, all_items.ids[k]): e for i, k, e, *_ in decontaminate.search(all_items, pa.array(texts))} == want


def test_decontamination_of_a_repetitive_text():
    items = decontaminate.Items([1, 2], ["a" * 300, "b" * 40])
    assert [x[:3] for x in decontaminate.search(items, pa.array(["a" * 60_000]))] == [(0, 0, 0)]


def test_special_token_strings_get_the_library_ids(spark):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["abc <|startoftext|> def <|endoftext|> x", "a<|endoftext|>b é<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "plain", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.ChunkTokenizer(path).packed(pa.array(texts))] == want
    out = packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["length"] for r in out} == {i: len(x) + 1 for i, x in enumerate(want)}


def test_warc_repeated_and_null_ids_with_different_payloads(spark, tmp_path):
    one, two = "first payload " * 900, "second payload " * 900
    pages = [(1, one), (1, two), (None, one + "x"), (None, two + "x"), (7, one), (1, one), (None, "short"), (None, "brief"), (8, "m" * 1_500_000)]
    rows = spark.createDataFrame(pages, "page_id long, html string").withColumns({"payload": F.col("html").cast("binary"), "url": F.lit("u"), "digest": F.lit(1), "first": F.lit(2)})
    warc.write(rows, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert not any(r["error"] for r in got)
    want = collections.Counter((str(i), t) for i, t in pages if i != 7)
    assert collections.Counter((r["row"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response") == want
    [other] = [r for r in got if r["record_type"] == "revisit"]
    assert (other["row"], other["refers_row"], other["payload_bytes"]) == ("7", "1", len(one))
    warc.write(rows.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def plain_chain(rows, folds):
    """(threshold, probabilities of the rows) by dictionaries and dense matrices; rows: (features, labels)."""
    n, many = len(rows), len(rows[0][1])
    y = np.array([r[1] for r in rows], float)
    fold = np.arange(n) % folds

    def best(train, target):
        p, value = target[train].mean(), {}
        for w in set().union(*(rows[i][0] for i in np.flatnonzero(train))):
            has = np.array([w in rows[i][0] for i in np.flatnonzero(train)])
            if has.sum() >= toxicity.LEAST_ROWS:
                expected = has.sum() * p
                value[w] = (target[train][has].sum() - expected) ** 2 / max(expected * (1 - p) * (1 - has.mean()), 1e-9)
        return [w for w, v in value.items() if v > 0]

    def newton(x, t):
        x = np.column_stack((x, np.ones(len(x))))
        b, ridge = np.zeros(x.shape[1]), np.diag([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (t - p) - ridge @ b)
        return b

    earlier = np.zeros((n, 0))
    done = np.zeros((n, 0))
    for c in range(many):
        target, out = y[:, c], np.zeros(n)
        present = lambda k: np.array([[w in r[0] for w in k] for r in rows], float)
        for f in range(folds):
            k = best(fold != f, target)
            x = np.column_stack((present(k), earlier))
            b = newton(x[fold != f], target[fold != f])
            out[fold == f] = (1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))))[fold == f]
        k = best(np.ones(n, bool), target)
        b = newton(np.column_stack((present(k), earlier)), target)
        done = np.column_stack((done, 1 / (1 + np.exp(-(np.column_stack((present(k), done)) @ b[:-1] + b[-1])))))
        earlier = np.column_stack((earlier, out))
    order = np.argsort(-earlier[:, -1], kind="stable")
    p, t = earlier[order, -1], y[order, -1]
    at = int((2 * np.cumsum(t) / (np.arange(n) + 1 + t.sum())).argmax())
    return float(np.clip((p[at] + p[at + 1]) / 2, t.mean() / 4, 0.9)), done


def test_toxicity_against_a_plain_chain(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(90):
        bad, poor = i % 3 == 0, i % 4 == 1
        words = [f"u{i}"]  # in every shingle, so no rows are near copies
        words += [rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(3)] + [f"u{i}"] + [rng.choice(["ff", "gg"]) for _ in range(3)] + [f"u{i}"]
        words += ["dolt"] * (bad and rng.random() < 0.8) + ["junk"] * (poor or rng.random() < 0.1)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(bad)))
    rows = spark.createDataFrame([*docs, docs[3], (500, None), (501, "")], "doc_id long, text string")
    chain = toxicity.fit(rows, spark.createDataFrame([*labels, labels[4]], "doc_id long, quality int, toxic int"), toxicity.default_categories())
    key = dict(spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", F.xxhash64("doc_id")).collect())
    order = sorted(range(90), key=lambda i: key[i])
    at, p = plain_chain([(set(docs[i][1].split()), (1 - labels[i][1], labels[i][2])) for i in order], toxicity.FOLDS)
    got = {r["doc_id"]: (r["_p"], r["_flag"]) for r in toxicity.annotate(rows, chain).collect()}
    assert abs(chain.threshold - at) < 1e-3
    assert all(np.allclose(got[i][0], p[n], atol=1e-3) and got[i][1] == (got[i][0][1] >= chain.threshold) for n, i in enumerate(order))
    assert got[500][0] == got[501][0]


def test_toxicity_sample_is_bounded_when_one_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"dolt number {i} of this") for i in range(60)] + [(2, "kind words only here"), (3, "x " * 600_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.default_categories(), per_class=10)
    assert toxicity.annotate(docs, chain).count() == 62


def test_pipeline_drops_rows_and_not_ids(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "other")
    rows = [(1, "X x"), (2, "X x"), (1, "Y y"), (None, "Z"), (None, "Z"), (3, "Z"), (4, long), (5, near), (5, "alone"), (None, near + " w1"), (6, None), (7, ""), (7, ""), (8, "v " * 700_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, _may string, row int, key string")
    kept = [tuple(r)[:2] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(2, "X x"), (1, "Y y"), (3, "Z"), (4, long), (5, near), (5, "alone"), (None, near + " w1"), (7, None) if (7, None) in kept else (7, ""), (8, "v " * 700_000)], key=str)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = collections.Counter(tuple(r)[:2] for r in out.collect())
    # sets are equal for equal texts, so one row of each group stays, a null id only if there is no other
    assert kept == collections.Counter([(1, "X x"), (1, "Y y"), (3, "Z"), (4, long), (5, "alone"), (6, None), (7, ""), (7, ""), (8, "v " * 700_000)])
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_against_plain_stages(spark):
    """Exact and near copies and leaks of sf0.001 by plain code, on what the toxicity stage keeps; packing of what is left."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    by_text = collections.defaultdict(list)
    for i, t in kept.items():
        by_text[t].append(i)
    left = {max(v): t for t, v in by_text.items()}
    shingles = {}
    for i, t in left.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        shingles[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = shingles[a], shingles[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    firsts = [i for i in ids if find(i) == i]
    items = [r[0] for r in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    column = pa.array([left[i] for i in firsts])
    leaking = {firsts[i] for i, *_ in decontaminate.search(decontaminate.Items(list(range(len(items))), items), column)}
    assert out == set(firsts) - leaking


def test_jaccard_blocks_of_one_large_group_that_is_not_one_component(spark, monkeypatch):
    from strandline.llm import jaccard_join
    from test_llm import brute_components

    rng = random.Random(21)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4, 5, 6, 7])):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    for block, few in ((1024, 8), (5, 1)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "FEW", few)
        got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_components(docs)
    assert len({r["component_id"] for r in got}) > 3


def test_jaccard_of_very_long_texts(spark):
    from strandline.llm import jaccard_join
    from test_llm import brute_components

    long = " ".join(f"w{i}" for i in range(200_000))
    docs = [(1, long), (2, long.replace("w777 ", "z ")), (3, long[: len(long) // 2]), (4, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(docs)


def test_workers_give_up_what_another_stage_kept():
    rows = pa.record_batch([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    list(textkit.thrifty(packing._pieces("word_bpe_49k.json", 1, 4096), keeps=True)([rows]))
    assert tokens._TOKENIZERS
    list(textkit.thrifty(jaccard_join._describe)([rows]))
    assert not tokens._TOKENIZERS


def test_signatures_are_sent_before_they_fill_a_worker():
    texts = pa.array([" ".join(f"w{(i * 977 + j) % 50021}" for j in range(400)) for i in range(3000)])
    blobs = list(jaccard_join._blobs(1, 80, 100)([pa.record_batch([texts], names=["text"])]))
    sizes = [len(x) // 8 for b in blobs for x in b.column("nodes").to_pylist()]
    assert sum(sizes) > 500_000
    assert max(sizes) < 500_000


def test_tokenizer_learns_a_word_once_whatever_its_case(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "CACHE", 40)
    rng = random.Random(5)
    texts = ["Bearing BEARING bearing", "J̌ ǰ ǰ İ İ ÉtÉ's ½²x ªµº×÷ a­.b a b ’s", "<|endoftext|> <|ENDOFTEXT|>"]
    texts += [" ".join("".join(map(chr, rng.choices([*range(0x21, 0x7F), *range(0xA1, 0x100)], k=rng.randint(1, 6)))) for _ in range(5)) + " Bearing" for _ in range(200)]
    met, t = [], tokens.ChunkTokenizer(path)
    learn = t.known.learn
    t.known.learn = lambda chunk: met.append(chunk) or learn(chunk)
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in t.packed(pa.array(texts))] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x for x in met if x.lower() == b"bearing"] == [b"bearing"]
    assert len(t.known) + len(t.known.older) < 60
