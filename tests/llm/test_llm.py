"""Training-data operators against brute force, round trips and held-out accuracy, with the odd cases."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing, ppm, tokens, toxicity, training_order, unigram_counts, warc
from strandline.llm.components import components

ODD = [
    (1, "a b c d e f g"), (2, "A b  c\td e f g"), (3, None), (4, ""), (5, "  \n "), (6, "one two"), (7, "ONE two"), (7, "ONE two"), (None, "a b c d e f g"), (9, "x" * 20000),
    (10, "wort " * 3000), (11, "ü ö ä ß"),
]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use inside."""
    rows = spark.createDataFrame([(i, t, "en", 1) for i, t in ODD], "doc_id long, text string, lang string, node int")
    return rows.withColumns({"score": F.lit(1), "_may": F.lit(True), "length": F.lit(0)})


def empty(spark):
    return odd(spark).limit(0)


def test_exact_dedup(spark):
    got = exact_dedup.exact_duplicates(odd(spark), digests=True).collect()
    texts = collections.defaultdict(list)
    for i, t in ODD:
        texts[t or ""].append(i)
    assert len(got) == len(ODD)
    for r in got:
        group = next(v for v in texts.values() if r["doc_id"] in v and len(v) == r["group_size"])
        assert r["keep_id"] == max(x for x in group if x is not None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), least.get(find(i), d)) for i, (d, x) in enumerate(sets)), key=str)


def test_jaccard_components(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 30)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(changed)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(docs)


def test_jaccard_odd_cases(spark):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(odd(spark)).collect()), key=str)
    assert got == brute_components(ODD)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [4, 6, 9, 12, 17, 21, 30, 60, 200])
def test_partenum_loses_no_link(size):
    rng = np.random.default_rng(size)
    schemes = jaccard_join.Schemes(80, 100)
    for _ in range(150):
        x = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
        same = int(np.ceil(0.8 * len(x)))
        both = x[:same]
        extra = rng.integers(1, 2**63, max(0, int(same / 0.8) - len(x))).astype(np.uint64)
        y = np.unique(np.concatenate((both, extra)))
        inter = len(np.intersect1d(x, y))
        if 100 * inter < 80 * (len(x) + len(y) - inter) or np.array_equal(x, y):
            continue
        sig, owner = jaccard_join.signatures([x, y], schemes)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_ppm_against_plain_trie(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "thin", "onion", "und", "Ätna", "x1"]) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(40, None), (41, " \n"), (42, "zz qq?!")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    got = {r["doc_id"]: r for r in ppm.ppm_scores(rows, train).collect()}
    model, count = ppm.AdaptivePPM(), collections.Counter()
    for d, t in docs:
        if d % 5 != 1:
            model.train(t)
            count.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(count.values()), len(count)
    for d, t in docs:
        words = [*(t or "").encode().lower().split(), "end"]
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), abs_tol=1e-6)
        assert math.isclose(r["score"], model.score(t, learn=False), abs_tol=1e-2)


def test_ppm_probabilities_sum_to_one():
    model = ppm.AdaptivePPM(order=2)
    model.train("abra cadabra abra")
    for history in (b"  ", b"br", b"zz", b"ra"):
        assert math.isclose(sum(model.probability(history, s) for s in range(257)), 1, rel_tol=1e-9)


def test_ppm_odd_cases(spark):
    assert ppm.ppm_scores(odd(spark), F.lit(True)).count() == len(ODD)
    assert ppm.ppm_scores(odd(spark), F.lit(False)).filter("train_tokens = 0").count() == len(ODD)
    assert ppm.ppm_scores(empty(spark), F.lit(True)).count() == 0
    few = odd(spark).filter("doc_id = 6")
    got = ppm.ppm_scores(few, F.lit(True), mode="adaptive").first()
    assert math.isclose(got["score"], ppm.AdaptivePPM().score("one two"), abs_tol=1e-9)


def test_lower_order_when_the_trie_is_too_large(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(ppm, "MAX_GRAMS", 60)
    low = ppm.ppm_scores(docs, F.lit(True)).agg(F.sum("score")).first()[0]
    monkeypatch.undo()
    assert low < ppm.ppm_scores(docs, F.lit(True)).agg(F.sum("score")).first()[0] < 0


def test_whole_mode_keeps_the_order_when_the_trie_is_cut_into_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of many \u00e4pfel") for i in range(30)] + [(30, None), (31, "qq zz"), (32, "text number 3 of many \u00e4pfel")], "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    score = lambda: {r["doc_id"]: r["score"] for r in ppm.ppm_scores(docs, train, mode="whole").collect()}
    want = score()
    seen, blocks = [], ppm._blocks
    monkeypatch.setattr(ppm, "MAX_GRAMS", 60)
    monkeypatch.setattr(ppm, "_blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    got = score()
    assert seen[0][1] > 2
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in want)
    monkeypatch.setattr(ppm, "ppm_scores", lambda *a, mode="pretrained", **b: docs.select("doc_id", F.lit(True).alias("train"), *(F.lit(mode).alias(x) for x in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))))
    assert ppm.op2_ppm_scores(spark, "/root/testdata/sf0.001").first()["score"] == "whole"


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(rng.randint(5, 60))]
        bad, poor = i % 6 == 0, i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "dolt", "wretchedly"])
        if poor:
            words.append("junk")
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(not poor), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.default_categories())
    got = {r["doc_id"]: r["_flag"] for r in toxicity.annotate(docs, chain).collect()}
    assert sum(got[i] != (i % 6 == 0) for i in range(400, 600)) <= 2


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd(spark), labels, toxicity.default_categories())
    out = toxicity.annotate(odd(spark), chain)
    assert out.count() == len(ODD) and out.filter("_flag").count() == 0
    assert out.columns[: len(odd(spark).columns)] == odd(spark).columns
    none = toxicity.fit(empty(spark), labels.limit(0), toxicity.default_categories())
    assert toxicity.annotate(empty(spark), none).count() == 0


ITEM = "The quick onyx goblin jumps over the lazy dwarf while seventeen wizards, quite bored, chant hymns of olden days."


def test_decontamination(spark):
    rng = random.Random(4)
    filler = " ".join(rng.choice(["stone", "water", "metal", "paper", "cloud"]) for _ in range(300))
    edited = ITEM.replace("goblin", "gobln").replace("wizards, quite", "wizards  quite").upper()
    docs = [(1, filler[:700] + " " + ITEM + " " + filler[700:]), (2, filler + edited), (3, filler), (4, None), (5, ITEM[: len(ITEM) // 2] + filler), (6, ITEM), (7, "")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "not there"), (13, ITEM)], "item_id long, text string")
    got = decontaminate.leaks(rows, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, i) for d in (1, 2, 6) for i in (10, 13)]
    for r in got:
        found = docs[r["doc_id"] - 1][1].encode()[r["start"] : r["end"]].decode()
        assert r["edits"] <= 0.1 * len(ITEM) and abs(len(found) - len(ITEM)) <= 14
    assert {r["doc_id"] for r in decontaminate.clean(rows, bench).collect()} == {3, 4, 5, 7}
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(odd(spark), bench.limit(0)).count() == 0
    assert decontaminate.clean(odd(spark), bench).count() == len(ODD)


def test_alignment_against_plain_distance():
    rng = random.Random(1)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(60):
        p, t = ([rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(2))
        [(d, _)] = decontaminate.align([np.array(p)], [np.array(t)], [-len(p)], len(p) + len(t) + 1)
        assert d == plain(p, t)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        slots = training_order.feistel(np.arange(n), n, 9)
        assert sorted(slots) == list(range(n))
        assert (training_order.feistel(slots, n, 9, inverse=True) == np.arange(n)).all()
    assert (training_order.feistel(np.arange(1000), 1000, 9) != training_order.feistel(np.arange(1000), 1000, 10)).any()


def test_training_order_round_trip(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    byte_ids = lambda t: [*(t or "").encode(), 255]
    word_ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    monkeypatch.setattr(training_order, "GATHER", 20_000)
    monkeypatch.setattr(training_order, "TASKS", 7)
    docs = odd(spark).unionByName(spark.createDataFrame([(20, "long " * 250_000)], "doc_id long, text string"), allowMissingColumns=True)
    rows_in = [*ODD, (20, "long " * 250_000)]
    for vocab, encode, kind in (("bytes", byte_ids, np.uint8), ("word_bpe_49k.json", word_ids, np.uint16)):
        path = str(tmp_path / vocab)
        n = training_order.write(docs, path, vocab=vocab, length=16, rows=5000)
        back = training_order.read(spark, path, vocab=vocab, length=16, rows=5000).collect()
        want = collections.Counter()
        for i, t in rows_in:
            ids = encode(t)
            for k, at in enumerate(range(0, len(ids), 16)):
                part = ids[at : at + 16]
                want[i, k, tuple(part), len(part)] += 1
        assert collections.Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], kind)[: r["used"]].tolist()), r["used"]) for r in back) == want
        assert sorted(r["slot"] for r in back) == list(range(n)) and n == sum(want.values())
        # the place of a sequence is its permuted number, and resuming opens the last shards only
        resumed = training_order.read(spark, path, start=n - 7, vocab=vocab, length=16, rows=5000)
        assert sorted(r["slot"] for r in resumed.collect()) == list(range(n - 7, n))
        plan = resumed._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(shard" in plan
    assert training_order.write(empty(spark), str(tmp_path / "e")) == 0


def test_tokenizer_chunks_match_the_library():
    from tokenizers import Tokenizer

    texts = [t or "" for _, t in ODD] + ["he's I'LL 3.14 <|startoftext|>x ẖH̱ ΣΑΣ 日本語 テスト x y", "ﬁ\x00\x85 a"]
    path = tokens.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = list(tokens.ChunkTokenizer(path).packed(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, capacity=4096):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    out = packing.packed_documents(odd(spark)).collect()
    check_packed(out)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = [*library.encode("a b c d e f g", add_special_tokens=False).ids, 1]
    first = next(r for r in out if r["doc_id"] == 1)
    assert (first["length"], first["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert packing.packed_documents(empty(spark)).count() == 0


def test_packing_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 300)
    rng = random.Random(8)
    sizes = [min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(2500)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "piece_no long, length long")
    out = packing.pack(pieces).join(pieces, "piece_no").collect()
    assert len(out) == len(sizes)
    assert check_packed(out) <= -(-sum(sizes) // 4096) + 2
    big = spark.createDataFrame([(i, 2100) for i in range(1000)], "piece_no long, length long")
    assert check_packed(packing.pack(big).join(big, "piece_no").collect()) == 1000


def test_viterbi_counts_match_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    base = unigram_counts.pieces(tokens.vocabulary("piece_bpe_32k.model"))
    texts = [t or "" for _, t in ODD] + ["  a  b ", "日本語 😀 ▁▁a", "<s> <0x0A>", "thonerin erthed, onanea."]
    for scored in (base, [(p, -math.log(i + 2)) for i, (p, _) in enumerate(base)], [(p, -1.0) for p, _ in base]):
        library = Tokenizer(models.Unigram(scored, unk_id=0, byte_fallback=True))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = unigram_counts.Counter(scored)
        assert [counter.text(t.encode()) for t in texts] == [len(library.encode(t).ids) for t in texts]


def test_token_counts_odd_cases(spark):
    got = unigram_counts.token_counts(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert unigram_counts.token_counts(empty(spark)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "héllo\r\n\r\nWARC/1.1\r\n" * 900), (2, None, "héllo\r\n\r\nWARC/1.1\r\n" * 900), (3, "x", None), (4, "x\ny", ""), (5, "k", "z"), (5, "k", "z"), (None, "q", "z")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.col("html").cast("binary"))
    for segment, chunk in ((4096, 1500), (7, 5)):
        path = str(tmp_path / f"w{segment}")
        warc.write(rows, path, segment=segment, chunk=chunk)
        got = warc.read(spark, path).collect()
        assert len(got) == len(pages) and not any(r["error"] for r in got)
        by = {r["row"]: r for r in got}
        assert (by["1"]["record_type"], by["2"]["record_type"], by["2"]["refers_row"]) == ("response", "revisit", "1")
        assert bytes(by["1"]["payload"]) == pages[0][2].encode() and by["2"]["payload_bytes"] == len(pages[0][2].encode())
        assert (by["4"]["refers_row"], by["None"]["refers_row"]) == ("3", "5")
    warc.write(rows.limit(0), str(tmp_path / "none"))


def test_warc_broken_segments():
    part = lambda n, block, total=None: {"number": n, "block": block, "total": total}
    assert warc.reassemble([part(2, b"cd", 4), part(1, b"ab"), part(2, b"cd", 4)]) == b"abcd"
    for bad in ([part(1, b"ab"), part(3, b"cd", 4)], [part(1, b"ab"), part(2, b"cd", 5)], [part(1, b"ab"), part(2, b"cd")], [part(1, b"ab"), part(1, b"xx"), part(2, b"cd", 4)]):
        with pytest.raises(ValueError):
            warc.reassemble(bad)
    assert warc.unchunk(b"3;ext=1\r\nabc\r\n2\r\nde\r\n0\r\nX: y\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_odd_cases(spark):
    got = language_id.identify(odd(spark), F.lit(False)).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), F.lit(True)).collect()} == {"und"}
    assert language_id.identify(empty(spark), F.lit(False)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    check_packed(rows)
