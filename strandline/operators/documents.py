"""Understanding documents and records: phrases, classes, headers, chunks, resolution."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.functions import tags as T
from strandline.functions import vocab as V
from strandline.functions.text import squash
from strandline.runtime import ship, slices


def failure_terms(text: Column) -> Column:
    """array(phrase) in order of occurrence; longer phrases win where two overlap."""
    phrases = sorted(V.FAILURE_TERMS, key=lambda p: (-len(p), p))
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(" + "|".join(phrases) + ")"), 1)


def best_failure(phrases: Column) -> Column:
    """Code of the surest phrase; the first of equals."""
    codes = F.create_map(*(x for p, (c, s) in V.FAILURE_TERMS.items() for x in (F.lit(p), F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")))))
    rated = F.transform(phrases, lambda p: F.try_element_at(codes, p))
    best = F.aggregate(rated, F.lit(None).cast("struct<s:double,c:string>"), lambda b, x: F.when(b.isNull() | (x["s"] > b["s"]), x).otherwise(b))
    return best["c"]


def coded_against_narrative(coded: Column, found: Column) -> Column:
    """no_text_evidence, recoded, agree or disagree."""
    code = F.upper(F.trim(F.coalesce(coded, F.lit(""))))
    return (
        F.when(found.isNull(), "no_text_evidence")
        .when(code.isin(V.UNINFORMATIVE_CODES), "recoded")
        .when(code.contains(found), "agree")
        .otherwise("disagree")
    )


def cues(text: Column) -> Column:
    """Early signs that a text names, in the order of the vocabulary."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.contains(c), F.lit(c)) for c in V.DEGRADATION_CUES)))


def classify(text: Column, title_window: int = V.TITLE_WINDOW) -> Column:
    """Document type by the heaviest phrase; one outside the title window counts less; none: unknown.

    All phrases are looked for in one walk over a text (Aho-Corasick).
    """
    rules = [(kind, weight, weight * V.REFERENCE_PENALTY) for kind, weight, _ in V.KEYWORD_RULES]
    phrases: dict[str, list[int]] = {}
    for n, (_, _, named) in enumerate(V.KEYWORD_RULES):
        for p in named:
            phrases.setdefault(p, []).append(n)
    built = []

    def heaviest(low: str) -> str:
        first: dict[int, int] = {}
        for end, (size, of) in built[0].iter(low):
            at = end - size + 2  # from 1
            for n in of:
                if at < first.get(n, at + 1):
                    first[n] = at
        rated = [(rules[n][1 if at <= title_window else 2], -n) for n, at in first.items()]
        best = max(rated, default=(0.0, 0))
        return rules[-best[1]][0] if best[0] > 0 else "unknown"

    @F.arrow_udf("string")
    def kinds(texts: pa.Array) -> pa.Array:
        if not built:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p, of in phrases.items():
                automaton.add_word(p, (len(p), of))
            automaton.make_automaton()
            built.append(automaton)
        return pa.array([heaviest(x.as_py()) for x in texts], pa.string())

    return kinds(F.lower(F.coalesce(text, F.lit(""))))


def map_headers(rows: DataFrame) -> DataFrame:
    """Columns under their canonical names, the first spelling that is there; all others in the map ``extra``."""
    have = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in reversed(rows.columns)}
    picked, used = [], set()
    for field, spellings in V.HEADER_SYNONYMS.items():
        found = [have[s] for s in spellings if s in have]
        if found:
            used.add(found[0])
            picked.append(F.nullif(F.trim(F.col(f"`{found[0]}`").cast("string")), F.lit("")).alias(field))
    rest = [c for c in rows.columns if c not in used]
    extra = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*picked, extra.alias("extra"))


def route(cml: Column, thickness: Column, wo: Column, incident: Column) -> Column:
    """Which table a record belongs to."""
    return F.when(cml.isNotNull() | thickness.isNotNull(), "inspection").when(wo.isNotNull(), "work_order").when(incident.isNotNull(), "incident").otherwise("unrouted")


def resolve(mentions: DataFrame, surface: str) -> DataFrame:
    """(surface, canonical, block, action) without regard to order.

    A tag without an item letter is ambiguous where its block holds tags with one.
    Blocks are compared through one row a block, never pairwise.
    """
    tags = T.with_tag(mentions.select(F.col(surface).alias("surface")).distinct(), "surface")
    tags = tags.select("surface", T.canonical(F.col("tag")).alias("canonical"), T.blocking_key(F.col("tag")).alias("block"), F.col("tag.suffix").alias("suffix"), F.col("tag.kind").alias("kind"))
    blocks = tags.groupBy("block").agg(F.countDistinct("canonical").alias("members"), F.countDistinct("suffix").alias("letters"))
    action = (
        F.when((F.col("kind") == "equipment") & F.col("suffix").isNull() & (F.col("letters") > 0), "needs_review")
        .when(F.col("letters") > 1, "link_sibling")
        .when(F.col("kind") == "unparsed", "separate")
        .otherwise("merge")
    )
    return tags.join(blocks, "block").select("surface", "canonical", "block", action.alias("action"))


def sibling_pairs(canonicals: DataFrame, canonical: str) -> DataFrame:
    """(a, b): tags of one block with different item letters, each pair once."""
    t = T.with_tag(canonicals.select(F.col(canonical).alias("a")).distinct(), "a").filter("tag.kind = 'equipment' and tag.suffix is not null")
    t = t.select("a", T.blocking_key(F.col("tag")).alias("block"))
    return t.join(t.withColumnRenamed("a", "b"), "block").filter("a < b").select("a", "b")


def chunks(docs: DataFrame, id_col: str, text_col: str, target: int = V.CHUNK_TARGET, most: int = V.CHUNK_MAX) -> DataFrame:
    """(id, ordinal, chunk): paragraphs gathered up to ``target`` characters; longer ones split at sentences.

    A fold over one text at a time; texts stay in their task.
    """
    ship(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for t in slices(batches, 1):
            ids, places, found = [], [], []
            for i, text in zip(t.column(0), t.column(1), strict=True):
                own = split_text(text.as_py() or "", target, most)
                ids += [i.as_py()] * len(own)
                places += range(len(own))
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["id", "ordinal", "chunk"])

    return out.mapInArrow(run, "id long, ordinal int, chunk string")


def split_text(text: str, target: int, most: int) -> list[str]:
    """Chunks of a text: whole paragraphs while they fit, sentences of paragraphs that don't."""
    import re

    units: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n|\n", text)):
        if len(p) > most:
            units += [s for s in re.split(r"(?<=[.!?])\s+", p) if s]
        elif p:
            units.append(p)
    out, held = [], ""
    for u in units:
        if held and len(held) + 1 + len(u) > target:
            out.append(held)
            held = u
        else:
            held = f"{held}\n{u}" if held else u
    return [*out, held] if held else out


def record_chunks(rows: DataFrame, fields: list[tuple[str, str]]) -> Column:
    """One summary sentence of a record: the fields that have a value, verbatim, in a fixed order."""
    return F.concat_ws("; ", *(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in fields))


def locate(text: Column, quote: Column) -> Column:
    """0-based place of a quote, in the text as it is or else in the squashed one; null if it is not there."""
    exact, loose = F.instr(text, quote) if isinstance(quote, str) else F.locate(quote, text), F.locate(squash(quote), squash(text))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)


def running_sections(lines: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Carries the last heading of a document forward over its lines."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


#: Bytes of quotes that a worker looks for at a time; more quotes take more passes.
QUOTE_BYTES = 4 << 20


def quoted(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(``id_col``, ``item_col``) of every text that holds a squashed, non-empty quote anywhere, each pair once.

    All quotes of a block are looked for in one walk over a text (Aho-Corasick), so no
    text moves, no key is hot and quotes may start or end inside a word.
    """
    spark = docs.sparkSession
    bodies = docs.select(F.col(id_col).alias("id"), squash(F.col(text_col)).alias("body")).filter("body <> ''")
    quotes = items.select(F.col(item_col).alias("item"), squash(F.col(item_text)).alias("quote")).filter("quote <> ''").distinct()
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}"

    def find(shared):
        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for quote, ids in shared.value.items():
                automaton.add_word(quote, ids)
            automaton.make_automaton()
            for t in batches:
                hits = [(i, item) for i, body in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) for item in sorted({x for _, ids in automaton.iter(body) for x in ids})]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], t.schema[0].type), pa.array([h[1] for h in hits], kind)], names=[id_col, item_col])

        return run

    kind = to_arrow_type(items.schema[item_col].dataType)
    found, block, size = [], {}, 0
    for r in quotes.orderBy("quote", "item").toLocalIterator():
        block.setdefault(r["quote"], []).append(r["item"])
        size += len(r["quote"])
        if size >= QUOTE_BYTES:
            found.append(bodies.mapInArrow(find(spark.sparkContext.broadcast(block)), schema))
            block, size = {}, 0
    if block:
        found.append(bodies.mapInArrow(find(spark.sparkContext.broadcast(block)), schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
