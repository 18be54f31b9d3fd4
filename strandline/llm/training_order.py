"""Training-order materialisation: every sequence at its own place of a keyed permutation.

Texts become token ids with an end id and are cut to sequences of ``LENGTH`` ids,
the last one padded. Ids are written once, as a table, with the number of each text's
first sequence within its task; running totals over tasks (one row a task) number the n
sequences 0 to n - 1. A keyed Feistel network on the smallest even number of bits that
covers n maps number to slot; a result of n or more is mapped again until it is below n
(cycle walking), which makes it a permutation of 0 to n - 1. No sort and no list of slots
is needed, and slot and number follow from each other by the key alone.

Shard k holds slots k * ROWS to (k + 1) * ROWS - 1 in order. A record is 16 bytes
of origin (doc_id, piece, ids in use) and LENGTH ids, so record i starts at byte
i * stride and a reader can resume at any slot. Tasks send compressed blobs by shard;
partitions are ranges of shards, whose bounds are known without sampling. A task builds
and checks its shards one after another, and a shard's size is fixed whatever the input.
Shards lie in folders ``shard=k``, so a reader that starts at a slot lists and opens
only the folders from that slot's shard on.

Ids are those of ``tokens`` for a vocabulary name or path, in two or four bytes; ``bytes``
is the byte-level vocabulary, one byte an id (UTF-8 never contains 254 and 255, which pad
and end).

Cases: null and empty texts are one sequence, the end id alone. Rows that repeat
are sequences of their own, as are rows without an id. A very long text is many
sequences of one row. An empty table writes no shard. Further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.textkit import U64, mix, texts
from strandline.llm.tokens import chunk_tokenizer, forget, vocabulary
from strandline.runtime import drop_shared, shared_path, shared_table, ship

LENGTH = 512
#: Vocabulary of the query, and the end and padding ids of all vocabularies but ``bytes``.
VOCAB, VOCAB_END, VOCAB_PAD = "word_bpe_49k.json", 1, 0
#: Records of a shard: 8.5 MB at two bytes an id.
ROWS = 8192
#: Tasks that build shards, about, once there are as many shards.
TASKS = 4096
ROUNDS = 6
KEY = 20240229
PAD, END = 254, 255
#: Bytes of sequences that a map task gathers before it sends blobs.
GATHER = 1 << 23


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 to n - 1 that ``key`` stands for, applied to ``x``."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(key))
    out = np.asarray(x).astype(U64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> shift, v & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (mix(left + k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def _id_type(vocab: str) -> np.dtype:
    if vocab == "bytes":
        return np.dtype("u1")
    size = chunk_tokenizer(vocab if "/" in vocab else vocabulary(vocab)).tokenizer.get_vocab_size()
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _encoded(column, vocab: str):
    """Ids of every text with the end id."""
    if vocab == "bytes":
        offsets, raw = texts(column)
        for i in range(len(offsets) - 1):
            ids = np.empty(int(offsets[i + 1] - offsets[i]) + 1, np.uint8)
            ids[:-1] = raw[offsets[i] : offsets[i + 1]]
            ids[-1] = END
            yield ids
    else:
        kind = _id_type(vocab)
        for packed in chunk_tokenizer(vocab if "/" in vocab else vocabulary(vocab)).packed(column):
            yield np.append(np.frombuffer(packed, "<u4"), VOCAB_END).astype(kind)


_IDS_SQL = "part int, number long, doc_id long, ids binary"
_IDS = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _ids(vocab: str, length: int):
    """Ids of every text, the task, and the number of the text's first sequence within the task."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for t in batches:
            rows, held = [], 0
            for doc, ids in zip(t.column("doc_id").to_pylist(), _encoded(t.column("text"), vocab), strict=True):
                rows.append((part, number, doc, ids.tobytes()))
                number += -(-len(ids) // length)
                held += ids.nbytes
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _IDS, strict=True)], schema=_IDS)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _IDS, strict=True)], schema=_IDS)

    return run


_SENT_SQL = "shard long, slots binary, records binary"
_SENT = pa.schema([("shard", pa.int64()), ("slots", pa.binary()), ("records", pa.binary())])


def record_type(vocab: str, length: int) -> np.dtype:
    """One record: its origin, then ``length`` ids. A null doc_id has ``used`` below zero."""
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("used", "<i4"), ("ids", _id_type(vocab), (length,))])


def _send(vocab: str, length: int, rows: int, n: int, key: int):
    """Compressed records by shard, from rows (number, doc_id, ids)."""
    kind = record_type(vocab, length)

    def run(batches):
        forget()  # the worker may have tokenized before; ids need no words
        squeeze = zstandard.ZstdCompressor(5).compress
        pad = PAD if vocab == "bytes" else VOCAB_PAD
        held, size = [], 0

        def flush():
            block = np.concatenate([x for _, x in held])
            slots = feistel(np.concatenate([np.arange(at, at + len(x)) for at, x in held]), n, key)
            order = np.argsort(slots)
            block, slots = block[order], slots[order]
            shard = slots // rows
            start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            end = np.concatenate((start[1:], [len(shard)]))
            for at in range(0, len(start), 64):
                spans = list(zip(start[at : at + 64], end[at : at + 64], strict=True))
                pack = lambda x: pa.array([squeeze(x[i:j].tobytes()) for i, j in spans], pa.binary())
                yield pa.record_batch([pa.array([int(shard[i]) for i, _ in spans], pa.int64()), pack(slots), pack(block)], schema=_SENT)

        for t in batches:
            for number, doc, packed in zip(t.column("number").to_pylist(), t.column("doc_id").to_pylist(), t.column("ids"), strict=True):
                ids = np.frombuffer(packed.as_buffer(), kind["ids"].base)
                many = -(-len(ids) // length)
                block = np.zeros(many, kind)
                block["doc_id"] = 0 if doc is None else doc
                block["piece"] = np.arange(many)
                block["used"] = length
                block["used"][-1] = len(ids) - (many - 1) * length
                if doc is None:
                    block["used"] *= -1
                padded = np.full(many * length, pad, ids.dtype)
                padded[: len(ids)] = ids
                block["ids"] = padded.reshape(many, length)
                held.append((number, block))
                size += block.nbytes
                if size > GATHER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _shards(rows: int, n: int, stride: int):
    """Whole shards from rows in the order of their shards."""
    schema = pa.schema([("shard", pa.int64()), ("value", pa.binary())])

    def build(shard: int, held: list[tuple[bytes, bytes]]):
        slots, records = (np.frombuffer(b"".join(zstandard.decompress(x[k]) for x in held), kind) for k, kind in ((0, np.int64), (1, np.uint8)))
        order = np.argsort(slots)
        want = min(rows, n - shard * rows)
        if len(slots) != want or (slots[order] != np.arange(shard * rows, shard * rows + want)).any():
            raise RuntimeError(f"shard {shard} has {len(slots)} records for {want} slots")
        return pa.record_batch([pa.array([shard], pa.int64()), pa.array([records.reshape(-1, stride)[order].tobytes()], pa.binary())], schema=schema)

    def run(batches):
        forget()
        now, held = None, []
        for t in batches:
            for shard, *blobs in zip(*(t.column(c).to_pylist() for c in ("shard", "slots", "records")), strict=True):
                if held and shard != now:
                    yield build(now, held)
                    held = []
                now = shard
                held.append(blobs)
        if held:
            yield build(now, held)

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, length: int = LENGTH, rows: int = ROWS, key: int = KEY) -> int:
    """Write shards below ``path``, one folder ``shard=k`` each; returns the number of sequences."""
    spark = docs.sparkSession
    ship(spark)
    texts_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = shared_table(texts_.mapInArrow(_ids(vocab, length), _IDS_SQL), "training-ids", "zstd")
    width = _id_type(vocab).itemsize
    counts = ids.groupBy("part").agg(F.sum(F.ceil(F.octet_length("ids") / (width * length))).alias("n"))
    # one row for each task that wrote ids, whatever the texts
    firsts = shared_table(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), "n"), "training-firsts")
    n = firsts.agg(F.sum("n")).first()[0]
    if not n:
        return 0
    numbered = ids.join(F.broadcast(firsts.select("part", "before")), "part").select((F.col("number") + F.col("before")).alias("number"), "doc_id", "ids")
    sent = numbered.mapInArrow(_send(vocab, length, rows, n, key), _SENT_SQL)
    shards = -(-n // rows)
    each = -(-shards // min(shards, TASKS))
    ranged = sent.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")
    built = ranged.mapInArrow(_shards(rows, n, record_type(vocab, length).itemsize), "shard long, value binary")
    # The text sink writes the bytes of a row as they are, and a line feed after the last record.
    built.select("shard", F.col("value").cast("string")).write.partitionBy("shard").text(path)
    drop_shared(ids)
    drop_shared(firsts)
    return n


def read(spark, path: str, start: int = 0, vocab: str = VOCAB, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """slot, doc_id, piece, used, ids (binary) of the stored records from slot ``start`` on.

    Only the folders of shards at or behind ``start`` are listed and opened, by a filter on
    the partition column; rows of a shard come in slot order.
    """
    ship(spark)
    kind = record_type(vocab, length)
    schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("used", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        for t in batches:
            for shard, content in zip(t.column("shard").to_pylist(), t.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                records = data[: len(data) // kind.itemsize * kind.itemsize].view(kind)
                lo = max(0, start - shard * rows)
                for at in range(lo, len(records), 4096):
                    r = records[at : at + 4096]
                    null = r["used"] < 0
                    width = kind["ids"].itemsize
                    packed = np.ascontiguousarray(r["ids"]).tobytes()
                    yield pa.record_batch(
                        [
                            pa.array(np.arange(shard * rows + at, shard * rows + at + len(r))), pa.array(r["doc_id"].copy(), mask=null), pa.array(r["piece"].copy()),
                            pa.array(np.abs(r["used"])), pa.array([packed[i * width : (i + 1) * width] for i in range(len(r))], pa.binary()),
                        ],
                        schema=schema,
                    )

    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # nothing was written
        return spark.createDataFrame([], "slot long, doc_id long, piece int, used int, ids binary")
    files = files.filter(F.col("shard") >= start // rows).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "slot long, doc_id long, piece int, used int, ids binary")


def op5_training_order(spark, sf_dir: str) -> DataFrame:
    """Write all of ``documents`` in training order and describe every stored record."""
    path = shared_path(spark, "training-order")
    n = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    if not n:
        return spark.createDataFrame([], "doc_id long, piece int, length int, slot long, shard long, byte_offset long, ids_crc32 long")
    size = record_type(VOCAB, LENGTH).itemsize
    return read(spark, path).select(
        "doc_id", "piece", F.col("used").alias("length"), "slot", F.floor(F.col("slot") / ROWS).alias("shard"),
        (F.col("slot") % ROWS * size).alias("byte_offset"), F.crc32("ids").alias("ids_crc32"),
    )
