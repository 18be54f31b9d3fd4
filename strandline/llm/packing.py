"""Best-fit packing of token sequences in rounds of a tree.

Pieces are dealt to tasks; each task packs its own by best fit, longest first.
Bins that are nearly full are final. The others go on as single items, whose
length is what they hold, to a round with as many fewer tasks as they need, until
one task packs the last of them. If a round has lowered the number of unfinished
bins by less than a fiftieth, the next is the last, with as many tasks: then
lengths allow no better fit (all over half a bin, say). Only ids and lengths
move; an item carries the list of its pieces, at most one a token of capacity.

Cases: a piece of length zero is packed like any other and takes no room. Pieces
over the capacity are refused; ``pieces_of`` cuts texts first. Rows that repeat a
doc_id are separate pieces. An empty table gives an empty result. Null texts are
empty: the end token alone. Further columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textkit import give_up, thrifty
from strandline.llm.tokens import chunk_tokenizer, vocabulary
from strandline.runtime import shared_table, ship

CAPACITY = 4096
#: A bin this full is final before the last round.
FULL = 0.995
#: Items that one task packs, and pieces that they may hold together.
TASK_ITEMS, TASK_PIECES = 40_000, 200_000
#: Id that ends every text.
END_ID = 1


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item by best fit decreasing; ties go to the bin opened first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[tuple[int, int]] = []  # (room, number), smallest room first
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(open_bins, (size, -1))
        if at == len(open_bins):
            room, number, n = capacity, n, n + 1
        else:
            room, number = open_bins.pop(at)
        bins[i], offsets[i] = number, capacity - room
        if room > size:
            insort(open_bins, (room - size, number))
    return bins, offsets


_ITEMS = pa.schema([("length", pa.int64()), ("bin", pa.int64()), ("final", pa.bool_()), ("members", pa.binary())])
_ITEMS_SQL = "length long, bin long, final boolean, members binary"


def _pack(capacity: int, level: int, last: bool):
    """One round in one task: items in, bins out. ``members``: (piece number, offset) pairs of int64."""

    def run(table: pa.Table) -> pa.Table:
        give_up()  # texts are tokenized by now
        task = table.column("task")[0].as_py()
        members = table.column("members").to_pylist()
        length = table.column("length").to_numpy()
        order = np.lexsort((np.array([np.frombuffer(m, np.int64)[0] for m in members]), -length))  # the same whatever order rows came in
        bins, offsets = best_fit(length[order], capacity)
        fill = np.bincount(bins, length[order]).astype(np.int64)
        by_bin: list[list[bytes]] = [[] for _ in range(len(fill))]
        for i, b, o in zip(order.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            m = np.frombuffer(members[i], np.int64).copy()
            m[1::2] += o
            by_bin[b].append(m.tobytes())
        number = (np.int64(level) << 56) | (np.int64(task) << 32) | np.arange(len(fill))
        return pa.table([pa.array(fill), pa.array(number), pa.array((fill >= FULL * capacity) | last), pa.array([b"".join(x) for x in by_bin], pa.binary())], schema=_ITEMS)

    return run


def _spread(batches):
    schema = pa.schema([("piece_no", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    for t in batches:
        m = [np.frombuffer(x, np.int64) for x in t.column("members").to_pylist()]
        pairs = np.concatenate([np.zeros(0, np.int64), *m])
        bins = np.repeat(t.column("bin").to_numpy(), [len(x) // 2 for x in m]) if m else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(pairs[::2]), pa.array(bins), pa.array(pairs[1::2])], schema=schema)


def _load(items: DataFrame) -> tuple[int, int]:
    """(items, tasks that they need)"""
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("members"))).first()
    return n, max(1, -(-n // TASK_ITEMS), -(-(size or 0) // (16 * TASK_PIECES)))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(piece_no, sequence_id, offset) for pieces (piece_no long, unique; length long)."""
    spark = pieces.sparkSession
    ship(spark)
    one = F.concat(*(F.unhex(F.substring(F.lpad(F.hex("piece_no"), 16, "0"), 15 - 2 * i, 2)) for i in range(8)), F.lit(bytes(8)))
    checked = F.when(F.col("length") <= capacity, F.col("length")).otherwise(F.raise_error(F.lit("a piece is longer than the capacity")).cast("long"))
    items = shared_table(pieces.select(checked.alias("length"), one.alias("members")), "pack-items-0")
    done, level, before = [], 0, None
    left, tasks = _load(items)
    while left:
        last = tasks == 1 or (before is not None and left > 0.98 * before)
        task = F.pmod(F.xxhash64("members"), F.lit(tasks)).alias("task")
        packed = items.select("length", "members", task).groupBy("task").applyInArrow(_pack(capacity, level, last), _ITEMS_SQL)
        packed = shared_table(packed, f"pack-items-{level + 1}")
        done.append(packed.filter("final"))
        if last:
            break
        items = packed.filter("not final").select("length", "members")
        before = left
        left, tasks = _load(items)
        level += 1
    if not done:
        done = [spark.createDataFrame([], _ITEMS_SQL)]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("bin", "members").mapInArrow(_spread, "piece_no long, sequence_id long, offset long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(vocab: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = chunk_tokenizer(vocabulary(vocab) if "/" not in vocab else vocab)
        for t in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, packed in zip(t.column("doc_id").to_pylist(), tokenizer.packed(t.column("text")), strict=True):
                packed += end
                n = len(packed) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(packed[4 * at : 4 * (at + size)]))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip((doc, piece, start, length, crc), _PIECES, strict=True)], schema=_PIECES)

    return run


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text.

    ``vocab`` is a path, or the name of one of the public vocabulary files.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(thrifty(_pieces(vocab, END_ID, capacity), keeps=True), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # numbers are fixed once written, so the join below sees the ones that were packed
    pieces = shared_table(pieces.withColumn("piece_no", F.monotonically_increasing_id()), "pack-pieces")
    return pieces.join(pack(pieces.select("piece_no", "length"), capacity), "piece_no").drop("piece_no")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of at most 4096 tokens."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
