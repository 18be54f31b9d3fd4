"""N-gram Jaccard join with PartEnum signatures.

A document is the set of hashes of its distinct five-word shingles. Two sets link
when 100 * |intersection| >= 80 * |union|. Linked sets have sizes within a factor
of 5/4, so sizes fall into bands [l, floor(5 l / 4)] and a link joins sets of one
band or of neighbouring bands. For such a pair the symmetric difference is at
most k = floor(2 r * 20 / 180), where r is the upper end of the larger band. Each
band therefore has one PartEnum scheme, and a set takes part in the scheme of its
own band and in that of the next:

* k <= 5: the shingle domain is hashed to k + 3 parts and every subset of three
  parts is a signature. k differences touch k parts at most, so linked sets agree
  on at least one subset.
* k > 5: the domain is hashed to k + 1 + s parts and each part is a signature;
  at least s + 1 parts agree. A set with at most s empty parts needs no signature
  for them, since one of the agreeing parts then holds a shingle; a set with more
  empty parts emits them too. So no link is lost, and the empty parts that nearly
  all sets of a band would share stay out of the shuffle.

Signatures travel as sorted binary blobs, one per map batch and bucket, not as
rows. A bucket finds the runs of equal signatures. Candidates are verified in three steps, each first by
sizes and by member counts of 256 hash cells (their differences are a lower bound
of the symmetric difference), then by finer cells, one for one or two members, and
only if these allow a link on the whole sets: each set against that first set of a run with
which it shares the most runs; then against the first of each run with which it is not yet connected;
then the remaining pairs under one first whose ends are still in different components,
in blocks of bounded size. Blocks exchange rows, never pairs: a pass returns the rows
that still have a possible partner, the last one a spanning forest of the links. The
largest component under a first is not compared with itself.
The result holds components only, so pairs inside a component need no check and
the copies of a large group cost one or a few checks each instead of all pairs.

Sets are identified by a 64-bit hash of their members, so identical sets collapse
before any join.

Cases: null, empty or blank texts have no shingles, n_shingles 0, and link with
nothing. Texts with one to four words are one shingle: the whole sequence. Rows
that repeat a doc_id are rows of their own; the component is that of each row's
text. A null id never becomes a component id unless a component has no other.
Further columns of the input play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bitmap
from strandline.llm.components import components
from strandline.llm.textkit import U64, give_back, mix, thrifty, word_hashes
from strandline.runtime import join_groups, shared_table, ship

WORDS = 5
NUM, DEN = 80, 100
#: Schemes with at most this many differences enumerate subsets of k + 3 parts.
SMALL_K = 5
#: Signatures gathered before a map task writes its blobs, and aimed at per bucket.
FLUSH = 250_000
PER_BUCKET = 1_500_000
#: Sets of one group compared in one task; larger groups are dealt in blocks of about this size.
BLOCK = 1024
#: Firsts that a set carries to decide under which of them a pair is returned.
FEW = 8
#: Hash cells whose member counts tell most unlinked pairs apart before whole sets are read.
CELLS = 256

_MULT = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def shingle_sets(column, k: int = WORDS):
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for a, b, hashes, firsts in word_hashes(column):
        n = len(hashes)
        if n >= k:
            rolled = np.zeros(n - k + 1, U64)
            for j in range(k):
                rolled += hashes[j : n - k + 1 + j] * _MULT[j % 5] + U64(j // 5)
            rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = int(firsts[i]), int(firsts[i + 1])
            if hi - lo >= k:
                x = np.sort(rolled[lo : hi - k + 1])
                yield a + i, x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif hi > lo:
                few = hashes[lo:hi] * np.array(_MULT, U64)[np.arange(hi - lo) % 5]
                yield a + i, mix(np.array([few.sum() + U64(hi - lo)], U64))
            else:
                yield a + i, np.zeros(0, U64)


def set_id(x: np.ndarray) -> int:
    """64-bit identity of a set of shingle hashes, as a signed long."""
    both = mix(np.array([mix(x).sum() + U64(len(x))], U64))
    return int(both.view(np.int64)[0])


def bands(largest: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, most differences) of each band up to past ``largest``."""
    out, low = [], 1
    while True:
        high = low * den // num
        out.append((low, high, 2 * high * (den - num) // (den + num)))
        if low > largest:
            return out
        low = high + 1


def parts_of(low: int, k: int) -> tuple[int, int]:
    """(parts, spare parts s) of a scheme without subsets."""
    empty = (k + 1) * np.exp(-low / (k + 1))
    spare = int(np.ceil(empty + 3 * np.sqrt(empty)))
    return k + 1 + spare, spare


class Schemes:
    def __init__(self, num: int, den: int):
        self.num, self.den, self.top = num, den, 0

    def upto(self, size: int) -> None:
        if size <= self.top:
            return
        self.top = max(size, 1024, 2 * self.top)
        self.bands = bands(self.top * self.den // self.num + 1, self.num, self.den)
        self.low = np.array([x[0] for x in self.bands], np.int64)
        self.k = np.array([x[2] for x in self.bands], np.int64)
        both = [parts_of(low, k) if k > SMALL_K else (k + 3, 0) for low, _, k in self.bands]
        self.parts, self.spare = (np.array(x, np.int64) for x in zip(*both, strict=True))


def signatures(sets: list[np.ndarray], schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for a list of non-empty sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    schemes.upto(int(sizes.max()))
    own = np.searchsorted(schemes.low, sizes, "right") - 1
    members = mix(np.concatenate(sets) ^ U64(0x5851F42D4C957F2D))
    member_of = np.repeat(np.arange(len(sets)), sizes)
    place = (members >> U64(40)).astype(np.int64)
    low32, high32 = (members & U64(0xFFFFFFFF)).astype(np.float64), (members >> U64(32)).astype(np.float64)
    sigs, owners = [], []
    for step in (0, 1):
        band = own + step
        parts, k = schemes.parts[band], schemes.k[band]
        start = np.concatenate(([0], np.cumsum(parts)))
        cell = start[member_of] + ((place * parts[member_of]) >> 24)
        total = int(start[-1])
        count = np.bincount(cell, minlength=total)
        # sums of halves stay below 2**53, hence exact
        value = np.bincount(cell, low32, total).astype(U64) + (np.bincount(cell, high32, total).astype(U64) << U64(32))
        of_set = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(total) - start[of_set]
        salt = mix(band.astype(U64) + U64(0x632BE59BD9B4E019))
        small = k <= SMALL_K
        empties = np.bincount(of_set, count == 0, len(sets))
        wanted = ~small[of_set] & ((count > 0) | (empties > schemes.spare[band])[of_set])
        cells = np.flatnonzero(wanted)
        at = of_set[cells]
        sigs.append(mix(value[cells] + salt[at] * (part[cells].astype(U64) + U64(1))))
        owners.append(at)
        for few in range(1, SMALL_K + 1):
            which = np.flatnonzero(k == few)
            if not len(which):
                continue
            grid = value[start[which][:, None] + np.arange(few + 3)]
            for n, chosen in enumerate(combinations(range(few + 3), 3)):
                joint = np.zeros(len(which), U64)
                for c in chosen:
                    joint += grid[:, c] * U64(2 * c + 1)
                sigs.append(mix(joint + salt[which] * U64(n + 1)))
                owners.append(which)
    return np.concatenate(sigs), np.concatenate(owners)


_BLOBS = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("nodes", pa.binary())])
_RUNS = pa.schema([("run", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("weight", pa.int64())])


def _describe(batches):
    for t in batches:
        n, node = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for i, x in shingle_sets(t.column(1)):
            n[i] = len(x)
            node[i] = set_id(x)
        yield pa.record_batch([t.column(0), pa.array(n), pa.array(node, mask=n == 0)], names=["doc_id", "n_shingles", "node"])


def _blobs(buckets: int, num: int, den: int):
    schemes = Schemes(num, den)

    def flush(sigs, nodes):
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        bucket = ((sig >> U64(48)).astype(np.int64) * buckets) >> 16
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        low, high = (sig & U64(0xFFFFFFFF)).astype(np.uint32), ((sig >> U64(32)) & U64(0xFFFF)).astype(np.uint16)
        some = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
        for at in range(0, len(some), 64):
            pick = some[at : at + 64]
            cut = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in pick], pa.binary())
            yield pa.record_batch([pa.array(pick, pa.int32()), cut(low), cut(high), cut(node)], schema=_BLOBS)

    def run(batches):
        seen: set[int] = set()
        sigs, nodes, held = [], [], 0
        for t in batches:
            sets, ids, size = [], [], 0
            for i, x in _with_end(shingle_sets(t.column(0))):
                if x is not None and len(x):
                    s = set_id(x)
                    if s in seen:
                        continue
                    seen.add(s)
                    sets.append(x)
                    ids.append(s)
                    size += len(x)
                if sets and (x is None or size > 1 << 17):
                    sig, owner = signatures(sets, schemes)
                    sigs.append(sig)
                    nodes.append(np.array(ids, np.int64)[owner])
                    held += len(sig)
                    sets, ids, size = [], [], 0
                    if held > FLUSH:
                        yield from flush(sigs, nodes)
                        sigs, nodes, held = [], [], 0
        if held:
            yield from flush(sigs, nodes)

    return run


def _with_end(items):
    yield from items
    yield -1, None


def _runs(table: pa.Table) -> pa.Table:
    """Runs of two or more sets with one signature; runs with the same members count once."""
    get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    sig = (get("high", np.uint16).astype(np.int64) << 32) | get("low", np.uint32)
    node = get("nodes", np.int64)
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    edge = sig[1:] == sig[:-1]
    shared = np.concatenate((edge, [False])) | np.concatenate(([False], edge))
    sig, node = sig[shared], node[shared]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if len(sig):
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.concatenate((start, [len(sig)])))
        members = np.add.reduceat(mix(node.view(U64)), start)
        _, once, alike = np.unique(members, return_index=True, return_counts=True)
        once, alike = once[size[once] > 1], alike[size[once] > 1]
        weight = np.zeros(len(start), np.int64)
        weight[once] = alike
        weight = np.repeat(weight, size)
        at = weight > 0
        weight = weight[at]
        run = np.repeat(members.view(np.int64), size)[at]
        first = np.repeat(node[start], size)[at]
        node = node[at]
    else:
        run = first = weight = node
    return pa.table([pa.array(run), pa.array(node), pa.array(first), pa.array(weight)], schema=_RUNS)


def _bucket_runs(table: pa.Table) -> pa.Table:
    out = _runs(table)
    give_back()
    return out


def _cells(x: np.ndarray) -> bytes:
    """How many members fall in each of ``CELLS`` hash cells, at most 255 told."""
    return np.minimum(np.bincount((mix(x) >> U64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _fine(x: np.ndarray) -> bytes:
    """Like ``_cells`` with a power of two of cells, one for each one or two members."""
    bits = min(16, max(8, (len(x) // 2).bit_length()))
    return np.minimum(np.bincount((mix(x) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _apart_by(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference from two strings of cell counts; more cells fold to fewer."""
    a, b = (np.frombuffer(z, np.uint8).astype(np.int32) for z in (x, y))
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        if b.max() == 255:
            return 0  # a cell that counts no further: no bound
        b = b.reshape(len(a), -1).sum(1)
        b = np.minimum(b, 255)
    return int(np.abs(a - b).sum())


def _contents(describe):
    """(node, size, ``describe(members)``) of every text with shingles."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])

    def run(batches):
        for t in batches:
            nodes, n, blobs, held = [], [], [], 0
            for i, x in _with_end(shingle_sets(t.column(0))):
                if x is not None and len(x):
                    nodes.append(set_id(x))
                    n.append(len(x))
                    blobs.append(describe(x))
                    held += len(x)
                if nodes and (x is None or held > 1 << 20):
                    yield pa.record_batch([pa.array(nodes), pa.array(n), pa.array(blobs, pa.binary())], schema=schema)
                    nodes, n, blobs, held = [], [], [], 0

    return run


def _near(num: int, den: int):
    """Keeps pairs whose cell counts differ by no more than a link allows."""

    def run(batches):
        for t in batches:
            na, nb = (t.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32) for c in ("ca", "cb"))
            apart = np.abs(x - y).sum(1)
            ok = (num + den) * apart <= (den - num) * (na + nb)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    return run


def _nearer(num: int, den: int):
    """Keeps pairs that finer cells don't rule out either."""

    def run(batches):
        for t in batches:
            na, nb = (t.column(c).to_numpy() for c in ("na", "nb"))
            apart = np.array([_apart_by(x, y) for x, y in zip(t.column("ma").to_pylist(), t.column("mb").to_pylist(), strict=True)], np.int64)
            yield t.select(["a", "b"]).filter(pa.array((num + den) * apart <= (den - num) * (na + nb), pa.bool_()))

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _fold(fine: bytes) -> np.ndarray:
    """The ``CELLS`` cell counts that finer ones add up to."""
    return np.minimum(np.frombuffer(fine, np.uint8).reshape(CELLS, -1).sum(1, dtype=np.int64), 255).astype(np.int16)


class Block:
    """The rows of one block, or of two, that are compared with each other."""

    def __init__(self, table: pa.Table, cells: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        column = lambda c: table.column(c).to_numpy()
        self.order = np.argsort(column("mine"), kind="stable")
        self.mine, self.node, self.label, self.n = (column(c)[self.order] for c in ("mine", "node", "label", "n"))
        self.cells = np.stack(cells)[self.order].astype(np.int16)
        firsts = table.column("firsts").to_pylist()
        self.firsts = [set(firsts[i]) for i in self.order]
        self.here, x, y = (table.column(c)[0].as_py() for c in ("first", "x", "y"))
        self.half = int(np.searchsorted(self.mine, x, "right")) if x != y else None

    def near(self):
        """(i, list of j) of the pairs in different components that sizes and cells don't rule out.

        Each set brings the smallest ``FEW`` of its firsts. A pair that has some of
        these in common is met under the smallest of them only.
        """
        num, den, n = self.num, self.den, self.n
        for i in range(len(n) - 1 if self.half is None else self.half):
            rest = np.arange(i + 1 if self.half is None else self.half, len(n))
            rest = rest[(self.label[rest] != self.label[i]) & (np.minimum(n[rest], n[i]) * den >= np.maximum(n[rest], n[i]) * num)]
            if not len(rest):
                continue
            apart = np.abs(self.cells[rest] - self.cells[i]).sum(1, dtype=np.int32)
            found = []
            for j in rest[(num + den) * apart <= (den - num) * (n[rest] + n[i])].tolist():
                both = self.firsts[i] & self.firsts[j]
                if not both or min(both) == self.here:
                    found.append(j)
            if found:
                yield i, found

    def nearer(self, fine: list[bytes]):
        """The pairs (i, j) that finer cells, in the block's order, don't rule out either."""
        for i, found in self.near():
            for j in found:
                if (self.num + self.den) * _apart_by(fine[i], fine[j]) <= (self.den - self.num) * int(self.n[i] + self.n[j]):
                    yield i, j


#: A row of a block without any description of its set.
_ROW = ["first", "x", "y", "mine", "node", "label", "n", "firsts"]
_ROW_SQL = "first long, x long, y long, mine long, node long, label long, n long, firsts array<long>"


def _rows_in(table: pa.Table, block: Block, kept: set[int]) -> pa.Table:
    return table.select(_ROW).take(pa.array(np.sort(block.order[sorted(kept)]) if kept else [], pa.int64()))


def _near_rows(num: int, den: int):
    """The rows of a block that are in any near pair. Pairs stay inside: a block returns no more rows than it has."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, [np.frombuffer(x, np.uint8) for x in table.column("cells").to_pylist()], num, den)
        kept: set[int] = set()
        for i, found in block.near():
            kept.update((i, *found))
        return _rows_in(table, block, kept)

    return run


def _nearer_rows(num: int, den: int):
    """The rows of a block that are in any pair which finer cells don't rule out."""

    def run(table: pa.Table) -> pa.Table:
        fine = table.column("members").to_pylist()
        block = Block(table, [_fold(x) for x in fine], num, den)
        fine = [fine[i] for i in block.order]
        return _rows_in(table, block, {k for pair in block.nearer(fine) for k in pair})

    return run


def _verify_rows(num: int, den: int):
    """Links between the rows of a block, on whole sets, each of which comes once.

    A pair whose ends the links found so far connect already needs no check; so a
    block returns fewer links than it has rows, and the components are the same.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in table.column("members").to_pylist()]
        fine = [_fine(x) for x in sets]
        block = Block(table, [_fold(x) for x in fine], num, den)
        sets, fine = [sets[i] for i in block.order], [fine[i] for i in block.order]
        root = {n: n for n in block.label.tolist()}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        links = []
        for i, found in block.near():
            for j in found:
                a, b = find(int(block.label[i])), find(int(block.label[j]))
                if a == b or (num + den) * _apart_by(fine[i], fine[j]) > (den - num) * int(block.n[i] + block.n[j]):
                    continue
                if _linked(sets[i], sets[j], num, den):
                    root[a] = b
                    links.append((int(block.node[i]), int(block.node[j])))
        a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b, "linked": pa.array([True] * len(links), pa.bool_())})

    return run


def _verify(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        for t in batches:
            linked = []
            for x, y in zip(t.column("ma"), t.column("mb"), strict=True):
                linked.append(_linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), num, den))
            yield pa.record_batch([t.column("a"), t.column("b"), pa.array(linked, pa.bool_())], schema=schema)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; ids may be of any type that has an order."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    described = shared_table(narrow.mapInArrow(thrifty(_describe), f"doc_id {kind}, n_shingles long, node long"), "jaccard-sets")
    classes = described.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n")
    )
    classes = shared_table(classes, "jaccard-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = int(min(65536, max(64, 0.6 * total / PER_BUCKET)))

    blobs = narrow.select("text").mapInArrow(thrifty(_blobs(buckets, num, den)), "bucket int, low binary, high binary, nodes binary")
    runs = blobs.groupBy("bucket").applyInArrow(lambda t: _bucket_runs(t), "run long, node long, first long, weight long")
    runs = shared_table(runs, "jaccard-runs")

    def contents(nodes: DataFrame, describe) -> DataFrame:
        """(node, n, description) of the sets in ``nodes``, from the texts of one row each."""
        reps = classes.join(nodes, "node", "left_semi")
        chosen = bitmap.probe(narrow, bitmap.build(reps, "rep"), "doc_id").filter("_may").select("text")
        return chosen.mapInArrow(thrifty(_contents(describe)), "node long, n long, members binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    cells = shared_table(contents(runs.select("node").distinct(), _cells), "jaccard-cells")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) of the pairs that sizes and cell counts don't rule out, checked on whole sets."""
        near = (
            pairs.join(cells.toDF("a", "na", "ca"), "a")
            .join(cells.toDF("b", "nb", "cb"), "b")
            .filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
            .mapInArrow(thrifty(_near(num, den)), "a long, b long")
        )
        near = shared_table(near, f"{name}-near")

        def described(pairs: DataFrame, describe) -> DataFrame:
            nodes = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes")
            of = shared_table(contents(nodes, describe), f"{name}-sets")
            return pairs.join(of.toDF("a", "na", "ma"), "a").join(of.toDF("b", "nb", "mb"), "b").select("a", "b", "na", "nb", "ma", "mb")

        nearer = shared_table(described(near, _fine).mapInArrow(thrifty(_nearer(num, den)), "a long, b long"), f"{name}-nearer")
        return shared_table(described(nearer, bytes).mapInArrow(thrifty(_verify(num, den)), "a long, b long, linked boolean"), name)

    def labelled(links: DataFrame) -> DataFrame:
        return components(links.filter("linked"))

    stars = runs.filter("node <> first")
    met = stars.groupBy("node", "first").agg(F.sum("weight").alias("times"))
    met = shared_table(met, "jaccard-met")
    most = met.groupBy("node").agg(F.max_by("first", F.struct("times", "first")).alias("b"))
    tried = verified(most.select(F.col("node").alias("a"), "b"), "jaccard-tried-1")
    labels = labelled(tried)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        la, lb = (labels.withColumnsRenamed({"node": c, "label": f"l{c}"}) for c in "ab")
        return (
            pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        )

    second = met.select(F.col("node").alias("a"), F.col("first").alias("b"))
    second = apart(second).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    tried = tried.unionByName(verified(second, "jaccard-tried-2"))
    labels = labelled(tried)

    # What is left: sets that share the first of a run and are in different components. The
    # largest component under a first needs no comparison with itself, only with the others.
    held = shared_table(met.join(labels, "node", "left").select("first", "node", F.coalesce("label", "node").alias("label")), "jaccard-under")
    under = held.groupBy("first", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = under.groupBy("first").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"))
    held = shared_table(held.join(mixed.filter("labels > 1").drop("labels"), "first"), "jaccard-held")
    few = held.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("first")), 1, FEW).alias("firsts"))
    known = shared_table(cells.withColumnsRenamed({"members": "cells"}).join(few, "node"), "jaccard-known")
    main, others, of_main = F.ceil(F.col("most") / BLOCK), F.ceil((F.col("m") - F.col("most")) / BLOCK), F.col("label") == F.col("main")
    own = F.when(of_main, F.pmod(F.xxhash64("node"), main)).otherwise(main + F.pmod(F.xxhash64("node"), others))
    dealt = held.join(known, "node").withColumn("mine", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(of_main, main).otherwise(F.lit(0).cast("long")), main + others - 1)))
    dealt = dealt.select("first", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "label", "n", "firsts", "cells")
    block = ["first", "x", "y"]
    near = shared_table(dealt.groupBy(*block).applyInArrow(_near_rows(num, den), _ROW_SQL), "jaccard-near-rows")

    def described_rows(rows: DataFrame, describe) -> DataFrame:
        """The rows with a description of their sets, ready for one task a block."""
        of = contents(rows.select("node").distinct(), describe)
        return rows.join(of.select("node", "members"), "node").groupBy(*block)

    nearer = shared_table(described_rows(near, _fine).applyInArrow(_nearer_rows(num, den), _ROW_SQL), "jaccard-nearer-rows")
    third = shared_table(described_rows(nearer, bytes).applyInArrow(_verify_rows(num, den), "a long, b long, linked boolean"), "jaccard-tried-3")
    tried = tried.unionByName(third)
    labels = labelled(tried)

    joined = classes.join(labels, "node", "left").select("node", "rep", "size", F.coalesce("label", "node").alias("label"))
    joined = shared_table(joined, "jaccard-labels")
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = shared_table(joined.join(least, "label").select("node", "size", "component_id"), "jaccard-groups")
    out = join_groups(described, groups, "node", "size", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components over the whole of ``documents``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
