"""Token counts of a unigram tokenizer by Viterbi search without a back-trace.

An Aho-Corasick automaton of the vocabulary runs once over a chunk and reports
every piece that ends at each character, longest first. The dynamic program keeps
only the best score and its number of pieces at each character. Ties follow the
tokenizer: a path replaces another only if its score is greater, and candidates
come in the order of their start, so the earliest start (the longest last piece)
wins. A character that is no piece itself may also be an unknown, scored 10 below
the lowest piece and spelt in one byte piece for each of its UTF-8 bytes. Scores
are added left to right in double precision, as the tokenizer does.

The text becomes pieces as a Metaspace pre-tokenizer cuts it: spaces turn to U+2581,
one stands in front of the text, and each opens a new chunk. Chunks are
independent, so a worker searches each distinct chunk once and remembers its
count; when its memory is full it starts over, which changes no result.

Cases: null and empty texts have no tokens. Very long chunks are searched in
time and memory in proportion to their length. Rows that repeat are counted each.
An empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokens import vocabulary
from strandline.runtime import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks a worker remembers (about 120 bytes each).
CACHE = 800_000


def pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece vocabulary file, by id."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    """Counts pieces of the best segmentation under a unigram vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(float(s) for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}

    def chunk(self, text: str) -> int:
        """Number of pieces of one chunk."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # characters whose ends are settled, but for ``open_end``
        single, unknown = self.single, self.unknown

        def settle(end: int, reached: bool) -> None:
            c = text[end - 1]
            if c not in single:
                score = best[end - 1] + unknown
                if not reached or score > best[end]:
                    best[end] = score
                    count[end] = count[end - 1] + len(c.encode("utf-8", "replace"))

        current, reached = 0, False
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            if end != current:
                if current:
                    settle(current, reached)
                    done = current
                for skipped in range(done + 1, end):
                    settle(skipped, False)
                current, reached = end, False
                done = end - 1
            total = best[end - size] + score
            if not reached or total > best[end]:
                best[end], reached = total, True
                count[end] = count[end - size] + 1
        if current:
            settle(current, reached)
            done = current
        for skipped in range(done + 1, n + 1):
            settle(skipped, False)
        return count[n]

    def text(self, data: bytes) -> int:
        """Number of pieces of a whole text in UTF-8."""
        if not data:
            return 0
        data = data.replace(b"\xe2\x96\x81", b" ")
        parts = data.split(b" ")
        if data[:1] == b" ":
            parts = parts[1:]  # the space in front is the one that would be added
        known = self.known
        total = 0
        for p in parts:
            n = known.get(p)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = known[p] = self.chunk(MARK + p.decode("utf-8", "replace"))
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def _count(vocab: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        if vocab not in _COUNTERS:
            _COUNTERS[vocab] = Counter(pieces(vocab if "/" in vocab else vocabulary(vocab)))
        counter = _COUNTERS[vocab]
        for t in batches:
            n = [counter.text(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in t.column("text")]
            yield pa.record_batch([t.column("doc_id"), pa.array(n, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens of every row; ``vocab`` is a path or the name of a public vocabulary file."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count(vocab), "doc_id long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of all of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
