"""Token ids of whole texts by a public tokenizer, at the cost of its distinct words.

The tokenizer in use drops white space and never joins what white space divides,
so the ids of a text are the ids of its chunks one after another. A worker keeps
the packed ids of chunks it has met; only new chunks go through the tokenizer.
Chunks are kept in two halves: when the newer is full it becomes the older, and
what stood in the older is forgotten unless it was met again. That costs time and
changes nothing else.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np

from strandline.llm.textkit import KEPT, texts

#: Chunks a worker remembers (about 150 bytes each).
CACHE = 600_000

#: Printable ASCII and Latin-1, which the tokenizer's normalizer leaves as they are but for case.
LATIN = re.compile(r"[!-~\xa1-\xff]+")
#: Fixed by the tokenizer's own split pattern, for lower-case text of those characters.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
#: The character that stands for each byte in a byte-level vocabulary.
_SPARE = iter(range(256, 512))
BYTE_LEVEL = "".join(chr(b if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else next(_SPARE)) for b in range(256))


class Known(dict):
    """Packed ids by chunk; a new chunk is taken from the older half or learned."""

    def __init__(self, learn):
        self.learn, self.older = learn, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        self[chunk] = ids = self.learn(chunk) if ids is None else ids
        return ids

    def limit(self, most: int) -> None:
        if len(self) > most // 2:
            self.older = dict(self)
            self.clear()


class ChunkTokenizer:
    """Packed little-endian uint32 ids of the white-space chunks of a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters_only = not any(x.isalpha() or not x.isascii() for x in self.added)
        self.model = self.tokenizer.model
        self.known = Known(self.learn)
        self.parts: dict[bytes, bytes] = {}

    def part(self, low: bytes) -> bytes:
        """Ids of a lower-case part that the tokenizer's split leaves whole; parts of letters are often chunks too."""
        ids = self.parts.get(low) or self.known.get(low) or self.known.older.get(low)
        if ids is None:
            ids = array("I", [x.id for x in self.model.tokenize(charmap_decode(low, "strict", BYTE_LEVEL)[0])]).tobytes()
            if len(low) < 4:
                self.parts[low] = ids
        return ids

    def learn(self, chunk: bytes) -> bytes:
        """Ids of a new chunk. One that holds an added token, or other than Latin-1, goes through the library."""
        if self.letters_only and chunk.isalpha():  # of ASCII
            return self.part(chunk.lower())
        text, low = chunk.decode(), chunk.lower()
        for x in self.added:
            if x in low:
                break
        else:
            if text.isprintable() if text.isascii() else LATIN.fullmatch(text):
                low = text.lower()
                if low.isalpha():
                    return self.part(low.encode())
                return b"".join([self.part(x.encode()) for x in LATIN_PARTS.findall(low)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def packed(self, column):
        """Packed ids of every text of a column; null counts as empty.

        The tokenizer takes lower case, so ASCII letters are lowered first and fewer chunks are met. Not where
        a combining mark (bytes CC and CD begin those that join ASCII letters) joins before it lowers, or by an added token.
        """
        offsets, raw = texts(column)
        data = raw.tobytes()
        get = self.known.__getitem__
        for i in range(len(offsets) - 1):
            text = data[offsets[i] : offsets[i + 1]]
            low = text.lower()
            if b"\xcc" not in low and b"\xcd" not in low and not any(x in low for x in self.added):
                text = low
            yield b"".join(map(get, text.split()))
            self.known.limit(CACHE)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}
KEPT.append(_TOKENIZERS.clear)


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer a worker process, with its cache."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    """Give up the tokenizers of this worker process, for work that follows without them."""
    _TOKENIZERS.clear()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
