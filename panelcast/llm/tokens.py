"""Token ids by a public tokenizer file, encoded once per distinct word.

The vocabulary drops white space, so a text's ids are the ids of its words in turn. Words are
looked up in lower case, as the tokenizer lower-cases, and without their trailing punctuation,
which it always splits off after a letter. These stems are kept in a bounded dictionary per Python
worker; new ones go to the tokenizers library. One batch may outgrow the dictionary by its own
distinct stems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Most stems kept per worker; beyond it the dictionary starts anew.
KEPT_WORDS = 300_000
ID = "<u4"
_TAIL = ",.!?;:&%$#*"
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
RUN = 2 << 20  # bytes of text that are encoded at once

_open: dict[str, WordEncoder] = {}


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on, in turn.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never span ASCII white space.

    A Latin lower-case word of letters only is one piece as it stands, so the library's
    model gets it directly; everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = kept
        self.characters = _byte_characters()
        self.stems: dict[bytes, bytes] = {}

    def _ids(self, stem: bytes) -> bytes:
        text = stem.decode()
        if text.isalpha() and text.lower() == text and (text.isascii() or max(text) < "\u0250"):
            ids = [token.id for token in self.model.tokenize(stem.decode("latin-1").translate(self.characters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null has none."""
        for text in texts:
            yield from self.encode_column(pa.array([text], pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` for a whole column, which is taken in runs of at most ``RUN`` bytes; a longer text is
        cut at white space, so that what stands beside the ids doesn't grow with it."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + RUN, "right")))
            if last == first + 1 and ends[first] - before > RUN:
                yield b"".join(i for piece in _cut(texts[first]) for i in self._encode(pa.array([piece], pa.string())))
            else:
                yield from self._encode(texts.slice(first, last - first))
            first = last
            give_back()

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Arrow splits and numbers the words, takes distinct ones apart and puts the ids of all of them
        together; only distinct stems are Python objects."""
        if len(self.stems) > self.kept:
            self.stems.clear()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        stems, tails = (part.dictionary_encode() for part in _parts(words.dictionary))
        known, pieces = self.stems, []
        for part in (stems, tails):
            for piece in part.dictionary.cast(pa.binary()).to_pylist():
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = self._ids(piece) if piece else b""
                pieces.append(ids)
        order = np.empty((len(words), 2), dtype=np.int32)
        at = words.indices.to_numpy()
        order[:, 0] = stems.indices.to_numpy()[at]
        order[:, 1] = tails.indices.to_numpy()[at] + len(stems.dictionary)
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(order.ravel()))
        place = np.frombuffer(joined.buffers()[1], dtype=np.int64)[2 * ends] if len(words) else np.zeros(len(ends), dtype=np.int64)
        data = memoryview(joined.buffers()[2] or b"")
        for i in range(len(texts)):
            yield bytes(data[place[i] : place[i + 1]])


def _cut(text: pa.Scalar) -> Iterator[pa.Scalar]:
    """A text in pieces of about ``RUN`` bytes that begin and end at white space."""
    data = memoryview(text.as_buffer())
    at = 0
    while at < len(data):
        end = min(at + RUN, len(data))
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield bytes(data[at:end]).decode()
        at = end


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Stems and trailing punctuation, where the tokenizer surely splits; else the words and nothing."""
    lower = pc.ascii_lower(words)
    stem = pc.ascii_rtrim(lower, _TAIL)
    last = pc.utf8_slice_codeunits(stem, -1).dictionary_encode()
    letter = pa.array([c.isalpha() for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
    special = pc.match_substring(words, "<|")  # may hold the name of a special token
    cut = pc.and_(letter, pc.invert(special))
    size = pc.binary_length(stem)
    whole = pc.if_else(special, words, lower)
    # the last characters of a word that the stem lacks; few words have any
    ended = pc.and_(cut, pc.less(size, pc.binary_length(lower)))
    some = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
    tails = np.full(len(words), "", dtype=object)
    tails[some] = [w[n:].decode() for w, n in zip(lower.take(some).cast(pa.binary()).to_pylist(), size.take(some).to_pylist(), strict=True)]
    return pc.if_else(cut, stem, whole), pa.array(tails, pa.string())


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
