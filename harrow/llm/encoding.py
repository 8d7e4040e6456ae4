"""Exact batch encoding of whole texts with a byte-level BPE vocabulary file.

Texts are cut at safe boundaries: an ASCII white-space character after a
character that is none, or a mark of punctuation after an ASCII letter. No
pre-token of the vocabulary's pattern reaches over such a place, no special
string holds one, and the pattern looks ahead only over white space, so the
parts encoded on their own give exactly the ids of the whole. Equal parts of a
step are encoded once.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa

from harrow.llm.common import ragged, text_bytes

# Parts joined into one text for the library, whose cost per call would prevail otherwise.
JOINED = 4_096
# Distinct parts whose ids are remembered from step to step.
REMEMBERED = 700_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Bytes that certainly end a character that is no white space, looked at alone.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
# First bytes of the characters beyond ASCII that are white space: two and three bytes long.
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC2] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE1:0xE4] = True


def safe_boundaries(data: np.ndarray) -> np.ndarray:
    """Positions where UTF-8 text may be cut without changing its ids."""
    at = np.flatnonzero(_SPACE[data[1:]] & _SOLID[data[:-1]]) + 1
    marks = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
    return np.concatenate((at[ends_solid(data, at)], marks))


def ends_solid(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the text before each position ends with a character that is no white space."""
    last = data[ends - 1]
    unsure = _LEAD2[data[np.maximum(ends - 2, 0)]] | _LEAD3[data[np.maximum(ends - 3, 0)]]
    return _SOLID[last] & ((last < 0x80) | ~unsure)


class Encoder:
    """Ids of whole texts; ``path`` names a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        # A Spark task owns one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # One character of a vocabulary entry stands for one byte.
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        for i, token in self.library.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
            if safe_boundaries(np.frombuffer(token.content.encode(), np.uint8)).size:
                raise ValueError(f"special string {token.content!r} holds a place where texts are cut")
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _encode(self, parts: pa.Array) -> np.ndarray:
        """Add the ids of parts that are not known yet; returns the place of each.

        Parts that begin with white space and end with none stay apart when
        put together; the bytes of the ids tell where each of them ends.
        """
        data, at = text_bytes(parts)
        joins = _SPACE[data[at[:-1]]] & ends_solid(data, at[1:])
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        parts = parts.take(pa.array(order))
        n = int(joins.sum())
        ends = np.cumsum(np.diff(at)[order])
        cuts = sorted({*range(0, n, JOINED), n, *range(n, len(order) + 1)})
        data, _ = text_bytes(parts)
        texts = [data[(ends[a - 1] if a else 0): ends[b - 1]].tobytes().decode() for a, b in itertools.pairwise(cuts)]
        flat = [self.ids]
        for i in range(0, len(texts), 64):
            found = self.library.encode_batch_fast(texts[i: i + 64], add_special_tokens=False)
            flat.extend(np.array(e.ids, np.uint32) for e in found)
        new = np.concatenate(flat[1:]) if len(flat) > 1 else np.zeros(0, np.uint32)
        reached = np.cumsum(self.width[new])
        if not np.array_equal(reached[-1:], ends[-1:]):
            raise ValueError("not a byte-level vocabulary: the ids do not spell the text")
        stops = np.searchsorted(reached, ends, side="right")
        self.starts = np.concatenate((self.starts, len(self.ids) + stops))
        self.ids = np.concatenate((self.ids, new))
        place = np.empty(len(order), np.int64)
        place[order] = len(self.known) + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, parts])
        return place

    def _parts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Known part at each place of the texts, and the first place of each text."""
        import pyarrow.compute as pc

        data, at = text_bytes(column)
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[safe_boundaries(data)] = True
        cut[at] = True
        cuts = np.flatnonzero(cut)
        texts = np.searchsorted(cuts, at)
        if len(cuts) < 2:
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = parts.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self._clear()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            place[place < 0] = self._encode(coded.dictionary.filter(pc.is_null(found)))
        return place[coded.indices.to_numpy(zero_copy_only=False)], texts

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and where each text's ids start."""
        places, texts = self._parts(column)
        lengths = np.diff(self.starts)[places]
        ids = self.ids[ragged(self.starts[places], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[texts]

    def lengths(self, column) -> np.ndarray:
        """Number of ids of each text."""
        places, texts = self._parts(column)
        ends = np.concatenate(([0], np.cumsum(np.diff(self.starts)[places])))[texts]
        return np.diff(ends)


_encoders: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives a task with all that it remembers."""
    import harrow.llm.encoding as own  # a function sent to a worker has globals of its own

    if path not in own._encoders:
        own._encoders[path] = own.Encoder(path)
    return own._encoders[path]
