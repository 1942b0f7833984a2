"""Token ids of whole texts from public vocabularies, each distinct chunk of text encoded once.

A text is cut where no token can cross, the distinct chunks are encoded by the library, and the
results are put together again. The tests compare with the library on whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tidemark.llm.words import SPACE, byte_values, span_hashes, text_buffer

CACHED_CHUNKS = 400_000  # per worker; the cache starts afresh beyond it, which changes no result

# White space beside the six ASCII characters, in UTF-8, and neighbours of it: a text with any is not cut.
OTHER_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81|\xe3\x80\x80|\xef\xbb\xbf"
)
# Bytes two of which such a sign can begin with; few other characters begin so, and the pattern decides.
SIGN_BEGINS = np.zeros(1 << 16, dtype=bool)
for _lead, _next in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,))):
    SIGN_BEGINS[[_lead << 8 | n for n in _next]] = True
SIGN_BEGINS[0x1C00:0x2000] = True
SIGN_LEADS = SIGN_BEGINS.reshape(256, 256).any(axis=1)
SPACE_SIGN = re.compile("▁".encode())
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[ord("."), ord(",")]] = True


# Byte-level vocabularies write each byte as a sign of its own; letters' bytes keep their Latin-1 sign but for these.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
BYTE_SIGNS = {b: 0x100 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x100 + 67}


def as_byte_signs(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)


def other_space(data: np.ndarray) -> list[int]:
    """Where ``OTHER_SPACE`` matches."""
    places = np.flatnonzero(SIGN_LEADS[data])
    if not len(places):
        return []
    following = np.append(data[1:], 0)[places]
    places = places[SIGN_BEGINS[data[places].astype(np.int64) << 8 | following]]
    raw = memoryview(data)
    return [at for at in places.tolist() if OTHER_SPACE.match(raw, at)]


class ChunkEncoder:
    """Encodes texts with a ``tokenizers`` file, without special tokens added.

    ``drops_space`` tells the vocabularies that ignore white space and case from the byte-level ones
    that keep both. In either kind a token ends before white space that follows another character, and
    between an ASCII letter or digit and a full stop or comma. Chunks are told apart by 128 bits of hash.
    """

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self.tokenizer.encode("A b", add_special_tokens=False).ids
        self.drops_space = probe == self.tokenizer.encode("a  b", add_special_tokens=False).ids
        self.values = byte_values(11), byte_values(12)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # ascending
        self.checks = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)  # of a chunk's ids in the arena
        self.size = np.zeros(0, dtype=np.int64)
        self.arena = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def largest_id(self) -> int:
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values())

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids per chunk. Latin letters need neither normalising nor splitting, so the model suffices."""
        tokenize, found, other = self.tokenizer.model.tokenize, [[]] * len(chunks), []
        for i, chunk in enumerate(chunks):
            if not self.drops_space and chunk[:1] == " " and LETTERS.fullmatch(chunk, 1):
                found[i] = [t.id for t in tokenize("Ġ" + as_byte_signs(chunk[1:]))]
            elif self.drops_space and LETTERS.fullmatch(chunk):
                found[i] = [t.id for t in tokenize(as_byte_signs(chunk.lower()))]
            else:
                other.append(i)
        encoded = self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)
        for i, e in zip(other, encoded, strict=True):
            found[i] = e.ids
        return found

    def _chunks(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[borders] = True
        first = first[:-1]
        before = np.concatenate([[True], space[:-1]])
        cut = STOP[data] & np.concatenate([[False], ALNUM[data[:-1]]])
        cut |= (~space & before) if self.drops_space else (space & ~before)
        for place in other_space(data):
            text = np.searchsorted(borders, place, side="right") - 1
            cut[borders[text] : borders[text + 1]] = False
        starts = np.flatnonzero(cut | first)
        ends = np.append(starts[1:], len(data))
        if self.drops_space:  # leave out the white space at the end
            last = np.maximum.accumulate(np.where(space, 0, np.arange(1, len(data) + 1)))
            ends = np.maximum(starts, last[ends - 1])
        return starts, ends

    def _learn(self, data: np.ndarray, starts, ends, keys, checks) -> None:
        raw = data.tobytes()
        ids = self._encode([raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
        if self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(len(flat), len(self.arena)), dtype=np.uint32)])
        self.arena[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text; null counts as empty."""
        data, borders = text_buffer(column)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(column), dtype=np.int64)
        starts, ends = self._chunks(data, borders)
        keys = span_hashes(data, starts, ends, self.values[0])
        checks = span_hashes(data, starts, ends, self.values[1])
        distinct, one, place = np.unique(keys, return_index=True, return_inverse=True)
        if not np.array_equal(checks[one][place], checks):
            return self._whole(column)
        if len(self.keys) + len(distinct) > self.cached:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), dtype=bool)
        if new.any():
            fresh = one[new]
            self._learn(data, starts[fresh], ends[fresh], distinct[new], checks[fresh])
            at = np.searchsorted(self.keys, distinct)
        if not np.array_equal(self.checks[at], checks[one]):
            return self._whole(column)
        codes = at[place]
        size = self.size[codes]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.arena[np.repeat(self.start[codes] - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(starts, borders)])

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Without chunks, for the rare batch in which two of them share a 64-bit hash."""
        texts = column.fill_null("").to_pylist()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())), size

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, type=pa.string()))


class PieceCounter(ChunkEncoder):
    """Counts tokens with a sentencepiece BPE model; a chunk begins at a space after another character.

    Only safe while no piece holds a space sign behind another character, which is checked on loading;
    else texts stay whole. A text that holds the sign itself stays whole too: beside it pieces made of signs
    alone can cross a cut. The model itself puts a space before each chunk, so all but a text's first chunk go without theirs.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.cached = CACHED_CHUNKS
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces)
        self.values = byte_values(11), byte_values(12)
        self._clear()

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)

    def _chunks(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(data) + 1, dtype=bool)
        first[borders] = True
        first = first[:-1]
        space = data == 0x20
        filled = np.maximum.accumulate(np.where(space, 0, np.arange(1, len(data) + 1)))
        cut = space & ~np.concatenate([[True], space[:-1]]) if self.safe else np.zeros(len(data), dtype=bool)
        for place in {m.start() for m in SPACE_SIGN.finditer(data)}:
            text = np.searchsorted(borders, place, side="right") - 1
            cut[borders[text] : borders[text + 1]] = False
        places = np.flatnonzero(cut & ~first)
        text_end = borders[np.searchsorted(borders, places, side="right")]
        places = places[places < filled[text_end - 1]]  # spaces at the end stay with the last word
        starts = np.sort(np.concatenate([np.flatnonzero(first), places]))
        ends = np.append(starts[1:], len(data))
        return starts + ~first[starts], ends

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in self.model.encode(column.fill_null("").to_pylist(), num_threads=1)])
        return np.zeros(0, dtype=np.uint32), size

    def count_column(self, column: pa.Array) -> np.ndarray:
        return self.encode_column(column)[1]


@lru_cache(maxsize=2)
def chunk_encoder(path: str, cached: int = CACHED_CHUNKS) -> ChunkEncoder:
    return ChunkEncoder(path, cached)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
