"""Token counts by batch encoding in Arrow functions.

Texts are split at safe boundaries, where the byte-level pre-tokeniser ends a token whatever stands around:
before a single space between two characters that aren't white space, where a Latin letter meets an ASCII character that
isn't one, before a line feed, and after a single one. The pieces' ids end to end are the text's ids, so a long text never
is encoded in one go. The pieces of a byte-balanced batch are found and fingerprinted in a few passes over the bytes;
distinct new ones are encoded by `encode_batch_fast`, and a bounded table keeps their ids for the worker's later batches.
A text that may hold a special string is encoded by the library as it is, a long one between its special strings, and there
in parts at safe boundaries. Only lengths leave the worker.

Null text: empty, 0 tokens. Null doc_id: kept as it is. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.text import by_bytes, byte_sums, flat, release, stretch

BATCH_BYTES = 1 << 21
TABLE_PIECES = 1_200_000
TABLE_IDS = 1 << 23
LONG = 1 << 16

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts, in bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    before = np.r_[np.uint8(0), data[:-1]]
    # the last byte of U+00C0 to U+024F, signs for times and division aside
    latin = ((before == 0xC3) & (data != 0x97) & (data != 0xB7) | (before >= 0xC4) & (before <= 0xC8) | (before == 0xC9) & (data < 0x90)) & (data >= 0x80) & (data < 0xC0)
    letter_end = _ASCII_LETTER[data] | latin
    plain_end = _PRINTED[data] | latin
    plain_start = _PRINTED[data] | (data >= 0xC3) & (data <= 0xC8)
    cut = np.zeros(n, bool)
    cut[1:] = letter_end[:-1] & (data[1:] < 0x80) & ~_ASCII_LETTER[data[1:]]
    cut[1:] |= plain_end[:-1] & (data[1:] == 0x0A)
    cut[1:-1] |= plain_end[:-2] & (data[1:-1] == 0x20) & plain_start[2:]
    cut[2:] |= plain_end[:-2] & (data[1:-1] == 0x0A) & plain_start[2:]
    cut[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Ids of texts by a tokenizers file. The table of known pieces is emptied when it outgrows its bounds."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # those that take no blanks with them and stand anywhere, so that a text may be parted at them
        self.plain_specials = bool(added) and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.specials = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")")
        self._empty()

    def _empty(self) -> None:
        self.names = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int32)  # of each name, in the arrays that follow
        self.n = self.used = 0
        self.start, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)

    def _learn(self, names: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Encodes new pieces, whose names are sorted; their places."""
        flat_ids: list[int] = []
        ends = [0]
        for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            flat_ids += e.ids
            ends.append(len(flat_ids))
        k = len(pieces)
        while self.n + k > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(flat_ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        size = np.diff(np.array(ends, np.int64))
        place = np.arange(self.n, self.n + k, dtype=np.int32)
        self.length[place] = size
        self.start[place] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat_ids)] = flat_ids
        self.used += len(flat_ids)
        self.n += k
        at = np.searchsorted(self.names, names)
        self.names, self.place = np.insert(self.names, at, names), np.insert(self.place, at, place)
        return place

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Places of the texts' pieces, the first of each text, and the texts that the library must encode whole."""
        if self.n > TABLE_PIECES or self.used > TABLE_IDS:
            self._empty()
        data, off = flat(texts)
        start = boundaries(data, off)
        first = np.searchsorted(start, off)
        sign = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole = set((np.searchsorted(off, sign, "right") - 1).tolist())
        if not len(start):
            return start, first, whole
        end = np.r_[start[1:], len(data)]
        names, pick, back = np.unique(stretch(byte_sums(data), start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        new = self.names[at] != names if len(self.names) else np.ones(len(names), bool)
        place = np.empty(len(names), np.int32)
        place[~new] = self.place[at[~new]] if len(self.names) else 0
        if new.any():
            raw = data.tobytes()
            place[new] = self._learn(names[new], [raw[a:b].decode() for a, b in zip(start[pick[new]].tolist(), end[pick[new]].tolist(), strict=True)])
        return place[back], first, whole

    def _whole(self, text: str | None) -> list[int]:
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if not text or len(text) <= LONG or not self.plain_specials:
            return encode(text or "")
        out: list[int] = []
        for part in self.specials.split(text):
            if len(part) <= LONG:
                out += encode(part)
                continue
            raw = np.frombuffer(part.encode(), np.uint8)
            start = boundaries(raw, np.array([0, len(raw)]))
            cuts = [a for a, _ in by_bytes(np.diff(np.r_[start, len(raw)]), 4 * LONG)]
            ends = [*start[cuts[1:]].tolist(), len(raw)]
            for a, b in zip(start[cuts].tolist(), ends, strict=True):
                out += encode(raw[a:b].tobytes().decode())
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Numbers of tokens."""
        place, first, whole = self.pieces(texts)
        total = np.r_[0, np.cumsum(self.length[place], dtype=np.int64)]
        out = total[first[1:]] - total[first[:-1]]
        for k in whole:
            out[k] = len(self._whole(texts[k].as_py()))
        return out

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        place, first, whole = self.pieces(texts)
        n = self.length[place].astype(np.int64)
        total = np.r_[0, np.cumsum(n)]
        ids = self.pool[np.repeat(self.start[place] - total[:-1], n) + np.arange(total[-1])]
        for k, (a, b) in enumerate(zip(total[first[:-1]].tolist(), total[first[1:]].tolist(), strict=True)):
            yield np.array(self._whole(texts[k].as_py()), np.uint32) if k in whole else ids[a:b]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def balanced(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of about limit bytes of text, and the bytes of each text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in by_bytes(sizes, limit):
        yield batch.slice(a, b - a), sizes[a:b]
    release()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for batch in batches:
            for part, sizes in balanced(batch, 1):
                n = encoder.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
