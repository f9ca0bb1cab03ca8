"""Sum-of-squares online packing of token ids into sequences.

A document's full windows become sequences of their own. Its remainder of s tokens goes to the fill level h (0: a new
window) for which the sum of squared counts of partially filled windows is least after the move; the counts stand in
an array by level. Levels need many documents to match, so a map encodes where the rows lie and one shuffle hands the
pieces, remainders with their ids, to packers of `each` documents, dealt evenly whatever their keys. A packer reads its
pieces as a stream and holds open windows only. When they end, or more than `max_open` windows are open (as when one
size fills the table and nothing fits to it), the open windows are poured: their pieces are laid anew by best fit, the
largest first, the least filled windows are cut to fill the others' gaps, and what is left over is cut at powers of two,
which need no padding. So padding is nil, and few documents are cut beside those longer than a sequence.

`closed_by` tells what closed a piece's sequence: whole (a full window of one document), level, or end. Null text: empty (the closing id alone).
Null or repeated doc_ids: each row is packed by itself. Sequence ids are unique over the table (packer x 2^40 + count).
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.text import release
from tidemark.llm.token_counts import balanced, encoder_for

FAR = np.iinfo(np.int64).max


class LevelPacker:
    """Items are (doc, start, doc_tokens, ids); closed windows come out as lists of them, `by` tells what closed them."""

    def __init__(self, size: int = 2048, max_open: int = 8192) -> None:
        self.size, self.max_open = size, max_open
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = {}
        self.open = 0
        self.by = "level"

    def level(self, s: int) -> int:
        """The fill level that an item of s tokens goes to; of equal ones the fullest."""
        c, size = self.counts, self.size
        best, at = 2 * int(c[s]) + 1, 0
        now = c[1 : size - s + 1]
        if len(now):
            after = c[1 + s : size + 1]
            cost = np.where(now > 0, 2 * (after - now) + 2, FAR)
            if now[-1]:
                cost[-1] = 1 - 2 * now[-1]  # a full window no longer counts
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best and cost[k] < FAR:
                at = k + 1
        return at

    def place(self, item: tuple) -> Iterator[list]:
        s, self.by = len(item[3]), "level"
        h = self.level(s)
        if h:
            window = self.windows[h].pop()
            self.counts[h] -= 1
            self.open -= 1
        else:
            window = []
        window.append(item)
        if h + s == self.size:
            yield window
        else:
            self.windows.setdefault(h + s, []).append(window)
            self.counts[h + s] += 1
            self.open += 1
            if self.open > self.max_open:
                yield from self.pour()

    def pour(self) -> Iterator[list]:
        """Closes all windows: full ones, then one of each power of two that the rest needs."""
        items = sorted((x for h in sorted(self.windows) for w in self.windows[h] for x in w), key=lambda x: -len(x[3]))
        full, left = divmod(sum(len(x[3]) for x in items), self.size)
        self.windows, self.open, self.by = {}, 0, "end"
        self.counts[:] = 0
        laid: list[list] = []
        rooms: list[tuple[int, int]] = []  # of the windows in laid, sorted
        for x in items:
            at = bisect.bisect_left(rooms, (len(x[3]), -1))
            room, k = rooms.pop(at) if at < len(rooms) else (self.size, len(laid))
            if k == len(laid):
                laid.append([])
            laid[k].append(x)
            bisect.insort(rooms, (room - len(x[3]), k))
        loose = [x for _, k in rooms[full:] for x in laid[k]][::-1]

        def take(n: int) -> Iterator[tuple]:
            while n:
                doc, start, tokens, ids = loose.pop()
                yield doc, start, tokens, ids[:n]
                if len(ids) > n:
                    loose.append((doc, start + n, tokens, ids[n:]))
                n -= min(n, len(ids))

        for room, k in rooms[:full]:
            yield [*laid[k], *take(room)]
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                yield list(take(1 << bit))


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, each: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, closed_by of every piece. Counts the documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    packers = max(1, -(-docs.count() // each))
    longs = [pa.int64()] * 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        width = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end, dealt = np.array([end_id], np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            for part, _ in balanced(batch, 1):
                pieces: list[tuple] = []
                row: list[int] = []
                for k, ids in enumerate(encoder.ids(part.column(1))):
                    ids = np.concatenate([ids, end])
                    n = len(ids)
                    for at in range(0, n, size):
                        own, whole = ids[at : at + size], n - at >= size
                        row.append(k)
                        pieces.append((at, len(own), zlib.crc32(own.astype("<u4").tobytes()) if whole else 0, n, None if whole else own.astype(width).tobytes(), dealt))
                        dealt += 1
                cols = list(zip(*pieces, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, [*longs, pa.binary(), pa.int64()], strict=True))], ["doc_id", "start", "length", "crc", "n", "ids", "dealt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = LevelPacker(size), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        id_type = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:-1]), pa.array(cols[-1], pa.string())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed_by"])

        def close(windows: Iterator[list]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, n, ids in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, packer.by))
                    offset += len(ids)
                sequence += 1

        for batch in batches:
            id_type = batch.column(0).type
            for doc, start, length, crc, n, ids, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids is None:
                    rows.append((doc, start, length, crc, n, sequence, 0, "whole"))
                    sequence += 1
                    continue
                close(packer.place((doc, start, n, np.frombuffer(ids, f"<u{len(ids) // length}"))))
            if rows:
                yield out()
            release()
        close(packer.pour())
        if rows:
            yield out()

    pieces = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(encode, f"doc_id {kind}, start long, length long, crc long, n long, ids binary, dealt long")
    form = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed_by string"
    return pieces.repartition(packers, "dealt").mapInArrow(place, form)
