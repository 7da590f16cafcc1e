"""Packing examples into sequences by vector bin packing.

An example has three sizes: its tokens, one segment, and its loss-bearing tokens
(those after its prompt).  A sequence limits all three.  The dot-product
heuristic fills one sequence at a time: of the waiting pieces that fit, it takes
the one whose sizes have the largest dot product with the room that is left, so
that a piece goes where its shape fits what remains.  A gap that no waiting
piece fits is closed by cutting one.

Each Spark task packs the examples of its own partition as they stream by and
holds a bounded pool of pieces; there is no shuffle, and no group to be large.
The sequences left at the end of a partition, and those that their segments or
loss-bearing tokens fill long before their tokens do, are cut at powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.bpe import MEMO_WORDS, encoder
from foldwise.llm.common import workers_ready


@dataclass(frozen=True)
class Limits:
    """Of a sequence.  ``min_cut``: a smaller gap is left as padding."""
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    min_cut: int = 16


#: a sequence that other limits than the tokens' close is cut at a power of two if more than this part
#: of it would be padding
MOST_PADDING = 16
#: pieces that a task holds while it packs, and examples after which it gives out what it placed
POOL, FLUSH = 1024, 256

PLACEMENT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
             "sequence_id long, offset long")


class Packer:
    """Streaming packer; ``add`` and ``finish`` return placed pieces as tuples
    (example, start, ids, loss tokens, sequence, offset)."""

    def __init__(self, limits: Limits, pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.pool = limits, pool
        self.pieces: list = [None] * (2 * pool)  # (example, start, ids, prompt tokens)
        self.size = np.zeros((2 * pool, 2), dtype=np.int64)  # tokens, loss; tokens 0: a free slot
        self.free = list(range(2 * pool - 1, -1, -1))
        self.total = self.sequence = 0

    def _wait(self, example, start, ids, prompt) -> None:
        slot = self.free.pop()
        self.pieces[slot] = (example, start, ids, prompt)
        self.size[slot] = len(ids), len(ids) - prompt
        self.total += len(ids)

    def _head(self, tokens: int, loss: int, prompt: int) -> int:
        """Tokens of the longest head within both limits."""
        return min(tokens, prompt + loss)

    def add(self, example, ids: np.ndarray, prompt: int = 0) -> list:
        """An example's ids, of which the first ``prompt`` bear no loss."""
        placed, start, prompt = [], 0, min(prompt, len(ids))
        while len(ids) > (n := self._head(self.limits.tokens, self.limits.loss, prompt)) or n == self.limits.tokens == len(ids):
            placed.append((example, start, ids[:n], max(0, n - prompt), self.sequence, 0))
            self.sequence += 1
            start, ids, prompt = start + n, ids[n:], max(0, prompt - n)
        if len(ids):
            self._wait(example, start, ids, prompt)
        while len(self.free) <= self.pool:  # fill from a full pool, so there is a choice
            placed += self._fill(self.limits.tokens, self.limits.min_cut)
        return placed

    def finish(self) -> list:
        placed = []
        while self.total:
            whole = self.total >= self.limits.tokens
            room = self.limits.tokens if whole else 1 << (self.total.bit_length() - 1)
            placed += self._fill(room, self.limits.min_cut if whole else 1)
        return placed

    def _fill(self, room: int, min_cut: int) -> list:
        """Fill and close one sequence of up to ``room`` tokens."""
        lim, placed, offset = self.limits, [], 0
        left = np.array([room, lim.loss], dtype=np.int64)
        segments = lim.segments
        scale = np.array([lim.tokens, lim.loss], dtype=np.float64) ** 2
        while segments and left[0]:
            size = self.size
            fits = (size[:, 0] > 0) & (size[:, 0] <= left[0]) & (size[:, 1] <= left[1])
            if fits.any():
                # the segment's share of the dot product is the same for every piece
                dot = np.where(fits, size @ (left / scale), -1.0)
                slot = int(dot.argmax())
                example, start, ids, prompt = self.pieces[slot]
                self._leave(slot)
            else:
                waiting = np.flatnonzero(size[:, 0])
                if not len(waiting) or left[0] < min_cut:
                    break
                slot = int(waiting[size[waiting, 0].argmax()])
                example, start, ids, prompt = self.pieces[slot]
                n = self._head(int(left[0]), int(left[1]), prompt)
                if n < min(min_cut, len(ids)):
                    break
                self._leave(slot)
                self._wait(example, start + n, ids[n:], max(0, prompt - n))
                ids, prompt = ids[:n], min(prompt, n)
            loss = len(ids) - prompt
            placed.append((example, start, ids, loss, self.sequence, offset))
            offset += len(ids)
            left -= (len(ids), loss)
            segments -= 1
        if offset < room - room // MOST_PADDING:  # another limit closed it: end at a power of two, without padding
            self._trim(placed, offset - (1 << (offset.bit_length() - 1)))
        self.sequence += 1
        return placed

    def _trim(self, placed: list, over: int) -> None:
        """Take the last ``over`` tokens of a sequence's pieces back."""
        while over:
            example, start, ids, loss, sequence, offset = placed.pop()
            n = max(0, len(ids) - over)
            prompt = len(ids) - loss
            self._wait(example, start + n, ids[n:], max(0, prompt - n))
            over -= len(ids) - n
            if n:
                placed.append((example, start, ids[:n], max(0, n - prompt), sequence, offset))

    def _leave(self, slot: int) -> None:
        self.total -= int(self.size[slot, 0])
        self.size[slot] = 0
        self.pieces[slot] = None
        self.free.append(slot)


def pack_texts(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(),
               id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
               memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pack the ids of every text, ``end_id`` after them, into sequences.

    ``prompt_col`` names a column with an example's prompt, whose ids come first
    and bear no loss (null: no prompt).  A row per piece, columns as in
    ``PLACEMENT``: ``start`` is the piece's place in its example, ``offset`` its
    place in its sequence.  A null or empty text is ``end_id`` alone; null and
    repeated ids are examples like any other; other columns are not read; an
    empty table has no rows.  The same partitions give the same placement.
    """
    workers_ready(docs.sparkSession)
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       prompt.alias("prompt"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc, packer = encoder(tokenizer_path, memo_words), Packer(limits)
        first = TaskContext.get().partitionId() << 36
        names = [c.split()[0] for c in PLACEMENT.split(", ")]

        def rows_of(placed):
            cols = [(e[0], s, len(ids), zlib.crc32(ids.tobytes()), e[1], loss, first + q, at)
                    for e, s, ids, loss, q, at in placed]
            for at in range(0, len(cols), 10_000):
                values = [pa.array(c, pa.int64()) for c in zip(*cols[at:at + 10_000])]
                yield pa.RecordBatch.from_arrays(values, names=names)

        for batch in batches:
            placed = []
            for n, (key, text, lead) in enumerate(zip(*(batch.column(i) for i in range(3))), 1):
                before = enc.encode(lead.as_py())
                ids = np.concatenate([before, enc.encode(text.as_py()), np.array([end_id], "<u4")])
                placed += packer.add((key.as_py(), len(ids)), ids, len(before))
                if n % FLUSH == 0 or n == batch.num_rows:
                    yield from rows_of(placed)
                    placed = []
        yield from rows_of(packer.finish())

    return rows.mapInArrow(pack, PLACEMENT)
