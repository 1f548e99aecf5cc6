"""Vector bin packing of token sequences.

An example is a vector: tokens, segments and loss-bearing tokens, which are its
last ones (the answer after the instruction or prompt). A sequence holds at most
a given sum of each. Within a task, examples of a bounded buffer are taken
longest first into the open sequence whose remaining room has the largest dot
product with the example, both as shares of the limits, so an example goes where
it uses up what is scarce in proportion, however many are open. Sequences close
when they are full, and the fullest closes when a further one must be opened
beyond ``most_open``, which bounds the ids held in open ones; they are carried
from batch to batch, so a task leaves only its last ones unfilled.

Examples longer than a sequence (with ``cut``, of too many loss-bearing tokens
too) are cut: full sequences first, the rest is packed. With ``cut``, an example that fits nowhere also fills the rest of the
fullest open sequence and continues as an example of what is left; so padding
stays in the last sequences of a task. Tasks are the input's partitions: nothing
shuffles, and one task holds one buffer.

Defined cases: null text is an empty text, whose one token is the end; an empty
table gives no rows; repeated rows are packed as rows of their own; without
``cut``, an example that alone breaks the limit of loss-bearing tokens stands
alone; a null number of loss-bearing tokens means all but the prompt's, others
are held between 0 and the document's tokens; the end token is no prompt.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tallyforge.llm import _tokens, _words

END = 1


def _part(tokens: int, loss: int, n: int) -> int:
    """Loss-bearing tokens among the first n, where the last ``loss`` tokens bear loss."""
    return max(0, n - (tokens - loss))


class Packer:
    """Places examples one buffer at a time. limits: tokens, segments, loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, most_open: int = 256):
        self.limits, self.cut, self.most_open = np.array(limits, np.float64), cut, most_open
        self.rooms = np.zeros((0, 3))
        self.open: list[list[tuple[int, int, int, int]]] = []
        self.closed: list[list[tuple[int, int, int, int]]] = []

    def _put(self, at: int, piece: tuple[int, int, int, int]) -> None:
        self.open[at].append(piece)
        self.rooms[at] -= (piece[2], 1, piece[3])
        if self.rooms[at].min() < 1:  # no room for one more token, segment or loss-bearing token
            self._close(at)

    def _close(self, at: int) -> None:
        self.closed.append(self.open.pop(at))
        self.rooms = np.delete(self.rooms, at, axis=0)

    def _new(self) -> int:
        if len(self.open) >= self.most_open:
            self._close(int((self.rooms / self.limits).min(axis=1).argmin()))
        self.open.append([])
        self.rooms = np.vstack([self.rooms, self.limits])
        return len(self.open) - 1

    def _best(self, tokens: int, loss: int) -> int | None:
        """The open sequence with the largest dot product of those with room; among equals the fullest."""
        need = np.array([tokens, 1, loss], np.float64)
        fits = np.flatnonzero((self.rooms >= need).all(axis=1))
        if not len(fits):
            return None
        score = (self.rooms[fits] / self.limits) @ (need / self.limits)
        fits = fits[score == score.max()]
        return int(fits[self.rooms[fits, 0].argmin()])

    def add(self, examples: list[tuple[int, int, int, int]]) -> None:
        """Places (example, start, tokens, loss-bearing tokens), longest first."""
        most, most_loss = int(self.limits[0]), int(self.limits[2])
        for example, start, tokens, loss in sorted(examples, key=lambda x: (-x[2], x[0], x[1])):
            while tokens > most or (self.cut and loss > most_loss):
                n = min(most, tokens - loss + most_loss) if self.cut else most
                part = _part(tokens, loss, n)
                self._put(self._new(), (example, start, n, part))
                start, tokens, loss = start + n, tokens - n, loss - part
            best = self._best(tokens, loss)
            if best is not None:
                self._put(best, (example, start, tokens, loss))
            elif self.cut and len(self.open) >= self.most_open and self.rooms[:, 0].min() < tokens and self._divide((example, start, tokens, loss)):
                continue
            else:
                self._put(self._new(), (example, start, tokens, loss))

    def _divide(self, piece: tuple[int, int, int, int]) -> bool:
        """Fills the fullest open sequence with the piece's start and places its rest."""
        example, start, tokens, loss = piece
        at = int(self.rooms[:, 0].argmin())
        n = int(min(self.rooms[at, 0], tokens - 1, tokens - loss + self.rooms[at, 2]))
        if n < 1 or self.rooms[at, 1] < 1:
            return False
        part = _part(tokens, loss, n)
        self._put(at, (example, start, n, part))
        self.add([(example, start + n, tokens - n, loss - part)])
        return True

    def _deal_out(self, at: int) -> bool:
        """Deals the pieces of one open sequence to the others, cut where they must be; False, and nothing done, if they don't hold them."""
        before = [list(x) for x in self.open], self.rooms.copy(), len(self.closed)
        pieces = self.open.pop(at)
        self.rooms = np.delete(self.rooms, at, axis=0)
        for example, start, tokens, loss in pieces:
            while tokens:
                able = np.flatnonzero(tokens - loss + self.rooms[:, 2] >= 1)
                if not len(able):
                    self.open, self.rooms = before[:2]
                    del self.closed[before[2] :]
                    return False
                to = int(able[self.rooms[able, 0].argmin()])
                n = int(min(tokens, self.rooms[to, 0], tokens - loss + self.rooms[to, 2]))
                part = _part(tokens, loss, n)
                self._put(to, (example, start, n, part))
                start, tokens, loss = start + n, tokens - n, loss - part
        return True

    def finish(self) -> None:
        """Closes what is open; with ``cut``, fills the fuller ones from the emptiest first."""
        while self.cut and len(self.open) > 1 and self._deal_out(int(self.rooms[:, 0].argmax())):
            pass
        self.closed += self.open
        self.open, self.rooms = [], np.zeros((0, 3))

    def take(self) -> list[list[tuple[int, int, int, int]]]:
        """The sequences that have closed since the last call."""
        out, self.closed = self.closed, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(docs: DataFrame, *, tokens: int = 2048, segments: int = 64, loss: int = 2048, loss_tokens: Column | str | None = None, prompt_tokens: int = 0, tokenizer: str | None = None, buffer_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece of a document (doc_id, text): where it starts and how long it is, its sequence and place in it.

    loss_tokens: how many tokens at a document's end bear loss, the end token among them (default: all but its first ``prompt_tokens``). A buffer holds ``buffer_tokens`` ids.
    """
    path = tokenizer or _tokens.default_path()

    def run(batches):
        packer = Packer((tokens, segments, loss), cut=True)
        base, n_sequences = TaskContext.get().partitionId() << 36, 0
        held: dict[int, tuple] = {}  # example: its id, token ids and pieces still to come
        waiting, n_waiting, number = [], 0, 0

        def rows():
            nonlocal n_sequences
            out = []
            for pieces in packer.take():
                offset = 0
                for example, start, n, bear in pieces:
                    doc_id, ids = held[example][:2]
                    out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + n_sequences, offset, bear))
                    offset += n
                    held[example][2] -= n
                    if not held[example][2]:
                        del held[example]
                n_sequences += 1
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=_NAMES)

        for batch in batches:
            names, bearing = _words.column(batch, "doc_id").to_pylist(), _words.column(batch, "loss").to_pylist()
            for first, flat, of in _tokens.encoded(_words.column(batch, "text"), path):
                for d in range(len(of) - 1):
                    ids = np.append(flat[of[d] : of[d + 1]], np.uint32(END)).astype("<u4")
                    held[number] = [names[first + d], ids, len(ids)]
                    own = bearing[first + d]
                    waiting.append((number, 0, len(ids), max(len(ids) - prompt_tokens, 1) if own is None else min(max(own, 0), len(ids))))
                    n_waiting, number = n_waiting + len(ids), number + 1
                if n_waiting >= buffer_tokens:
                    packer.add(waiting)
                    waiting, n_waiting = [], 0
                    if out := rows():
                        yield batch_of(out)
        packer.add(waiting)
        packer.finish()
        if out := rows():
            yield batch_of(out)

    bears = F.lit(None) if loss_tokens is None else F.col(loss_tokens) if isinstance(loss_tokens, str) else loss_tokens
    return docs.select(F.col("doc_id").cast("long"), "text", bears.cast("long").alias("loss")).mapInArrow(run, SCHEMA)
