"""Packed token-id matrices in binary files.

Documents are encoded, ended with one id, and those longer than a row are cut
into full rows and a rest, losslessly. Rests are placed best-fit-decreasing, one
bounded buffer at a time: a segment tree over remaining capacities finds the
fullest open row that still has room in log(row) steps. Rows that are nearly
full are written; others stay open for the next buffer of the task, the fullest
ones only as long as all open rows together hold at most a buffer of ids.

A shard is five little-endian files: ``ids.bin`` (the matrix, unsigned 16-bit
ids if the vocabulary allows, else 32-bit, padded with 0), ``cu.bin`` (32-bit:
each row's cumulative segment lengths from 0), ``rows.bin`` (64-bit: where each
row's begin in it), ``resets.bin`` (64-bit: flat places in the matrix where
position ids restart at 0) and ``segments.arrow`` (doc_id and start of each
segment). A shard is named by its task and number, its files new in each attempt,
and only shards that finished tasks list in the manifest count, so lost executors
and repeated tasks do no harm. ``read_packed`` reads the shards back.

Defined cases: null text is an empty text of one end id; an empty table writes
no shard; repeated rows are segments of their own.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tallyforge.llm import _files, _shared, _tokens, _words

END, PAD = 1, 0
MANIFEST = "shard string, n_rows long, n_segments long, row_tokens long, id_bytes long, n_bytes long"
SEGMENTS = "shard string, row long, segment long, doc_id long, start long, length long, offset long, ids_crc32 long, position_first long"


class CapacityTree:
    """How many open rows have each remaining capacity; finds the least capacity of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int = 1) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, n: int) -> int | None:
        at, count = n + self.size, self.count
        if count[at]:
            return n
        while at > 1:  # up until a right sibling has rows
            if not at & 1 and count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:  # down to its leftmost
            at *= 2
            if not count[at]:
                at += 1
        return at - self.size


class Rows:
    """Rows of ``width`` ids being filled best-fit-decreasing."""

    def __init__(self, width: int, nearly: int, most: int):
        """most: ids that the open rows may hold between two calls of add."""
        self.width, self.nearly, self.most, self.held = width, nearly, most, 0
        self.tree, self.open, self.full = CapacityTree(width), {}, []

    def add(self, segments: list[tuple[int, int, int]]) -> None:
        """Places (document, start, length) of at most a row, longest first."""
        for segment in sorted(segments, key=lambda x: (-x[2], x[0], x[1])):
            n = segment[2]
            room = self.tree.least(n)
            if room is None:
                room, row = self.width, []
            else:
                row = self._take(room)
            row.append(segment)
            if room - n <= self.nearly:
                self.full.append(row)
            else:
                self.open.setdefault(room - n, []).append(row)
                self.tree.add(room - n)
                self.held += self.width - (room - n)
        while self.held > self.most:
            self.full.append(self._take(self.tree.least(0)))

    def _take(self, room: int) -> list[tuple[int, int, int]]:
        self.tree.add(room, -1)
        self.held -= self.width - room
        return self.open[room].pop()

    def take(self, everything: bool = False) -> list[list[tuple[int, int, int]]]:
        out, self.full = self.full, []
        if everything:
            out += [row for room in sorted(self.open) for row in self.open[room]]
            self.open, self.tree, self.held = {}, CapacityTree(self.width), 0
        return out


def _shard(name: str, rows: list, held: dict, width: int, kind: str) -> tuple:
    """Writes the files of some rows; the manifest's row."""
    matrix = np.full((len(rows), width), PAD, kind)
    cu, begin, resets, ids, starts = [], [0], [], [], []
    for r, row in enumerate(rows):
        at = 0
        cu.append(0)
        for number, start, n in row:
            doc_id, tokens = held[number][:2]
            matrix[r, at : at + n] = tokens[start : start + n]
            resets.append(r * width + at)
            ids.append(doc_id)
            starts.append(start)
            at += n
            cu.append(at)
            held[number][2] -= n
            if not held[number][2]:
                del held[number]
        begin.append(len(cu))
    sink = io.BytesIO()
    segments = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64())})
    with pa.ipc.new_file(sink, segments.schema) as out:
        out.write_table(segments)
    files = {
        "ids.bin": matrix.tobytes(), "cu.bin": np.array(cu, "<i4").tobytes(), "rows.bin": np.array(begin, "<i8").tobytes(),
        "resets.bin": np.array(resets, "<i8").tobytes(), "segments.arrow": sink.getvalue(),
    }
    for suffix, data in files.items():
        _files.write(f"{name}.{suffix}", data)
    return name, len(rows), len(ids), width, matrix.itemsize, sum(map(len, files.values()))


def write_packed(docs: DataFrame, folder: str, *, width: int = 2048, tokenizer: str | None = None, buffer_tokens: int = 4_000_000, wide: bool = False) -> DataFrame:
    """Writes shards under ``folder``; the manifest, a row for each shard. ``wide``: 32-bit ids."""
    path, kind = tokenizer or _tokens.default_path(), "<u4" if wide else "<u2"

    def run(batches):
        rows, held, waiting, n_waiting, number, n_shards = Rows(width, width // 64, buffer_tokens), {}, [], 0, 0, 0
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex

        def flush(everything: bool):
            nonlocal n_shards
            rows.add(waiting)
            taken = rows.take(everything)
            most, listed = max(1, buffer_tokens // width), []
            for i in range(0, len(taken), most):
                listed.append(_shard(f"{folder}/{task:06d}-{n_shards:06d}-{attempt}", taken[i : i + most], held, width, kind))
                n_shards += 1
            if listed:
                names = [x.split()[0] for x in MANIFEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*listed, strict=True)], names=names)

        for batch in batches:
            ids = _words.column(batch, "doc_id").to_pylist()
            for first, flat, of in _tokens.encoded(_words.column(batch, "text"), path):
                if not wide and len(flat) and flat.max() >= 1 << 16:
                    raise ValueError("the vocabulary needs wide=True")
                for d in range(len(of) - 1):
                    tokens = np.append(flat[of[d] : of[d + 1]], np.uint32(END)).astype(kind)
                    held[number] = [ids[first + d], tokens, len(tokens)]
                    waiting += [(number, s, min(width, len(tokens) - s)) for s in range(0, len(tokens), width)]
                    n_waiting, number = n_waiting + len(tokens), number + 1
                if n_waiting >= buffer_tokens:
                    yield from flush(False)
                    waiting, n_waiting = [], 0
        yield from flush(True)

    _files.make_folder(folder)
    return _shared.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_shard(shard: str, width: int, id_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """The matrix, cumulative lengths, where each row's begin, position resets and segments."""
    matrix = np.frombuffer(_files.read(f"{shard}.ids.bin"), f"<u{id_bytes}").reshape(-1, width)
    cu, rows, resets = (np.frombuffer(_files.read(f"{shard}.{x}.bin"), k) for x, k in (("cu", "<i4"), ("rows", "<i8"), ("resets", "<i8")))
    return matrix, cu, rows, resets, pa.ipc.open_file(_files.read(f"{shard}.segments.arrow")).read_all()


def read_packed(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per segment, from the files: its row and place, and the checksum of its ids as 32-bit numbers."""

    def run(batches):
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        for batch in batches:
            for shard, width, id_bytes in zip(*(_words.column(batch, c).to_pylist() for c in ("shard", "row_tokens", "id_bytes")), strict=True):
                matrix, cu, begin, resets, segments = read_shard(shard, width, id_bytes)
                out, k = [], 0
                ids, starts = segments["doc_id"].to_pylist(), segments["start"].to_pylist()
                for r in range(len(matrix)):
                    own = cu[begin[r] : begin[r + 1]].tolist()
                    row = matrix[r].astype("<u4")
                    for s, (a, b) in enumerate(zip(own, own[1:], strict=False)):
                        out.append((shard.rsplit("/", 1)[-1].rsplit("-", 1)[0], r, s, ids[k], starts[k], b - a, a, zlib.crc32(row[a:b].tobytes()), int(resets[k]) - r * width))
                        k += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)

    return manifest.select("shard", "row_tokens", "id_bytes").repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, SEGMENTS)
