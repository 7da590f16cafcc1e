"""Sorted arrays in the shared folder: written by the tasks that hold a bucket of
keys, mapped into memory by the tasks that look keys up.

A table is cut into buckets by a hash of its keys.  Tasks pre-aggregate what they
have seen in bounded buffers and send one packed row a bucket and buffer; a bucket's
task merges the rows as they come (its memory holds the bucket's distinct keys and
one buffer), writes a file of sorted keys and values, and sends on a row that names
the file.  Files carry the attempt in their names, so a task that runs twice leaves
a file that nobody names.  A reader maps a bucket's file when it is first asked for
a key of it; where the shared folder is no local path, it copies the file into a
temporary one, maps that, and unlinks it at once.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections import OrderedDict

import numpy as np

from foldwise.llm.token_stream import open_store

#: files that a worker holds mapped
OPEN_FILES = 512
#: numbers of fewer bytes first; the code of a packed column is its place here
KINDS = ("<u1", "<u2", "<u4", "<u8")
ZEROS, RUNS = 254, 255

_OPEN: OrderedDict = OrderedDict()


def smallest(values: np.ndarray) -> int:
    """Place of the narrowest kind that holds the values (not negative)."""
    top = int(values.max()) if len(values) else 0
    return 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3


def _packed(values: np.ndarray) -> bytes:
    values = np.asarray(values).astype(np.uint64, copy=False)
    if not values.any():
        return bytes([ZEROS])
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    if 3 * len(starts) < 2 * len(values):
        return bytes([RUNS]) + len(starts).to_bytes(8, "little") + _packed(values[starts]) + _packed(
            np.diff(np.r_[starts, len(values)]))
    kind = smallest(values)
    return bytes([kind]) + values.astype(KINDS[kind]).tobytes()


def _unpacked(raw: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    code = raw[at]
    at += 1
    if code == ZEROS:
        return np.zeros(n, np.uint64), at
    if code == RUNS:
        runs = int.from_bytes(raw[at:at + 8], "little")
        values, at = _unpacked(raw, at + 8, runs)
        lengths, at = _unpacked(raw, at, runs)
        return np.repeat(values, lengths.astype(np.int64)), at
    kind = np.dtype(KINDS[code])
    end = at + n * kind.itemsize
    return np.frombuffer(raw[at:end], kind).astype(np.uint64), end


def pack(columns: list) -> bytes:
    """Columns of numbers from 0 on, equally long, each in its narrowest kind, or as runs."""
    return len(columns[0]).to_bytes(8, "little") + b"".join(map(_packed, columns))


def unpack(raw: bytes) -> list[np.ndarray]:
    view = memoryview(raw)
    n, at, out = int.from_bytes(view[:8], "little"), 8, []
    while at < len(view):
        values, at = _unpacked(view, at, n)
        out.append(values)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finalizer of splitmix64)."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """0 to buckets - 1, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def write_arrays(folder: str, bucket: int, columns: dict) -> str:
    """A new file of the folder with these columns (numbers from 0 on), in one record batch; its path."""
    import pyarrow as pa
    path = f"{folder}/{bucket:07d}-{uuid.uuid4().hex[:12]}.arrow"
    store, place = open_store(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    narrow = {k: pa.array(v.astype(KINDS[smallest(v)], copy=False)) for k, v in columns.items()}
    batch = pa.RecordBatch.from_pydict(narrow)
    with store.open_output_stream(place) as sink, pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return path


def read_arrays(path: str) -> dict:
    """The columns of a file, mapped; kept open for the next call."""
    import pyarrow as pa
    from pyarrow import fs
    if path in _OPEN:
        _OPEN.move_to_end(path)
        return _OPEN[path]
    store, place = open_store(path)
    if not isinstance(store, fs.LocalFileSystem):
        with tempfile.NamedTemporaryFile() as local:  # mapped below, gone with the mapping
            with store.open_input_stream(place) as source:
                shutil.copyfileobj(source, local, 1 << 20)
            local.flush()
            mapped = pa.memory_map(local.name)
    else:
        mapped = pa.memory_map(place)
    table = pa.ipc.open_file(mapped)
    batch = table.get_batch(0)
    _OPEN[path] = {name: batch.column(i).to_numpy(zero_copy_only=True) for i, name in enumerate(table.schema.names)}
    while len(_OPEN) > OPEN_FILES:
        _OPEN.popitem(last=False)
    return _OPEN[path]


class SortedTable:
    """``lookup`` in the files of a table; ``paths`` by bucket, a bucket without keys has none."""

    def __init__(self, paths: dict, buckets: int):
        self.paths, self.buckets = paths, buckets

    def lookup(self, keys: np.ndarray, hashes: np.ndarray, names: list) -> list[np.ndarray]:
        """Values of ``names`` for each key, 0 where the table doesn't have it.  ``keys`` are
        distinct and sorted within each bucket that ``hashes`` gives."""
        out = [np.zeros(len(keys), np.uint64) for _ in names]
        of = bucket_of(hashes, self.buckets)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True]) if len(of) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            rows = order[lo:hi]
            path = self.paths.get(int(of[rows[0]]))
            if path is None:
                continue
            table, asked = read_arrays(path), keys[rows]
            at = np.minimum(np.searchsorted(table["key"], asked), len(table["key"]) - 1)
            hit = table["key"][at] == asked
            for values, name in zip(out, names):
                values[rows[hit]] = table[name][at[hit]]
        return out
