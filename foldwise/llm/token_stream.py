"""Token-ID / binary output: Arrow IPC files whose record batches hold fixed-size lists.

Texts become one stream of ids in ascending id order, cut into sequences of
equal length.  A file holds the stream of one range of ids: column ``ids``
(fixed-size list of uint16, or uint32 beyond 65,536 ids) and column ``mask``
(fixed-size list of bool; false on the padding of a file's last sequence).
Every record batch but the last has the same number of sequences, so sequence
k is row ``k % rows`` of batch ``k // rows``: a reader maps the file and slices,
and copies nothing.  Beside each file lies an Arrow file that says where each
document starts in it.

Spark range-partitions the texts by id and each task streams its partition into
files of its own attempt (a lost task leaves a file that no manifest names).
The manifest, a Parquet table of file paths and counts, is written by Spark.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.bpe import encoder
from foldwise.llm.common import shared_folder, workers_ready

SEQUENCE = 2048
#: sequences in a record batch
BATCH_ROWS = 128


def open_store(uri: str):
    """(pyarrow file system, path) of a folder's or file's URI."""
    from pyarrow import fs
    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class StreamWriter:
    """Takes ids bit by bit and writes equal-length sequences with masks."""

    def __init__(self, uri: str, vocabulary: int, length: int = SEQUENCE, rows: int = BATCH_ROWS):
        import pyarrow as pa
        self.length, self.rows = length, rows
        self.kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        store, path = open_store(uri)
        self.sink = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list = []
        self.n_held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, block: int) -> None:
        """Write what is held in whole blocks; the rest stays held."""
        import pyarrow as pa
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        whole = len(ids) // block * block
        for at in range(0, whole, block):
            self._batch(pa, ids[at:at + block], block)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _batch(self, pa, ids: np.ndarray, n: int) -> None:
        padded = np.zeros(n, dtype=self.kind.to_pandas_dtype())
        padded[:len(ids)] = ids
        mask = np.arange(n) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += len(ids)

    def close(self) -> None:
        import pyarrow as pa
        self._flush(self.length * self.rows)
        if self.n_held:
            rest = np.concatenate(self.held)
            self._batch(pa, rest, -(-len(rest) // self.length) * self.length)
        self.file.close()
        self.sink.close()


class StreamReader:
    """Random access to a file: ``ids(start, n)`` of its stream, ``sequence(k)`` with its mask."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs
        store, path = open_store(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _values(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch.column(0).values.to_numpy(zero_copy_only=True)

    def ids(self, start: int, n: int) -> np.ndarray:
        block, out = self.rows * self.length, []
        while n > 0:
            k, at = divmod(start, block)
            out.append(self._values(k)[at:at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, "<u4")])

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = divmod(k, self.rows)
        columns = self.file.get_batch(batch)
        return tuple(columns.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (0, 1))


def write_token_stream(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                       id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> str:
    """Write the texts' ids (``end_id`` after each) in ascending id order; null ids come
    first, repeated ids in the order in which they are read, a null or empty text is
    ``end_id`` alone, other columns are not read.  Returns the path of the manifest:
    part, path, n_docs, n_tokens."""
    workers_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").drop("row")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc, part, out = encoder(tokenizer_path), TaskContext.get().partitionId(), None
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = start = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/part-{part:07d}-{uuid.uuid4().hex[:8]}.arrow"
                out = StreamWriter(path, enc.tok.get_vocab_size(), length)
                store, place = open_store(path + ".docs")
                index_sink = store.open_output_stream(place)
                index = pa.ipc.new_file(index_sink, index_schema)
            counts = []
            for text in batch.column(1):
                out.add(ids := np.append(enc.encode(text.as_py()), np.uint32(end_id)))
                counts.append(len(ids))
            ends = start + np.cumsum(counts)
            index.write_batch(pa.record_batch(
                [batch.column(0), pa.array(ends - counts), pa.array(counts, pa.int64())], schema=index_schema))
            n_docs, start = n_docs + len(counts), int(ends[-1])
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [start]})

    store, place = open_store(folder)
    store.create_dir(place, recursive=True)
    manifest = f"{folder}/manifest"
    ranged.mapInArrow(write, "part long, path string, n_docs long, n_tokens long").write.parquet(manifest)
    return manifest


def read_token_stream(spark: SparkSession, manifest: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    workers_ready(spark)
    files = spark.read.schema("part long, path string, n_docs long, n_tokens long").parquet(manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        import pyarrow as pa
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = StreamReader(path)
                store, place = open_store(path + ".docs")
                index = pa.ipc.open_file(store.open_input_file(place))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    crc = [zlib.crc32(stream.ids(s, n).astype("<u4").tobytes())
                           for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist())]
                    starts = pa.array(docs.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n_files = max(1, files.count())
    return files.repartition(n_files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_stream_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write a new stream in the shared folder and read it back (see the two above).
    An empty table gives no files and no rows."""
    spark = docs.sparkSession
    return read_token_stream(spark, write_token_stream(
        docs, shared_folder(spark, "token-stream"), tokenizer_path, end_id))
