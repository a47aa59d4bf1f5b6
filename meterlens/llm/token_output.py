"""Token ids of documents as files of range-coded blocks, and reading them back.

Documents are dealt out by ranges of their id, so that the files in order hold them in
ascending order. A task streams its documents: Python gathers ids until a run of blocks
is full, the JVM codes it (see jvm_coder.py), Python writes it; memory holds a few runs. A
file ends with its documents' ids and lengths and a footer. Beside the files stands a
manifest: the files of the tasks that succeeded, in order, with the ids they hold. It is
written last, so a folder without it holds nothing that can be read. Reading goes the same
way back, a run of blocks at a time.

A file: MAGIC, blocks (four 32-bit numbers: ids, bytes of code, crc32 of the ids, crc32
of the code; then the code), the zlib-compressed index (per document: id, whether it is
null, length), and the footer (place and bytes of the index, blocks, ids, MAGIC). All
numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, new_folder, stored, values
from .jvm_coder import decoded, encoded
from .range_coder import BLOCK
from .tokens import encoder

MAGIC = b"IDBLOCK1"
HEAD, FOOT = struct.Struct("<IIII"), struct.Struct("<QQQQ8s")
#: Ids that are coded at once, and about as many bytes of code are read at once.
RUN = 64 * BLOCK
END_ID = 2
MANIFEST = "_manifest.json"


class Index:
    """Ids and lengths of documents, in the layout of a file's index."""

    def __init__(self) -> None:
        self.docs, self.null, self.lengths = [], [], []

    def add(self, doc: int | None, length: int) -> None:
        self.docs.append(doc or 0)
        self.null.append(doc is None)
        self.lengths.append(length)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.docs, "<i8"), np.array(self.null, np.uint8), np.array(self.lengths, "<i8")


def _packed(docs: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    return docs.tobytes() + null.tobytes() + lengths.tobytes()


def _unpacked(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 17
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)


def _ending(size: int, docs: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index and footer of a file whose blocks end at this place."""
    index, total = zlib.compress(_packed(docs, null, lengths)), int(lengths.sum())
    return index + FOOT.pack(size, len(index), -(-total // BLOCK), total, MAGIC)


def _batch(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns.values()], names=list(columns))


def _ids(tokenizer: str, end_id: int):
    """Runs of ids (all but the last full), each with the index of the documents that end in it or were the last to begin."""
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many, index = encoder(tokenizer), [], 0, Index()

        def row(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal index
            done, index = index, Index()
            return _batch(ids=([ids.tobytes()], pa.binary()), index=([_packed(*done.arrays())], pa.binary()))

        for batch in batches:
            for doc, ids in zip(values(batch.column(0)), own.encode(values(batch.column(1)))):
                held += [ids, tail]
                many += len(ids) + 1
                index.add(doc, len(ids) + 1)
                if many >= RUN:
                    joined = np.concatenate(held).astype("<u4", copy=False)
                    for first in range(0, many - RUN + 1, RUN):
                        yield row(joined[first : first + RUN])
                    many %= RUN
                    held = [joined[len(joined) - many :].copy()]
        if many or index.docs:
            yield row(np.concatenate(held).astype("<u4", copy=False))

    return run


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        name, out, size, parts = f"ids-{uuid.uuid4().hex}.bin", None, len(MAGIC), []
        for batch in batches:
            for blocks, index in zip(batch.column(0), batch.column(1)):
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(MAGIC)
                out.write(blocks.as_buffer())
                size += blocks.as_buffer().size
                parts.append(_unpacked(index.as_py()))
        if out is not None:
            docs, null, lengths = (np.concatenate(c) for c in zip(*parts))
            total = int(lengths.sum())
            out.write(_ending(size, docs, null, lengths))
            out.close()
            long, text = pa.int64(), pa.string()
            yield _batch(part=([TaskContext.get().partitionId()], long), name=([name], text), ids=([total], long), docs=([len(docs)], long), blocks=([-(-total // BLOCK)], long), bytes=([size], long))

    return run


def write_token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> list[dict]:
    """Writes docs in ascending order of their id and returns the manifest: a row per file with name, ids, docs, blocks, bytes.

    Null ids come first; rows of one id are in the order of their text's hash, so that
    many of them need not go to one task. A null or empty text is its end id alone. An
    empty table writes a manifest without files. A folder that has a manifest already is refused.
    """
    bounded_batches(docs.sparkSession)
    store, folder = file_system(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type.name != "NotFound":
        raise ValueError(f"{path} holds token ids already")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    mixed = F.xxhash64("text")
    own = own.repartitionByRange("doc", mixed).sortWithinPartitions("doc", mixed, "text")
    runs = own.mapInArrow(_ids(tokenizer, end_id), "ids binary, index binary").select(encoded(docs.sparkSession, F.col("ids")).alias("blocks"), "index")
    files = stored(runs.mapInArrow(_write(path), "part long, name string, ids long, docs long, blocks long, bytes long"), "id-files")
    manifest = [r.asDict() for r in sorted(files.collect())]
    for r in manifest:
        del r["part"]
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_blocks(file) -> Iterator[tuple[bytes, bytes]]:
    """Runs of a file's blocks, each with the part of the index whose documents end in it."""
    size = file.size()
    if size < len(MAGIC) + FOOT.size or file.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a file of token-id blocks")
    at, length, blocks, total, magic = FOOT.unpack(file.read_at(FOOT.size, size - FOOT.size))
    if magic != MAGIC:
        raise ValueError("the file of token-id blocks is cut short")
    docs, null, lengths = _unpacked(zlib.decompress(file.read_at(length, at)))
    ends = np.cumsum(lengths)
    place, rest, ids, listed = len(MAGIC), b"", 0, 0
    while place < at:
        more = file.read_at(min(RUN, at - place), place)
        place += len(more)
        rest, end = rest + more, 0
        while end + HEAD.size <= len(rest):
            many, code, _, _ = HEAD.unpack_from(rest, end)
            if end + HEAD.size + code > len(rest):
                break
            end += HEAD.size + code
            ids += many
            blocks -= 1
        if end:
            upto = int(np.searchsorted(ends, ids, side="right"))
            yield rest[:end], _packed(docs[listed:upto], null[listed:upto], lengths[listed:upto])
            rest, listed = rest[end:], upto
    if rest or blocks or ids != total or listed != len(docs) or total != (ends[-1] if len(ends) else 0):
        raise ValueError("the index does not cover the blocks")


def _read(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with store.open_input_file(f"{folder}/{names[k]}") as file:
                    for blocks, index in read_blocks(file):
                        yield _batch(file=([k], pa.int64()), blocks=([blocks], pa.binary()), index=([index], pa.binary()))

    return run


def _digests(starts: list[int]):
    """A row per document of runs of ids, which come file by file; a document may go on from run to run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, crc, have = None, 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for k, raw, index in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if k != now:
                    now, at = k, starts[k]
                ids, place = memoryview(raw.as_buffer()), 0
                for doc, none, length in zip(*(x.tolist() for x in _unpacked(index.as_py()))):
                    end = place + 4 * (length - have)
                    rows.append((None if none else doc, at, length, zlib.crc32(ids[place:end], crc)))
                    place, at, crc, have = end, at + length, 0, 0
                crc, have = zlib.crc32(ids[place:], crc), have + (len(ids) - place) // 4
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files that the manifest lists: id, start, n_tokens, ids_crc32. A task reads one file."""
    bounded_batches(spark)
    store, folder = file_system(path)
    with store.open_input_file(f"{folder}/{MANIFEST}") as file:
        listed = json.loads(file.read())
    starts, at = [], 0
    for r in listed:
        starts.append(at)
        at += r["ids"]
    files = spark.range(0, len(listed), 1, max(1, len(listed)))
    runs = files.mapInArrow(_read(path, [r["name"] for r in listed]), "file long, blocks binary, index binary").select("file", decoded(spark, F.col("blocks")).alias("ids"), "index")
    return runs.mapInArrow(_digests(starts), "doc long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc", id_col)


def token_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """docs written as token ids and read back. Nulls, empties and repeats as in write_token_ids(); an empty table gives an empty result; other columns are ignored."""
    path = new_folder(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, id_col, text_col, tokenizer)
    return read_token_ids(docs.sparkSession, path, id_col)
