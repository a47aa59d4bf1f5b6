"""WARC archives as a PySpark data source, and writing pages as responses and revisits.

Reading: files are planned into partitions of about equal size. A record's headers are
parsed first; conditions on its type, ids, address or digest that Spark pushes down are
decided on them, and the payload of a record that fails, or of any record if the schema
asks for no ``payload``, is skipped without decoding. Records are gzip members of their
own; members written here name their length in the gzip header (extra field ``SL``), so
skipping is a seek. Other archives, compressed by record or plain, read as well.

Writing: each task writes files of its own; the commit lists those of the attempts that
succeeded in ``_manifest.json``, and only listed files are read where there is a list.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import file_system, new_folder, stored, values

SCHEMA = "type string, record_id string, target_uri string, date string, refers_to string, digest string, content_type string, payload_length long, headers map<string,string>, payload binary"
#: Columns that conditions are pushed down to, with their header.
HEADERS = {"type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "digest": "warc-payload-digest", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES, FILE_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 256 << 20, 1000, 8 << 20
LEVEL = 6


def member(record: bytes) -> bytes:
    """A gzip member that names its own length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + b"\x08\0SL\x04\0" + size.to_bytes(4, "little") + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(kind: str, record_id: str | None, uri: str | None, date: str | None, refers_to: str | None, digest: str | None, content_type: str | None, length: int, payload: bytes | None) -> bytes:
    """One record. Its block is an HTTP response, of which a revisit has the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type or 'text/html; charset=utf-8'}\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date or '1970-01-01T00:00:00Z'}"]
    for name, value in (("WARC-Record-ID", f"<{record_id}>" if record_id else None), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None), ("WARC-Profile", PROFILE if kind == "revisit" else None)):
        if value is not None:
            lines.append(f"{name}: {' '.join(value.split())}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Headers by lower-case name; angle brackets around ids go."""
    out, last = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            value = value.strip()
            out[last] = value[1:-1] if last in ("warc-record-id", "warc-refers-to") and value[:1] == "<" and value[-1:] == ">" else value
    return out


def _split(data: bytes) -> tuple[bytes, int] | None:
    """The head and where the block begins, once the head is complete."""
    end = data.find(b"\r\n\r\n")
    return None if end < 0 else (data[:end], end + 4)


class _Source:
    """A file with read-ahead; forgets what was skipped."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def need(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.file.read_at(max(n - len(self.held), 1 << 16, len(self.held)), self.at + len(self.held)) if self.at + len(self.held) < self.size else b""
        return self.held

    def skip(self, n: int) -> None:
        self.at, self.held = self.at + n, self.held[n:]


def _records(source: _Source, wanted) -> Iterator[tuple[dict[str, str], bytes | None, bytes]]:
    """(headers, first bytes of the block, rest) of each record; the block is whole where wanted(headers) says so, its first bytes otherwise."""
    while source.need(20):
        start = source.held
        if start[:2] == b"\x1f\x8b":
            named = int.from_bytes(start[16:20], "little") if start[3] & 4 and start[12:14] == b"SL" and len(start) >= 20 else 0
            unpack, data, used = zlib.decompressobj(31), b"", 0
            while (head := _split(data)) is None and not unpack.eof:
                if used >= len(source.held) and len(source.need(used + (1 << 16))) <= used:
                    break
                piece = source.held[used : used + 4096]
                used += len(piece)
                data += unpack.decompress(piece)
            if head is None:
                raise ValueError("a WARC record has no end of head")
            headers = parse_head(head[0])
            whole = wanted(headers)
            if named and not whole:
                yield headers, data[head[1] :], False
                source.skip(named)
                continue
            rest = [data]
            while not unpack.eof:
                if used >= len(source.held) and len(source.need(used + (1 << 18))) <= used:
                    raise ValueError("a WARC file ends inside a record")
                piece = source.held[used : used + (1 << 18)]
                used += len(piece)
                got = unpack.decompress(piece)
                if whole:
                    rest.append(got)
            data = b"".join(rest)
            yield headers, data[head[1] : head[1] + int(headers.get("content-length", 0))] if whole else data[head[1] :], whole
            source.skip(used - len(unpack.unused_data))
        else:
            size = 4096
            while (head := _split(source.need(size))) is None and len(source.held) >= size:
                size *= 2
            if head is None:
                if not source.held.strip():
                    return
                raise ValueError("a WARC record has no end of head")
            headers = parse_head(head[0])
            length, whole = int(headers.get("content-length", 0)), wanted(headers)
            block = source.need(head[1] + (length if whole else min(length, 8192)))[head[1] : head[1] + length]
            if whole and len(block) < length:
                raise ValueError("a WARC file ends inside a record")
            yield headers, block, whole
            source.skip(head[1] + length)
            while source.need(2)[:2] == b"\r\n":
                source.skip(2)


def _passes(filters: list[Filter], headers: dict[str, str]) -> bool:
    for f in filters:
        deny = isinstance(f, Not)
        f = f.child if deny else f
        value = headers.get(HEADERS[f.attribute[0]])
        if isinstance(f, (IsNull, IsNotNull)):
            ok = (value is None) == isinstance(f, IsNull)
        elif isinstance(f, EqualNullSafe):
            ok = value == f.value
        elif value is None:
            return False  # neither the condition nor its negation holds of a null
        elif isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        else:
            ok = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(f)](value, f.value)
        if ok == deny:
            return False
    return True


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.names, self.filters = options["path"], schema.fieldNames(), []
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, known) and len(inner.attribute) == 1 and inner.attribute[0] in HEADERS and not (isinstance(inner, In) and None in inner.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, path = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        found = [x for x in found if x.type == fs.FileType.File]
        lists = [x for x in found if x.base_name.startswith("_manifest-")]
        listed = None
        if lists:
            listed = {f"{x.path.rpartition('/')[0]}/{name}" for x in lists for name in json.loads(store.open_input_file(x.path).read())}
        files = sorted((x.path, x.size) for x in found if (x.path in listed if listed is not None else x.path.endswith((".warc", ".warc.gz"))))
        plan: list[tuple[int, list[str]]] = []
        for name, size in files:
            if plan and plan[-1][0] + size <= self.split:
                plan[-1] = (plan[-1][0] + size, [*plan[-1][1], name])
            else:
                plan.append((size, [name]))
        return [Files(names) for _, names in plan] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        kinds = {"payload_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(self.names)], names=self.names)

        with_payload = "payload" in self.names
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for headers, block, whole in _records(_Source(file), lambda h: with_payload and _passes(self.filters, h)):
                    if not whole and not _passes(self.filters, headers):
                        continue
                    row = self._row(headers, block, whole)
                    rows.append(row)
                    held += len(block) if whole else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def _row(self, headers: dict[str, str], block: bytes, whole: bool) -> list:
        content, length, body = headers.get("content-type"), int(headers.get("content-length", 0)), block
        if (content or "").startswith("application/http"):
            end = block.find(b"\r\n\r\n")
            http = parse_head(block[:end]) if end >= 0 else {}
            content, body = http.get("content-type"), block[end + 4 :] if end >= 0 else b""
            length = int(http["content-length"]) if http.get("content-length", "").isdigit() else length - end - 4
        revisit = headers.get("warc-type") == "revisit"
        known = {"content_type": content, "payload_length": length, "headers": list(headers.items()), "payload": body if whole and not revisit else None}
        return [known[n] if n in known else headers.get(HEADERS[n]) for n in self.names]


class WarcWriter(DataSourceArrowWriter):
    """Columns as in SCHEMA, headers aside; those that are missing count as null."""

    def __init__(self, options: dict, schema) -> None:
        self.path, self.names = options["path"], schema.fieldNames()

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            none = pa.nulls(batch.num_rows)
            fields = ("type", "record_id", "target_uri", "date", "refers_to", "digest", "content_type", "payload_length", "payload")
            for row in zip(*(values(column.get(n, none), 100) for n in fields)):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                size += out.write(data := member(record(row[0] or "response", *row[1:7], row[7] if row[7] is not None else len(row[8] or b""), row[8]))) or len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with store.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as out:  # one of its own for each write
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        store, path = file_system(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{path}/{name}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcDataSource(DataSource):
    """format("warc"); options: path, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> WarcReader:
        return WarcReader(self._options(), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self._options(), schema)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """columns: part of SCHEMA; payloads are decoded only if it has ``payload``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(columns).load(path)


def write_warc(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Rows for write_warc: of equal payloads (by SHA-256) of least_bytes or more, the smallest id is the response that the others revisit.

    A null payload is empty. Rows that share the smallest id are responses all, as a
    page cannot revisit itself; so are rows with a null id, which nothing refers to.
    """
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("hex", F.sha2("payload", 256)).withColumn("payload_length", F.length("payload").cast("long"))
    first = own.filter(F.col("payload_length") >= least_bytes).groupBy("hex").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1").drop("n"), "payloads")  # a table of its own: AQE can split a payload's rows
    rows = own.join(first, "hex", "left").withColumn("again", F.coalesce(F.col("page") != F.col("first"), F.lit(False)))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("type"), name(F.col("page")).alias("record_id"), "target_uri", F.when(F.col("again"), name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "hex").alias("digest"), "payload_length", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty, repeated rows and null ids as in page_records(); an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    path = new_folder(spark, "warc")
    write_warc(page_records(pages), path)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    whole = read_warc(spark, path, "type string, record_id string, payload binary").filter("type = 'response'")
    whole = whole.select(number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, "type string, record_id string, refers_to string, digest string, payload_length long").filter("type = 'revisit'")
    again = again.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("digest", ":", -1).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    return whole.unionByName(again)
