"""Records of WARC files as the captures that ``revisits`` resolves."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a record's block in which its HTTP head is looked for; bytes that are passed over at a time.
HEAD_BYTES, SKIP_BYTES = 1 << 16, 1 << 20
KINDS = ("response", "revisit")
SCHEMA = "record_id long, warc_record_id string, kind string, url string, ts long, status int, headers map<string,string>, file string, offset long"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines by name in lower case; the last of equal names counts, folded lines belong to the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {text.strip()}"
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _skip(f: BinaryIO, size: int) -> None:
    while size > 0:
        got = len(f.read(min(size, SKIP_BYTES)))
        if not got:
            raise ValueError("record is cut short")
        size -= got


def _http(block: bytes) -> tuple[int | None, dict[str, str]]:
    head = block.replace(b"\r\n", b"\n").split(b"\n\n", 1)[0].split(b"\n")
    first = head[0].split(b" ")
    known = head[0].startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit()
    return (int(first[1]), _fields(head[1:])) if known else (None, {})


def _seconds(date: str | None) -> int | None:
    """Microseconds of a WARC date."""
    try:
        return round(datetime.fromisoformat((date or "").replace("Z", "+00:00")).astimezone(UTC).timestamp() * 1_000_000)
    except ValueError:
        return None


def records(f: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place in the stream, WARC fields, first HEAD_BYTES of the block) of each record; blocks of any size are streamed past."""
    at = 0
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            at += len(line)
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head, size = [], len(line)
        while (line := f.readline()).strip():
            head.append(line)
            size += len(line)
        if not line:
            raise ValueError("record is cut short")
        fields = _fields(head)
        length = int(fields.get("content-length", "0"))
        block = f.read(min(length, HEAD_BYTES))
        _skip(f, length - len(block))
        yield at, fields, block
        at += size + len(line) + length


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Responses and revisits of all ``.warc`` and ``.warc.gz`` files under a URI that all executors reach, one file a task.

    record_id is the first eight bytes of the record id's SHA-1 (unsigned bits in a long), ts is in
    microseconds, headers are those of the HTTP message with names in lower case; a record without
    one has none. Other kinds of records are passed over. A broken file fails its task. Without
    files there are no rows.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    files = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = pafs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                with own.open_input_file(path) as raw, gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw) as f:
                    for at, fields, block in records(f):
                        kind = fields.get("warc-type", "").lower()
                        if kind not in KINDS:
                            continue
                        status, headers = _http(block)
                        name = fields.get("warc-record-id", "")
                        number = int.from_bytes(hashlib.sha1(name.encode()).digest()[:8], "little", signed=True)
                        rows.append((number, name, kind, fields.get("warc-target-uri"), _seconds(fields.get("warc-date")), status, list(headers.items()), path, at))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    listed = spark.createDataFrame([(x,) for x in files], "path string").repartition(max(1, len(files)))
    return listed.mapInArrow(work, SCHEMA)
