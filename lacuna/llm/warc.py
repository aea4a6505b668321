"""WARC archives with a two-level capture index.

Writing: each task writes one archive of WARC 1.1 records, every record its own gzip member. Of
records with equal payloads one is a response, the others are revisits that refer to it. Who revisits
whom is found on digests and ids alone and noted for the readers of each input file, so no payload is exchanged.

Index: capture lines (key, archive, offset, length, ...) are sorted by reversed-host url key and
stored in compressed blocks; a sparse directory keeps the first key and the byte range of each
block. A lookup bisects the first keys of the index parts, then the directory of one part, reads
that block's range, bisects its lines, and reads the record's range from the archive. A revisit is followed
to its response in the same way.

Archives and index lie in a folder that driver and executors share. A task writes under a name of
its own attempt; only names that a committed task reported are ever read, so a lost or repeated
task leaves nothing but an unused file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.shared import Notes, Scratch, hot_join, noted_runs, open_folder, placed, session_of, write_row_notes

#: Payloads below this are always stored in full.
SMALLEST_REVISIT = 100
#: Capture lines in an index block.
BLOCK_LINES = 512
#: Index parts at most: their first keys are what every reader holds.
INDEX_PARTS = 4096
ROWS_A_PART = 250_000
_LEVEL = 1
#: Keys that a task looks up together, and pages that it writes together.
KEYS_HELD, PAGES_HELD = 4096, 256


def url_key(url: str | None) -> str:
    """The url with its host's labels reversed, as in ``org,example,www)/path?query``; lower-cased host, no fragment."""
    if not url:
        return ")"
    url = _header(url)
    try:
        parts = urlsplit(url)
        host = (parts.netloc.rpartition("@")[2]).lower()
    except ValueError:
        return ")" + url
    name, _, port = host.partition(":")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + rest


def sort_key(url: str | None, page_id: int | None, record_id: str = "") -> str:
    """Captures in order of url key, then id (null ones first), then record: each has a key of its own."""
    return f"{url_key(url)} {'' if page_id is None else f'{page_id + (1 << 63):020d}'} {record_id}"


def record(kind: str, url: str, record_id: str, payload: bytes, digest: str, refers_to: str | None = None, refers_url: str = "") -> bytes:
    """A WARC record as a gzip member. A revisit holds the response's header block but no payload, and says whose it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Refers-To-Target-URI: {_header(refers_url)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _header(value: str) -> str:
    """A header value stays on its line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(member: bytes) -> Record:
    """Read back one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(block) < int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload)


def _page_of(record_id: str) -> int | None:
    page_id = record_id.strip("<>").split(":")[2]
    return int(page_id) if page_id else None


def plan_records(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The records to write: page_id, url, html, digest, record, file, row; and the folder of notes that tell which are revisits.

    Records are named by page, file and row there. Only digests, ids and urls are exchanged; each task has counted its own first, and
    a payload that a third of all pages share is no hot key.
    """
    rows, file, row = placed(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), scratch)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.col(file).cast("binary"), 256), 1, 16), F.lit("-"), F.col(row).cast("string"))
    rows = rows.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), name.alias("record"), F.col(file).alias("file"), F.col(row).alias("row"))
    large = scratch.keep(rows.where(F.octet_length(payload) >= SMALLEST_REVISIT).select("page_id", "digest", "record", "url", "file", "row"), "large")
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "row", "record", "url")).alias("first")
    shared = large.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(shared.select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.record").alias("refers_to"), F.col("first.url").alias("refers_url")), "shared")
    revisits = hot_join(large, shared, "digest", "n", large.count(), "inner").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    write_row_notes(revisits.select("file", "row", "refers_to", "refers_url"), "file", "row", scratch.path("revisits"))
    return rows, scratch.path("revisits")


_CAPTURES = "key string, page_id bigint, url string, archive string, offset bigint, length bigint, kind string, digest string"


def write_archives(records: DataFrame, revisits: str, folder: str) -> DataFrame:
    """Write one archive for each task under ``folder``; gives the capture lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        name, out, offset, notes = f"{uuid.uuid4().hex}.warc.gz", None, 0, Notes(revisits)

        def by_row(noted: pa.Table) -> dict[int, tuple[str, str | None]]:
            return dict(zip(noted.column("row").to_pylist(), zip(noted.column("refers_to").to_pylist(), noted.column("refers_url").to_pylist(), strict=True), strict=True))

        try:
            for key, batch in (run for whole in batches for lo in range(0, whole.num_rows, PAGES_HELD) for run in noted_runs(whole.slice(lo, PAGES_HELD), "file", "row")):
                known, lines = notes.of(key, by_row) or {}, []
                for page in batch.to_pylist():
                    out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                    refers_to, refers_url = known.get(page["row"], (None, None))
                    kind = "response" if refers_to is None else "revisit"
                    data = record(kind, page["url"] or "", page["record"], (page["html"] or "").encode("utf-8", "surrogatepass"), page["digest"], refers_to, refers_url or "")
                    out.write(data)
                    lines.append((sort_key(page["url"], page["page_id"], page["record"]), page["page_id"], page["url"], name, offset, len(data), kind, page["digest"]))
                    offset += len(data)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in _CAPTURES.split(", ")])
        finally:
            if out:
                out.close()

    return records.mapInArrow(run, _CAPTURES)


def write_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Sort capture lines into compressed blocks, one file and one directory for each part.

    Gives a row for each part: its first key, its file and where the directory lies in it.
    """
    ordered = captures.repartitionByRange(parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        name, out, at, directory, waiting = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal at, waiting
            data = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode("utf-8", "surrogatepass"), _LEVEL)
            out.write(data)
            directory.append((waiting[0]["key"], at, len(data)))
            at, waiting = at + len(data), []

        for batch in batches:
            for line in batch.to_pylist():
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                waiting.append(line)
                if len(waiting) >= BLOCK_LINES:
                    flush()
        if out:
            if waiting:
                flush()
            tail = zlib.compress(json.dumps(directory).encode("utf-8", "surrogatepass"), _LEVEL)
            out.write(tail)
            out.close()
            yield pa.record_batch({"first": pa.array([directory[0][0]]), "part": pa.array([name]), "directory_at": pa.array([at]), "directory_size": pa.array([len(tail)])})

    return ordered.select(*[x.split()[0] for x in _CAPTURES.split(", ")]).mapInArrow(run, "first string, part string, directory_at bigint, directory_size bigint")


class CaptureIndex:
    """Lookups in a written index. ``parts``: (first key, file, directory offset, directory size), by key."""

    def __init__(self, folder: str, parts: list[tuple[str, str, int, int]]):
        self.files, self.base = open_folder(folder)
        self.parts = sorted(parts)
        self.firsts = [p[0] for p in self.parts]
        self._directory: tuple[int, list, list[str]] = (-1, [], [])
        self._block: tuple[int, int, list, list] = (-1, -1, [], [])
        self._open_name, self._open_file = "", None

    def range(self, name: str, at: int, size: int) -> bytes:
        if name != self._open_name:
            if self._open_file:
                self._open_file.close()
            self._open_name, self._open_file = name, self.files.open_input_file(f"{self.base}/{name}")
        return self._open_file.read_at(size, at)

    def _lines(self, part: int, block: int) -> tuple[list[str], list[dict]]:
        if self._block[:2] != (part, block):
            _, at, size = self.directory(part)[0][block]
            lines = [json.loads(x) for x in zlib.decompress(self.range(self.parts[part][1], at, size)).decode("utf-8", "surrogatepass").split("\n")]
            self._block = part, block, [x["key"] for x in lines], lines
        return self._block[2:]

    def directory(self, part: int) -> tuple[list, list[str]]:
        """The blocks of a part, and the first key of each."""
        if self._directory[0] != part:
            _, name, at, size = self.parts[part]
            blocks = json.loads(zlib.decompress(self.range(name, at, size)).decode("utf-8", "surrogatepass"))
            self._directory = part, blocks, [x[0] for x in blocks]
        return self._directory[1:]

    def find(self, key: str) -> list[dict]:
        """All captures of a key. A key's lines can run over the ends of blocks and parts."""
        found, part = [], max(0, bisect_left(self.firsts, key) - 1)
        while part < len(self.parts) and self.firsts[part] <= key:
            firsts = self.directory(part)[1]
            block = max(0, bisect_left(firsts, key) - 1)
            while block < len(firsts) and firsts[block] <= key:
                keys, lines = self._lines(part, block)
                found += lines[bisect_left(keys, key) : bisect_right(keys, key)]
                block += 1
            part += 1
        return found


class Archives:
    """Reads records of archives by way of their index, and follows revisits to their responses."""

    def __init__(self, parts: list[tuple[str, str, int, int]], index: str, archives: str):
        self.lookup, self.store = CaptureIndex(index, parts), CaptureIndex(archives, [])

    def read(self, line: dict) -> Record:
        got = parse(self.store.range(line["archive"], line["offset"], line["length"]))
        digest = got.headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if got.headers["WARC-Type"] != line["kind"] or line["kind"] == "response" and hashlib.sha256(got.payload).hexdigest() != digest:
            raise ValueError(f"a record of page {line['page_id']} is damaged")
        return got

    def records(self, keys: list[str]) -> Iterator[tuple[dict, Record]]:
        """Each key's capture line and record; the archives are read in order."""
        lines = [x for k in keys for x in self.lookup.find(k)]
        for line in sorted(lines, key=lambda x: (x["archive"], x["offset"])):
            yield line, self.read(line)


def read_back(keys: DataFrame, parts: list[tuple[str, str, int, int]], index: str, archives: str) -> DataFrame:
    """Look every key up once and read its records: the rows of the archives, checked, revisits with the payload of their response.

    Keys come sorted to their tasks, so each index block is read and unpacked about once; the responses that
    revisits name are looked up in order too, for many keys at a time.
    """
    asked = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = Archives(parts, index, archives), Archives(parts, index, archives)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for lo in range(0, len(keys), KEYS_HELD):
                out, revisits = [], []
                for line, got in own.records(keys[lo : lo + KEYS_HELD]):
                    digest = got.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if line["kind"] == "response":
                        out.append((line["page_id"], len(got.payload), digest, "response", None))
                    else:
                        named = got.headers["WARC-Refers-To"].strip("<>")
                        revisits.append((sort_key(got.headers["WARC-Refers-To-Target-URI"], _page_of(named), named), digest, line["page_id"], _page_of(named)))
                sizes = {(line["key"], line["digest"]): len(got.payload) for line, got in others.records(sorted({r[0] for r in revisits})) if line["kind"] == "response"}
                for key, digest, page_id, refers_to in revisits:
                    if (key, digest) not in sizes:
                        raise ValueError(f"the revisit of page {page_id} refers to no response with its payload")
                    out.append((page_id, sizes[key, digest], digest, "revisit", refers_to))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return asked.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, index them, and read all records back.

    Gives page_id, payload_bytes, payload_digest, record_type, refers_to. Defined cases: a null html
    is an empty payload, a null url has the empty key. Of equal payloads of at least 100 bytes the
    record with the smallest page_id is the response; records that repeat with that very id are
    responses too, and records without an id are revisits if another one has an id, else responses.
    Rows that repeat come back each. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(session_of(pages), "warc")
    archives, index = scratch.path("archives"), scratch.path("index")
    captures = scratch.keep(write_archives(*plan_records(pages, scratch), archives), "captures")
    count = captures.count()
    parts = max(1, min(INDEX_PARTS, -(-count // ROWS_A_PART)), min(count // BLOCK_LINES, 16))
    listed = scratch.keep(write_index(captures, index, parts), "parts")
    # One row for each index part, INDEX_PARTS at most.
    return read_back(captures, [tuple(r) for r in listed.select("first", "part", "directory_at", "directory_size").collect()], index, archives)
