"""Web archives in ZIP packages: written a package at a time, read by ranges without extraction.

A package is a ZIP file of stored (uncompressed) members: `archive/data.warc.gz`, WARC 1.1 records that are each a gzip member of
their own, and `indexes/data.jsonl`, one JSON line a record with its `offset` and `length` in the archive. The reader takes the
end of the file, its ZIP64 parts where there are any, and the central directory; then pieces of an index, and the records those
lines name. It reads packages of others too: several archives, `.warc` without gzip, CDXJ lines (a key before the JSON), and
archives without an index, which are scanned record after record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import NO_ID
from lodestat.session import saved, scratch_path

FILE_BYTES = 256 << 20  # a package is closed at the first record beyond this
SLICE_BYTES = 4 << 20  # of an index, read by one task
READ_BYTES = 8 << 20  # neighbouring records are read together up to this
MOST_TASKS = 20_000
HOT_GROUPS = 1_000  # groups with more than this share of the rows; there are no more than so many
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store_of(folder: str):
    """The file system of a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- ZIP directories

class BadPackage(ValueError):
    """The file is no ZIP package, or one that cannot be read by ranges."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header

    def data_offset(self, source) -> int:
        """Where the member's bytes begin; only stored members can be read by ranges."""
        if self.method != 0:
            raise BadPackage(f"{self.name} is compressed")
        head = source.read_at(30, self.header)
        if head[:4] != b"PK\x03\x04" or len(head) < 30:
            raise BadPackage(f"no local header of {self.name}")
        name, extra = struct.unpack_from("<HH", head, 26)
        return self.header + 30 + name + extra


def _end_records(source) -> tuple[int, int, int, int]:
    """(entries, size of the central directory, its offset, bytes before the package), from the end of the file."""
    size = source.size()
    begin = max(0, size - 65_557 - 76)  # the longest comment, and the ZIP64 records before the end record
    tail = source.read_at(size - begin, begin)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    before = begin + at - length - offset
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != b"PK\x06\x07":
            return entries, length, offset, before
        wide = struct.unpack_from("<Q", tail, at - 12)[0]
        head = source.read_at(56, wide)
        if head[:4] != b"PK\x06\x06":  # bytes were put before the package: the record stands right before its locator
            wide = begin + at - 20 - 56
            head = source.read_at(56, wide)
            if head[:4] != b"PK\x06\x06":
                raise BadPackage("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", head, 32)
        before = wide - length - offset
    return entries, length, offset, before


def members(source) -> list[Member]:
    """The members of a package, from its central directory."""
    entries, length, offset, before = _end_records(source)
    if before < 0:
        raise BadPackage("the central directory is cut off")
    data, at, out = source.read_at(length, offset + before), 0, []
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            raise BadPackage("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, size, name_length, extra_length, comment_length = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437")
        extra, here = data[at + 46 + name_length : at + 46 + name_length + extra_length], 0
        while here + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, here)
            if kind == 1:  # ZIP64: those of size, packed size and offset that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, here + 4))
                size, packed, header = (next(wide, x) if x == 0xFFFFFFFF else x for x in (size, packed, header))
            here += 4 + n
        out.append(Member(name, method, size, header + before))
        at += 46 + name_length + extra_length + comment_length
    return out


# ---------------------------------------------------------------- WARC records

def headers_of(lines: bytes) -> dict[str, str]:
    """Header fields, names in lower case; lines that go on the one before are joined to it."""
    out, last = {}, ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def hex_digest(value: str | None) -> str | None:
    """A `sha1:` digest, base32 or hex, as lower-case hex."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    text = value[5:]
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else bytes.fromhex(text).hex()
    except ValueError:
        return None


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None = None) -> tuple[bytes, str]:
    """One WARC record as a gzip member, and its type. `refers_to` is the record id that a revisit repeats."""
    digest = hashlib.sha1(payload)
    kind = "revisit" if refers_to else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(page_id, digest.hexdigest())}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest.digest()).decode()),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush(), kind


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}"


def parsed_record(data: bytes) -> dict:
    """The fields of a WARC record from its bytes; `payload` is the body of an HTTP response, else the block, None for revisits."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BadPackage("no WARC record")
    fields = headers_of(head)
    block = rest[: int(fields.get("content-length", "0"))]
    kind, payload, size = fields.get("warc-type"), block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = headers_of(http).get("content-length")
    digest = hex_digest(fields.get("warc-payload-digest"))
    if kind == "revisit":
        payload, intact = None, None
        n, shown = int(size) if size and size.isdigit() else None, digest
    else:
        n, shown = len(payload), hashlib.sha1(payload).hexdigest()
        intact = None if digest is None else digest == shown
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": n, "payload_digest": shown, "intact": intact, "payload": payload}


# ---------------------------------------------------------------- writing

def revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 1000) -> DataFrame:
    """`page_id, sha, refers_to` of the pages whose payload of `least` bytes or more equals that of a page with a larger id.

    Only ids and hashes are shuffled. Groups that hold 1/1000 of the rows or more are at most 1000, and meet their rows by a
    broadcast; the others are joined by hash, so no group of copies lands in one task.
    """
    long = F.col("n") >= least
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n")).where(long).drop("n")
    groups = saved(rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")), "payload_groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > total / HOT_GROUPS
    many = groups.where((F.col("copies") > 1) & hot).select("sha", "refers_to")
    few = groups.where((F.col("copies") > 1) & ~hot).select("sha", "refers_to")
    marked = rows.join(F.broadcast(many.select("sha", F.col("refers_to").alias("hot_to"))), "sha", "left")
    rest = marked.where("hot_to IS NULL").drop("hot_to").join(few, "sha")
    both = marked.where("hot_to IS NOT NULL").select("page_id", "sha", F.col("hot_to").alias("refers_to")).unionByName(rest)
    return both.where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page to packages below `folder`; return the table of packages `path, n_records, n_bytes`.

    The payload is the text in UTF-8, null counts as empty. Of equal payloads of `least` bytes or more the page with the largest
    id is a response record and the others are revisits of it; all else are responses. Rows that repeat an id and a payload are
    the same page and of the same type; null ids never win over an id, and if all are null each is a response.

    A package is in no list until its task is committed, so those that lost tasks left half written are never read. A task
    streams records and holds one batch and its index lines. Null urls have no target URI. Other columns are ignored; an empty table
    gives no packages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder)
        part, number, package = TaskContext.get().partitionId(), 0, None

        def done() -> pd.DataFrame:
            archive.close()
            package.writestr("indexes/data.jsonl", "".join(lines))
            package.close()
            stream.close()
            return pd.DataFrame([(path, len(lines), written)], columns=["path", "n_records", "n_bytes"])

        for batch in batches:
            for page, url, text, sha_to, other in zip(batch["page_id"].array, batch["url"], batch["html"], batch["has_original"], batch["refers_to"].array):
                if package is None:
                    path = f"{root}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(path)
                    package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    archive = package.open("archive/data.warc.gz", "w", force_zip64=True)
                    lines, written, number = [], 0, number + 1
                payload = (text or "").encode("utf-8", "surrogatepass")
                target = record_id(int(other), hashlib.sha1(payload).hexdigest()) if sha_to else None
                data, kind = page_record(None if page == NO_ID else int(page), url, payload, target)
                archive.write(data)
                lines.append(json.dumps({"offset": written, "length": len(data), "type": kind, "filename": "archive/data.warc.gz"}) + "\n")
                written += len(data)
                if written >= file_bytes:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("html"), F.sha2(text, 256).alias("sha"))
    other = saved(revisits(pages, id_col, text_col, least), "revisits").select(F.col("page_id").alias("__page"), F.col("sha").alias("__sha"), "refers_to")
    # by id and payload: evenly dealt also where one payload has many pages
    placed = rows.join(other, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha") == F.col("__sha")), "left")
    placed = placed.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", "html", F.col("refers_to").isNotNull().alias("has_original"), F.coalesce("refers_to", F.lit(NO_ID)).alias("refers_to"))
    return saved(placed.mapInPandas(run, "path string, n_records long, n_bytes long"), "packages")


# ---------------------------------------------------------------- reading

def index_slices(packages: DataFrame, folder: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`path, archive, archive_at, archive_bytes, index_at, index_bytes, first, last`: pieces of each package's indexes, from the
    directory alone; an archive that no index of the package is named for is one piece without an index (`index_at` -1).

    An index belongs to the archive of the same name up to the first dot; a lone index to a lone archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = store_of(folder)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with store.open_input_file(path) as source:
                    found = [m for m in members(source) if not m.name.endswith("/")]
                    archives = [m for m in found if m.name.endswith((".warc", ".warc.gz"))]
                    indexes = [m for m in found if m.name.startswith("indexes/") and m.name.endswith((".jsonl", ".cdxj"))]

                    def stem(m: Member) -> str:
                        return m.name.rsplit("/", 1)[-1].split(".")[0]

                    for a in archives:
                        mine = [i for i in indexes if stem(i) == stem(a)] or (indexes if len(archives) == len(indexes) == 1 else [])
                        begin = a.data_offset(source)
                        if not mine:
                            rows.append((path, a.name, begin, a.size, -1, 0, 0, 0))
                        for i in mine[:1]:
                            at = i.data_offset(source)
                            rows += [(path, a.name, begin, a.size, at, i.size, k, min(i.size, k + slice_bytes)) for k in range(0, i.size, slice_bytes)]
            yield pd.DataFrame(rows, columns=names)

    names = ["path", "archive", "archive_at", "archive_bytes", "index_at", "index_bytes", "first", "last"]
    kinds = "path string, archive string, archive_at long, archive_bytes long, index_at long, index_bytes long, first long, last long"
    return packages.select("path").repartition(max(1, min(MOST_TASKS, packages.count()))).mapInPandas(run, kinds)


def slice_lines(source, at: int, size: int, first: int, last: int) -> list[dict]:
    """The index lines that begin in [first, last) of an index of `size` bytes at `at`."""
    begin = max(0, first - 1)
    data = source.read_at(last - begin, at + begin)
    end = last
    while end < size and not data.endswith(b"\n"):  # the last line goes on
        more = source.read_at(min(65_536, size - end), at + end)
        cut = more.find(b"\n") + 1 or len(more)
        data, end = data + more[:cut], end + cut
    if first:
        cut = data.find(b"\n") + 1
        data = data[cut:] if cut else b""
    return [json.loads(line[line.index(b"{") :]) for line in data.split(b"\n") if b"{" in line]


def records_of(source, lines: list[dict], archive_at: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of the records that index lines name; neighbours are read together."""
    spans = sorted((int(x["offset"]), int(x["length"])) for x in lines)
    k = 0
    while k < len(spans):
        begin, end, stop = spans[k][0], sum(spans[k]), k + 1
        while stop < len(spans) and spans[stop][0] == end and sum(spans[stop]) - begin <= READ_BYTES:
            end, stop = sum(spans[stop]), stop + 1
        data = source.read_at(end - begin, archive_at + begin)
        for offset, length in spans[k:stop]:
            yield offset, length, data[offset - begin : offset - begin + length]
        k = stop


def scanned_records(source, archive_at: int, size: int, packed: bool) -> Iterator[tuple[int, int, bytes]]:
    """The same for an archive without an index, record after record."""
    at = 0
    while at < size:
        buffer, end, done = b"", at, False
        parts, unpack = [], zlib.decompressobj(31) if packed else None
        while not done:
            more = source.read_at(min(READ_BYTES, size - end), archive_at + end)
            if not more:
                raise BadPackage("the last record is cut off")
            end += len(more)
            if packed:
                parts.append(unpack.decompress(more))
                if unpack.eof:
                    end -= len(unpack.unused_data)
                    yield at, end - at, b"".join(parts)
                    done = True
            else:
                buffer += more
                head, found, _ = buffer.partition(b"\r\n\r\n")
                if found:
                    whole = len(head) + 4 + int(headers_of(head).get("content-length", "0")) + 4
                    if len(buffer) >= whole:
                        end = at + whole
                        yield at, whole, buffer[:whole]
                        done = True
        at = end


def read_archives(packages: DataFrame, folder: str, with_payload: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for every record of the packages in column `path`: `path, archive, offset, length, record_type, record_id, target_uri,
    date, refers_to, payload_bytes, payload_digest, intact` and, unless `with_payload` is false, `payload`.

    `payload_digest` is the SHA-1 of the payload read; for revisits, which hold none, what their header states, and
    `payload_bytes` then comes from the HTTP header kept with them. `intact` says whether a stated digest is met, null without one.
    Records are read by ranges; a task has one or a few pieces of an index and holds no more than 8 MB or one record. `folder` names the
    file system. No packages, no rows; packages that are cut off or compressed raise BadPackage.
    """
    slices = saved(index_slices(packages, folder, slice_bytes), "index_slices")
    names = ["record_type", "record_id", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "intact", *(["payload"] if with_payload else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = store_of(folder)

        def table(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["path", "archive", "offset", "length", *names])
            return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"), intact=out["intact"].astype("boolean"))

        for batch in batches:
            for s in batch.itertuples(index=False):
                rows, held = [], 0
                with store.open_input_file(s.path) as source:
                    packed = s.archive.endswith(".gz")
                    if s.index_at < 0:
                        records = scanned_records(source, s.archive_at, s.archive_bytes, packed)
                    else:
                        lines = slice_lines(source, s.index_at, s.index_bytes, s.first, s.last)
                        named = [x for x in lines if x.get("filename", s.archive).rsplit("/", 1)[-1] == s.archive.rsplit("/", 1)[-1]]
                        records = records_of(source, named, s.archive_at)
                    for offset, length, data in records:
                        if packed and s.index_at >= 0:
                            data = zlib.decompress(data, 31)
                        rows.append({"path": s.path, "archive": s.archive, "offset": offset, "length": length, **parsed_record(data)})
                        held += len(data)
                        if held > READ_BYTES or len(rows) >= 5_000:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    kinds = ("path string, archive string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, "
             "payload_bytes long, payload_digest string, intact boolean" + (", payload binary" if with_payload else ""))
    return slices.repartition(max(1, min(MOST_TASKS, slices.count()))).mapInPandas(run, kinds)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write `pages` to packages (below the shared folder unless `folder` is named) and return what they hold, a row a page:
    `page_id, payload_bytes, payload_digest, record_type, refers_to, intact`."""
    folder = folder or scratch_path(pages.sparkSession, "archives")
    found = read_archives(write_archives(pages, folder, id_col, url_col, text_col, least), folder, with_payload=False)

    def page(name: str):
        return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+):", 1).try_cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")
