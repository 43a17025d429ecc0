"""WARC derivatives: from response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .session import fresh_dir, written

VERSION = b"WARC/1.1\r\n"
#: A file is closed once it reaches this size.
FILE_BYTES = 64 << 20
#: Elements that stand on lines of their own.
_BLOCKS = frozenset(x + y for x in ("", "/") for y in "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer title head body blockquote pre".split())
#: Text, and what ends it: a comment or an element whose content is no text, a tag, another declaration, or a sign that begins
#: none of them. What isn't closed reaches to the end, so that no character is read twice.
_MARKUP = re.compile(
    r"([^<]*)(?:<(?:(!--.*?(?:-->|\Z)|(script|style|noscript|template)(?![a-z0-9-])[^>]*(?:>.*?(?:</\3\s*+(?:>|\Z)|\Z)|\Z))|(/?[a-z][^\s/>]*)([^>]*)(?:>|\Z)|[!/?][^>]*(?:>|\Z))|(<)|\Z)",
    re.S | re.I,
)
_BREAKS = re.compile(r"[\r\n]+")
_HREF = re.compile(r"""(?<![\w-])href\s*+=\s*+["']?([^"'\s>]+)""", re.I)
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+(\r\n|\Z)")
_FOLD = re.compile(r"\r?\n[ \t]+")
_LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]+)", re.I)
#: Bytes read of a file at a time.
_SLICE = 1 << 16
_CHARSET = re.compile(r"""charset\s*+=\s*+["']?([\w.:-]+)""", re.I)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _ALPHABET for b in _ALPHABET]


def digest(data: bytes) -> str:
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> at & 1023] for at in range(150, -1, -10)])  # 32 digits of 5 bits, two at a time


def record_id(*parts: object) -> str:
    """The same id for the same parts, so that a job that runs again links the same records: a UUID of version 5."""
    h = bytearray(hashlib.sha1(uuid.NAMESPACE_URL.bytes + json.dumps(parts).encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def record(kind: str, name: str, block: bytes, content_type: str, headers: list[tuple[str, str | None]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_BREAKS.sub(' ', v) if chr(13) in v or chr(10) in v else v}\r\n" for k, v in lines if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def header_fields(head: str) -> dict[str, str | list[str]]:
    """Header lines by lowered name, a list where a name is repeated; the blank after the colon may be missing, folded lines are one."""
    fields: dict[str, str | list[str]] = {}
    for line in _FOLD.sub(" ", head).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            held = fields.get(name)
            fields[name] = value if held is None else [*(held if isinstance(held, list) else [held]), value]
    return fields


def one(fields: dict[str, str | list[str]], name: str) -> str | None:
    """The first value of a name."""
    value = fields.get(name)
    return value[0] if isinstance(value, list) else value


def matches(said: str, data: bytes) -> bool:
    """Whether a labelled digest is that of the data, in base 32 or hexadecimal; one of an unknown algorithm can't be told and passes."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "md5", "sha256", "sha512"):
        return True
    found = hashlib.new(name, data).digest()
    return value.strip().lower() in (found.hex(), base64.b32encode(found).decode().rstrip("=").lower(), base64.b32encode(found).decode().lower())


def parse(data: bytes, verify: bool = True) -> tuple[dict[str, str | list[str]], bytes]:
    """Headers (names lowered, repeated ones as lists) and block of one record of any WARC version.

    A block that is shorter than its header says is an error, with ``verify`` also one that doesn't have its digest, if it has one.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    if not _VERSION.match(head):
        raise ValueError("no WARC record")
    headers = header_fields(head.partition(b"\r\n")[2].decode("utf-8", "replace"))
    size = one(headers, "content-length") or ""
    if not size.isdecimal() or len(rest) < int(size):
        raise ValueError(f"damaged record {one(headers, 'warc-record-id')}: length")
    block = rest[: int(size)]
    said = one(headers, "warc-block-digest")
    if verify and said and digest(block) != said and not matches(said, block):
        raise ValueError(f"damaged record {one(headers, 'warc-record-id')}: digest")
    return headers, block


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """Text, title and links of a page, in one pass whose time is in proportion to its length.

    Text is without scripts, styles and comments, has a line for each block and its entities resolved. A tag, comment or
    script that isn't closed reaches to the end.
    """
    text, links, title, title_at = [], [], None, -1
    for said, dropped, _, name, inside, sign in _MARKUP.findall(page):
        text.append(said)
        if name:
            name = name.lower()
            if name == "a":
                if link := _HREF.search(inside):
                    links.append(html.unescape(link[1]))
            elif name in _BLOCKS:
                text.append("\n")
                if name == "title" and title_at < 0:
                    title_at = len(text)
                elif name == "/title" and title_at >= 0 and title is None:
                    title = html.unescape("".join(text[title_at:])).strip()
        elif dropped:
            text.append(" ")
        elif sign:
            text.append(sign)
    lines = map(" ".join, map(str.split, html.unescape("".join(text)).split("\n")))
    return "\n".join(filter(None, lines)), title, links


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    said = digest(payload)
    return record("response", record_id("response", url, page_id, said), block, "application/http; msgtype=response", [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", said), ("X-Page-Id", None if page_id is None else str(page_id))])


def _decoded(payload: bytes, content_type: str) -> str:
    """The payload in the character set that the HTTP headers name; in UTF-8 where they name none, or none that is known."""
    named = _CHARSET.search(content_type)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    """A chunked body without its chunk sizes."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunks")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if len(body) < end + 2 + n:
            raise ValueError("chunks")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _inflated(body: bytes, coding: str) -> bytes:
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            return zlib.decompressobj(47).decompress(body)
        except zlib.error:
            return zlib.decompressobj(-15).decompress(body)  # deflate without its frame, as some servers send it
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if coding in ("identity", ""):
        return body
    raise ValueError(f"content-encoding {coding}")


def _entity(payload: bytes, http: dict[str, str | list[str]]) -> tuple[bytes, list[str]]:
    """The body as the page's author wrote it, and what could not be undone; a body that is said to be coded but isn't is taken as it is."""
    problems = []
    codings = lambda name: [c.strip().lower() for v in (http.get(name) or [],) for x in (v if isinstance(v, list) else [v]) for c in x.split(",")]
    try:
        if "chunked" in codings("transfer-encoding"):
            payload = _unchunked(payload)
    except ValueError:
        problems.append("transfer-encoding")
    for coding in reversed(codings("content-encoding")):
        try:
            payload = _inflated(payload, coding)
        except (ValueError, zlib.error, zstandard.ZstdError):
            problems.append("content-encoding")
            return (b"" if coding in ("br", "compress") else payload), problems
    return payload, problems


def derive(data: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record; nothing of other records.

    Both refer to the response and repeat its target, date and page id; the metadata holds the source's and HTTP's
    headers (repeated ones as lists), its digests, title and links. Chunked and compressed bodies are read as what they hold; problems name
    what could not be undone. An empty payload gives an empty conversion. Texts of any length take time in proportion to it.
    """
    headers, block = parse(data)
    if (one(headers, "warc-type") or "").lower() != "response":
        return []
    http, payload, problems = {}, block, []
    if (one(headers, "content-type") or "application/http").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        lines = head.decode("latin-1")
        names = {n.lower(): n for n in re.findall(r"^([^\s:]+)[ \t]*:", lines, re.M)}
        http = header_fields(lines.partition("\n")[2])
        payload, problems = _entity(payload, http)
        content_type = one(http, "content-type") or ""
        http = {names.get(k, k): v for k, v in http.items()}
    else:
        content_type = one(headers, "content-type") or ""
    source = one(headers, "warc-record-id")
    text, title, links = read_page(_decoded(payload, content_type))
    linked = [("WARC-Date", one(headers, "warc-date")), ("WARC-Target-URI", one(headers, "warc-target-uri")), ("WARC-Refers-To", source), ("X-Page-Id", one(headers, "x-page-id"))]
    conversion = record_id("conversion", source)
    about = {"source": headers, "http": http, "title": title, "links": links, "conversion": conversion} | ({"problems": problems} if problems else {})
    return [
        record("metadata", record_id("metadata", source), json.dumps(about, sort_keys=True).encode(), "application/json", linked),
        record("conversion", conversion, text.encode(), "text/plain; charset=utf-8", [*linked, ("WARC-Source-Payload-Digest", one(headers, "warc-payload-digest"))]),
    ]


def damaged(path: str, place: int, problem: str) -> bytes:
    """A metadata record that tells of a record which could not be read: its file and its place there."""
    about = {"problem": problem, "file": path, "place": place}
    return record("metadata", record_id("damaged", path, place), json.dumps(about, sort_keys=True).encode(), "application/json", [])


def _gzip(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 16 + 13, 7)  # a small window: most records are short, and one is set up for each
    return press.compress(data) + press.flush()


class Writer:
    """Files of gzip members, one for each record; a file takes its name when it is whole."""

    def __init__(self, folder: str):
        self.folder, self.files, self.out = folder, [], None
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{TaskContext.get().partitionId():06d}-{len(self.files):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
            self.out, self.size = self.fs.open_output_stream(f"{self.path}/.{self.name}", compression=None), 0
        packed = _gzip(data)
        self.out.write(packed)
        self.size += len(packed)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.path}/.{self.name}", f"{self.path}/{self.name}")
            self.files.append(f"{self.folder}/{self.name}")
            self.out = None


def _bytes_of(stream: pa.NativeFile) -> Iterator[tuple[bytes, bool]]:
    """What a file holds, in slices, and whether a gzip member ends with each; a file that is no gzip is taken as it is."""
    held = stream.read(_SLICE)
    if held[:2] != b"\x1f\x8b":
        while held:
            yield held, False
            held = stream.read(_SLICE)
        return
    part = zlib.decompressobj(31)
    while held or (held := stream.read(_SLICE)):
        data = part.decompress(held, 16 * _SLICE)
        held = part.unused_data if part.eof else part.unconsumed_tail
        yield data, part.eof
        if part.eof:
            part = zlib.decompressobj(31)


def records(uri: str) -> Iterator[bytes]:
    """The records of a WARC file, one at a time: plain, or gzip with a member for each record or for many.

    What stands between records and is none, and a record that breaks off, come as they are. A broken gzip stream ends the file with an error.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        held = bytearray()
        for data, ends in _bytes_of(stream):
            held += data
            while True:
                while held[:2] == b"\r\n":
                    del held[:2]
                head = held.find(b"\r\n\r\n")
                if not held.startswith(b"WARC/"):
                    again = held.find(b"\r\nWARC/1.")
                    if again < 0:
                        break
                    yield bytes(held[:again])
                    del held[: again + 2]
                    continue
                size = _LENGTH.search(held, 0, head) if head >= 0 else None
                if head < 0 or (size and len(held) < head + 4 + int(size[1])):
                    break
                n = head + 4 + (int(size[1]) if size else 0)
                yield bytes(held[:n])
                del held[:n]
            if ends and held:  # members hold whole records
                yield bytes(held)
                held.clear()
        if held:
            yield bytes(held)


def write_responses(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages(page_id, url, html)`` as WARC response records; returns (path) of the files.

    A null html is an empty payload, a null url or page_id leaves its header out; rows that repeat page_id, url and
    html give repeated records with one id. An empty table gives no files. Further columns are not read.
    """
    folder = folder or fresh_dir(pages.sparkSession, "responses")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                out.add(response(*(x.as_py() for x in row), date))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(out.files, pa.string())], ["path"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(write, "path string"), "response-files")


def build_derivatives(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Read the WARC files named in ``files(path)`` and write their derivatives; returns (path) of the new files.

    Records that aren't responses have none; repeated records have repeated ones. No files give no files, a file
    that is named twice is read twice, a null path is passed over. A record whose digest is wrong fails the job. Further columns are not read.
    """
    spark = files.sparkSession
    folder = folder or fresh_dir(spark, "derivatives")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                place = 0
                try:
                    for place, data in enumerate(records(path) if path else ()):
                        try:
                            made = derive(data)
                        except ValueError as problem:
                            made = [damaged(path, place, str(problem))]
                        for x in made:
                            out.add(x)
                except zlib.error as problem:
                    out.add(damaged(path, place + 1, str(problem)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(out.files, pa.string())], ["path"])

    return written(_spread(files).mapInArrow(build, "path string"), "derivative-files")


def _spread(files: DataFrame) -> DataFrame:
    return files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_derivatives(files: DataFrame, with_blocks: bool = False) -> DataFrame:
    """One row for each record: (page_id, kind, record_id, refers_to, target, block_digest, source_digest, n_bytes,
    conversion_id, n_links[, block]).

    What a record doesn't have is null; n_links and conversion_id are those of metadata. Repeated records and files give
    repeated rows, null paths and no files give none. A record whose digest is wrong fails the job. Further columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "kind", "record_id", "refers_to", "target", "block_digest", "source_digest", "n_bytes", "conversion_id", "n_links", "block"]
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for data in records(path) if path else ():
                    h, block = parse(data)
                    about = json.loads(block) if h["warc-type"] == "metadata" else {}
                    source = h.get("warc-source-payload-digest") or one(about.get("source", {}), "warc-payload-digest")
                    rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-block-digest"], source, len(block), about.get("conversion"), len(about["links"]) if "links" in about else None, block if with_blocks else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = _spread(files).mapInArrow(read, "page_id long, kind string, record_id string, refers_to string, target string, block_digest string, source_digest string, n_bytes long, conversion_id string, n_links long, block binary")
    return rows if with_blocks else rows.drop("block")


def linked_derivatives(pages: DataFrame) -> DataFrame:
    """One row for each distinct response: ids of the three records, where they refer to, digests and sizes.

    Responses and derivatives are written as files and read back. Rows of ``pages`` that repeat page_id, url and html
    are one response; rows that share only some of them stay apart. A null html is an empty payload, a null url or
    page_id is in no record. An empty table gives no rows. Further columns are not read.
    """
    read = read_derivatives(build_derivatives(write_responses(pages)))
    of = lambda kind, column, name: F.max(F.when(F.col("kind") == kind, F.col(column))).alias(name)
    about = [of("metadata", *x) for x in (("record_id", "metadata_id"), ("conversion_id", "conversion_id"), ("n_links", "n_links"), ("n_bytes", "metadata_bytes"))]
    text = [of("conversion", *x) for x in (("record_id", "made_id"), ("refers_to", "conversion_refers_to"), ("source_digest", "payload_digest"), ("block_digest", "text_digest"), ("n_bytes", "text_bytes"))]
    met = read.groupBy(F.col("refers_to").alias("response_id")).agg(F.max("page_id").alias("page_id"), F.max("target").alias("target"), *about, *text)
    return met.where("made_id = conversion_id").drop("made_id")
