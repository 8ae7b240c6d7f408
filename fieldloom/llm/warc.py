"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare, slices
from fieldloom.session import materialize

# Version line, record terminator, and the capture date given to pages that have none.
VERSION = "WARC/1.0"
END = "\r\n\r\n"
NO_DATE = "1970-01-01T00:00:00Z"
#: Bytes that the records of a file that is written have, before it is packed.
FILE_BYTES = 32_000_000

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<(a|link|img|iframe|source)\b[^>]*?\s(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RECORD = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, block string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """A name that depends on the parts alone, so that a retried task gives the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(10).join(parts).encode()).digest(), version=4)}>"


def visible_text(source: str, shown: str | None = None) -> str:
    """All text a reader sees: one line per block, white space inside it as one space."""
    text = _TAG.sub("", _BREAK.sub("\x00", _shown(source) if shown is None else shown))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\x00"))
    return "\n".join(line for line in lines if line)


def _shown(source: str) -> str:
    """A page without its comments, scripts, styles and head."""
    return _HIDDEN.sub(" ", source)


def describe(source: str, shown: str | None = None) -> dict:
    """Title and links of a page, in page order."""
    title = _TITLE.search(source)
    links = [
        {"tag": m[1].lower(), "url": entities.unescape(m[2] or m[3] or m[4] or "").strip()}
        for m in _LINK.finditer(_shown(source) if shown is None else shown)
    ]
    return {"title": " ".join(entities.unescape(title[1]).split()) if title else None, "links": links}


def _record(raw: bytes | None = None, **fields) -> dict:
    """A record with its block's digest; ``raw``, the block's bytes, is kept for the file."""
    fields.setdefault("refers_to", None)
    fields.setdefault("payload_digest", None)
    raw = fields["block"].encode() if raw is None else raw
    return fields | {"block_digest": digest(raw), "raw": raw}


def response(url: str | None, source: str, date: str = NO_DATE, key: str = "") -> dict:
    """A response record of a page; control characters of a url become %20."""
    url = None if url is None else re.sub(r"[\x00-\x1f]+", "%20", url)
    body = source.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    payload = digest(body)
    return _record(
        type="response", record_id=record_id("response", key, url or "", payload), target_uri=url, date=date,
        content_type="application/http; msgtype=response", payload_digest=payload, block=head + source, raw=head.encode() + body,
    )


def derive(source: dict, key: str | None = None) -> tuple[dict, dict]:
    """The metadata and the conversion record of a response record, the former with the page's key."""
    head, _, body = source["block"].partition(END)
    status, *lines = head.split("\r\n")
    headers = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    shown = _shown(body)
    names = {"target_uri": "WARC-Target-URI", "date": "WARC-Date", "record_id": "WARC-Record-ID", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest"}
    about = {
        "source": {names[k]: source[k] for k in names if source[k] is not None},
        "http": {"status": status, "headers": headers},
        "html": describe(body, shown),
    } | ({} if key is None else {"page": key})
    common = {"refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"], "payload_digest": source["payload_digest"]}
    metadata = _record(
        type="metadata", record_id=record_id("metadata", source["record_id"]), content_type="application/json",
        block=json.dumps(about, ensure_ascii=False, sort_keys=True), **common,
    )
    conversion = _record(
        type="conversion", record_id=record_id("conversion", source["record_id"]), content_type="text/plain; charset=utf-8",
        block=visible_text(body, shown), **common,
    )
    return metadata, conversion


_HEADERS = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type",
}


def serialise(record: dict) -> bytes:
    """The record as it stands in a file, without the terminator."""
    raw = record["raw"] if "raw" in record else record["block"].encode()
    lines = [VERSION, *(f"{name}: {record[key]}" for key, name in _HEADERS.items() if record[key] is not None), f"Content-Length: {len(raw)}"]
    return ("\r\n".join(lines) + END).encode() + raw


def _opened(raw: bytes) -> bytes:
    """The bytes of all gzip members; of a cut or damaged one what can be read."""
    while raw[:2] == b"\x1f\x8b":
        out, rest = [], raw
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        raw = b"".join(out)
    return raw


_START = re.compile(rb"(?:\A|(?<=\n))WARC/1\.")


def parse(raw: bytes):
    """Records of a file's bytes; gzip members are opened.

    A record whose header or block is cut, or whose length is missing or no number, is left out;
    reading goes on at the next line that starts like a record.
    """
    raw = _opened(raw)
    names = {v.lower(): k for k, v in _HEADERS.items()}
    at = 0
    while found := _START.search(raw, at):
        at = found.end()
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        fields, size = dict.fromkeys(_HEADERS), ""
        for line in raw[found.start() : stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length":
                size = value.strip()
            elif key := names.get(name.strip().lower()):
                fields[key] = value.strip()
        if re.fullmatch("[0-9]{1,18}", size) and stop + 4 + int(size) <= len(raw):
            at = stop + 4 + int(size)
            yield fields | {"block": raw[stop + 4 : at].decode("utf-8", "replace")}


def _batch(records: list[dict]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], pa.string()) for n in names], names=names)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        F.col(id_col).cast("string").alias("page_key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page, after the page's key and url.

    A null page is an empty one, a null url leaves the target header out; equal rows have
    equal records; other columns are left behind; an empty table gives no record.
    """
    prepare(pages.sparkSession)
    rows = _pages(pages, id_col, url_col, html_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                keys = part.column("page_key")
                made = [response(u, h, key=k or "") for k, u, h in zip(keys.to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist())]
                records = _batch(made)
                yield pa.RecordBatch.from_arrays([keys, *records.columns], names=["page_key", *records.schema.names])

    return rows.mapInArrow(run, f"page_key string, {RECORD}")


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; others are left out."""
    prepare(records.sparkSession)
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "block"):
                yield _batch([made for source in part.to_pylist() for made in derive(source)])

    return records.where("type = 'response'").select(*names).na.fill("", ["block"]).mapInArrow(run, RECORD)


def _lines(records, numbers: list[int]) -> pa.RecordBatch:
    """Serialised records with the numbers of their files."""
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).view(pa.string()), pa.array(numbers, pa.int32())], names=["value", "file"])


class _Files:
    """Numbers files by a running size, so that what a reader holds of one is bounded."""

    def __init__(self, most: int):
        self.most, self.number, self.size = most, 0, 0

    def __call__(self, record: bytes) -> int:
        if self.size and self.size + len(record) > self.most:
            self.number, self.size = self.number + 1, 0
        self.size += len(record)
        return self.number


#: Files that a task writes side by side before it sorts the rest of its records by file.
OPEN_FILES = 32


def _store(lines: DataFrame, path: str, compression: str) -> None:
    """Write (value, file) by Spark's text sink, with the record terminator as line end, one folder per number.

    Files of a task are open side by side, so that records need not be sorted by their file.
    """
    conf, key = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, OPEN_FILES)
    try:
        lines.write.partitionBy("file").option("lineSep", END).option("compression", compression).text(path)
    finally:
        conf.set(key, before)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files of about ``FILE_BYTES``, a longer record aside."""
    prepare(records.sparkSession)
    most = FILE_BYTES

    def run(batches):
        place = _Files(most)
        for batch in batches:
            lines = list(map(serialise, batch.to_pylist()))
            yield _lines(lines, list(map(place, lines)))

    _store(records.mapInArrow(run, "value string, file int"), path, compression)


def write_derivatives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the metadata and conversion records of all pages, as ``derivatives`` of their ``responses``, in one pass.

    A metadata record holds its page's key.
    """
    prepare(pages.sparkSession)
    most = FILE_BYTES

    def run(batches):
        place = _Files(most)
        for batch in batches:
            for part in slices(batch, "html"):
                columns = (part.column(c).to_pylist() for c in ("page_key", "url", "html"))
                lines = [serialise(r) for k, u, h in zip(*columns) for r in derive(response(u, h, key=k or ""), k)]
                yield _lines(lines, list(map(place, lines)))

    _store(_pages(pages, id_col, url_col, html_col).mapInArrow(run, "value string, file int"), path, "gzip")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in a folder. A task holds one file at a time in memory."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                some, size = [], 0
                for record in parse(raw.as_py()):
                    some.append(record)
                    size += len(record["block"])
                    if size > 4_000_000:
                        yield _batch(some)
                        some, size = [], 0
                if some:
                    yield _batch(some)

    return files.mapInArrow(run, RECORD)


#: What the report takes from a metadata record's block.
ABOUT = "page string, source struct<`WARC-Record-ID`: string, `WARC-Payload-Digest`: string>, html struct<links: array<string>>"


def derivative_report(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page the identifiers, links and digests of its records, from files written to ``path``.

    A page is its metadata record; the conversion record is the one that refers to the same
    response. Equal rows have equal records and each its row.
    """
    write_derivatives(pages, path, id_col, url_col, html_col)
    light = read_warc(pages.sparkSession, path).selectExpr(
        "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest",
        f"if(type = 'metadata', from_json(block, '{ABOUT}'), null) as about", "length(block) as chars",
    )
    light = materialize(light, "warc-records")
    metadata = light.where("type = 'metadata'").selectExpr(
        "cast(about.page as bigint) as page_id", "target_uri as url", "refers_to as response_id", "about.source.`WARC-Payload-Digest` as payload_digest",
        "record_id as metadata_id", "block_digest as metadata_digest", "cast(size(about.html.links) as bigint) as n_links", "about.source.`WARC-Record-ID` as names",
    )
    kept = ("record_id as conversion_id", "block_digest as conversion_digest", "cast(chars as bigint) as text_chars", "payload_digest as derived_payload_digest")
    conversions = light.where("type = 'conversion'").selectExpr("refers_to as response_id", f"struct({', '.join(kept)}) as made")
    conversions = conversions.groupBy("response_id").agg(F.min("made").alias("made")).select("response_id", "made.*")
    return metadata.join(conversions, "response_id").selectExpr(
        "page_id", "url", "response_id", "payload_digest", "metadata_id", "metadata_digest", "conversion_id", "conversion_digest",
        "n_links", "text_chars", "derived_payload_digest = payload_digest and names = response_id as linked",
    )
