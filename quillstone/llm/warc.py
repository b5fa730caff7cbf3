"""WARC derivatives: linked metadata and plain-text conversion records made from response records."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import cut

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
#: Response records: what derive() reads.
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string"
DERIVED = "record_id string, record_type string, refers_to string, target_uri string, date string, refers_to_date string, content_type string, source_headers string, source_digest string, block string, block_digest string, content_length long"

# The rest of a tag: quoted values may hold ">" and "<"; a quote that nothing closes is a letter like others. Nothing is read twice.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s/>])" + _REST + r".*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"<(?:/?(?:p|div|section|article|header|footer|nav|aside|main|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|title|head|body|html)|br|hr)(?=[\s/>])" + _REST, re.I)
_TAG = re.compile(r"<[/!?A-Za-z]" + _REST)
_NAME = re.compile(r"<(a|area|link|img|script|iframe|source|meta)\b", re.I)
_ATTRIBUTE = re.compile(r"""(?<![-\w:.])([A-Za-z_:][-\w:.]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"<title(?=[\s/>])" + _REST, re.I), re.compile(r"</title", re.I)
_HEADER = re.compile(r"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()


_CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)


def decoded(payload: bytes, headers: str) -> str:
    """A payload as text, by the charset of its headers, else by the one that the page names, else as UTF-8; what doesn't fit is replaced."""
    named = _CHARSET.search(headers.encode("utf-8", "replace")) or _CHARSET.search(payload)
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _whole_tags(html: str) -> tuple[str, str]:
    """The page up to its last ">", and what follows, in which no tag ends."""
    end = html.rfind(">") + 1
    return html[:end], html[end:]


def plain_text(html: str) -> str:
    """The text of a page: without scripts, styles, comments and tags, blocks on lines of their own, entities resolved."""
    tagged, rest = _whole_tags(html)
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", tagged))) + rest
    return _LINES.sub("\n", _SPACES.sub(" ", entities.unescape(text))).strip()


def page_metadata(record_id: str | None, target: str | None, headers: str, html: str, payload_digest: str) -> str:
    """A JSON envelope: the response's identity and headers, and title, metas and links of the page."""
    opened = _TITLE.search(html)
    closed = opened and _TITLE_END.search(html, opened.end())
    title = entities.unescape(html[opened.end() : closed.start()]).strip() if closed else None
    links, metas = [], []
    for tag in _TAG.finditer(_DROP.sub(" ", _whole_tags(html)[0])):
        if not (name := _NAME.match(tag.group())):
            continue
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(tag.group()):
            found.setdefault(m[1].lower(), entities.unescape(next(x for x in m.groups()[1:] if x is not None)))
        if name[1].lower() == "meta":
            key = found.get("name", found.get("property"))
            metas += [{"name": key, "content": found["content"]}] if key and "content" in found else []
        elif (url := found.get("href", found.get("src"))) is not None:
            links.append({"path": name[1].lower(), "url": url})
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Payload-Digest": payload_digest},
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": headers.split("\n", 1)[0].strip(), "Headers": dict(_HEADER.findall(headers)), "HTML-Metadata": {"Title": title, "Metas": metas, "Links": links}}},
        }
    }
    return json.dumps(envelope, ensure_ascii=False, sort_keys=True)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and a response record for each page: the html behind a status line and headers, with an id made from id, url and content."""
    length = F.coalesce(F.octet_length("html"), F.lit(0))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("\u0000")), F.coalesce("url", F.lit("\u0000")), F.md5(F.coalesce("html", F.lit("\u0000")).cast("binary"))).cast("binary"))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), made, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response, a metadata and a conversion record that name it in refers_to; other columns are kept.

    source_headers keeps the response's HTTP headers, source_digest its payload_digest if records have that column and it isn't null,
    as those of read_warc() do, else the digest of the payload in UTF-8. Record ids follow from
    the response's, so reruns agree. A null payload is empty; a null id or target stays null. Columns of other names
    stay with both records; other columns named like an output are replaced.
    """
    own = [f.split()[0] for f in DERIVED.split(", ")]
    kept = [c for c in records.columns if c not in own and c not in ("http_headers", "payload", "payload_digest")]
    schema = records.select(*kept).schema
    for f in DERIVED.split(", "):
        schema = schema.add(*f.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                out: list[tuple] = []
                for rid, target, date, headers, payload, stated in zip(*[batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")], strict=True):
                    payload, headers = payload or "", headers or ""
                    source = stated or digest(payload.encode("utf-8", "surrogatepass"))
                    blocks = (("metadata", "application/json", page_metadata(rid, target, headers, payload, source)), ("conversion", "text/plain", plain_text(payload)))
                    for kind, content, block in blocks:
                        raw = block.encode("utf-8", "surrogatepass")
                        new = rid and f"<urn:uuid:{uuid.uuid5(NAMESPACE, rid + kind)}>"
                        out.append((new, kind, rid, target, date, date, content, headers, source, block, digest(raw), len(raw)))
                twice = pa.array([i for i in range(len(batch)) for _ in (0, 1)])
                made = [pa.array(list(c), pa.int64() if n == "content_length" else pa.string()) for n, c in zip(own, zip(*out, strict=True), strict=True)] if out else [pa.array([], pa.int64() if n == "content_length" else pa.string()) for n in own]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(twice) for c in kept], *made], names=[*kept, *own])

    stated = F.col("payload_digest") if "payload_digest" in records.columns else F.lit(None).cast("string").alias("payload_digest")
    return records.select(*kept, "record_id", "target_uri", "date", "http_headers", "payload", stated).mapInArrow(run, schema)


def record_text(prefix: str = "") -> Column:
    """A derived record as WARC/1.0 text, without the two line ends that close it."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n"))).otherwise("")
    c = lambda n: F.col(prefix + n)
    return F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", c("record_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Refers-To", c("refers_to")), line("WARC-Refers-To-Date", c("refers_to_date")),
        line("WARC-Target-URI", c("target_uri")), line("WARC-Date", c("date")), line("Content-Type", c("content_type")), line("WARC-Block-Digest", c("block_digest")), line("WARC-Source-Digest", c("source_digest")),
        line("Content-Length", c("content_length")), F.lit("\r\n"), c("block"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write derived records as WARC files, one a partition, by Spark's own writer.

    With gzip a file is one member, which Spark reads back; tools that seek records by member should be given plain files.
    """
    records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(headers by lower-case name, what follows them, length of the block by its header) of a record; None without headers.

    A length that isn't a number is that of what follows.
    """
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[:end].decode("utf-8", "replace").split("\r\n")[1:])}
    rest, said = raw[end + 4 :], headers.get("content-length", "")
    return headers, rest, int(said) if said.isascii() and said.isdigit() else len(rest)


MARK = b"WARC/1."
_PIECE = "file string, begin long, piece long, value binary"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, piece, value): files cut at "WARC/1." by Spark's text reader, with the split and a number in it; the mark is put back."""
    raw = spark.read.option("lineSep", MARK.decode()).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = None, 0
        for batch in batches:
            numbers, values = [], []
            for file, begin, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = n + 1 if (file, begin) == place else 0
                place = (file, begin)
                numbers.append(n)
                values.append(value if n == 0 and begin == 0 else MARK + value)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("begin"), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], names=["file", "begin", "piece", "value"])

    return raw.mapInArrow(run, _PIECE)


def _owners(sizes: DataFrame) -> DataFrame:
    """(file, begin, piece, own_begin, own_piece) of pieces that aren't whole records: the piece with which their record begins.

    Goes through a file's pieces in order, by their sizes and by what their headers say a record needs: a record's pieces follow it until
    its length is filled. A file is one task here, of a few numbers a piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, own, left, first = None, None, 0, True
        for pdf in batches:
            out = []
            for name, begin, piece, size, need in pdf.itertuples(index=False, name=None):
                if name != file:
                    file, own, left = name, None, 0
                if left > 0:
                    if first:
                        out.append((file, *own, *own))
                    out.append((file, begin, piece, *own))
                    left, first = left - size, False
                elif need > 0:
                    own, left, first = (begin, piece), need - size, True
            yield pd.DataFrame(out, columns=["file", "begin", "piece", "own_begin", "own_piece"])

    rows = sizes.repartition("file").sortWithinPartitions("file", "begin", "piece")
    return rows.mapInPandas(run, "file string, begin long, piece long, own_begin long, own_piece long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, date, http_headers, payload, payload_digest, headers) of the records in WARC files, gzipped or not.

    For responses, http_headers and payload are the block's two parts, and payload is decoded by its charset; for others payload is the
    whole block. payload_digest is the stated one, else that of the payload's bytes. Spark's text reader cuts files
    at "WARC/1.", so plain files of any size are read in splits, and gzipped ones are streamed. A block may hold these characters and cross splits:
    which pieces are one record is found by lengths from the file's start, and only such pieces are moved. What isn't a record is skipped.
    """
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "http_headers", "payload", "payload_digest", "headers"]
    schema = ", ".join(f"{n} string" for n in names[:-1]) + ", headers map<string,string>"

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, needs = [], []
            for value in batch.column("value").to_pylist():
                got = parse_record(value) if value.startswith(MARK) else None
                sizes.append(len(value))
                needs.append(len(value) - len(got[1]) + got[2] if got else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "begin", "piece")), pa.array(sizes, pa.int64()), pa.array(needs, pa.int64())], names=["file", "begin", "piece", "size", "need"])

    def row(raw: bytes) -> tuple | None:
        got = parse_record(raw) if raw.startswith(MARK) else None
        if got is None:
            return None
        headers, block, head = got[0], got[1][: got[2]], ""
        if headers.get("warc-type") == "response":
            top, _, block = block.partition(b"\r\n\r\n")
            head = top.decode("utf-8", "replace")
        stated = headers.get("warc-payload-digest") or digest(block)
        return (*[headers.get(h) for h in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")], head, decoded(block, head), stated, headers)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for raw in pdf["value"] if (r := row(raw)) is not None], columns=names)

    pieces, key = _pieces(spark, path), ["file", "begin", "piece"]
    parts = cut(_owners(pieces.mapInArrow(need, "file string, begin long, piece long, size long, need long")), "warc-parts")
    known = pieces.join(parts, key, "left")
    whole = known.where("own_piece is null").select("value")
    joined = pieces.join(parts, key).groupBy("file", "own_begin", "own_piece").agg(F.array_sort(F.collect_list(F.struct("begin", "piece", "value"))).alias("p"))
    joined = joined.select(F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["value"])).alias("value"))
    return whole.unionByName(joined).mapInPandas(parse, schema)


def op10(pages: DataFrame) -> DataFrame:
    """For each page and derived record: page_id, record_type, ids, target, headers and digests, and the block's SHA-256 and length."""
    made = derive(responses(pages.select("page_id", "url", "html")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_headers", "source_digest", "block_digest", "content_length", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"))
