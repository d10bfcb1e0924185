"""WARC derivatives: for each response a metadata record and a plain-text conversion record.

Both refer to the response (WARC-Refers-To), carry its target, date and payload digest on, and have digests
of their own; the metadata record also names the conversion it goes with and keeps the HTTP headers of the source, the title and
the links. Identifiers are name-based UUIDs of the response's identifier, so reruns agree. Records are made row by
row, without any shuffle.

Defined results: null html is an empty page, a null url an empty target; repeated rows give repeated records (there are no ties to break); broken
markup is read as far as tags close, pages of any length in time that grows with it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, source_digest string, block_digest string, content_length long, payload string"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_HIDDEN = re.compile(r"<!--|<(script|style|head|title|noscript|template|nav)\b", re.I)
_END = {"": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "head", "title", "noscript", "template", "nav")}
_BREAK = re.compile(r"<(?:br|hr|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|blockquote|pre|article|section|header|footer|aside|main))\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_SPACES, _LINES = re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title[^>]*>", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b", re.I), re.compile(r"""\shref\s*=\s*["']([^"'<>]*)["']""", re.I)


def without_hidden(markup: str) -> str:
    """Markup without comments and elements that show no text. One pass: an end that isn't there is looked for once for each kind."""
    out, at, look, endless = [], 0, 0, set()
    while found := _HIDDEN.search(markup, look):
        kind = (found[1] or "").lower()
        end = None if kind in endless else _END[kind].search(markup, found.end())
        if end is None:
            endless.add(kind)
            look = found.end()
        else:
            out += [markup[at : found.start()], " "]
            at = look = end.end()
    return "".join([*out, markup[at:]])


def _closed(markup: str) -> tuple[str, str]:
    """Markup up to its last >, and the rest, which holds no whole tag: no search for one runs to the end again and again."""
    cut = markup.rfind(">") + 1
    return markup[:cut], markup[cut:]


def plain_text(markup: str) -> str:
    """Visible text of a page, a line for each block."""
    tagged, rest = _closed(without_hidden(markup))
    text = _TAG.sub("", _BREAK.sub("\n", tagged)) + rest
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text))).strip()


def page_fields(markup: str, headers: str) -> str:
    """application/warc-fields: source headers, title and links in order."""
    one_line = lambda x: _SPACES.sub(" ", html.unescape(x).replace("\n", " ")).strip()
    tagged, _ = _closed(markup)
    lines = [f"source-header: {h}" for h in headers.split("\r\n") if h]
    title = _TITLE.search(tagged)
    end = title and _END["title"].search(tagged, title.end())
    lines += [f"title: {one_line(tagged[title.end() : end.start()])}"] if title and end else []
    links = (_HREF.search(tag[0]) for tag in _TAG.finditer(tagged) if _ANCHOR.match(tag[0]))
    lines += [f"outlink: {one_line(x[1])}" for x in links if x]
    return "\r\n".join(lines) + "\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Responses (page_id, response_id, target_uri, date, headers, payload) of the pages table."""
    url = F.coalesce("url", F.lit(""))
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.coalesce("html", F.lit(""))), 256)
    urn = F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(name, 1, 32), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", r"$1-$2-5$3-8$4-$5"))
    return pages.select(F.col("page_id").cast("long"), urn.alias("response_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n").alias("headers"), F.coalesce("html", F.lit("")).alias("payload"))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page_id, source, target, date, headers, markup = r
            base = uuid.uuid5(uuid.NAMESPACE_URL, source)
            ids = {k: f"urn:uuid:{uuid.uuid5(base, k)}" for k in ("metadata", "conversion")}
            came = digest(markup.encode())
            for kind, other, content, body in (("metadata", "conversion", "application/warc-fields", page_fields(markup, headers)), ("conversion", "metadata", "text/plain; charset=utf-8", plain_text(markup))):
                data = body.encode()
                rows.append((page_id, kind, ids[kind], source, ids[other], target, date, content, came, digest(data), len(data), body))
        columns = list(zip(*rows, strict=True)) or [[] for _ in _NAMES]
        kinds = [pa.int64() if n in ("page_id", "content_length") else pa.string() for n in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response."""
    return source.select("page_id", "response_id", "target_uri", "date", "headers", "payload").mapInArrow(_derive, RECORD)


def record_bytes(r: dict) -> bytes:
    """One WARC/1.1 record. Line ends in a header's value are written as %0D and %0A, so that no value starts a header of its own."""
    block = r["payload"].encode()
    r = {k: v.replace("\r", "%0D").replace("\n", "%0A") if isinstance(v, str) else v for k, v in r.items()}
    head = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['target_uri']}", f"WARC-Refers-To: <{r['refers_to']}>",
        f"WARC-Concurrent-To: <{r['concurrent_to']}>", f"WARC-Source-Payload-Digest: {r['source_digest']}", f"WARC-Block-Digest: {r['block_digest']}", f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, file_bytes: int = 1 << 28) -> DataFrame:
    """Gzipped WARC files (a member for each record), a new one in each partition after `file_bytes`; (path, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        attempt, out, n, size, done = f"{base}/.attempt-{task.taskAttemptId()}", None, 0, 0, []

        def close() -> None:
            out.close()
            name = f"{base}/part-{task.partitionId():05d}-{len(done):04d}.warc.gz"
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)  # of an attempt that was lost after this step: it wrote the same records
            store.move(attempt, name)
            done.append((name, n))

        for batch in batches:
            for r in batch.to_pylist():
                out = out or store.open_output_stream(attempt, compression=None)
                size += out.write(gzip.compress(record_bytes(r), mtime=0))
                n += 1
                if size >= file_bytes:
                    close()
                    out, n, size = None, 0, 0
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [x for x, _ in done], "n_records": [x for _, x in done]})

    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return materialize(records.mapInArrow(run, "path string, n_records long"), "warc-parts")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            data, at, heads, blocks = gzip.decompress(data.as_py()), 0, [], []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
                size = int(fields["Content-Length"])
                heads.append(list(fields.items()))
                blocks.append(data[end + 4 : end + 4 + size].decode())
                at = end + 8 + size
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.string())], ["headers", "payload"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(headers, payload) of every record under a folder of .warc.gz files of bounded size, as write_warc makes them: each is read whole by a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(_parse, "headers map<string,string>, payload string")
