"""WARC archives with an index: records are written with offset, length, URL and digest, then read by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.text import map_rows
from tracegrid.session import fresh_path, ship

HTTP, DATE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", "1970-01-01T00:00:00Z"
SPLIT_AT, GAP, RANGE = 64 << 20, 64 << 10, 4 << 20


NO_ID = "urn:no-page"


def urn(page_id: object) -> str:
    """An id of any type as a name in a header."""
    return NO_ID if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def id_of(name: str) -> str | None:
    return None if name == NO_ID else unquote(name.removeprefix("urn:page:"))


def record(page: dict) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response and holds none."""
    full = page["record_type"] == "response"
    block = HTTP + (page["payload"] if full else b"")
    head = {"WARC-Type": page["record_type"], "WARC-Record-ID": f"<{urn(page['page_id'])}>", "WARC-Date": DATE}
    if page["url"] is not None:
        head["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in page["url"])
    head |= {"WARC-Payload-Digest": f"sha1:{page['digest']}", "X-Payload-Length": str(page["payload_bytes"])}
    if not full:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{urn(page['refers_to'])}>"}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record's gzip member; raises where a length or a response's digest does not fit."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or not block.startswith(HTTP):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    payload = block[len(HTTP) :]
    if fields["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not fit")
    return fields, payload


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, record_type, refers_to. Of equal payloads (by SHA-1 and length) of at least `least`
    bytes the one of the largest page_id is the response (each of them, should several rows have it), and rows without an id are
    responses; the payloads themselves do not leave their task for that."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("digest"))
    groups = named.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = named.join(groups, ["digest", "payload_bytes"], "left")
    revisit = F.col("page_id") < F.col("keeper")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to")
    )


def write_archive(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write pages (page_id, url, html) as .warc.gz files under path, and the index beside them, which is returned: page_id, url,
    file, offset, length, digest, payload_bytes.

    A task writes files of its own under names that no other attempt uses and reports them only when they are whole, so after a
    lost executor the index names the files of the attempt that counted; others are never read. Rows of equal payload are joined
    by digest, where Spark splits a digest that very many rows share. Null html counts as empty, a null url is left out."""
    spark = ship(pages.sparkSession)
    id_type = dict(pages.dtypes)["page_id"]

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        fs, root = filesystem(f"{path}/archive")
        fs.create_dir(root, recursive=True)
        out, name, at, held = None, "", 0, []
        for r in source:
            if out is None:
                name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = record(r | {"payload": (r["html"] or "").encode("utf-8", "surrogatepass")})
            out.write(data)
            held.append((r["page_id"], r["url"], name, at, len(data), r["digest"], r["payload_bytes"]))
            at += len(data)
            if at >= SPLIT_AT:
                out.close()
                out = None
                yield from held
                held = []
        if out is not None:
            out.close()
        yield from held

    schema = f"page_id {id_type}, url string, file string, offset long, length long, digest string, payload_bytes long"
    map_rows(plan_records(pages, least), schema, rows).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def ranges(entries: list[dict], gap: int = GAP, most: int = RANGE) -> Iterator[list[dict]]:
    """Runs of index rows of one file, sorted by offset, that one read serves: gaps of at most `gap`, `most` bytes in all (a longer record alone)."""
    run: list[dict] = []
    for e in entries:
        if run and (e["file"] != run[0]["file"] or e["offset"] > run[-1]["offset"] + run[-1]["length"] + gap or e["offset"] + e["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def read_archive(index: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """The records that the rows of index select: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Rows are dealt by file and 4 MB stretch and sorted by offset; neighbouring records come in one read. Lengths and digests are
    checked; a revisit's payload is null."""
    spark = ship(index.sparkSession)
    stretch = F.floor(F.col("offset") / RANGE)
    dealt = index.select("file", "offset", "length").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", stretch).sortWithinPartitions("file", "offset")

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        fs, root = filesystem(f"{path}/archive")

        def batches() -> Iterator[list[dict]]:
            held: list[dict] = []
            for e in source:
                if held and (e["file"] != held[0]["file"] or len(held) >= 4096):
                    yield held
                    held = []
                held.append(e)
            if held:
                yield held

        for batch in batches():
            with fs.open_input_file(f"{root}/{batch[0]['file']}") as file:
                for run in ranges(batch):
                    start = run[0]["offset"]
                    data = file.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                    for e in run:
                        fields, payload = parse(data[e["offset"] - start : e["offset"] - start + e["length"]])
                        full = fields["WARC-Type"] == "response"
                        name = lambda k: id_of(fields[k][1:-1]) if k in fields else None
                        size = len(payload) if full else int(fields["X-Payload-Length"])
                        out = (name("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], name("WARC-Refers-To"))
                        yield (*out, payload if full else None) if with_payload else out

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    out = map_rows(dealt, schema + (", payload binary" if with_payload else ""), rows)
    kind = dict(index.dtypes)["page_id"]
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read every record back."""
    path = fresh_path(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, path), path).drop("url")
