"""WARC archives and their merged capture index.

1. Records with equal payloads are found by SHA-256 and length; the one with the largest page_id is the response, the
   others are revisits of it (payloads below ``min_bytes`` are all responses).
2. Tasks write archives (WARC/1.1, one gzip member per record, rolled at ``ROLL`` bytes) into the shared folder, under
   names that no other attempt uses; the manifest names those of the attempts that counted.
3. Every archive is read back, each payload's digest is verified, and its captures, sorted by URL key, time and page,
   form a local run of the index.
4. The key space is cut into ranges. Each range merges its part of all runs with a loser tree, which makes the globally
   ordered capture histories. The result is read from those.

Defined cases: null html is an empty payload; null url has the empty URL key; a row without page_id is a response only
where none of its payload group has one; repeated rows get a record each, and those that share the largest page_id are
all responses; other columns are ignored; an empty table writes no archive. The time is that of a ``captured_at``
column (a time without zone is UTC), with its microseconds; without the column, or where it is null or no time, it is the
epoch plus page_id seconds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

ROLL = 8 << 20
CHUNK = 1 << 14
EPOCH = datetime(2024, 1, 1)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUNS = "run string, seq long, url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_length long"
CAPTURE = [x.split()[0] for x in RUNS.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, no scheme, user, default port, leading www or fragment; query sorted."""
    try:
        parts = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower().rstrip('/') or '/'}{'?' + query if query else ''}" if host else (url or "").lower()


def made_up(page: int | None) -> str:
    return f"{EPOCH + timedelta(seconds=(page or 0) % 3_000_000_000):%Y-%m-%dT%H:%M:%S}.000000Z"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, time: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {quote(url or '', safe='/:?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Date: {time}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    head += [f"X-Page-ID: {page}"] if page is not None else []
    head += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers}"] if revisit else []
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def filesystem(uri: str):  # noqa: ANN201
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def optional(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def written(batches: Iterable[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    fs, root = filesystem(folder)
    stream, name, size, names = None, "", 0, []
    for pdf in batches:
        for page, url, html, refers, revisit, time in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["revisit"], pdf["time"]):
            if stream is None:
                fs.create_dir(root, recursive=True)
                name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                stream = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = record(optional(page), url, (html or "").encode(), optional(refers), bool(revisit), time or made_up(optional(page)))
            stream.write(data)
            size += len(data)
            if size >= ROLL:
                stream.close()
                names.append(name)
                stream = None
    if stream is not None:
        stream.close()
        names.append(name)
    yield pd.DataFrame({"run": names}, dtype="object")


def members(stream: object) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; reads CHUNK bytes at a time."""
    at, begin, z, parts, data = 0, 0, zlib.decompressobj(31), [], b""
    while data or (data := stream.read(CHUNK)):
        parts.append(z.decompress(data))
        rest = z.unused_data
        at += len(data) - len(rest)
        data = rest
        if z.eof:
            yield begin, at - begin, b"".join(parts)
            begin, z, parts = at, zlib.decompressobj(31), []
    if parts:
        raise ValueError("archive ends within a record")


def capture(offset: int, length: int, content: bytes) -> tuple:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return (url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], page and int(page), n, digest, fields["WARC-Type"], refers and int(refers), offset, length)


def local_runs(batches: Iterable[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    fs, root = filesystem(folder)
    for pdf in batches:
        for run in pdf["run"]:
            with fs.open_input_stream(f"{root}/{run}", compression=None) as stream:
                rows = sorted((capture(*m) for m in members(stream)), key=order)
            yield frame([(run, i, *r) for i, r in enumerate(rows)])


def order(row: tuple) -> tuple:
    """URL key, time, page, offset."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[7]


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=CAPTURE)
    return out.astype({c: "Int64" for c in ("page_id", "refers_to")})


def loser_tree(runs: list[list]) -> Iterator:
    """k-way merge of sorted lists of (key, row): each inner node keeps the loser of its match, a step replays one path."""
    k = len(runs)
    at, tree = [0] * k, [-1] * max(k, 1)
    heads = [(0, r[0][0], i) if r else (1, (), i) for i, r in enumerate(runs)]

    def replay(i: int) -> None:
        node = (i + k) // 2
        while node:
            j = tree[node]
            if j < 0:
                tree[node] = i
                return
            if heads[j] < heads[i]:
                tree[node], i = i, j
            node //= 2
        tree[0] = i

    for i in range(k):
        replay(i)
    while k and not heads[i := tree[0]][0]:
        yield runs[i][at[i]][1]
        at[i] += 1
        heads[i] = (0, runs[i][at[i]][0], i) if at[i] < len(runs[i]) else (1, (), i)
        replay(i)


def merged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: dict[str, list] = {}
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            row = tuple(None if x is pd.NA or x != x else x for x in row)
            runs.setdefault(row[0], []).append((order(row[2:]), row))
    for rows in runs.values():
        rows.sort(key=lambda x: x[1][1])  # a run's blocks can arrive in any order; within them it is in order
    out = list(loser_tree([runs[r] for r in sorted(runs)]))
    for i in range(0, len(out), 10_000):
        yield frame(out[i : i + 10_000])


def times(pages: DataFrame) -> Column:
    """captured_at in UTC as a WARC-Date whose text sorts by time, null where the made-up time is to be used."""
    kind = dict(pages.dtypes).get("captured_at")
    if kind is None:
        return F.lit(None).cast("string")
    at = F.col("captured_at").try_cast("timestamp")
    return F.date_format(at if kind == "timestamp_ntz" else F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def captures(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, merge their runs: a row per record in global capture order within ranges."""
    folder = folder or fresh(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", times(pages).alias("time")).withColumn("body", F.coalesce("html", F.lit("")).cast("binary"))
    rows = rows.select("page_id", "url", "html", "time", F.sha2("body", 256).alias("same"), F.octet_length("body").alias("size"))
    first = rows.groupBy("same", "size").agg(F.max("page_id").alias("first_id"))
    rows = rows.join(first, ["same", "size"])
    revisit = (F.col("size") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "html", "time", F.col("first_id").alias("refers_to"), revisit.alias("revisit"))
    manifest = cut(rows.mapInPandas(lambda it: written(it, folder), "run string"), "manifest")
    runs = cut(manifest.repartition(max(1, manifest.count()), "run").mapInPandas(lambda it: local_runs(it, folder), RUNS), "runs")
    return runs.repartitionByRange("url_key", "captured_at", "page_id").mapInPandas(merged, RUNS)
