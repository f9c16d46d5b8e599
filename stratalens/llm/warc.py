"""WARC archives: a deterministic sharded writer and a reader.

Writer: records are dealt to shards by ranges of the key, with range borders from an exact
histogram of payload bytes, whose heavy bins are cut finer until a bin fits a shard, so that keys may lie
anywhere; each shard is one task's sorted run and rolls to a new file when its compressed size passes
the limit. Headers and digests are regenerated from the payload. A file is
written under a temporary name that holds the task attempt and renamed when complete, so a lost
or repeated attempt leaves at most an orphan; the manifest, renamed last, names the valid files
with sizes and SHA-256, and readers trust the manifest only.

Of equal payloads (SHA-256 over the bytes) of ``min_bytes`` or more, the record with the smallest
id becomes the response and the others revisit records that refer to it. The group minimum is
pre-aggregated before the shuffle and joined back; the rows of a hot payload are dealt into parts.

Defined cases: null html is an empty payload; null url is written as an empty target; a null id is
written and read as null and never chosen as response while another id has the payload; repeated
rows (same id and payload) give one response and further rows that revisit it; an empty table
gives an archive of no files; other columns are not archived.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, salted_join, shared_dir

#: Compressed bytes after which a shard rolls to its next file, and payload bytes meant for a shard.
ROLL_BYTES, SHARD_BYTES = 64 << 20, 256 << 20
#: Bins that the range of keys is cut into at first, and bins for each shard that a heavy one holds.
BINS, FINER = 4096, 16
#: Fixed: the date written in headers, so that equal input gives equal bytes.
DATE = "2020-01-01T00:00:00Z"

MANIFEST = "path string, shard int, part int, n_bytes long, sha256 string, n_records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str):
    """A file system and the path in it: any store that pyarrow can reach by URI, else local."""
    from pyarrow import fs

    if ":/" in path:
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head only."""
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if is_revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """One gzip member per record, with a zero time stamp."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, key, refers_to) of the rows of (page_id, key, size) that revisit a smaller id."""
    first = pages.filter(F.col("size") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    joined = salted_join(pages.select("page_id", "key"), materialise(first, "warc-first"), ["key"], ["page_id"])
    return joined.filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "key", F.col("first_id").alias("refers_to"))


def shards_of(records: DataFrame, shard_bytes: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """A function that adds the ``shard`` of rows by their page_id, and the number of shards.

    A bin of the histogram with more bytes than a shard is cut finer until it has one key. The driver sees
    ``BINS`` bins and about ``FINER`` for each shard, and no more than those are broadcast.
    """
    spark = records.sparkSession
    low, high = records.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return lambda df: df.withColumn("shard", F.lit(0)), 1
    levels: list[DataFrame] = []

    def binned(df: DataFrame) -> DataFrame:
        """Adds ``start``, the first key of a row's bin; null for rows without an id."""
        out = df.withColumn("start", F.when(F.col("page_id").isNotNull(), F.lit(low).cast("long")))
        for widths in levels:
            out = out.join(F.broadcast(widths), "start", "left").withColumn("start", F.expr("CASE WHEN width IS NULL THEN start ELSE start + CAST((CAST(page_id AS DECIMAL(20,0)) - start) div width * width AS BIGINT) END")).drop("width")
        return out

    sizes: dict[int | None, int] = {}
    heavy = {low: (high - low + 1, BINS)}  # first key: keys in the bin, bins to cut it into
    while heavy:
        widths = {start: -(-span // cuts) for start, (span, cuts) in heavy.items()}
        levels.append(spark.createDataFrame(list(widths.items()), "start long, width long"))
        sizes = {r.start: r.b for r in binned(records).groupBy("start").agg((F.sum("size") + 400 * F.count("*")).alias("b")).collect()}
        parents = sorted(widths)
        heavy, cut = {}, heavy
        for start, size in sizes.items():
            if start is None or size <= shard_bytes:
                continue
            parent = parents[bisect.bisect_right(parents, start) - 1] if parents[0] <= start else None
            if parent is not None and start < parent + cut[parent][0] and widths[parent] > 1:
                heavy[start] = (widths[parent], min(BINS, FINER * -(-size // shard_bytes)))
    shard, filled, of_bin = 0, 0, []
    for start in sorted(sizes, key=lambda x: (x is not None, x)):
        if filled and filled + sizes[start] > shard_bytes:
            shard, filled = shard + 1, 0
        filled += sizes[start]
        of_bin.append((start, shard))
    table = spark.createDataFrame([x for x in of_bin if x[0] is not None], "start long, shard int")
    return lambda df: binned(df).join(F.broadcast(table), "start", "left").drop("start").withColumn("shard", F.coalesce("shard", F.lit(0))), shard + 1


def write(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as an archive in ``folder`` and returns its manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b""))
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    narrow = records.select("page_id", "key", F.octet_length("payload").cast("long").alias("size"))
    with_shard, n = shards_of(materialise(narrow.select("page_id", "size"), "warc-sizes"), shard_bytes)
    # payloads are moved once: notes on revisits travel to the same place and sort before their record
    notes = revisits(narrow, min_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "key", "refers_to")
    both = records.withColumn("refers_to", F.lit(None).cast("long")).unionByName(notes)
    dealt = with_shard(both).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "key", F.desc(F.col("payload").isNull()), "url")

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, root = _open(folder)
        done, state = [], {}

        def close() -> None:
            if "sink" in state:
                state["sink"].close()
                name = f"{root}/shard-{state['shard']:06d}-{state['part']:06d}.warc.gz"
                store.move(state["temp"], name)
                done.append((name.removeprefix(root + "/"), state["shard"], state["part"], state["size"], state["sha"].hexdigest(), state["n"]))
                del state["sink"]

        def start(shard: int, part: int) -> None:
            temp = f"{root}/_temporary-{attempt}-{shard:06d}-{part:06d}"
            state.update(shard=shard, part=part, temp=temp, sink=store.open_output_stream(temp, compression=None), size=0, n=0, sha=hashlib.sha256())

        store.create_dir(root, recursive=True)
        last = noted = None
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("shard", "page_id", "url", "payload", "key", "refers_to")), strict=True):
                shard, page_id, url, payload, key, refers = (x.as_py() for x in row)
                if payload is None:
                    noted = (page_id, key, refers)
                    continue
                revisit = noted is not None and noted[:2] == (page_id, key)
                refers = noted[2] if revisit else None
                if not revisit and page_id is not None and last == (page_id, payload):
                    revisit, refers = True, page_id  # a repeated row
                last = last if revisit else (page_id, payload)
                if "sink" not in state or state["shard"] != shard:
                    close()
                    start(shard, 0)
                elif state["size"] >= roll_bytes:
                    part = state["part"] + 1
                    close()
                    start(shard, part)
                made = member(record_bytes(page_id, url, payload, refers, revisit))
                state["sink"].write(made)
                state["sha"].update(made)
                state["size"] += len(made)
                state["n"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "shard", "part", "n_bytes", "sha256", "n_records"), d, strict=True)) for d in done], schema=pa.schema([("path", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("n_records", pa.int64())]))

    listed = materialise(dealt.mapInArrow(put, MANIFEST), "warc-manifest")
    listed.coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest_temporary")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.rename(jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest_temporary"), jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")):
        raise OSError(f"{folder}: the manifest could not be committed")
    return listed


def _records(stream) -> Iterator[bytes]:
    """Gzip members of a file, one decompressed record each."""
    inflate, out, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(1 << 20):
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("a truncated record")


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{sha1_base32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("a block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length"))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("a payload does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest lists; sizes and digests are checked."""
    files = spark.read.schema(MANIFEST).json(f"{folder}/_manifest")
    n = max(1, min(files.count(), 100_000))

    def get(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        store, root = _open(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{path}").size != size:
                    raise ValueError(f"{path}: not the size in the manifest")
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    rows, held = [], 0
                    for record in _records(stream):
                        rows.append(parse(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "n_bytes").repartition(n, "path").mapInArrow(get, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    folder = shared_dir(spark, "warc")
    write(read_table(spark, sf_dir, "pages"), folder, shard_bytes=16 << 20, roll_bytes=4 << 20)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUPS = [f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT)" for g in range(8)]
_SIGNS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {bits}) & 31 AS INTEGER) + 1, 1)" for v in _GROUPS for bits in (15, 10, 5, 0))

ORACLE = f"""
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_SIGNS} AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS low
      FROM (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages))
"""
