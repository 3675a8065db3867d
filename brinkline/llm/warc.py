"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key between exact bounds and written by the task that holds them into gzip members, one a
record. A file is rolled when its compressed size passes a limit. Files get temporary names of their attempt and are
renamed to names made of their place and their content's digest, which are the same whenever equal rows are written; the manifest, written by Spark in one atomic commit, lists the files
that count. A task that runs twice leaves at most a second copy of equal content, which no manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinkline.plans.shared import materialize, shared_root

DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record with regenerated headers; its id is a name-based UUID of the page_id (without one, of url and payload), so bytes depend on content alone."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}' if i is not None else f'page:{url} {sha1_base32(payload)}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The records of concatenated gzip members, from chunks of a file."""
    unzip, out = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            out.append(unzip.decompress(chunk))
            chunk = unzip.unused_data
            if unzip.eof:
                yield b"".join(out)
                unzip, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("a record is cut short")


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), its block and, from the HTTP part, its payload; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (s.partition(": ") for s in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("a record's block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if headers["warc-type"] == "response" and (said != len(payload) or headers["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}"):
        raise ValueError("a record's payload is damaged")
    return headers | {"payload": payload, "payload_bytes": said}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def _cuts(sizes: DataFrame, shard_bytes: int, most_shards: int, cells_a_shard: int = 8) -> tuple[list[tuple[int, DataFrame]], int]:
    """Range bounds of shards, from exact sums: ([(bits, table of cell and shard)], number of shards).

    ``sizes`` (page_id, bytes). A cell is the ids that agree in all but their last ``bits`` bits. Bytes are summed by
    cell; a cell that would overfill a shard is cut into ``cells_a_shard`` to twice as many for each shard it fills,
    down to single ids, and neighbours are packed into a shard until it is full. What comes out depends on the ids and
    sizes alone, neither on samples nor on the order or the partitions of the rows. The sums that reach the driver in a
    round are at most ``4 * cells_a_shard`` for each shard, whatever the ids; a round takes four bits or more off a
    cell, so there are at most 17.
    """
    spark = sizes.sparkSession
    ends = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if ends[0] is None:
        return [], 1
    shard_bytes = max(shard_bytes, -(-ends[2] // most_shards))
    parts = lambda size: (cells_a_shard * -(-size // shard_bytes) - 1).bit_length()  # noqa: E731  bits that tell a cell's parts apart
    bits = max(0, (ends[1] - ends[0]).bit_length() - parts(ends[2]))
    found, todo = {}, sizes.withColumn("bits", F.lit(bits))  # first id of a cell: (bits, bytes)
    cell = F.expr("shiftright(page_id, bits)")
    while True:
        sums = todo.groupBy("bits", cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).collect()
        heavy = [(r.bits, r.cell, max(0, r.bits - parts(r.bytes))) for r in sums if r.bytes > shard_bytes and r.bits]
        found |= {r.cell << r.bits: (r.bits, r.bytes) for r in sums if r.bytes <= shard_bytes or not r.bits}
        if not heavy:
            break
        cut = F.broadcast(spark.createDataFrame(heavy, "bits int, cell long, finer int"))
        todo = todo.withColumn("cell", cell).join(cut, ["bits", "cell"]).select("page_id", "bytes", F.col("finer").alias("bits"))
    shard, full, by_bits = 0, 0, {}
    for first, (b, size) in sorted(found.items()):
        if full and full + size > shard_bytes:
            shard, full = shard + 1, 0
        by_bits.setdefault(b, []).append((first >> b, shard))
        full += size
    return [(b, spark.createDataFrame(rows, "cell long, shard int")) for b, rows in sorted(by_bits.items(), reverse=True)], shard + 1


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, shard_bytes: int = 16 << 20, most_shards: int = 32_768, least_revisit_bytes: int = 0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under ``folder``; returns the manifest table (path, records, bytes, sha256).

    Records are in order of page_id, url and payload digest. A shard is a range of ids of about ``shard_bytes`` of
    payload (more where that would make over ``most_shards``); a shard's file is rolled when it reaches
    ``roll_bytes`` compressed. Names and bytes of the files follow from the rows alone. Payloads are the html in
    UTF-8, null: empty. Of records with equal payloads of at least ``least_revisit_bytes`` the one with the smallest
    page_id is a response and the others revisit it; other records are responses. Null urls count as empty. Rows with
    a null page_id come last, in shards by a hash of url and payload; they revisit the smallest page_id of their payload, or are responses if it has none.
    Rows that repeat a page_id are decided each by its own payload; those with equal content that no smaller page_id
    has are each a response. Extra columns are ignored; an empty table gives an empty manifest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    # thin rows decide who answers; a payload that many pages share is pre-aggregated, then dealt back in salted parts
    salts = 32
    keys = rows.select("page_id", F.sha2("payload", 256).alias("same"), F.octet_length("payload").cast("long").alias("size"))
    keys = materialize(keys, folder, "keys")
    firsts = keys.where(F.col("size") >= least_revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = firsts.select("same", "first", F.explode(F.when(F.col("n") > 1000, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"), (F.col("n") > 1000).alias("large"))
    small, large = firsts.where("not large"), firsts.where("large")
    # rows of large groups keep their salt, so that they stay spread when the others look for small groups
    salted = keys.select("page_id", "same", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    spread = salted.join(large.select("same", "salt", F.col("first").alias("first_l")), ["same", "salt"], "left")
    spread = spread.withColumn("salt", F.when(F.col("first_l").isNotNull(), F.col("salt")).otherwise(F.lit(-1)))
    joined = spread.join(small.select("same", "salt", F.col("first").alias("first_s")), ["same", "salt"], "left")
    thin = joined.select(F.col("page_id").alias("id"), F.col("same").alias("digest"), F.coalesce("first_l", "first_s").alias("refers_to")).where("not refers_to <=> id and refers_to is not null").distinct()
    thin = materialize(thin, folder, "revisits")
    revisits = thin.count()
    cuts, shards = _cuts(keys.where("page_id is not null").select("page_id", (F.col("size") + 500).alias("bytes")), shard_bytes, most_shards)
    placed = rows.withColumn("same", F.sha2("payload", 256)).withColumn("shard", F.lit(None).cast("int"))
    for bits, table in cuts:
        table = table.toDF("cell", "found")
        placed = placed.join(F.broadcast(table), F.shiftright("page_id", bits) == F.col("cell"), "left").withColumn("shard", F.coalesce("shard", "found")).drop("cell", "found")
    unnumbered = keys.where("page_id is null").agg(F.sum(F.col("size") + 500)).first()[0] or 0
    more = min(most_shards, -(-unnumbered // shard_bytes))
    placed = placed.withColumn("shard", F.coalesce("shard", shards + F.pmod(F.xxhash64("url", "same"), F.lit(max(1, more))).cast("int")))
    shards += more
    known = (placed["page_id"].eqNullSafe(thin["id"])) & (placed["same"] == thin["digest"])
    # payloads are shuffled once, by shard, unless the revisits are too many to be broadcast
    ready = placed.join(F.broadcast(thin) if revisits <= broadcast_rows else thin, known, "left").select("shard", "page_id", "url", "payload", "refers_to", "same")
    ready = ready.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "url", "same", "refers_to").drop("same")

    def run(batches):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}"
        state = {"out": None, "n": 0, "size": 0, "file": 0, "shard": None}

        def close():
            state["out"].close()
            name = f"part-{state['shard']:06d}-{state['file']:05d}-{state['sha'].hexdigest()[:16]}.warc.gz"
            system.move(state["temporary"], f"{base}/{name}")
            done = (f"{folder}/{name}", state["n"], state["size"], state["sha"].hexdigest())
            state.update(out=None, n=0, size=0, file=state["file"] + 1)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in done], names=["path", "records", "bytes", "sha256"])

        for batch in batches:
            for shard, page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != state["shard"]:
                    if state["out"] is not None:
                        yield close()
                    state.update(shard=shard, file=0)
                if state["out"] is None:
                    state["temporary"] = f"{base}/.tmp-{attempt}-{shard:06d}-{state['file']:05d}"
                    state.update(out=system.open_output_stream(state["temporary"], compression=None), sha=hashlib.sha256())
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipped.compress(record(page_id, url, payload, refers_to)) + zipped.flush()
                state["out"].write(data)
                state["sha"].update(data)
                state.update(n=state["n"] + 1, size=state["size"] + len(data))
                if state["size"] >= roll_bytes:
                    yield close()
        if state["out"] is not None:
            yield close()

    manifest = ready.mapInArrow(run, "path string, records long, bytes long, sha256 string")
    return materialize(manifest, folder, "manifest")


def read_archives(manifest: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """One row a record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    The manifest's paths are whole URIs, so archives are read from wherever they were written.
    """

    def run(batches):
        for batch in batches:
            for uri, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                seen, rows = 0, []
                with system.open_input_stream(path, compression=None) as file:
                    for raw in members(iter(lambda file=file: file.read(chunk), b"")):
                        h = parse(raw)
                        reply = h["warc-type"] == "response"
                        number, refers = h["x-page-id"], h.get("x-refers-to-page-id")
                        rows.append((int(number) if number else None, h.get("warc-target-uri", ""), h["payload_bytes"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(refers) if refers else None, h["payload"] if reply else None))
                        seen += 1
                        if len(rows) == 200:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)
                if seen != records:
                    raise ValueError(f"{uri} holds {seen} records, not {records}")

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return manifest.select("path", "records").repartition(max(1, min(4096, manifest.count()))).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, then read the archives back (see the two functions)."""
    return read_archives(write_archives(pages, f"{shared_root(pages.sparkSession)}/warc", **options))
