"""WARC archives: a deterministic sharded writer and a reader, as Spark jobs.

Records are range-sorted by ``page_id`` into shards, written as one gzip member
per record, rolled to a new file once the compressed size reaches ``roll_bytes``.
Headers, record ids and digests are generated from the data alone, shard edges
come from exact counts, so the same pages give the same bytes.

* **Duplicates.**  Only digests travel to find equal payloads: of the rows whose
  payload of at least ``min_bytes`` is equal, the largest ``page_id`` is the
  response, the others revisit it.  The html is shuffled once, into its shard;
  the revisit decisions join it there by being sorted in front of it.
* **Shard edges.**  Records are ordered by ``page_id``, then payload digest.  Bytes
  are summed by the leading bits of the ids (65,536 ranges at most); a range with more
  than ``shard_bytes`` is summed again by its next bits, and a single id that is
  larger by the bits of its digests.  So neither a far id nor a hot (or null) one puts the
  table into one shard; evenly spread ids take one pass.  Adjoining ranges are then cut
  into shards of about ``shard_bytes`` (more where there would be over 16,384 of them).
  Only rows equal in id and payload stay together; the writer streams them.
* **Commit.**  A task writes ``<out>/_tmp/<attempt>/...`` and moves a finished
  file to its final name, which depends on shard and number only, so a repeated
  or speculative task replaces a file by the same bytes.  Each file yields a
  manifest row; the manifest, written last by Spark, is the commit: readers take
  what it lists and check the file sizes against it.  Then ``_tmp`` is removed.

Files are written through ``pyarrow.fs`` (local or shared paths, object stores)
and read back with Spark's ``binaryFile`` source.

Defined results: null html is an empty payload; null url leaves the target
header out; control characters of a url are percent-encoded; null ``page_id``
sorts first and is written without an id, as a revisit where a page with an id has its payload
(a response where only rows without an id have it); rows with equal ``page_id`` and payload
give one response, the rest revisit that id; other columns are ignored; an
empty table gives an empty manifest and reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
ROLL_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
SLOT_BITS = 16        # ranges summed at once: 2 ** SLOT_BITS
SUB_BITS = 60         # of the digest, to split a single page_id
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time; a parameter so that output stays reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")

MANIFEST_DDL = "file string, shard int, records long, bytes long, sha1 string"
MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
READ_DDL = ("file string, page_id long, record_type string, url string, record_id string, refers_to long, "
            "payload_bytes long, payload_digest string, payload binary")
READ = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
                  ("record_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("payload", pa.binary())])


def _digest() -> Column:
    return F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of every row that repeats a payload of a larger ``page_id`` (a null one is least)."""
    large = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", _digest().alias("digest"))
    best = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    return large.distinct().join(best.drop("n"), "digest").filter("NOT page_id <=> refers_to").select("page_id", "digest", "refers_to")


STEP = ["node", "in_id", "shift", "mask"]  # the range a row is in, and the bits of its id (or digest) that split it


def _slot() -> Column:
    """The part of its range that a row falls into; -1: no id."""
    by_id = F.col("page_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    by_digest = F.conv(F.substring("digest", 1, SUB_BITS // 4), 16, 10).cast("long")
    bits = F.call_function("shiftrightunsigned", F.when(F.col("in_id"), by_digest).otherwise(by_id), F.col("shift"))
    return F.when(~F.col("in_id") & F.col("page_id").isNull(), -1).otherwise(bits.bitwiseAND(F.col("mask").cast("long")).cast("int"))


def _start(rows: DataFrame, step: tuple) -> DataFrame:
    return rows.withColumns({c: F.lit(v) for c, v in zip(STEP, step)})


def _split(step: tuple, slot: int, bits: int) -> tuple | None:
    """Bits that split a part further: the next of the id, then those of the digest; none when both are used up."""
    _, in_id, shift, _ = step
    if not in_id and (slot < 0 or not shift):
        in_id, shift = True, SUB_BITS
    if not shift:
        return None
    bits = min(bits, shift)
    return in_id, shift - bits, (1 << bits) - 1


def _ranges(pages: DataFrame, shard_bytes: int) -> tuple[tuple, list[list[tuple]], int]:
    """The first step, rows ``node, slot, shard, below, in_id, shift, mask`` for each level, and the number of shards.

    A part is a shard's or is split by the node ``below``. A pass collects 2 ** 18 rows at most: parts are split
    only above a 16,384th of all bytes, into 16 parts each or more as long as a level has 2 ** 16.
    """
    size = (F.coalesce(F.octet_length("html"), F.lit(0)) + F.lit(300)).cast("long")
    left = pages.select("page_id", _digest().alias("digest"), size.alias("b"))
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    spread = 0 if low is None else 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    first = (0, False, max(0, spread - SLOT_BITS), (1 << SLOT_BITS) - 1)
    left, steps, parts, limit = _start(left, first), {0: first}, [], None
    while True:
        sums = left.groupBy("node", _slot().alias("slot")).agg(F.sum("b")).collect()
        limit = limit or max(shard_bytes, sum(r[2] for r in sums) >> (SLOT_BITS - 2))
        heavy = [(r[0], r[1]) for r in sums if r[2] > limit]
        bits = max(4, SLOT_BITS - len(heavy).bit_length())
        on = {}
        for part in sorted(heavy):
            step = _split(steps[part[0]], part[1], bits)
            if step:
                on[part] = (len(steps), *step)
                steps[len(steps)] = on[part]
        parts.append({(r[0], r[1]): (r[2], on.get((r[0], r[1]))) for r in sums})
        if not on:
            break
        table = pages.sparkSession.createDataFrame([(*p, *step) for p, step in on.items()], "node int, slot int, below int, _in boolean, _shift int, _mask int")
        left = (left.withColumn("slot", _slot()).join(F.broadcast(table), ["node", "slot"])  # fewer than 2 ** 14 rows
                .select("page_id", "digest", "b", F.col("below").alias("node"), F.col("_in").alias("in_id"), F.col("_shift").alias("shift"), F.col("_mask").alias("mask")))

    of_node: dict = {}
    for level, found in enumerate(parts):
        for (node, slot), (b, step) in found.items():
            of_node.setdefault(node, []).append((slot, b, step, level))

    def leaves(node):
        for slot, b, step, level in sorted(of_node.get(node, []), key=lambda p: p[0]):
            if step:
                levels[level].append((node, slot, None, *step))
                yield from leaves(step[0])
            else:
                yield level, node, slot, b

    levels, shard, have = [[] for _ in parts], 0, 0
    for level, node, slot, b in leaves(0):
        if have and have + b > limit:
            shard, have = shard + 1, 0
        have += b
        levels[level].append((node, slot, shard, None, None, None, None))
    return first, levels, shard + 1


def _sharded(rows: DataFrame, pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows (page_id, digest, ...)`` with their ``shard``, and the number of shards."""
    first, levels, shards = _ranges(pages, shard_bytes)
    at = _start(rows, first).withColumn("shard", F.lit(None).cast("int"))
    for level in levels:
        table = rows.sparkSession.createDataFrame(level, "node int, slot int, _shard int, below int, _in boolean, _shift int, _mask int")
        at = (at.withColumn("slot", _slot()).join(F.broadcast(table), ["node", "slot"], "left")  # at most 2 ** 18 rows
              .select(*rows.columns, F.coalesce("shard", "_shard").alias("shard"), F.col("below").alias("node"), F.col("_in").alias("in_id"),
                      F.col("_shift").alias("shift"), F.col("_mask").alias("mask")))
    return at.drop(*STEP), shards


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{again}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: int, date: str) -> bytes:
    """One WARC record, its blank lines included."""
    sha = lambda raw: "sha1:" + base64.b32encode(raw).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest, again)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {sha(bytes.fromhex(digest))}", f"WARC-Block-Digest: {sha(hashlib.sha1(block).digest())}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without name or time
    return z.compress(raw) + z.flush()


class _Files:
    """The files of one task: temporary names while written, final names once complete."""

    def __init__(self, out: str, roll_bytes: int):
        from pyarrow import fs
        self.fs, self.root = fs.FileSystem.from_uri(out)
        ctx = TaskContext.get()
        self.tmp = f"{self.root}/_tmp/{ctx.stageId()}-{ctx.partitionId()}-{ctx.taskAttemptId()}"
        self.roll, self.shard, self.number, self.stream = roll_bytes, None, 0, None

    def write(self, shard: int, raw: bytes):
        """Rows for the manifest of files that this record completed."""
        done = []
        if shard != self.shard or self.stream is not None and self.size >= self.roll:
            done = self.close()
            self.number = 0 if shard != self.shard else self.number + 1
            self.shard = shard
        if self.stream is None:
            self.name, self.records, self.size, self.sha = f"shard-{shard:06d}-{self.number:05d}.warc.gz", 0, 0, hashlib.sha1()
            self.fs.create_dir(self.tmp, recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.tmp}/{self.name}", compression=None)
        z = _member(raw)
        self.stream.write(z)
        self.sha.update(z)
        self.records, self.size = self.records + 1, self.size + len(z)
        return done

    def close(self):
        if self.stream is None:
            return []
        self.stream.close()
        self.stream = None
        self.fs.move(f"{self.tmp}/{self.name}", f"{self.root}/{self.name}")
        return [(self.name, self.shard, self.records, self.size, self.sha.hexdigest())]


def _rows(done):
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(MANIFEST.types)], schema=MANIFEST)


def _writer(out: str, roll_bytes: int, min_bytes: int, date: str):
    def fn(batches):
        files, at, to, again = _Files(out, roll_bytes), None, None, 0
        for batch in batches:
            done = []
            for shard, page_id, kind, digest, refers, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if (page_id, digest) != at:
                    at, to, again = (page_id, digest), None, 0
                if kind == 0:  # stands before the rows it is about
                    to = refers
                    continue
                payload = (html or "").encode()
                if to is None and again and len(payload) >= min_bytes and page_id is not None:
                    to = page_id
                done += files.write(shard, record(page_id, url, payload, digest, to, again, date))
                again += 1
            if done:
                yield _rows(done)
        done = files.close()
        if done:
            yield _rows(done)
    return fn


def _drop_tmp(out: str):
    """What ended attempts left behind; the manifest is written, so nothing there is needed."""
    from pyarrow import fs
    files, root = fs.FileSystem.from_uri(out)
    if files.get_file_info(f"{root}/_tmp").type == fs.FileType.Directory:
        files.delete_dir(f"{root}/_tmp")


def write_warc(pages: DataFrame, out: str, *, min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES,
               shard_bytes: int = SHARD_BYTES, date: str = DATE) -> str:
    """Write ``pages (page_id, url, html)`` as archives below ``out`` (a fresh folder); returns the manifest's path."""
    html = pages.select("page_id", F.lit(1).alias("kind"), _digest().alias("digest"),
                        F.lit(None).cast("long").alias("refers_to"), "url", "html")
    said = revisits(pages, min_bytes).select("page_id", F.lit(0).alias("kind"), "digest", "refers_to",
                                             F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows, shards = _sharded(html.unionByName(said), pages, shard_bytes)
    dealt = (rows.select("shard", "page_id", "kind", "digest", "refers_to", "url", "html").repartitionById(shards, "shard")
             .sortWithinPartitions("shard", "page_id", "digest", "kind", "url"))
    dealt.mapInArrow(_writer(out, roll_bytes, min_bytes, date), MANIFEST_DDL).write.parquet(f"{out}/_manifest")
    _drop_tmp(out)
    return f"{out}/_manifest"


def _members(data: memoryview, step: int = 1 << 16):
    """Uncompressed gzip members, one after another."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(z.decompress(data[at:at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """``page_id, type, url, record id, refers_to, payload size, payload digest, payload`` of one record; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.0" or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:-4]
    raw_digest = lambda k: base64.b32decode(field[k].removeprefix("sha1:")).hex()
    if len(block) != int(field["Content-Length"]) or hashlib.sha1(block).hexdigest() != raw_digest("WARC-Block-Digest"):
        raise ValueError(f"record {field['WARC-Record-ID']}: block and digest differ")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = raw_digest("WARC-Payload-Digest"), field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {field['WARC-Record-ID']}: payload and digest differ")
    num = lambda k: int(field[k]) if k in field else None
    return (num("X-Page-ID"), kind, field.get("WARC-Target-URI"), field["WARC-Record-ID"], num("X-Refers-To-Page-ID"), size, digest,
            payload if kind == "response" else None)


def _reader(with_payload: bool):
    def fn(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, held, size = path.rsplit("/", 1)[-1], [], 0
                for raw in _members(memoryview(content.as_buffer())):
                    r = parse(raw)
                    held.append((name, *(r if with_payload else (*r[:-1], None))))
                    size += len(raw) if with_payload else 200
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)
    return fn


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(READ.types)], schema=READ)


def read_warc(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest of ``out`` lists; raises where files and manifest differ."""
    manifest = spark.read.schema(MANIFEST_DDL).parquet(f"{out}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(out)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("file"), F.col("length"))
    wrong = manifest.join(found, "file", "left").filter("length IS NULL OR length <> bytes").select("file").first()
    if wrong:
        raise ValueError(f"archive {wrong.file} is missing or not as the manifest says")
    listed = files.withColumn("file", name).join(manifest.select("file"), "file", "left_semi")
    return listed.select("path", "content").mapInArrow(_reader(payloads), READ_DDL)
