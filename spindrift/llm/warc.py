"""WARC archives: a writer, and a reader that salvages what it can.

``write_warc`` writes one gzip member for each record, archives of at most ``archive_bytes`` bytes,
through ``pyarrow.fs`` into a folder that all executors share. Each task attempt has files of its
own names; those of the attempts that succeeded are in the returned manifest, and only they count.
Of records with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is a
response, the others are revisits (identical-payload-digest) that refer to it.

``read_warc`` lists archives with Spark's binaryFile source and opens each in its task, one at a
time, through ``pyarrow.fs``, or where that doesn't know the store takes Spark's bytes; archives are
plain, gzipped or both in turn. A record counts if its version line (of any version), header lines and
Content-Length hold, it ends in two line ends, and its block and payload digests, where given, are
right: md5, sha1, sha256 or sha512 in hexadecimal, base32 or base64 digits; others say nothing. Of a
member that doesn't unpack to its end (gzip's own checksum and length) the part before the damage is
read; its records count too, those without a digest with a reason that says so. After a failed check
the reader looks in all of the rest for the next place where a member that begins with a record, or
a version line, stands, goes on there, and logs the bytes in between as a gap with the reason. Every
byte is in a record or in a gap.

Defined cases: null html is an empty payload, null url leaves the target out. A null id is written as
``null`` and read back as null; it is never referred to unless no other id has the payload. A revisit whose payload digest isn't sha1 is read with a null one. Rows
that repeat an id and payload are responses of one id each. An empty table gives no archive and no
rows. Extra columns are not looked at. A record of any size is one unit of work.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import _text as tx

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d{1,2}\.\d{1,2}\r\n")
_MAGIC = b"\x1f\x8b\x08"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response or revisit record. digest and the HTTP header's length are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """Writes a record for each row; returns the manifest (path, n_records, n_bytes)."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_from)
    first = large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    spark = pages.sparkSession
    joined = tx.spread_join(large, first, ["digest"], "n", tx.partitions(spark), pages.count())  # one payload may be that of any share of the pages
    joined = joined.select("key", "url", "payload", "digest", "first", (F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))).alias("revisit"))
    if revisit_from > 0:
        joined = joined.union(rows.where(F.octet_length("payload") < revisit_from).select("key", "url", "payload", "digest", F.lit(None).cast("long"), F.lit(False)))

    def run(batches):
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}" if context else f"part-{uuid.uuid4().hex}"
        held: list[bytes] = []
        size = number = 0

        def close():
            nonlocal size, number
            path = f"{root}/{name}-{number:05d}.warc.gz"
            with store.open_output_stream(path, compression=None) as out:
                for x in held:
                    out.write(x)
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}-{number:05d}.warc.gz"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])
            held.clear()
            size, number = 0, number + 1
            return row

        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                payload = col["payload"][i].as_py()
                digest = base64.b32encode(bytes.fromhex(col["digest"][i].as_py())).decode()
                raw = record(col["key"][i].as_py(), col["url"][i].as_py(), payload, digest, col["first"][i].as_py(), col["revisit"][i].as_py())
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                if held and size + len(member) > archive_bytes:
                    yield close()
                held.append(member)
                size += len(member)
        if held:
            yield close()

    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return tx.table(joined.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def _fields(head: bytes) -> dict[str, str] | None:
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        last = name.strip().decode("utf-8", "replace").lower()
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _digest(given: str) -> tuple[str, bytes] | None:
    """Algorithm and value of a labelled digest in hexadecimal, base32 or base64 digits; None where either isn't known."""
    name, colon, digits = given.strip().partition(":")
    name = name.lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    for decode in (bytes.fromhex, lambda x: base64.b32decode(x.upper() + "=" * (-len(x) % 8)), lambda x: base64.urlsafe_b64decode(x.replace("+", "-").replace("/", "_") + "=" * (-len(x) % 4))):
        try:
            value = decode(digits.strip().rstrip("="))
        except ValueError:
            continue
        if len(value) == size:
            return name, value
    return None


def _holds(digest: tuple[str, bytes] | None, data: bytes) -> bool:
    return digest is None or hashlib.new(digest[0], data).digest() == digest[1]


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, reason): the record that starts at a place in unpacked data; without one, a reason."""
    version = _VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    cut = data.find(b"\r\n\r\n", version.end() - 2)
    if cut < 0:
        return None, at, "header without an end"
    fields = _fields(data[version.end() : cut]) if cut > version.end() else {}
    if fields is None:
        return None, at, "malformed header line"
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        return None, at, "no content length"
    start, size = cut + 4, int(fields["content-length"])
    end = start + size
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "cut off" if end + 4 > len(data) else "content length doesn't hold"
    block = data[start:end]
    given = _digest(fields.get("warc-block-digest", ""))
    checked = given is not None
    if not _holds(given, block):
        return None, end + 4, "block digest doesn't hold"
    payload, length = block, size
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        payload = body if blank else b""
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r\n", b"\n"))
        length = int(found[1]) if found else len(payload)
    kind = fields.get("warc-type", "")
    digest = _digest(fields.get("warc-payload-digest", ""))
    if kind != "revisit":
        length = len(payload)
        if not _holds(digest, payload):
            return None, end + 4, "payload digest doesn't hold"
        checked = checked or digest is not None and block == payload
    if digest and digest[0] == "sha1":
        shown = base64.b32encode(digest[1]).decode()
    else:
        shown = base32_sha1(payload) if kind != "revisit" else None
    return {"fields": fields, "type": kind, "checked": checked, "payload": payload, "payload_bytes": length, "payload_digest": shown}, end + 4, ""


def _plain(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and gaps of unpacked data: (kind, start, end, record or reason)."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found, end, why = parse_record(data, at)
        if found:
            if gap is not None:
                yield "gap", gap, at, reason
                gap = None
            yield "record", at, end, found
            at = end
            continue
        if gap is None:
            gap, reason = at, why
        if end > at and (end == len(data) or _VERSION.match(data, end)):
            at = end  # sound but for a digest: only this record is lost
            continue
        following = _VERSION.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield "gap", gap, len(data), reason


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, reason) of the gzip member at a place; with a reason, the content is what unpacked before the damage."""
    unpacker = zlib.decompressobj(31)
    out = []
    step = 1 << 11  # members are small as a rule
    place = at
    try:
        while not unpacker.eof and place < len(data):
            out.append(unpacker.decompress(data[place : place + step]))
            place += step
            step = min(2 * step, 1 << 20)
    except zlib.error as error:
        unpacker = zlib.decompressobj(31)
        unpacker.decompress(data[at:place])
        while step := step // 2:  # the longest beginning of the step that unpacks
            trial = unpacker.copy()
            try:
                out.append(trial.decompress(data[place : place + step]))
            except zlib.error:
                continue
            unpacker, place = trial, place + step
        return b"".join(out), at, f"gzip: {error}"
    if not unpacker.eof:
        return b"".join(out), at, "gzip: cut off"
    return b"".join(out), min(place, len(data)) - len(unpacker.unused_data), ""


def _packed(data: bytes, at: int, size: int) -> int:
    """Where the first ``size`` bytes of a member's content end in the file, to a byte or two."""
    unpacker = zlib.decompressobj(31)
    unpacker.decompress(memoryview(data)[at:], max(1, size - 1))  # asked for the last byte, it would look at what follows
    return len(data) - len(unpacker.unconsumed_tail)


def _starts_record(data: bytes, at: int) -> bool:
    """Whether a gzip member begins here whose content begins with a version line."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(data[at : at + (1 << 17)], 16)))  # a header may have 64 KB
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and quarantined gaps of an archive: (kind, start, end, record or reason); offsets are those of the file."""
    at, gap, reason = 0, None, ""
    version = member = -1  # the next places of each kind

    def following(at: int) -> int:
        nonlocal version, member
        if version < at:
            found = _VERSION.search(data, at)
            version = found.start() if found else len(data)
        if member < at:
            member = data.find(_MAGIC, at)
            while member >= 0 and not _starts_record(data, member):
                member = data.find(_MAGIC, member + 1)
            if member < 0:
                member = len(data)
        return min(version, member)

    while at < len(data):
        if zipped := data.startswith(_MAGIC, at):
            content, end, why = _member(data, at)
            inner = list(_plain(content))
            good = [x for x in inner if x[0] == "record"]
            sound = bool(good or not content and not why)
            if good and why:
                last = good[-1][2]
                inner = [x for x in inner if x[2] <= last]
                end = _packed(data, at, last)
                for x in good:
                    if not x[3]["checked"]:
                        x[3]["doubt"] = f"{why}; the record has no digest to check it by"
            elif not sound:
                why = why or inner[0][3]
        else:
            found, end, why = parse_record(data, at)
            inner, sound = [("record", at, end, found)], found is not None
        if sound:
            if gap is not None:
                yield "gap", gap, at, reason
                gap = None
            for kind, s, e, found in inner:
                yield kind, at, end, found if kind == "record" else f"within the member, {s} to {e}: {found}"
            at = end
            if zipped and why:
                gap, reason = at, why
                at = following(at)
            continue
        if gap is None:
            gap, reason = at, why
        # a whole member without a record, or a record sound but for a digest: only this is lost
        whole = end > at and (zipped or end == len(data) or _VERSION.match(data, end) or data.startswith(_MAGIC, end))
        at = following(end if whole else at + 1)
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data), reason


def _openable(path: str) -> bool:
    import pyarrow.fs as fs

    try:
        store, root = fs.FileSystem.from_uri(_uri(path))
        return store.get_file_info(root).type == fs.FileType.File
    except (OSError, pa.ArrowException):
        return False


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _contents(path: str) -> bytes:
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(_uri(path))
    with store.open_input_file(root) as file:
        return file.read()


_READ = "path string, start long, end long, kind string, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark, paths, payloads: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives (paths, folders or globs). payloads: whether to return them."""
    files = spark.read.format("binaryFile").load(paths)
    some = files.select("path").head(1)
    direct = bool(some) and _openable(some[0]["path"])  # then contents needn't pass through the JVM
    files = files.select("path").repartition(tx.partitions(spark), "path") if direct else files.select("path", "content")

    def rows(path, data):
        out = [[] for _ in range(12)]
        for kind, start, end, found in salvage(data):
            if kind == "gap":
                values = (path, start, end, kind, found, *[None] * 7)
            else:
                f = found["fields"]
                values = (path, start, end, kind, found.get("doubt"), found["type"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), found["payload_bytes"], found["payload_digest"], found["payload"] if payloads else None)
            for a, v in zip(out, values):
                a.append(v)
            if len(out[0]) >= 500:
                yield out
                out = [[] for _ in range(12)]
        if out[0]:
            yield out

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                for out in rows(path, _contents(path) if direct else batch.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    return files.mapInArrow(run, _READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Writes and reads back a record per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{tx.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    if not manifest.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_warc(spark, f"{folder}/*.warc.gz", payloads=False).join(manifest.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file")), F.regexp_extract("path", r"[^/]+$", 0) == F.col("file"), "left_semi")
    return found.where("kind = 'record'").select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


#: Five hexadecimal digits are four base32 digits.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
five AS (SELECT page_id, n, first, list_transform(range(8), lambda j: ('0x' || substr(x, CAST(5 * j + 1 AS BIGINT), 5))::BIGINT) AS g FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM five
"""
