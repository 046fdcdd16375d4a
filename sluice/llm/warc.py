"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage

#: Magic of the skippable frame that holds the dictionary, and of a dictionary.
FRAME_MAGIC = (0x184D2A5D).to_bytes(4, "little")
DICT_MAGIC = (0xEC30A437).to_bytes(4, "little")
ZSTD_MAGIC = (0xFD2FB528).to_bytes(4, "little")
#: A task's first rows give the dictionary: so many rows, and bytes of them, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 4 << 20
DICT_BYTES = 32 << 10
#: Date of records that come without one.
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20


class WarcError(ValueError):
    """An archive that isn't as the format wants it."""


def digest(payload: bytes) -> str:
    """Base32 SHA-1, bare and upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``: the HTTP head alone, with the length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, with its version, lengths and digests checked."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not end or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError("no WARC record")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"no {name}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length is not Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and h["warc-block-digest"] != "sha1:" + digest(block):
        raise WarcError("the block's digest differs")
    return h, block


def payload_of(h: dict[str, str], block: bytes) -> tuple[int, str]:
    """(length, digest) of the full payload; a response's own payload is checked against both."""
    http, end, payload = block.partition(b"\r\n\r\n")
    if not end or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP head")
    n = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    said = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != n or digest(payload) != said):
        raise WarcError("the payload differs from its length or digest")
    return n, said


def dictionary(samples: list[bytes]):
    """A trained dictionary, or None where the samples are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive(records, samples: list[bytes], level: int = 3):
    """Yields the bytes of an archive."""
    import zstandard

    known = dictionary(samples)
    if known is not None:
        body = zstandard.ZstdCompressor(level=level).compress(known.as_bytes())
        yield FRAME_MAGIC + len(body).to_bytes(4, "little") + body
    to = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        yield to.compress(r)


def read_archive(stream):
    """Yields the raw records of a stream with ``read(n)``, frame by frame; holds one record at a time."""
    import zstandard

    held = stream.read(8)
    known = None
    if held[:4] == FRAME_MAGIC:
        n = int.from_bytes(held[4:8], "little")
        body = b""
        while len(body) < n:
            if not (x := stream.read(n - len(body))):
                raise WarcError("the dictionary frame ends early")
            body += x
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        if body[:4] != DICT_MAGIC:
            raise WarcError("no dictionary in the leading frame")
        known, held = zstandard.ZstdCompressionDict(body), b""
    from_ = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while held or (held := stream.read(READ_BYTES)):
        frame, out = from_.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                held = frame.unused_data
                break
            if not (held := stream.read(READ_BYTES)):
                raise WarcError("the last frame ends early")
        yield b"".join(out)


def _write(root: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")))

        it, first, held = rows(), [], 0
        for r in it:
            first.append(r)
            held += len(r[2] or "")
            if len(first) >= SAMPLE_ROWS or held >= SAMPLE_BYTES:
                break
        if not first:
            return
        n = [0]

        def all_():
            from itertools import chain

            for page_id, url, html, to in chain(first, it):
                n[0] += 1
                yield record(page_id, url, (html or "").encode(), to)

        sample = [record(p, u, (h or "").encode()[: 64 << 10], None) for p, u, h, to in first if to is None]
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        storage.write_file(path, archive(all_(), sample))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n[0]], pa.int64())], names=["path", "n_records"])

    return run


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches):
    import pyarrow as pa

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def page(x):
        x = x[len("<urn:page:") : -1] if x else ""
        return int(x) if x else None

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    for b in batches:
        for path, n in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist()):
            at, name = storage.filesystem(path)
            rows, seen = [], 0
            with at.open_input_stream(name, compression=None) as f:
                for raw in read_archive(f):
                    h, block = parse(raw)
                    size, said = payload_of(h, block)
                    rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), size, said, h["warc-type"], page(h.get("warc-refers-to"))))
                    seen += 1
                    if len(rows) == 2000:
                        yield pack(rows)
                        rows = []
            if seen != n:
                raise WarcError(f"{path} holds {seen} records, not {n}")
            if rows:
                yield pack(rows)


def write_archives(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html), one archive for each partition, and returns the
    written list (path, n_records).

    Of rows with equal html (null counts as empty) the one with the smallest page_id is a response, the others revisit
    it; rows that repeat that page_id are responses too. A null url leaves the target out, a null page_id is never
    referred to while its payload has others. Long pages are written whole. Other columns are ignored; an empty table writes nothing.
    """
    spark = pages.sparkSession
    root = root or storage.new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    # payloads are equal if two digests are: SHA-1 alone can be made to collide
    raw = F.coalesce("html", F.lit("")).cast("binary")
    sha = F.concat(F.unhex(F.sha1(raw)), F.unhex(F.sha2(raw, 256)))
    keys = storage.persist(rows.select("page_id", sha.alias("sha")), "digests")
    firsts = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = storage.persist(keys.join(firsts, "sha").where("page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct(), "revisits")
    out = rows.withColumn("sha", sha).join(storage.small(again), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    return storage.persist(out.mapInArrow(_write(root), "path string, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Reads archives (path, n_records) record by record, validating headers, lengths and digests: a damaged one raises
    WarcError. A path that is listed twice is read twice; nulls in the list aren't allowed; an empty list gives no rows."""
    n = max(1, archives.count())
    return archives.repartition(n, "path").mapInArrow(_read, READ)
