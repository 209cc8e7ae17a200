"""WARC archives: a writer of gzipped records and a splittable reader.

Writing: every record is a gzip member of its own. Spark's text writer puts the members into files, so
the files are committed like any of Spark's output and reach any file system Spark writes to. It ends each
value with a separator; here that is an empty gzip member, which keeps a file valid gzip.

Reading: an archive is cut into byte ranges. A task scans its range for the gzip magic and owns what starts
inside, reading beyond the end to finish its last piece; this is Spark's text reader with the magic as
line separator. The magic also occurs by chance inside compressed data, so each piece is a candidate: it
starts a record only if its header inflates to a WARC version line. A record that such a chance has cut
goes on in the next piece; where it runs over the end of a range, both sides are kept (`open` and `lead`
rows, a few per range at most) and joined by file afterwards.

Cases: a null payload is empty; a null url is an empty target. Of rows equal in page_id and payload each
is written, and each that has the largest id is a response. A null page_id counts as less than any id. Control characters and spaces
in a url are percent-encoded. Other columns are ignored; an empty table gives empty archives and no rows. Bytes that belong to no
record are skipped."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimeter.storage import materialize

MAGIC = b"\x1f\x8b\x08"
_ID = "urn:x-page:"
_END = b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = _gzip(b"")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the payload's length, and leaves the payload out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{_ID}{'' if page_id is None else page_id}>",
              "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"),
              "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<{_ID}{refers_to}>"
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + _END


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A record per row of `pages` (page_id, url, html). Equal payloads are found by digest; a hot one combines per task first."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", F.when(
        F.col("first").isNotNull() & (F.length("payload") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))
            members = [_gzip(record(i, u, p, f, f is not None)) for i, u, p, f in zip(*columns)]
            yield pa.record_batch([pa.array(members, pa.binary())], ["value"])
    members = told.mapInArrow(build, "value binary")
    # The cast changes no byte: Spark keeps strings as bytes and writes them so.
    (members.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("encoding", "ISO-8859-1").text(path))


class _Scan:
    """Joins pieces to members. feed() gives inflated WARC records; what cannot be told yet is in `lead` and `open`."""

    def __init__(self) -> None:
        self.lead: list[bytes] = []   # pieces before the first member of the range
        self.open: list[bytes] = []   # pieces of a record not at its end yet
        self.begun = False
        self._z = None
        self._out: list[bytes] = []
        self._head = b""

    def feed(self, piece: bytes) -> Iterator[bytes]:
        if self.open:
            try:
                self._out.append(self._z.decompress(piece))
            except zlib.error:
                self._give_up()  # damaged, or no member at all; the piece may start another
            else:
                self.open.append(piece)
                yield from self._settle()
                return
        self._z = zlib.decompressobj(31)
        try:
            self._out, self.open, self._head = [self._z.decompress(piece)], [piece], b""
        except zlib.error:
            self.open = [piece]
            self._give_up()
        else:
            yield from self._settle()

    def _settle(self) -> Iterator[bytes]:
        if len(self._head) < 5:
            self._head += self._out[-1][:5]
        if self._z.eof:  # its checksum was right; a member of another kind, like the empty one, is passed over
            self.begun = True
            if self._head.startswith(b"WARC/"):
                yield b"".join(self._out)
            self.open = []
        elif not b"WARC/".startswith(self._head[:5]):
            self._give_up()
        elif len(self._head) >= 5:
            self.begun = True

    def _give_up(self) -> None:
        if not self.begun:
            self.lead += self.open
        self.open = []


def parse(data: bytes) -> dict:
    """Headers (lower case) and block of an inflated record."""
    head, _, rest = data.partition(_END)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    fields["block"] = rest[: int(fields.get("content-length", 0))]
    return fields


SCHEMA = "kind string, file string, at long, seq int, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _row(data: bytes, with_payload: bool) -> dict:
    r = parse(data)
    http, _, body = r["block"].partition(_END)
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    whole = r.get("warc-type") != "revisit"
    return {"kind": "record", "record_type": r.get("warc-type"), "record_id": r.get("warc-record-id", "").strip("<>"),
            "target": r.get("warc-target-uri"), "refers_to": r.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": digest_of(body) if whole else r.get("warc-payload-digest", "").removeprefix("sha1:"),
            "payload_bytes": len(body) if whole else length, "payload": body if with_payload and whole else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"at": pa.int64(), "seq": pa.int32(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in _NAMES], _NAMES)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below `path`, one row each. File names must not end in a suffix, such as .gz, for which Spark inflates whole files."""
    raw = (spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
           .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("at")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, rows = None, _Scan(), []

        def rest() -> list[dict]:
            kept = [("lead", p) for p in state.lead] + [("open", p) for p in state.open]
            return [{"kind": k, "file": here[0], "at": here[1], "seq": i, "payload": p} for i, (k, p) in enumerate(kept)]
        for b in batches:
            for value, file, at in zip(*(b.column(c).to_pylist() for c in ("value", "file", "at"))):
                if (file, at) != here:
                    if here:
                        rows += rest()
                    here, state = (file, at), _Scan()
                    if at == 0:
                        continue  # what stands before the first magic
                rows += [_row(x, with_payload) for x in state.feed(MAGIC + value)]
            if rows:
                yield _batch(rows)
                rows = []
        if here and (rows := rest()):
            yield _batch(rows)

    def mend(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by([("at", "ascending"), ("seq", "ascending")])
        state, out = _Scan(), []
        for piece in parts["payload"].to_pylist():
            out += [_row(x, with_payload) for x in state.feed(piece)]
        return pa.Table.from_batches([_batch(out)])

    found = materialize(raw.mapInArrow(scan, SCHEMA))
    cut = found.filter("kind <> 'record'")
    mended = cut.groupBy("file").applyInArrow(mend, SCHEMA)
    return found.filter("kind = 'record'").unionByName(mended).drop("kind", "file", "at", "seq")


def page_of(record_id: str):
    """The page_id inside a record id column (null if it has none)."""
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) AS bigint)")
