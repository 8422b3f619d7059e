"""WARC records over a content-addressed store.

Writing: every row is a record. Of records with equal payloads (SHA-256) those of the largest id are responses and carry the payload, all
others are revisits that refer to it; records are written by Spark as gzipped WARC files, one a partition, without a shuffle of payloads
while the table of repeated digests is small.

Reading: files come as pieces of their byte stream, and records are cut out of the stream by their Content-Length, in constant memory; payloads may
hold anything, record separators included.

Store: payload bytes stand once in one table under their SHA-256, exact record headers in another. Both digests of a record are verified where
they are used: the address against the bytes when they enter the store, the SHA-1 and the length that a record states (of its own payload, taken before
any of them was left out) against the bytes that the join gives back. A record's bytes in the archive are its header, its HTTP header and, for
responses, its payload. The join deals a very common payload to many tasks: its records are salted, and as many copies of it are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: What parts the pieces that files are read in; a piece need not be a record.
PIECE = END + "WARC/1."
#: The most repeated digests that are broadcast to records (64 letters and an id each).
SENT = 200_000


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: four letters for each five digits."""
    letters = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*letters)


def _meet_holders(scratch: Scratch, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with the holder of their address, if it has one. ``repeated``: address, n, holder."""
    least = repeated.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if least["keys"] <= SENT:
        return rows.join(F.broadcast(repeated.select("address", "holder")), "address", "left")
    often = max(2_000, least["rows"] // 10_000)  # at most 10,000 addresses
    common = F.broadcast(repeated.where(F.col("n") > often).select("address", "holder"))
    rest = repeated.where(F.col("n") <= often).select("address", "holder")
    return rows.join(common, "address").unionByName(rows.join(common, "address", "left_anti").join(rest, "address", "left"))


def _urn(page_id: Column, address: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), address).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; fields that are null are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields])


def write_archives(pages: DataFrame, path: str, scratch: Scratch, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row in gzipped files under ``path``: responses, and revisits of equal payloads of ``min_bytes`` or more."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload")).withColumns({"address": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    narrow = rows.where(F.col("bytes") >= min_bytes).select("address", "page_id")
    repeated = scratch.keep(narrow.groupBy("address").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).where("n > 1"))
    placed = _meet_holders(scratch, rows, repeated).withColumn("again", F.coalesce(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False)))
    line = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    again = F.col("again")
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", _urn(F.col("page_id"), F.col("address"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", line),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("payload")))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(again, _urn(F.col("holder"), F.col("address")))),
            ("Page-Id", F.col("page_id")), ("Refers-To-Page-Id", F.when(again, F.col("holder"))), ("Payload-Address", F.concat(F.lit("sha256:"), F.col("address"))), ("Payload-Length", F.col("bytes")),
            ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", size),
        ),
        F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), http.cast("binary"), F.when(again, F.lit(b"")).otherwise(F.col("payload")))
    placed.select(record.cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Framer:
    """Cuts records out of a byte stream that comes in pieces."""

    def __init__(self):
        self.rest = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(header with its blank line, block) of every record that ends in what has come so far."""
        self.rest += piece
        at = 0
        while (split := self.rest.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(self.rest[at : split + 4])
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record starts with {head[:40]!r}")
            size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
            if size is None:
                raise ValueError(f"a WARC record without Content-Length: {head[:200]!r}")
            stop = split + 4 + size
            if len(self.rest) < stop + 4:
                break
            yield head, bytes(self.rest[split + 4 : stop])
            at = stop + 4
        del self.rest[:at]

    def end(self) -> None:
        """To be called when the stream is over."""
        if self.rest:
            raise ValueError(f"a WARC file ends within a record: {bytes(self.rest[:40])!r}")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """file, record (from 0), header, http_header, payload (null unless ``payloads``) of every record of the gzipped WARC files under ``path``.

    The header has its exact bytes, the blank line included; so has http_header, which is empty for blocks that aren't HTTP.
    A file that ends within a record, or holds what is no record, fails.
    """
    import pyarrow as pa

    fields = {"file": pa.string(), "record": pa.int64(), "header": pa.binary(), "http_header": pa.binary(), "payload": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields.values())], names=list(fields))

    def frame(batches):
        file, framer, number, rows, held = None, Framer(), 0, [], 0
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    framer.end()
                    file, framer, number = name, Framer(), 0
                else:
                    piece = PIECE.encode() + piece
                for head, block in framer.feed(piece):
                    split = block.find(b"\r\n\r\n") + 4 if b"\r\ncontent-type: application/http" in head.lower() else 0
                    rows.append((file, number, head, block[:split], block[split:] if payloads else None))
                    number += 1
                    held += len(block)
                if held > batch_bytes:
                    yield batch_of(rows)
                    rows, held = [], 0
        framer.end()
        yield batch_of(rows)

    pieces = spark.read.option("lineSep", PIECE).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(frame, "file string, record long, header binary, http_header binary, payload binary")


def _field(name: str) -> Column:
    """A header field's value, null if there is none."""
    return F.expr(rf"nullif(regexp_extract(cast(header as string), '(?:^|\r\n)(?i:{name}): ([^\r\n]*)', 1), '')")


def store(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of the archives under ``path``, written.

    headers: file, record, page_id, record_type, refers_to, address, stated_sha1, stated_bytes, header, http_header, one row per record.
    payloads: address, payload, one row per address. A payload that isn't what its address says fails.
    """
    address = F.regexp_extract(_field("Payload-Address"), "sha256:([0-9a-f]{64})", 1).alias("address")
    heads = read_archives(spark, path, payloads=False).select(
        "file", "record", _field("Page-Id").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("Refers-To-Page-Id").cast("long").alias("refers_to"), address,
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:([A-Z2-7]{32})", 1).alias("stated_sha1"), _field("Payload-Length").cast("long").alias("stated_bytes"), "header", "http_header",
    )
    headers = scratch.keep(heads)
    full = read_archives(spark, path).where(_field("WARC-Type") == "response").select(address, "payload")
    sound = full.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its address says: "), "address"))).alias("payload"))
    twice = scratch.keep(headers.where("record_type = 'response'").groupBy("address").agg(F.count("*").alias("n"), F.lit(1).alias("holder")).where("n > 1"))
    met = _meet_holders(scratch, sound, twice)
    once = met.where("holder is null").select("address", "payload")
    payloads = scratch.keep(once.unionByName(met.where("holder is not null").groupBy("address").agg(F.min("payload").alias("payload"))))
    scratch.drop(twice)
    return headers, payloads


def restore(headers: DataFrame, payloads: DataFrame, scratch: Scratch, least: int = 2_000) -> DataFrame:
    """The rows of headers with ``payload``: the whole one, also for revisits; null where no record of the archives holds it.

    Addresses of more than a ten-thousandth of all records (at most 10,000; none below ``least`` records) are dealt out: their records go to
    random parts, and their payload to each part, which makes 20,000 payloads at most. A payload of another length or SHA-1 than a record states fails.
    """
    often = max(least, headers.count() // 10_000)
    common = scratch.keep(headers.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > often).select("address", F.ceil(F.col("n") / often).cast("int").alias("parts")))
    few = F.broadcast(common)
    left = headers.join(few, "address", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("file", "record"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    right = payloads.join(few, "address", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    met = left.join(right, ["address", "part"], "left").drop("part")
    wrong = (F.octet_length("payload") != F.col("stated_bytes")) | (base32_of_hex(F.sha1("payload")) != F.col("stated_sha1"))
    return met.withColumn("payload", F.when(wrong, F.raise_error(F.concat(F.lit("payload is not what its record states: "), "file", F.lit(" "), F.col("record").cast("string")))).otherwise(F.col("payload")))


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as its record says after a round trip.

    Rows are written as WARC records, the archives are read back into a store, and all records are restored from it. Null payloads are empty ones, and equal
    like all others. Ids are integers; of equal payloads the rows of the largest id are responses (all of them, should rows share it), the
    others revisit it; a null id is the smallest. Payloads of under ``min_bytes`` bytes are all responses. A null url gives no target.
    Other columns are ignored; an empty table gives no rows. Line ends in a url are percent-encoded.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    path = f"{scratch.home}/archives"
    write_archives(pages, path, scratch, page_id, url, payload, min_bytes)
    headers, payloads = store(spark, path, scratch)
    scratch.drop_path(path)
    whole = restore(headers, payloads, scratch)
    result = scratch.keep(whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to"))
    scratch.drop_all_but(result)
    return result


def oracle() -> str:
    """The same in DuckDB, from the digests of the rows."""
    letters = " || ".join(f"substr('{BASE32}', 1 + ((('0x' || substr(h, {at}, 5))::INTEGER >> {bits}) & 31), 1)" for at in range(1, 41, 5) for bits in (15, 10, 5, 0))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
    SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to FROM d"""
