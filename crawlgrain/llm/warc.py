"""WARC archives: writing with deduplicated payloads, reading by boundary-chain verification.

Archives are plain files of Spark's text writer. A reader splits them at the magic
`WARC/1.0` into candidate records, wherever Spark splits the file; each candidate knows
its own offset and, from its Content-Length, that of its successor. Candidates of one
input split that follow each other without a gap form a run. Pointer jumping over the
runs, from offset 0 of each file, finds which are reached and where they are entered;
a magic inside a payload is never reached.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgrain.llm.cluster import checkpoint_dir, durable, parted, removed, small, tidied

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"
#: Payloads under this many bytes are never written as revisits.
REVISIT_BYTES = 1000
_DATE = "2026-01-01T00:00:00Z"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
_CANDIDATE = "file string, block long, rel long, size long, succ long, record_type string, record_id string, uri string, refers_to string, payload_at long, digest string, stated string"
#: Files whose split records are read again by name; more are read again with all others.
_FILES_BY_NAME = 1000


def records(pages: DataFrame, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(id, record): one WARC record per row, without its last two line ends.

    Of equal payloads of at least revisit_bytes, the row with the largest id is the
    response and the others are revisits without payload that name it; of repeated ids
    every row with the largest id is a response. Null payloads are empty, null URIs
    are written as empty, null ids as `null`. Rows whose digest isn't repeated go
    straight to the writer; only what may be repeated is joined with the response's id.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(uri_column).cast("string"), F.lit("")), r"[\r\n]", " ").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    last = rows.where(F.col("n") >= revisit_bytes).groupBy("digest", "n").agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n", "last")
    last = durable(last)
    if small(last, 100):
        rows = rows.join(F.broadcast(last), ["digest", "n"], "left")
    else:
        single, many = parted(rows, last.select(F.xxhash64("digest", "n")), F.xxhash64("digest", "n"))
        rows = single.withColumn("last", F.lit(None).cast("long")).unionByName(many.join(last, ["digest", "n"], "left"))
    again = F.col("id") < F.col("last")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    body = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    head = [
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("last"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    ]
    return rows.select("id", F.concat(*head).alias("record"))


def write(records_: DataFrame, path: str) -> None:
    """Writes records as archives under `path`, a file per task."""
    records_.select("record").write.mode("overwrite").option("lineSep", _END.decode()).text(path)


def _parse(tail: bytes) -> dict:
    """Fields of the candidate whose bytes after the magic are `tail`; without a Content-Length, none."""
    end = tail.find(_END)
    fields = {k.lower(): v for k, v in _FIELD.findall(tail[:end].replace(b"\r", b""))} if end >= 0 else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return {}
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    body = end + len(_END)
    http = tail.find(_END, body) if tail[body : body + 5] == b"HTTP/" else -1
    return {"head": len(MAGIC) + body, "length": int(length), "payload": http + len(_END) if 0 <= http < body + int(length) else body, "type": text(b"warc-type"), "id": text(b"warc-record-id"), "uri": text(b"warc-target-uri"), "refers": text(b"warc-refers-to"), "stated": text(b"warc-payload-digest")}


def _hex(stated: str | None) -> str | None:
    """A stated SHA-1, in hexadecimal or base 32, as lower-case hexadecimal; null if it is of another kind."""
    kind, _, value = (stated or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except binascii.Error:
            return None
    return value.lower()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece between two magics: its place in the split, its successor, its payload's digest if it is whole."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        rows = []
        for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            tail = line.as_buffer().to_pybytes()
            rel = at.get((file, block), 0)
            # the file's first piece is what stands before its first magic
            first = block == 0 and (file, block) not in at
            size = len(tail) + len(MAGIC)  # to where the next piece's tail begins
            at[file, block] = rel + size
            x = {} if first else _parse(tail)
            if not x:
                rows.append((file, block, rel, size, None, None, None, None, None, None, None, None))
                continue
            end = x["head"] + x["length"]
            whole = end + len(_END) == size  # else a magic stands in its payload, or it is cut short
            payload = tail[x["payload"] : end - len(MAGIC)] if whole and tail.endswith(_END) else None
            rows.append((file, block, rel, size, end + len(_END), x["type"], x["id"], x["uri"], x["refers"], len(MAGIC) + x["payload"], hashlib.sha1(payload).hexdigest() if payload is not None else None, _hex(x["stated"])))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _CANDIDATE.split(", ")])


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("tail"))


def _before(values: DataFrame, f: Column) -> DataFrame:
    """(file, block, base): f over the blocks of the file before this one, a small row each."""
    return values.select("file", "block", f.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))


def _bases(pieces: DataFrame) -> DataFrame:
    """(file, block, base): where a split's pieces begin in their file, by the sizes of the splits before."""
    return _before(pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes")), F.sum("bytes"))


def _placed(pieces: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds `at`, a piece's magic's offset in its file."""
    return pieces.join(bases, ["file", "block"]).withColumn("at", F.coalesce("base", F.lit(0)) + F.col("rel") - len(MAGIC)).drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Verified records of the archives under `path`.

    (file, offset, record_id, record_type, uri, refers_to, payload_bytes, payload_digest,
    digest_ok): the digest is computed from the bytes read; digest_ok says whether it is
    the one that a response states, null where none is stated by SHA-1 or the record is
    no response. Records are those that the chain from each file's start reaches; a chain
    ends at its first broken record, and what stands before a file's first magic breaks
    it at once. Files without a record give no rows.
    """
    pieces = durable(_pieces(spark, path).mapInArrow(tidied(_candidates), _CANDIDATE))
    found = _placed(pieces, _bases(pieces))
    real = found.where("succ is not null").withColumn("next", F.col("at") + F.col("succ"))
    order = Window.partitionBy("file", "block").orderBy("rel")
    touching = F.lag("next").over(order) == F.col("at")
    runs = real.select("file", "block", "rel", "at", "next").withColumn("opens", F.when(touching, F.lit(None)).otherwise(F.col("at")))
    runs = durable(runs.withColumn("run", F.last("opens", ignorenulls=True).over(order)).select("file", "at", "next", "run"))
    ends = runs.groupBy("file", "run").agg(F.max("next").alias("exit"))
    target = runs.select("file", F.col("at").alias("exit"), F.col("run").alias("to"))
    edges = durable(ends.join(target, ["file", "exit"], "left").select("file", "run", "exit", "to"))
    entered = _reached(edges)
    kept = runs.join(entered, ["file", "run"]).where(F.col("at") >= F.col("entry")).select("file", "at")
    out = found.join(kept, ["file", "at"])
    whole, split = out.where("digest is not null"), durable(out.where("digest is null").select("file", "at", "succ", "payload_at", "record_type", "record_id", "uri", "refers_to", "stated"))
    ok = F.when(F.col("record_type") == "response", F.col("digest") == F.col("stated"))
    columns = ["file", F.col("at").alias("offset"), "record_id", "record_type", "uri", "refers_to", (F.col("succ") - F.col("payload_at") - len(_END)).alias("payload_bytes"), F.col("digest").alias("payload_digest"), ok.alias("digest_ok")]
    done = whole.select(*columns)
    if split.isEmpty():
        return done
    return done.unionByName(_joined(spark, path, found, split).select(*columns))


def _reached(edges: DataFrame) -> DataFrame:
    """(file, run, entry): runs that the chain from offset 0 reaches, by doubling pointers.

    After step k, `reached` holds the first 2**k runs of every chain and `to` jumps
    2**k runs ahead.
    """
    exits = edges.select("file", F.col("to").alias("run"), F.col("exit").alias("entry"), F.col("run").alias("before")).where("run is not null")
    jump = edges.where("to is not null").select("file", "run", "to")
    reached = durable(edges.where("run = 0").select("file", "run"))
    while not jump.isEmpty():
        more = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = durable(reached.unionByName(more).distinct())
        ahead = jump.select("file", F.col("run").alias("to"), F.col("to").alias("beyond"))
        jump = durable(jump.join(ahead, ["file", "to"]).select("file", "run", F.col("beyond").alias("to")))
    came = exits.join(reached.select("file", F.col("run").alias("before")), ["file", "before"]).select("file", "run", "entry")
    return reached.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry")).unionByName(came)


def _owners(found: DataFrame, split: DataFrame) -> DataFrame:
    """(file, own, piece): of each piece that stands in a split record, the record's offset and its own.

    Split records don't overlap, so a piece belongs to the last one that begins before
    it, in its block or in those before: no range join.
    """
    starts = split.select("file", "at", F.col("at").alias("begin"), (F.col("at") + F.col("succ")).alias("end"))
    begins = found.select("file", "block", "rel", "at").join(starts, ["file", "at"], "left")
    here = F.last(F.when(F.col("begin").isNotNull(), F.struct("begin", "end")), ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("rel"))
    latest = begins.groupBy("file", "block").agg(F.max(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))).alias("m"))
    carried = _before(latest, F.max("m"))
    owned = begins.withColumn("here", here).join(carried, ["file", "block"]).withColumn("o", F.coalesce("here", "base"))
    return owned.where(F.col("at") < F.col("o.end")).select("file", F.col("o.begin").alias("own"), F.col("at").alias("piece"))


def _joined(spark: SparkSession, path: str, found: DataFrame, split: DataFrame) -> DataFrame:
    """Records whose payload holds a magic: their pieces are read again and put together.

    Up to _FILES_BY_NAME files that have such records are read by name. A record's
    pieces are one task's work, as its digest is.
    """

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        first = table.slice(0, 1)
        at, succ, payload_at = (first.column(c)[0].as_py() for c in ("at", "succ", "payload_at"))
        raw = b"".join(MAGIC + t.as_buffer().to_pybytes() for t in table.column("tail"))
        ok = table.column("piece")[0].as_py() == at and raw[succ - len(_END) : succ] == _END
        digest = hashlib.sha1(raw[payload_at : succ - len(_END)]).hexdigest() if ok else None
        return pa.table({"file": first.column("file"), "at": pa.array([at], pa.int64()), "digest": pa.array([digest], pa.string())})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            rel, size = [], [len(tail.as_buffer()) + len(MAGIC) for tail in batch.column(2)]
            for k, n in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), size, strict=True):
                rel.append(at.get(k, 0))
                at[k] = rel[-1] + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64()), pa.array(size, pa.int64())], ["file", "block", "tail", "rel", "size"])

    files = [r["file"] for r in split.select("file").distinct().limit(_FILES_BY_NAME + 1).collect()]
    by_name = len(files) <= _FILES_BY_NAME
    pieces = _pieces(spark, files if by_name else path).mapInArrow(tidied(placed), "file string, block long, tail binary, rel long, size long")
    # read by name, files may be cut into other blocks than before
    base = _bases(pieces.drop("tail")) if by_name else _bases(found)
    of = _placed(pieces, base).select("file", F.col("at").alias("piece"), "tail").join(durable(_owners(found, split)), ["file", "piece"])
    near = of.join(split.select("file", F.col("at").alias("own"), "succ", "payload_at"), ["file", "own"]).withColumnRenamed("own", "at")
    digests = near.groupBy("file", "at").applyInArrow(whole, "file string, at long, digest string").where("digest is not null")
    return split.join(digests, ["file", "at"])


def page_id(urn: Column) -> Column:
    """The id in a record id of records()."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back, and returns what they hold, by page.

    A revisit's payload is that of the response it names. The archives are deleted once read.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(records(pages), path)
    got = durable(read(spark, path).select(page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"), "uri", "file", "offset", "digest_ok"))
    removed(spark, path)
    full = got.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).dropDuplicates(["refers_to"])
    again = got.where("record_type = 'revisit'").join(full, "refers_to", "left")
    return got.where("record_type = 'response'").unionByName(again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to", "uri", "file", "offset", "digest_ok"))
