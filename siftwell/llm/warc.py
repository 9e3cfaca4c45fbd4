"""WARC captures: reading records, and resolving not-modified revisits.

A revisit says that a page had not changed. It is resolved by an as-of join: of the full responses with its canonical
url, the latest earlier one. If the validators agree, its payload stands for the revisit's, and the header fields that
a not-modified answer may carry replace the stored ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import own

#: Header fields (lower case) that a not-modified answer may update; others would describe a body it does not have.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a page.
TRACKING = ("ref", "fbclid", "gclid", "sessionid")
#: Seconds of captures of one url that a task sees together.
SPAN = 3600

RECORD = "record_id string, record_type string, url string, ts timestamp, status int, headers map<string,string>, payload_digest string, payload binary, skipped long"
_BATCH_BYTES = 8 << 20


def canonical_url(url: Column) -> Column:
    """Host (lower case, without a default port), path (at least /) and the sorted query without tracking parameters;
    scheme and fragment do not matter. Null for null and for what has no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    rest = F.regexp_replace(rest, r"(?s)#.*", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"\A([^/?]*)", 1)), r":(80|443)\z", "")
    path = F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(rest, r"(?s)\A[^?]*\?(.*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING) & ~p.startswith("utm_")))
    joined = F.array_join(kept, "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"\AW/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit among the records (record_id, record_type response or revisit, url, ts, headers with
    lower-case names, payload_digest): record_id, canonical_url, ts, resolved_id, outcome and headers.

    outcome is resolved, changed (validators differ; resolved_id then names the response that was compared),
    unvalidated (neither entity tag, date nor digest to compare) or missing (no earlier response, or no url). Entity
    tags are compared weakly; without a pair of them the modification dates are, then payload digests. Of responses at
    one time the one with the largest record_id counts as latest; only a strictly earlier time is earlier. Null times
    never match. headers: the response's, with the revisit's permitted ones put over them, if resolved; else the
    revisit's own.

    Repeated revisits each get a row; of responses with one url, time and record_id any stands for all. Columns beside
    those named are dropped, and record types other than the two are left out.

    A url with any number of captures is safe: responses and revisits of one time are first brought down to one row
    each; the url's time is cut into spans, a span's times are ordered by themselves, and revisits without an earlier
    response in their span take the last one of earlier spans from a table with a row for each url and span.
    """
    url, at, micros, info, last = own("url"), own("span"), own("micros"), own("info"), own("last")
    named = records.select(
        "record_id",
        "record_type",
        "ts",
        canonical_url(F.col("url")).alias(url),
        F.floor(F.unix_timestamp("ts") / span).alias(at),
        F.unix_micros("ts").alias(micros),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "payload_digest",
    )
    usable = named.filter(F.col(url).isNotNull() & F.col("ts").isNotNull())
    shown = F.struct("record_id", "headers", "payload_digest")
    responses = usable.filter("record_type = 'response'").groupBy(url, at, micros).agg(F.max_by(shown, F.coalesce("record_id", F.lit(""))).alias(info))
    asked = usable.filter("record_type = 'revisit'")
    times = responses.unionByName(asked.select(url, at, micros).distinct().withColumn(info, F.lit(None).cast(responses.schema[info].dataType)))
    before = Window.partitionBy(url, at).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    inside = times.withColumn(last, F.last(info, ignorenulls=True).over(before)).withColumn(own("is"), F.col(info).isNull()).filter(own("is")).select(url, at, micros, last)
    by_span = responses.groupBy(url, at).agg(F.max_by(info, micros).alias(last))
    spans = times.select(url, at).distinct().join(by_span, [url, at], "left")
    earlier = F.last(last, ignorenulls=True).over(Window.partitionBy(url).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(url, at, earlier.alias(own("before"))).filter(F.col(own("before")).isNotNull())
    known = inside.join(carried, [url, at], "left").select(url, micros, F.coalesce(last, own("before")).alias(last))
    found = asked.join(known, [url, micros], "left")
    lost = named.filter((F.col("record_type") == "revisit") & (F.col(url).isNull() | F.col("ts").isNull()))
    every = found.select("record_id", "ts", url, "headers", "payload_digest", last).unionByName(lost.select("record_id", "ts", url, "headers", "payload_digest").withColumn(last, F.lit(None)), allowMissingColumns=True)
    theirs, ours = F.col(last)["headers"], F.col("headers")
    tag = _weak(ours["etag"]) == _weak(theirs["etag"])
    date = ours["last-modified"] == theirs["last-modified"]
    digest = F.col("payload_digest") == F.col(last)["payload_digest"]
    same = F.coalesce(tag, date, digest)
    outcome = F.when(F.col(last).isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")
    allowed = F.map_filter(ours, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return every.select("record_id", F.col(url).alias("canonical_url"), "ts", F.col(last)["record_id"].alias("resolved_id"), outcome.alias("outcome"), F.when(outcome == "resolved", merged).otherwise(ours).alias("headers"))


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        if name.strip():
            out[name.strip().lower()] = value.strip()
    return out


def _plain(content: bytes) -> Iterator[tuple[bytes, int]]:
    """The bytes of a file, unpacked where it is gzipped, in parts, each with the packed bytes left out before it. After
    a broken member it goes on at the next one; what that one held up to the break is kept."""
    if content[:2] != b"\x1f\x8b":
        yield content, 0
        return
    at, skipped, view = 0, 0, memoryview(content)
    while at < len(content):
        member, parts, used = zlib.decompressobj(wbits=31), [], at
        try:
            while used < len(content) and not member.eof:
                step = view[used : used + (1 << 20)]
                parts.append(member.decompress(step))
                used += len(step) - len(member.unused_data)
        except zlib.error:
            pass
        if data := b"".join(parts):
            yield data, skipped
            skipped = 0
        if not member.eof:  # broken or cut
            after = content.find(b"\x1f\x8b\x08", at + 1)
            used = len(content) if after < 0 else after
            skipped += 0 if data else used - at
        at = used
    if skipped:
        yield b"", skipped


def _records(data: bytes) -> Iterator[tuple[dict | None, int]]:
    """(fields and body of a record, 0) or (None, bytes that are no record) for all of data, in order."""
    at, end = 0, len(data)

    def begins(place):
        return data.startswith(b"WARC/", place)

    def following(place):
        """The next line from a place on that begins a record."""
        while 0 <= (place := data.find(b"WARC/", place)):
            if place == 0 or data[place - 1] == 10:
                return place
            place += 1
        return end

    while at < end:
        if not begins(at):
            stop = following(at)
            if data[at:stop].strip():
                yield None, stop - at
            at = stop
            continue
        head = data.find(b"\r\n\r\n", at)
        lines = data[at : head if head >= 0 else end].split(b"\r\n")
        fields = _headers(lines[1:])
        size = fields.get("content-length", "")
        begin = head + 4
        if head >= 0 and size.isdigit() and begin + int(size) <= end:
            after = begin + int(size)
            rest = after
            while rest < end and data[rest] in b"\r\n":
                rest += 1
            if rest == end or begins(rest) or data.startswith(b"\r\n\r\n", after):
                yield fields | {"": data[begin:after]}, 0
                at = rest
                continue
        stop = following(at + 5)  # cut, or of a wrong length
        yield None, stop - at
        at = stop


def parse_warc(content: bytes) -> Iterator[dict]:
    """The response and revisit records of a WARC file, plain or gzipped by record. What is no whole record (foreign
    lines, a cut record, one whose length does not lead to the next) is stepped over up to the next record, and told as
    a row of type `unreadable` with the number of bytes in `skipped`."""
    nothing = dict.fromkeys(("record_id", "record_type", "url", "ts", "status", "headers", "payload_digest", "payload"))
    for data, lost in _plain(content):
        for fields, skipped in ([(None, lost)] if lost else []) + list(_records(data)):
            if fields is None:
                yield nothing | {"record_type": "unreadable", "headers": {}, "skipped": skipped}
                continue
            kind = fields.get("warc-type", "")
            if kind not in ("response", "revisit"):
                continue
            head, _, payload = fields[""].partition(b"\r\n\r\n")
            first, *rest = head.split(b"\r\n")
            status = first.split(b" ")[1:2]
            yield {"record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "ts": fields.get("warc-date"), "status": int(status[0]) if status and status[0].isdigit() else None, "headers": _headers(rest), "payload_digest": fields.get("warc-payload-digest"), "payload": payload if kind == "response" else None, "skipped": 0}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, read by Spark's own reader: one file of at most 2 GB (that reader's limit; writers
    close files at about 1 GB) at a time in a task. Rows of type `unreadable` tell what could not be read."""

    def run(batches):
        import pyarrow as pa

        kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_digest", pa.string()), ("payload", pa.binary()), ("skipped", pa.int64())]
        held, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parse_warc(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    held.append(record | {"headers": list(record["headers"].items())})
                    size += len(record["payload"] or b"") + 500
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD.replace("ts timestamp", "ts string"))
    return found.withColumn("ts", F.try_to_timestamp("ts"))
