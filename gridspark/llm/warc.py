"""Web archives: WARC records written, read back, and indexed in order of URL and time.

Each page becomes one WARC/1.1 record, a gzip member of its own, so that any record can be read by its offset. Of
captures with equal payloads one is stored as ``response``; the others are ``revisit`` records that refer to it and
hold the HTTP head alone. An archive is a table of members: (archive, offset, member), whose concatenation by
offset is the file, as :func:`export` writes it.

Reading unpacks every member, parses its head by ``Content-Length`` and checks the payload against its digest. The
captures that are read form sorted runs, one a task. These are dealt by range of URL key and time, and each range
merges its pieces of all runs with a tree of losers; ranges follow each other, so that the histories of all URLs
are in one order. A URL that a third of all captures have goes to as many ranges as its captures need, as time and place
in the archive are part of the key.

Cases: a null payload is empty, a null URL has no target and the empty key; payloads under ``least`` bytes are always
responses; the original of equal payloads is the capture with the smallest id, and repeated rows of it are responses too; a
capture without id refers to the original, if one has an id, and is a response otherwise; blanks and control characters
in a URL, which a head cannot hold, are percent-encoded; an empty table gives an archive-less empty table; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.order import numbered

from .storage import materialize

#: Captures of tables without a time are dated from here, 2024-01-01, a second apart.
EPOCH = 1_704_067_200
#: An archive that has reached so many bytes is followed by another.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then path and query: ``http://A.example.com/x?y#z`` is
    ``com,example,a)/x?y``. What is no URL is its own key."""
    host = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    rest = F.regexp_extract(url, URL, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.rlike(URL), key).otherwise(F.coalesce(url, F.lit("")))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = 100) -> DataFrame:
    """(id, url, seconds, digest, payload, first): each page with its payload's SHA-256 and, where it repeats an
    earlier one, that one as struct<id, url, seconds>. ``time_col`` holds seconds since 1970."""
    seconds = F.col(time_col).cast("long") if time_col else F.lit(EPOCH) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(10**9))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), seconds.alias("seconds"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ = F.octet_length("payload") >= least
    alike = rows.filter(long_).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url", "seconds"))).alias("first"))
    # A table of its own: a sorted join with it can be split at digests that many pages have.
    alike = materialize(alike.filter("n > 1 and first is not null").select("digest", "first"), "originals")
    later = long_ & (F.col("id").isNull() | (F.col("id") > F.col("first.id")))
    return rows.join(alike, "digest", "left").select("id", "url", "seconds", "digest", "payload", F.when(later, F.col("first")).alias("first"))


def record_id(id_: int | None, digest: str) -> str:
    h = hashlib.md5(f"{'' if id_ is None else id_}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _date(seconds: int) -> str:
    from datetime import UTC, datetime, timedelta

    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def member(kind: str, heads: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in heads), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def _page(row: dict) -> bytes:
    payload, first, url = (row["payload"] or "").encode("utf-8", "surrogatepass"), row["first"], row["url"]
    heads = [("WARC-Record-ID", record_id(row["id"], row["digest"])), ("WARC-Date", _date(row["seconds"]))]
    heads += [("WARC-Target-URI", _uri(url))] if url is not None else []
    heads += [("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http;msgtype=response")]
    heads += [("Capture-Id", str(row["id"]))] if row["id"] is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return member("response", heads, http + payload)
    heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["id"], row["digest"])), ("WARC-Refers-To-Date", _date(first["seconds"]))]
    heads += [("WARC-Refers-To-Target-URI", _uri(first["url"]))] if first["url"] is not None else []
    return member("revisit", heads, http)


def _writer(archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, at = TaskContext.get().partitionId(), -1, archive_bytes
        for batch in batches:
            names, offsets, members = [], [], []
            for row in batch.to_pylist():
                if at >= archive_bytes:  # each archive begins with a record about itself
                    serial, at = serial + 1, 0
                    name = f"pages-{task:05d}-{serial:05d}.warc.gz"
                    about = member("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", _date(EPOCH)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    names, offsets, members, at = [*names, name], [*offsets, 0], [*members, about], len(about)
                packed = _page(row)
                names.append(name)
                offsets.append(at)
                members.append(packed)
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(members, pa.binary())], ["archive", "offset", "member"])

    return run


def write_archives(found: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, offset, member) for :func:`captures`, written to the shared folder: archives of gzip members."""
    return materialize(found.mapInArrow(_writer(archive_bytes), "archive string, offset long, member binary"), "archives", compression="none")


def export(archives: DataFrame, folder: str) -> None:
    """Archives as files, each in a folder of its own name, in any store that Spark writes.

    Spark has no writer of plain bytes; its text writer ends each row with a separator. A gzip member of less than 16 MiB
    ends with a zero byte, which stands for the separator here; a larger one is followed by an empty member, which ends so too.
    """
    body, empty = F.col("member"), F.lit(zlib.compressobj(0, zlib.DEFLATED, 31).flush())
    ended = F.when(F.substring(body, -1, 1) == F.lit(b"\0"), body).otherwise(F.concat(body, empty))
    rows = archives.repartition("archive").sortWithinPartitions("archive", "offset")
    rows.select("archive", F.substring(ended, F.lit(1), F.octet_length(ended) - 1).cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(folder)


def parse(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Heads (names in lower case) and block of a gzip member that holds one record; an error if it is damaged."""
    unpacker = zlib.decompressobj(31)
    data = unpacker.decompress(packed) + unpacker.flush()
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    heads = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(heads.get("content-length", -1))
    if first != "WARC/1.1" or not unpacker.eof or unpacker.unused_data or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"no whole WARC record: {first[:80]}")
    return heads, rest[:size]


READ = "archive string, offset long, length int, kind string, record string, url string, time string, digest string, payload_bytes long, id long, refers string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            heads, block = parse(r["member"])
            if heads["warc-type"] == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = heads["warc-payload-digest"].removeprefix("sha256:")
            if heads["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"payload and digest differ at {r['offset']} of {r['archive']}")
            time = "".join(c for c in heads["warc-date"] if c.isdigit())
            id_ = heads.get("capture-id")
            rows.append((r["archive"], r["offset"], len(r["member"]), heads["warc-type"], heads["warc-record-id"], heads.get("warc-target-uri"), time, digest, size, None if id_ is None else int(id_), heads.get("warc-refers-to")))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])


def read_archives(archives: DataFrame) -> DataFrame:
    """What the members of ``archives`` say, in the columns of READ and ``refers_to``, the id of the capture whose payload a
    revisit has. A response's payload is checked here; a revisit's digest and size must be those of its response."""
    rows = materialize(archives.mapInArrow(_read, READ), "captures")
    asked = rows.filter("refers is not null").select(F.col("refers").alias("record")).distinct()
    known = rows.filter("kind = 'response'").join(asked, "record", "left_semi").groupBy("record").agg(F.first("id").alias("refers_to"), F.first("digest").alias("of"), F.first("payload_bytes").alias("bytes_of"))
    known = materialize(known.withColumnRenamed("record", "refers"), "referred")
    met = rows.join(known, "refers", "left")
    sound = F.col("refers").isNull() | (F.col("of").eqNullSafe(F.col("digest")) & F.col("bytes_of").eqNullSafe(F.col("payload_bytes")))
    wrong = F.raise_error(F.concat(F.lit("no payload for "), F.col("record"))).cast("string")
    return met.withColumn("kind", F.when(sound, F.col("kind")).otherwise(wrong)).drop("of", "bytes_of")


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """All rows of sorted ``runs`` in order, equal ones by run: a tournament tree that keeps at each node the loser."""
    k = len(runs)
    places = [0] * k

    def before(a: int, b: int) -> bool:
        if places[a] >= len(runs[a]) or places[b] >= len(runs[b]):  # an exhausted run loses
            return places[b] >= len(runs[b]) and (places[a] < len(runs[a]) or a < b)
        x, y = runs[a][places[a]], runs[b][places[b]]
        return x < y or (x == y and a < b)

    losers = [-1] * k  # node i has the children 2i and 2i+1; run r is the leaf k+r
    champion = -1
    for r in range(k):  # the first to come to a node waits there for the other
        node, player = (k + r) // 2, r
        while node and losers[node] >= 0:
            if before(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        if node:
            losers[node] = player
        else:
            champion = player
    while k and places[champion] < len(runs[champion]):
        yield runs[champion][places[champion]]
        places[champion] += 1
        node, player = (k + champion) // 2, champion
        while node:
            if before(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        champion = player


KEY = ("url_key", "time", "rank_id", "archive", "offset")


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    columns = [whole.column(c).to_pylist() for c in KEY]
    pieces: dict[int, list[tuple]] = {}
    for nth, (run, *key) in enumerate(zip(whole.column("run").to_pylist(), *columns, strict=True)):
        pieces.setdefault(run, []).append((*key, nth))
    runs = [p if all(a <= b for a, b in zip(p, p[1:], strict=False)) else sorted(p) for p in pieces.values()]  # a shuffle may mix what one task sent
    order = [row[-1] for row in merge(runs)]
    yield from whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)


def history(found: DataFrame) -> DataFrame:
    """``found`` (as :func:`read_archives` gives it) with url_key, ``position`` in the order of URL key, time, id and place
    in the archives, and ``capture_no`` within the URL key, both from 1. A null id comes first."""
    keyed = found.withColumns({"url_key": url_key(F.col("url")), "rank_id": F.coalesce("id", F.lit(-(2**63)))})
    runs = keyed.sortWithinPartitions(*KEY).withColumn("run", F.spark_partition_id())
    dealt = runs.repartitionByRange(*KEY)
    rows = numbered(dealt.mapInArrow(_merge_runs, dealt.schema).drop("run", "rank_id"), "position")
    firsts = rows.groupBy("url_key").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("url_key", "first")
    firsts = materialize(firsts, "histories")
    return rows.join(firsts, "url_key", "left").withColumn("capture_no", F.coalesce(F.col("position") - F.col("first") + 1, F.lit(1))).drop("first")
