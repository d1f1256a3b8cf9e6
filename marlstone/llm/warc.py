"""WARC archives with a globally ordered capture index.

Each writer task makes one archive and one capture run, a file of blocks sorted by URL key and time. The runs are merged
externally: key ranges are chosen from the blocks' first keys, and in each range a loser tree merges the runs,
reading the next block of a run only when the last is used up; where there are more than FAN_IN runs, groups of them are
merged to longer runs first. The ranges in turn are the whole capture history in order, and each capture has its place in
it. Archives are read back through that index.

Defined results: a null html is an empty payload, a null url an empty key; of
rows that share a payload and the smallest page_id each is a response; a null
page_id never is referred to; captures of one key and time stand in any order; an empty table gives no archive; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import math
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .blocks import by_first

#: Payloads shorter than this are always written whole.
LEAST_REVISIT = 100
_EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z: captures without a time are dated from here by page id
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "urlkey string, ts long, page_id long, file string, offset long, length long"
_FIELDS = [f.split()[0] for f in _CAPTURE.split(", ")]
#: Captures in a block of a run, in a key range on average, and runs that are merged at once.
BLOCK, PER_RANGE, FAN_IN = 256, 4096, 512
_DIRECTORY = "run string, nth long, offset long, length long, n long, first struct<urlkey: string, ts: bigint>, last struct<urlkey: string, ts: bigint>"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


class LoserTree:
    """Merges k sorted iterables: each inner node holds the loser of its match, so a winner is replaced in log k comparisons."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return x < y or (x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def record(page_id, url: str, ts: int, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, as a gzip member. A revisit keeps the HTTP head, which tells the full payload's length, and no payload."""
    from datetime import datetime, timezone

    date = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Headers and block of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    return headers | {"block": rest[: int(headers["content-length"])]}


def _urn(x: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
    return int(found[1]) if found else None


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to: the page that holds the same payload."""
    held = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    held = held.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = F.octet_length("html") >= LEAST_REVISIT
    first = held.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = store.materialise(first.select(F.col("digest").alias("__digest"), "first"), "first-captures")
    joined = held.join(first, F.col("digest") == F.col("__digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


class _RunWriter:
    """Writes sorted captures (urlkey, ts, file, offset, page_id, length) as blocks, and tells the directory's row of each."""

    def __init__(self, uri: str, run: str):
        self.fs, base = store.filesystem(uri)
        self.fs.create_dir(base, recursive=True)
        self.run, self.nth, self.at = run, 0, 0
        self.out = self.fs.open_output_stream(posixpath.join(base, run), compression=None)

    def put(self, block: list[tuple]) -> tuple:
        import pickle

        import zstandard

        raw = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(block, 5))
        self.out.write(raw)
        ends = [{"urlkey": x[0], "ts": x[1]} for x in (block[0], block[-1])]
        row = self.run, self.nth, self.at, len(raw), len(block), *ends
        self.nth, self.at = self.nth + 1, self.at + len(raw)
        return row


def _directory(rows: list[tuple]):
    import pyarrow as pa

    key = pa.struct([("urlkey", pa.string()), ("ts", pa.int64())])
    kinds = (pa.string(), *(pa.int64(),) * 4, key, key)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["run", "nth", "offset", "length", "n", "first", "last"])


def _blocks(uri: str, rows: list[dict], low, high) -> Iterator:
    """The captures of one run in [low, high), a block at a time."""
    import pickle

    import zstandard

    fs, base = store.filesystem(uri)
    for row in rows:
        with fs.open_input_file(posixpath.join(base, row["run"])) as f:
            block = pickle.loads(zstandard.ZstdDecompressor().decompress(f.read_at(row["length"], row["offset"])))
        for x in block:
            if (low is None or x[:2] >= low) and (high is None or x[:2] < high):
                yield x


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """One archive and one sorted run for each task; gives the runs' directory."""
    size = BLOCK

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        out, at, captures = None, 0, []
        fs, base = store.filesystem(uri)
        # Each attempt has files of its own, and only a finished one's are read.
        name = f"pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(posixpath.join(base, f"{name}.warc.gz"), compression=None)
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                ts = _EPOCH + (page or 0) % 1_000_000_000
                raw = record(page, url, ts, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(raw)
                captures.append((url_key(url), ts, f"{name}.warc.gz", at, page, len(raw)))
                at += len(raw)
        if out is not None:
            out.close()
        if captures:
            captures.sort(key=lambda c: c[:4])
            run = _RunWriter(uri, f"{name}.run")
            rows = [run.put(captures[x : x + size]) for x in range(0, len(captures), size)]
            run.out.close()
            yield _directory(rows)

    return pages.mapInArrow(write, _DIRECTORY)


def _bounds(directory: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the captures into about even ranges: from at most 20 keys a range, whatever the size."""
    blocks = directory.count()
    some = directory if blocks <= 20 * ranges else directory.sample(20 * ranges / blocks, 7)
    keys = sorted((r["first"].urlkey, r["first"].ts) for r in some.select("first").limit(40 * ranges).collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def _merge(directory: DataFrame, uri: str, made: str, groups: int, finish) -> DataFrame:
    """finish(group and range, merged captures) for each range of keys of each group of runs; made is its schema."""
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one row
    bounds = _bounds(directory, max(1, min(n, math.ceil(total / PER_RANGE / groups))))
    fields = _DIRECTORY.split(", first")[0]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            first, last = ([(x["urlkey"], x["ts"]) for x in batch.column(c).to_pylist()] for c in ("first", "last"))
            spans = [range(bisect.bisect_right(bounds, a), bisect.bisect_right(bounds, b) + 1) for a, b in zip(first, last)]
            rows = pa.array([k for k, s in enumerate(spans) for _ in s], pa.int64())
            own = batch.select(["group", "run", "nth", "offset", "length", "n"]).take(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r for s in spans for r in s], pa.int32()), *own.columns], ["range", "group", "run", "nth", "offset", "length", "n"])

    def merge(batches: Iterator) -> Iterator:
        def one(rows: list[tuple]) -> Iterator:
            key = rows[0][0]
            low, high = (bounds[k] if 0 <= k < len(bounds) else None for k in (key["range"] - 1, key["range"]))
            runs: dict[str, list[dict]] = {}
            for _, block in rows:
                runs.setdefault(block["run"], []).append(block)
            yield from finish(key, LoserTree([_blocks(uri, x, low, high) for x in runs.values()]))

        yield from by_first(batches, one)

    grouped = directory.select(F.expr(f"cast(pmod(xxhash64(run), {groups}) as int)").alias("group"), *[f.split()[0] for f in fields.split(", ")], "first", "last")
    placed = grouped.mapInArrow(place, f"range int, group int, {fields}")
    dealt = placed.select(F.struct("group", "range").alias("key"), F.struct("run", "nth", "offset", "length").alias("block"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "block").mapInArrow(merge, made)


def merge_runs(directory: DataFrame, uri: str) -> DataFrame:
    """The capture history in order of (urlkey, ts): each capture with its range and its number there; ranges follow each other."""
    size, names = BLOCK, [*_FIELDS, "range", "nth"]

    def to_run(key: dict, captures) -> Iterator:
        from pyspark import TaskContext

        run, rows, held = _RunWriter(uri, f"merged-{key['group']:06d}-{key['range']:06d}-{TaskContext.get().taskAttemptId()}.run"), [], []
        for x in captures:
            held.append(x)
            if len(held) == size:
                rows.append(run.put(held))
                held = []
        if held:
            rows.append(run.put(held))
        run.out.close()
        if rows:
            yield _directory(rows)

    def to_rows(key: dict, captures) -> Iterator:
        import pyarrow as pa

        kinds, held = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
        for nth, (k, ts, file, at, page, n) in enumerate(captures):
            held.append((k, ts, page, file, at, n, key["range"], nth))
            if len(held) == 10_000:
                yield out()
                held = []
        if held:
            yield out()

    while (runs := directory.select("run").distinct().count()) > FAN_IN:
        directory = store.materialise(_merge(directory, uri, _DIRECTORY, math.ceil(runs / FAN_IN), to_run), "runs")
        if directory.select("run").distinct().count() >= runs:
            break  # ranges are as many as runs were: the merge is as narrow as it gets
    return _merge(directory, uri, f"{_CAPTURE}, range int, nth long", 1, to_rows)


def read_archives(index: DataFrame, uri: str) -> DataFrame:
    """Every record that the index names, read from its archive."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = store.filesystem(uri)
        name, file = None, None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "range", "nth"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        for batch in batches:
            rows = []
            for f, at, n, *place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "range", "nth"))):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(posixpath.join(base, f))
                file.seek(at)
                r = parse(file.read(n))
                http, _, payload = r["block"].partition(b"\r\n\r\n")
                told = r["warc-payload-digest"].removeprefix("sha256:")
                if r["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != told:
                        raise ValueError(f"{f} at {at}: the payload does not have its digest")
                else:
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), told
                rows.append((_urn(r["warc-record-id"]), size, digest, r["warc-type"], _urn(r.get("warc-refers-to")), r["warc-target-uri"], *place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        if file is not None:
            file.close()

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length", "range", "nth").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, range int, nth long")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC, merge the capture runs, and read every record back through the merged index; place is a
    record's number in the whole history, from 0."""
    spark = pages.sparkSession
    uri = store.new_dir(spark, "warc")
    directory = store.materialise(write_archives(roles(pages), uri), "runs")
    history = store.materialise(merge_runs(directory, uri), "history")
    sizes, starts, at = {r["range"]: r["count"] for r in history.groupBy("range").count().collect()}, [], 0  # one row a range
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    base = spark.createDataFrame(starts, "of int, base long")
    out = read_archives(history, uri).join(F.broadcast(base), F.col("range") == F.col("of"))  # one row a range
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("base") + F.col("nth")).alias("place"))
