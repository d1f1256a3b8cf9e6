"""Token-id shards with a minimal perfect hash index.

Shards hold raw ids, documents in ascending key order. The index maps a key to
(shard, offset, length) through a minimal perfect hash: keys fall into buckets,
each bucket has the displacement that sends its keys to free slots, and a slot
stores a fingerprint that tells a stranger's key.

Shard file: magic, width of an id in bytes, number of ids, ids. Index file:
magic, number of keys and buckets, displacements (u4), then per slot
fingerprint (u4), shard (u4), offset (u8) and length (u8) in columns.

Defined results: a null or empty text is only the end id; a null key is first
in order and is indexed as its own key; of repeated keys each row gets its own
place, told apart by its number among them; an empty table gives no shard; extra columns
are ignored.
"""

from __future__ import annotations

import math
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .token_ids import encoder

END = 2
_SHARD, _INDEX = b"MRLT0001", b"MRLH0001"
_PER_BUCKET = 4
#: Keys of one index file, on average.
PER_INDEX = 10_000
#: Bytes of an id in a shard.
WIDTH = 2
_M = (1 << 64) - 1


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mix of keys by seed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) if np.isscalar(seed) else x ^ (seed * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(buckets, displacement of each bucket, slot of each key) of distinct 64-bit keys; slots are 0..n-1."""
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("equal keys have no perfect hash")
    buckets = max(1, math.ceil(n / _PER_BUCKET))
    of = (_mix(keys, np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sizes_left = sizes.tolist()
    taken, shift, slot = bytearray(n), np.zeros(buckets, "<u4"), np.zeros(n, np.int64)
    for size in range(int(sizes.max(initial=0)), 0, -1):  # larger buckets first, while slots are free
        todo, d = np.flatnonzero(sizes == size).tolist(), 0
        while todo:
            # Many buckets try one displacement each round; the last few try many at once.
            width = 1 if len(todo) > 64 else 512
            for at in range(0, len(todo), len(todo) if width == 1 else 1):
                some = todo[at:] if width == 1 else todo[at : at + 1]
                own = keys[np.concatenate([order[starts[b] : starts[b + 1]] for b in some])]
                seeds = np.arange(d, d + width, dtype=np.uint64) + np.uint64(2)
                tried = (_mix(np.broadcast_to(own, (width, len(own))), seeds[:, None]) % np.uint64(n)).reshape(-1, size).tolist()
                for k, t in enumerate(tried):
                    b = some[k] if width == 1 else some[0]
                    if not any(map(taken.__getitem__, t)) and len(set(t)) == size:
                        shift[b] = d + (0 if width == 1 else k)
                        slot[order[starts[b] : starts[b + 1]]] = t
                        sizes_left[b] = 0
                        for x in t:
                            taken[x] = 1
                        if width > 1:
                            break
            todo = [b for b in todo if sizes_left[b]]
            d += width
    return buckets, shift, slot


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, np.uint64(0)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def write_index(keys: np.ndarray, shards: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    buckets, shift, slot = build_hash(keys)
    n = len(keys)
    out = [_INDEX, struct.pack("<QQ", n, buckets), shift.tobytes()]
    for values, kind in ((_fingerprint(keys), "<u4"), (shards, "<u4"), (offsets, "<u8"), (lengths, "<u8")):
        column = np.zeros(n, kind)
        column[slot] = values
        out.append(column.tobytes())
    return b"".join(out)


class Index:
    """Constant-time lookups in an index file's bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != _INDEX:
            raise ValueError("not an index")
        self.n, self.buckets = struct.unpack_from("<QQ", raw, 8)
        at, parts = 24, []
        for kind, count in (("<u4", self.buckets), ("<u4", self.n), ("<u4", self.n), ("<u8", self.n), ("<u8", self.n)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += count * int(kind[-1])
        self.shift, self.prints, self.shards, self.offsets, self.lengths = parts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for one that the fingerprint rejects."""
        if not self.n:
            return np.full(len(keys), -1)
        bucket = (_mix(keys, np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64)
        slot = (_mix(keys, self.shift[bucket].astype(np.uint64) + np.uint64(2)) % np.uint64(self.n)).astype(np.int64)
        return np.where(self.prints[slot] == _fingerprint(keys), slot, -1)


def _put(uri: str, chunks) -> None:
    """Write a file under a name of the attempt's own, then move it into place: a re-run task replaces it whole."""
    from pyspark import TaskContext

    fs, path = store.filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(draft) as out:
        for c in chunks:
            out.write(c)
    fs.move(draft, path)


def encode_documents(docs: DataFrame, tokenizer: str, uri: str, end: int = END, text: str = "text") -> DataFrame:
    """Encode each document once, in the order in which tasks read them, to raw files; gives (doc_id, file, start, n_tokens,
    ids_crc32). Texts go no further than here, and ids only to the shards."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, tail = encoder(tokenizer), np.array([end], f"<u{WIDTH}").tobytes()
        if enc.tokenizer.get_vocab_size() > 1 << 8 * WIDTH:
            raise ValueError("ids of this tokenizer need a wider shard format")
        file, out, at = TaskContext.get().taskAttemptId(), None, 0  # a file for each attempt
        for batch in batches:
            if out is None:
                fs, path = store.filesystem(f"{uri}/{file}.raw")
                fs.create_dir(posixpath.dirname(path), recursive=True)
                out = fs.open_output_stream(path)
            starts, sizes, sums = [], [], []
            for x in enc.stream(batch.column(1).to_pylist()):
                ids = np.frombuffer(x, "<u4").astype(f"<u{WIDTH}").tobytes() + tail
                out.write(ids)
                starts.append(at), sizes.append(len(ids) // WIDTH), sums.append(zlib.crc32(ids))
                at += len(ids) // WIDTH
            own = [pa.array(x, pa.int64()) for x in ([file] * len(starts), starts, sizes, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], ["doc_id", "file", "start", "n_tokens", "sum"])
        if out is not None:
            out.close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(encode, "doc_id long, file long, start long, n_tokens long, sum long")


def write_shards(encoded: DataFrame, raw: str, uri: str) -> DataFrame:
    """Copy encoded documents (a written table) to shards in ascending key order; gives (doc_id, nth, shard, local, n_tokens).
    Only places are shuffled; a shard's writer reads the ids from the raw files, what lies together in one piece."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, path = store.filesystem(f"{uri}/shard-{shard:06d}.ids")
        fs.create_dir(posixpath.dirname(path), recursive=True)
        draft, out, at, last, nth = f"{path}.{TaskContext.get().taskAttemptId()}", None, 0, object(), 0
        names, kinds = ["doc_id", "nth", "shard", "local", "n_tokens"], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        places: list[pa.RecordBatch] = []
        files: dict = {}

        def copy(file, start, stop):
            if file not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[file] = fs.open_input_file(store.filesystem(f"{raw}/{file}.raw")[1])
            for x in range(start, stop, 1 << 22):
                out.write(files[file].read_at(WIDTH * (min(stop, x + (1 << 22)) - x), WIDTH * x))

        piece = None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(draft)
                out.write(_SHARD + struct.pack("<Q", WIDTH))
            rows: list[tuple] = []
            for doc, file, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                nth = nth + 1 if doc == last else 0
                last = doc
                rows.append((doc, nth, shard, at, n))
                at += n
                if piece and piece[0] == file and piece[2] == start:
                    piece[2] = start + n
                else:
                    if piece:
                        copy(*piece)
                    piece = [file, start, start + n]
            if rows:
                places.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names))
        if piece:
            copy(*piece)
        if out is not None:
            out.close()
            fs.move(draft, path)
        yield from places  # places are told only once the shard is whole

    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range partitions never part equal keys, so nth counts them all.
    order = F.asc_nulls_first("doc_id"), "n_tokens", "sum", "file", "start"
    ordered = encoded.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(*order).select("doc_id", "file", "start", "n_tokens")
    return ordered.mapInArrow(write, "doc_id long, nth long, shard int, local long, n_tokens long")


def _key() -> F.Column:
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("nth"))


def build_index(places: DataFrame, uri: str, files: int) -> DataFrame:
    """Write index files; gives (part, keys)."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(own):
            t = pa.Table.from_batches(own)
            c = {k: t.column(k).to_numpy() for k in ("key", "shard", "local", "n_tokens")}
            p = own[0].column("part")[0].as_py()
            _put(f"{uri}/index-{p:06d}.mph", [write_index(c["key"].view(np.uint64), c["shard"], c["local"], c["n_tokens"])])
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(t)], pa.int64())], ["part", "keys"])

        held, last = [], None
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for x, y in zip(cuts, cuts[1:]):
                if x < y:
                    if held and part[x] != last:
                        yield done(held)
                        held = []
                    last = part[x]
                    held.append(batch.slice(x, y - x))
        if held:
            yield done(held)

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = places.select(F.pmod(_key(), F.lit(files)).cast("int").alias("part"), _key().alias("key"), "shard", "local", "n_tokens")
    return keyed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(build, "part int, keys long")


def look_up(keys: DataFrame, uri: str, files: int) -> DataFrame:
    """keys (doc_id, nth) with shard, local and n_tokens from the index; unknown keys are absent."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        opened: dict[int, Index] = {}
        for batch in batches:
            part, key = batch.column("part").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for p in np.unique(part).tolist():
                if p not in opened:
                    fs, path = store.filesystem(f"{uri}/index-{p:06d}.mph")
                    with fs.open_input_file(path) as f:
                        opened = {p: Index(f.read())}
                rows = np.flatnonzero(part == p)
                ix, slot = opened[p], opened[p].find(key[rows])
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("nth"), pa.array(ix.shards[slot].astype(np.int32)), pa.array(ix.offsets[slot].astype(np.int64)), pa.array(ix.lengths[slot].astype(np.int64))],
                    ["doc_id", "nth", "shard", "local", "n_tokens"],
                )

    keyed = keys.select("doc_id", "nth", F.pmod(_key(), F.lit(files)).cast("int").alias("part"), _key().alias("key"))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(find, "doc_id long, nth long, shard int, local long, n_tokens long")


def read_payload(found: DataFrame, uri: str) -> DataFrame:
    """found with ids_crc32 of each document's ids, read from its shard."""
    names = found.columns

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        opened: dict = {}
        for batch in batches:
            sums = []
            for shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "local", "n_tokens"))):
                if shard not in opened:
                    for f, _ in opened.values():
                        f.close()
                    fs, path = store.filesystem(f"{uri}/shard-{shard:06d}.ids")
                    f = fs.open_input_file(path)
                    head = f.read(16)
                    if head[:8] != _SHARD:
                        raise ValueError("not a shard")
                    opened = {shard: (f, struct.unpack("<Q", head[8:])[0])}
                f, width = opened[shard]
                f.seek(16 + at * width)
                sums.append(zlib.crc32(np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    spark = found.sparkSession
    dealt = found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "local").sortWithinPartitions("shard", "local")
    return dealt.mapInArrow(read, found.schema.add("ids_crc32", "long"))


def store_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write shards and index, then read every document back through the index."""
    spark = docs.sparkSession
    uri = store.new_dir(spark, "token-shards")
    raw = store.new_dir(spark, "raw-ids")
    encoded = store.materialise(encode_documents(docs, tokenizer, raw), "encoded")
    places = store.materialise(write_shards(encoded, raw, uri), "places")
    store.drop(encoded)
    store.remove(spark, raw)
    totals = {r["shard"]: r["n"] for r in places.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a shard
    starts, at = [], 0
    for shard in sorted(totals):
        starts.append((shard, at))
        at += totals[shard]
    files = max(1, math.ceil(places.count() / PER_INDEX))
    store.materialise(build_index(places, uri, files), "index-sizes")
    read = read_payload(look_up(places.select("doc_id", "nth"), uri, files), uri)
    base = spark.createDataFrame(starts, "base_shard int, base long")
    joined = read.join(F.broadcast(base), F.col("shard") == F.col("base_shard"))  # one row a shard
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
