"""Exact n-gram Jaccard join of documents: the links of each, and the groups that links make.

1. Equal sets become one node. Sets are written once, as sorted 64-bit hashes, to files in the shared folder; from
   there on rows carry a set's place, and only those who compare a set read it.
2. Exact counts of all shingles give the order of rarity: a linked set shares three quarters of its shingles, so nodes
   with fewer shared ones can link with nothing and go no further.
3. Clusters: nodes that share a min-hash gather round the node with the fewest rare shingles. A cluster's leader has its
   overlaps computed once; those of any two members follow from their differences to it alone (one product of
   matrices for a block of members), so a cluster yields counts and a spanning forest and never its pairs.
4. Lists: prefix filtering over nodes of different clusters. In any total order of shingles, sets with Jaccard >= 3/4
   share one of their first n - ceil(3n/4) + 1 shingles. Index lists are cut to blocks by size and position, and a block
   whose bound on the overlap is too small is skipped whole. Lists of very common shingles are split into cells. A pair is
   compared in one list only, that of the least shingle its prefixes share, so lists too yield counts and forests and never pairs.
5. Links are contracted to components.

Shingles are counted by the first 48 bits of their hashes: equal ones count too often at worst, which weakens the pruning
and changes no result. Two different sets are taken for one with a chance of 2^-64 a pair.

Defined results: a null or empty text has the empty set, links with nothing and is its own component; a text of
fewer words than a shingle has one shingle; repeated rows are each returned and share a component, also when rows
repeat an id; a null id never is a component id unless the group has no other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .blocks import by_first, squeeze, unsqueeze
from .words import _finish, windows, word_hashes, words

WORDS = 5
MINHASHES = 6
#: What one task holds at a time. These bound memory; none bounds what is found.
CHUNK_SHINGLES, CHUNK_NODES, PART_SHINGLES = 1_000_000, 20_000, 4_000_000
CELL_NODES, CELL_SHINGLES, LIST_NODES, PAIR_SHINGLES, COUNT_KEYS = 1024, 4_000_000, 4096, 2_000_000, 500_000
_BLOCK = 64
_KEY_BITS = 48


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Windows are hashed over many texts at once."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0

    def flush():
        h = word_hashes([w for x in held for w in x])
        over = windows(h, WORDS) if len(h) >= WORDS else h[:0]
        at = 0
        for x in held:
            n = len(x)
            own = over[at : at + n - WORDS + 1] if n >= WORDS else windows(h[at : at + n], WORDS)
            own = np.sort(own)
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
            at += n

    for t in texts:
        held.append(words(t))
        size += len(held[-1])
        if size > 200_000:
            flush()
            held, size = [], 0
    flush()
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def linked(overlap, a, b):
    return 100 * overlap >= 75 * (a + b - overlap)


def least_overlap(a, b):
    """Smallest overlap of linked sets of sizes a and b."""
    return -((-3 * (a + b)) // 7)


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), len(s)) - (1 << 63)


_BOUNDS = np.arange(2 * MINHASHES, dtype=np.uint64) * np.uint64((1 << 64) // (2 * MINHASHES))


def _minhashes(s: np.ndarray) -> list[int]:
    """One-permutation min-hashes: hashes are random and sorted, so each range's least is the first at or after its start. Two
    make one value, which sets of small overlap hardly ever share."""
    least = s[np.searchsorted(s, _BOUNDS) % len(s)]
    with np.errstate(over="ignore"):
        return _finish(least[::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2]).view(np.int64).tolist()


#: Where a document stands: the hash of its file's path, and its row there.
_AT = "struct<path: bigint, row: bigint>"


class SetFiles:
    """Reads sets by their place: file, start, length."""

    def __init__(self, uri: str):
        self.uri, self.open = uri, {}

    def __call__(self, file: int, start: int, n: int) -> np.ndarray:
        found = self.open.get(file)
        if found is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = store.filesystem(f"{self.uri}/{file}.sets")
            found = self.open[file] = fs.open_input_file(path)
        return np.frombuffer(found.read_at(8 * n, 8 * start), "<u8")


def sign(docs: DataFrame, uri: str) -> DataFrame:
    """(doc_id, said, at, n, node, file, chunk, start) of each document (doc_id, text, at): said is a hash of the text; the last four are
    null for the empty set. Each attempt of a task writes its sets to a file of its own."""
    names, most, most_nodes = ["doc_id", "said", "at", "n", "node", "file", "chunk", "start"], CHUNK_SHINGLES, CHUNK_NODES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file, out = TaskContext.get().taskAttemptId(), None
        at, chunk, size, seen = 0, 0, 0, {}
        for batch in batches:
            if out is None:
                fs, path = store.filesystem(f"{uri}/{file}.sets")
                fs.create_dir(posixpath.dirname(path), recursive=True)
                out = fs.open_output_stream(path)
            n, node, chunks, starts = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(s))
                if not len(s):
                    node.append(None), chunks.append(None), starts.append(None)
                    continue
                v = _node(s)
                if v not in seen:
                    if size >= most or len(seen) >= most_nodes:
                        chunk, size, seen = chunk + 1, 0, {}
                    seen[v] = chunk, at
                    out.write(s.tobytes())
                    at += len(s)
                    size += len(s)
                node.append(v), chunks.append(seen[v][0]), starts.append(seen[v][1])
            own = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([None if v is None else file for v in node], pa.int64()), pa.array(chunks, pa.int32()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *own], names)
        if out is not None:
            out.close()

    held = docs.select("doc_id", "text", F.xxhash64("text").alias("said"), "at")
    return held.mapInArrow(run, f"doc_id long, said long, at {_AT}, n long, node long, file long, chunk int, start long")


def _in_order(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the shingles, their keys in that order, bounds of the parts): parts are ranges of keys."""
    order = np.argsort(shingles, kind="stable")
    keys = shingles[order] >> np.uint64(64 - _KEY_BITS)
    edges = np.array([(p << _KEY_BITS) // parts for p in range(1, parts)], np.uint64)
    return order, keys, np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _chunk(read: SetFiles, file: int, held: list[dict]) -> np.ndarray:
    """The sets of a chunk's nodes, one after the other; held is in order of start, and copies of other files leave gaps."""
    first, stop = held[0]["start"], held[-1]["start"] + held[-1]["n"]
    raw = read(file, first, stop - first)
    return np.concatenate([raw[x["start"] - first : x["start"] - first + x["n"]] for x in held])


def shingle_keys(chunks: DataFrame, uri: str, parts: int) -> DataFrame:
    """(part, file, chunk, block): the keys of each chunk's sets, in order, by ranges."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = SetFiles(uri)
        for batch in batches:
            for file, chunk, held in zip(*(c.to_pylist() for c in batch.columns)):
                _, keys, cuts = _in_order(_chunk(read, file, held), parts)
                some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                blocks = [squeeze(keys[cuts[p] : cuts[p + 1]]) for p in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([file] * n, pa.int64()), pa.array([chunk] * n, pa.int32()), pa.array(blocks, pa.binary())], ["part", "file", "chunk", "block"])

    return chunks.select("file", "chunk", "held").mapInArrow(emit, "part int, file long, chunk int, block binary")


def _classes(counts: np.ndarray) -> np.ndarray:
    """A count as one byte: itself below 128, its logarithm beyond."""
    return np.where(counts < 128, counts, 128 + np.floor(np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def times_of(each: list[np.ndarray]) -> list[np.ndarray]:
    """In how many of all these ascending keys each one is, as classes: by ranges of keys, so that few are sorted at a time."""
    out = [np.empty(len(x), np.uint8) for x in each]
    low, high = min(int(x[0]) for x in each), max(int(x[-1]) for x in each)
    steps = -(-sum(map(len, each)) // COUNT_KEYS)
    edges = np.array([low + (high - low) * k // steps for k in range(1, steps)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in each]
    for k in range(steps):
        some = np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(each, cuts)])
        _, inverse, times = np.unique(some, return_inverse=True, return_counts=True)
        found, at = _classes(times)[inverse], 0
        for x, c in zip(out, cuts):
            n = int(c[k + 1] - c[k])
            x[c[k] : c[k + 1]] = found[at : at + n]
            at += n
    return out


def shingle_counts(keys: DataFrame) -> DataFrame:
    """(file, chunk, part, block): in how many sets each key of shingle_keys is, in the same order, as a byte."""

    def count(rows: list[tuple]) -> Iterator:
        import pyarrow as pa
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        blocks = [small.compress(x.tobytes()) for x in times_of([unsqueeze(x[3]) for x in rows])]
        part, file, chunk, _ = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(chunk, pa.int32()), pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], ["file", "chunk", "part", "block"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(n, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: by_first(batches, count), "file long, chunk int, part int, block binary")


_ENTRY = np.dtype([("t", "<u8"), ("p", "<u4"), ("c", "u1")])


def alive(chunks: DataFrame, counts: DataFrame, uri: str, parts: int) -> DataFrame:
    """Nodes that can link: node, file, start, n, copies, mins, central (share of shared shingles, and how common they
    are), entries (shared shingles of the prefix in order of rarity, with places and counts), and the place of the node's record: file,
    start and shingles. A record is the place of the set and then the entries' shingles in order; each attempt of a task
    writes its records to a file of its own."""
    fields = "node long, file long, start long, n long, copies long, mins array<long>, central double, entries binary, record_file long, record_start long, record_n long"
    names = [f.split()[0] for f in fields.split(", ")]

    def pick(rows: list[tuple], read: SetFiles, write: Callable[[np.ndarray], int], own_file: int) -> Iterator:
        """rows of one chunk: (chunk, file, part, block, held), the chunk's own first."""
        import pyarrow as pa
        import zstandard

        (_, file, _, _, held), *blocks = rows
        shingles = _chunk(read, file, held)
        order, _, _ = _in_order(shingles, parts)
        opened = zstandard.ZstdDecompressor()
        times = np.empty(len(shingles), np.uint8)
        times[order] = np.frombuffer(b"".join(opened.decompress(x[3]) for x in blocks), np.uint8)
        sizes = np.array([x["n"] for x in held])
        starts = np.cumsum(sizes) - sizes
        shared = np.add.reduceat((times > 1).astype(np.int64), starts)
        out = []
        for k in np.flatnonzero(4 * shared >= 3 * sizes).tolist():
            x, n, at = held[k], int(sizes[k]), int(starts[k])
            s, c = shingles[at : at + n], times[at : at + n]
            first = np.lexsort((s, c))[: n - -(-3 * n // 4) + 1]
            e = np.empty(len(first), _ENTRY)
            e["t"], e["p"], e["c"] = s[first], np.arange(len(first)), c[first]
            e = e[e["c"] > 1]
            central = float(shared[k] / n + 1e-4 * np.log(c).mean())
            record = write(np.concatenate([np.array([file, x["start"]], "<u8"), np.sort(e["t"])]))
            out.append((x["node"], file, x["start"], n, x["copies"], _minhashes(s), central, e.tobytes(), own_file, record, len(e)))
        if out:
            kinds = (pa.int64(),) * 5 + (pa.list_(pa.int64()), pa.float64(), pa.binary()) + (pa.int64(),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        read, own_file, out, at = SetFiles(uri), TaskContext.get().taskAttemptId(), None, 0

        def write(record: np.ndarray) -> int:
            nonlocal out, at
            if out is None:
                fs, path = store.filesystem(f"{uri}/{own_file}.sets")
                fs.create_dir(posixpath.dirname(path), recursive=True)
                out = fs.open_output_stream(path)
            out.write(record.tobytes())
            at += len(record)
            return at - len(record)

        yield from by_first(batches, lambda rows: pick(rows, read, write, own_file))
        if out is not None:
            out.close()

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("file", "chunk").alias("key")
    own = chunks.select(key, "file", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("block"), "held")
    both = own.unionByName(counts.select(key, "file", "part", "block", F.lit(None).cast(own.schema["held"].dataType).alias("held")))
    dealt = both.repartition(n, "key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, fields)


def clusters(live: DataFrame) -> DataFrame:
    """A table (node, label): the leader of each node's cluster, the node itself if it leads or shares no min-hash."""
    keyed = live.select("node", "central", F.posexplode("mins").alias("k", "m"))
    lead = keyed.groupBy("k", "m").agg(F.max(F.struct("central", "node")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1")
    lead = lead.select(F.col("k").alias("lk"), F.col("m").alias("lm"), "lead")
    votes = keyed.join(lead, (F.col("k") == F.col("lk")) & (F.col("m") == F.col("lm"))).where("node <> lead.node")
    votes = votes.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("node").agg(F.max(F.struct("votes", "lead")).alias("best")).select("node", F.col("best.lead.node").alias("leader"))
    chosen = store.materialise(chosen, "chosen")
    leaders = chosen.select(F.col("leader").alias("leads")).distinct()
    led = chosen.join(leaders, F.col("node") == F.col("leads"), "left_anti").select(F.col("node").alias("member"), "leader")
    found = store.materialise(live.select("node").join(led, F.col("node") == F.col("member"), "left").select("node", F.coalesce("leader", "node").alias("label")), "clusters")
    store.drop(chosen)
    return found


def overlaps(leader: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all pairs of sets, derived from each set's overlap with the leader: with g shingles of the leader missing
    in a, h in b, and c differences that a and b have in common, it is |leader| - g - h + c."""
    missing, more, rows_m, rows_x = [], [], [], []
    gone = np.zeros(len(sets), np.int64)
    for k, s in enumerate(sets):
        at = np.searchsorted(leader, s)
        hit = at < len(leader)
        hit[hit] = leader[at[hit]] == s[hit]
        lost = np.ones(len(leader), bool)
        lost[at[hit]] = False
        lost = np.flatnonzero(lost)
        gone[k] = len(lost)
        missing.append(lost)
        more.append(s[~hit])
        rows_m.append(np.full(len(lost), k))
        rows_x.append(np.full(len(more[-1]), k))
    extra, column, times = np.unique(np.concatenate(more), return_inverse=True, return_counts=True)
    rows, columns = np.concatenate(rows_x), column + len(leader)
    often = times[column] > 1
    rows, columns = np.concatenate([np.concatenate(rows_m), rows[often]]), np.concatenate([np.concatenate(missing), columns[often]])
    _, columns = np.unique(columns, return_inverse=True)
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    out = (len(leader) - gone[:, None] - gone[None, :]).astype(np.float32)
    wide = max(64, 4_000_000 // max(1, len(sets)))
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, wide):
        a, b = np.searchsorted(columns, [at, at + wide])
        strip = np.zeros((len(sets), min(wide, int(columns[-1]) + 1 - at)), np.float32)
        strip[rows[a:b], columns[a:b] - at] = 1
        out += strip @ strip.T
    return np.rint(out).astype(np.int64)


def _roots(links: np.ndarray) -> np.ndarray:
    """The first of each row's component in a symmetric boolean matrix."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            root[i], todo = i, np.array([i])
            while len(todo):
                todo = np.flatnonzero(links[todo].any(axis=0) & (root < 0))
                root[todo] = i
    return root


def within_clusters(live: DataFrame, labels: DataFrame, uri: str) -> DataFrame:
    """(node, others, root): how many documents of its cluster each node links with, and a node it is connected with, by cells:
    a large cluster is dealt into blocks, and any two blocks meet in one cell. Parts of a node's count are to be added up."""
    l = labels.select(F.col("node").alias("own"), "label")
    placed = live.join(l, F.col("node") == F.col("own")).select("label", "node", "file", "start", "n", "copies")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_NODES), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int")
    lead = F.max(F.when(F.col("node") == F.col("label"), F.struct("file", "start", "n")))
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("size"), blocks.alias("blocks"), lead.alias("lead")).where("size > 1")
    placed = placed.join(sizes.withColumnRenamed("label", "of"), F.col("label") == F.col("of"))
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.struct("label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).alias("cell")

    def count(rows: list[tuple], read: SetFiles) -> Iterator:
        import pyarrow as pa

        cell, lead = rows[0][0], rows[0][7]
        sets = [read(f, at, n) for _, _, f, at, n, *_ in rows]
        o = overlaps(read(lead["file"], lead["start"], lead["n"]), sets)
        n, block = np.array([len(s) for s in sets]), np.array([x[6] for x in rows])
        found = linked(o, n[:, None], n[None, :])
        if cell["x"] == cell["y"]:
            np.fill_diagonal(found, False)
        else:
            found &= block[:, None] != block[None, :]
        others = found @ np.array([x[5] for x in rows])
        root, some = _roots(found), np.flatnonzero(others)
        node = np.array([x[1] for x in rows], np.int64)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(others[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "others", "root"])

    def run(batches: Iterator) -> Iterator:
        read = SetFiles(uri)
        yield from by_first(batches, lambda rows: count(rows, read))

    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(cell, "node", "file", "start", "n", "copies", "block", "lead").repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "node long, others long, root long")


def list_pairs(n: np.ndarray, pos: np.ndarray, group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of one index list that may link, of different groups and, where a list has two sides, of different sides: by blocks of
    the list in order of size and position."""
    order = np.lexsort((pos, n))
    n, pos, group, side = n[order], pos[order], group[order], side[order]
    two = len(side) > 0 and side.min() != side.max()
    starts = np.arange(0, len(n), _BLOCK)
    low_n, high_n = n[starts], np.maximum.reduceat(n, starts)
    most_left = np.maximum.reduceat(n - pos, starts)
    for i in range(len(n) - 1):
        top = 4 * n[i] // 3
        first, end = (i + 1) // _BLOCK, int(np.searchsorted(low_n, top, "right"))
        blocks = np.arange(first, end)
        # The overlap is at most the words left after this place in either set: skip blocks that cannot reach it.
        reach = np.minimum(n[i] - pos[i], most_left[blocks]) >= least_overlap(n[i], np.maximum(low_n[blocks], n[i])) - np.minimum(pos[i], high_n[blocks])
        for b in blocks[reach]:
            j = np.arange(max(i + 1, b * _BLOCK), min((b + 1) * _BLOCK, len(n)))
            j = j[(n[j] <= top) & (group[j] != group[i])]
            if two:
                j = j[side[j] != side[i]]
            j = j[np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j]) >= least_overlap(n[i], n[j])]
            if len(j):
                yield np.full(len(j), order[i]), order[j]


#: An index entry: shingle, place in the prefix, and of the node its set's size, copies, record, id and cluster.
_POSTING = np.dtype([("t", "<u8"), ("p", "<u4"), ("n", "<u4"), ("copies", "<i8"), ("record_file", "<i8"), ("record_start", "<i8"), ("record_n", "<u4"), ("node", "<i8"), ("label", "<i8")])


def common(x: np.ndarray, y: np.ndarray, sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingles the sets of each pair share, the least of these). Sets are sorted and not empty; pairs are in order of x."""
    many, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        probe, each = sets[int(x[a])], [sets[k] for k in y[a:b].tolist()]
        every = np.concatenate(each)
        starts = np.cumsum([0] + [len(s) for s in each[:-1]])
        hit = probe[np.minimum(np.searchsorted(probe, every), len(probe) - 1)] == every
        many[a:b] = np.add.reduceat(hit.astype(np.int64), starts)
        least[a:b] = np.minimum.reduceat(np.where(hit, every, np.uint64((1 << 64) - 1)), starts)
    return many, least


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root, the least member of each one's component, after the links (x, y)."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _links_of(e: np.ndarray, read: SetFiles, side: np.ndarray | None = None) -> Iterator:
    """One record batch, node, others, root as within_clusters has them, of the links that the index lists in e make. Lists of one cluster make
    none. A pair belongs to the list of the least shingle that both prefixes hold, and is left to it by all others: so its link
    is counted once, in whichever task that list is."""
    import pyarrow as pa

    order = np.argsort(e["t"], kind="stable")
    e, side = e[order], np.zeros(len(e), np.int64) if side is None else side[order]
    if not len(e):
        return
    cuts = np.flatnonzero(np.concatenate([[True], e["t"][1:] != e["t"][:-1]]))
    mixed = np.minimum.reduceat(e["label"], cuts) != np.maximum.reduceat(e["label"], cuts)
    ends = np.append(cuts[1:], len(e))
    # One entry for each node, in order of id: pairs are pairs of these.
    _, first, of = np.unique(e["node"], return_index=True, return_inverse=True)
    own = e[first]
    others, root = np.zeros(len(own), np.int64), np.arange(len(own))

    def link(a, b, t):
        nonlocal root
        x, y, t = np.concatenate(a), np.concatenate(b), np.concatenate(t)
        by = np.argsort(x, kind="stable")
        x, y, t = x[by], y[by], t[by]
        records = {k: read(int(own["record_file"][k]), int(own["record_start"][k]), 2 + int(own["record_n"][k])) for k in np.unique([x, y]).tolist()}
        here = common(x, y, {k: r[2:] for k, r in records.items()})[1] == t
        x, y = x[here], y[here]
        sets = {k: read(int(records[k][0]), int(records[k][1]), int(own["n"][k])) for k in np.unique([x, y]).tolist()}
        ok = linked(common(x, y, sets)[0], own["n"][x].astype(np.int64), own["n"][y].astype(np.int64))
        x, y = x[ok], y[ok]
        np.add.at(others, x, own["copies"][y])
        np.add.at(others, y, own["copies"][x])
        root = _join(root, x, y)

    a, b, t, size = [], [], [], 0
    for x, y in zip(cuts[mixed].tolist(), ends[mixed].tolist()):
        l = e[x:y]
        n = l["n"].astype(np.int64)
        for i, j in list_pairs(n, l["p"].astype(np.int64), l["label"], side[x:y]):
            a.append(of[x:y][i])
            b.append(of[x:y][j])
            t.append(l["t"][j])
            size += int(n[i[0]] + n[j].sum())
            if size > PAIR_SHINGLES:
                link(a, b, t)
                a, b, t, size = [], [], [], 0
    if a:
        link(a, b, t)
    some = np.flatnonzero(others)
    if len(some):
        node = np.ascontiguousarray(own["node"])
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(others[some]), pa.array(node[root[some]])], ["node", "others", "root"])


def postings(live: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """(part, block, and the fields of an entry): packed index entries by parts; those of very common shingles as rows of their own."""
    names, common = ["part", "block", *_POSTING.names], int(_classes(np.array([LIST_NODES]))[0])

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        small, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def flush():
            e, hot = (np.concatenate(x) for x in zip(*held))
            h, e = e[hot], e[~hot]
            part = (e["t"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            e, cuts = e[order], np.searchsorted(part[order], np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            # Column by column: a node's entries follow each other, so all but the hash shrinks to little.
            blocks = [small.compress(b"".join(e[f][cuts[p] : cuts[p + 1]].tobytes() for f in _POSTING.names)) for p in some]
            n, m = len(some), len(h)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary()), *(pa.nulls(n, pa.int64()),) * len(_POSTING.names)], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *(pa.array(np.ascontiguousarray(h[f]).astype("<u8").view("<i8")) for f in _POSTING.names)], names)

        for batch in batches:
            for raw, *own in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, _ENTRY)
                e = np.empty(len(x), _POSTING)
                e["t"], e["p"] = x["t"], x["p"]
                for f, v in zip(_POSTING.names[2:], own):
                    e[f] = v
                held.append((e, x["c"] >= common))
                size += len(e)
                if size > 1_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    l = labels.select(F.col("node").alias("own"), "label")
    labelled = live.join(l, F.col("node") == F.col("own")).select("entries", *_POSTING.names[2:])
    return labelled.mapInArrow(emit, "part int, block binary, " + ", ".join(f"{f} long" for f in _POSTING.names))


def across_clusters(packed: DataFrame, uri: str) -> DataFrame:
    """(node, others, root) as within_clusters has them, of the links between clusters; packed is written. Parts of a node's count are to
    be added up."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "node long, others long, root long"

    def opened(raw: bytes) -> np.ndarray:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw)
        e, at = np.empty(len(raw) // _POSTING.itemsize, _POSTING), 0
        for f in _POSTING.names:
            e[f] = np.frombuffer(raw, _POSTING[f], len(e), at)
            at += len(e) * _POSTING[f].itemsize
        return e

    def of_part(rows: list[tuple], read: SetFiles) -> Iterator:
        yield from _links_of(np.concatenate([opened(x[1]) for x in rows]), read)

    def of_cell(rows: list[tuple], read: SetFiles) -> Iterator:
        cell, e = rows[0][0], np.zeros(len(rows), _POSTING)
        e["t"] = np.int64(cell["t"]).view(np.uint64)
        _, *columns, side = zip(*rows)
        for f, column in zip(_POSTING.names[1:], columns):
            e[f] = column
        yield from _links_of(e, read, np.array(side))  # two blocks meet here, and the pairs of each in its own cell

    def by(of):
        def run(batches: Iterator) -> Iterator:
            read = SetFiles(uri)
            yield from by_first(batches, lambda rows: of(rows, read))

        return run

    common = packed.where(F.col("block").isNotNull()).select("part", "block").repartition(n, "part").sortWithinPartitions("part")
    made = common.mapInArrow(by(of_part), fields)
    hot = packed.where(F.col("block").isNull())
    mixed = hot.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
    mixed = mixed.select(F.col("t").alias("of"), F.ceil(F.col("c") / LIST_NODES).cast("int").alias("blocks"))
    dealt = hot.join(mixed, F.col("t") == F.col("of")).withColumn("x", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.struct("t", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).alias("cell")
    dealt = dealt.select(cell, *_POSTING.names[1:], "x").repartition(n, "cell").sortWithinPartitions("cell")
    return made.unionByName(dealt.mapInArrow(by(of_cell), fields))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in links (a, b): edges are contracted until none is left; label is a node of the component.

    Node ids are hashes, so hooking each to its least neighbour shrinks any graph by a constant share each round.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = store.materialise(links.where("a <> b").distinct(), "edges")
    labels = store.materialise(both(edges).select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not edges.isEmpty():
        hook = both(edges).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = store.materialise(hook, "hooks")
        h = lambda c, t: hook.select(F.col("a").alias(c), F.col("to").alias(t))
        old = hook, labels, edges
        labels = labels.join(h("ha", "ta"), F.col("label") == F.col("ha"), "left").select("node", F.coalesce("ta", "label").alias("label"))
        labels = store.materialise(labels, "labels")
        moved = edges.join(h("ha", "ta"), F.col("a") == F.col("ha")).select("ta", "b").join(h("hb", "tb"), F.col("b") == F.col("hb"))
        edges = store.materialise(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        store.drop(*old)
    return labels


def _grouped(docs: DataFrame, at: F.Column | None = None) -> DataFrame:
    """(doc_id, said, at, n_shingles, n_links, label, component_id) of each document; label is null for one without copy or link."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = store.new_dir(spark, "sets")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.lit(None) if at is None else at).cast(_AT).alias("at"))
    signed = store.materialise(sign(slim, uri), "nodes")
    place = F.min(F.struct("file", "chunk", "start", "n")).alias("place")
    reps = signed.where(F.col("node").isNotNull()).groupBy("node").agg(place, F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    reps = store.materialise(reps.select("node", "place.*", "doc_id", "copies"), "reps")

    # Which nodes can link, and the order of rarity.
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one row
    parts = max(least, math.ceil(total / PART_SHINGLES))
    held = F.sort_array(F.collect_list(F.struct("start", "n", "node", "copies"))).alias("held")  # CHUNK_NODES at most
    chunks = store.materialise(reps.groupBy("file", "chunk").agg(held), "chunks")
    counts = store.materialise(shingle_counts(shingle_keys(chunks, uri, parts)), "counts")
    live = store.materialise(alive(chunks, counts, uri, parts), "live")
    store.drop(chunks, counts)

    # Links.
    labels = clusters(live)
    near = store.materialise(within_clusters(live, labels, uri), "near")
    packed = store.materialise(postings(live, labels, parts), "postings")
    far = store.materialise(across_clusters(packed, uri), "links")
    store.drop(labels, packed)

    # Components and counts. Only nodes with copies or links are told apart from the rest.
    found = near.unionByName(far)
    groups = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    counted = found.groupBy("node").agg(F.sum("others").alias("others"))
    g, c = groups.withColumnRenamed("node", "g"), counted.withColumnRenamed("node", "c")
    some = reps.join(g, F.col("node") == F.col("g"), "left").where("copies > 1 or g is not null").join(c, F.col("node") == F.col("c"), "left")
    some = store.materialise(some.select("node", "doc_id", F.coalesce("label", "node").alias("label"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "grouped-nodes")
    first = some.groupBy("label").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("label", "l")
    ids = some.join(first, F.col("label") == F.col("l")).select(F.col("node").alias("of"), "label", "component_id", "n_links")
    ids = store.materialise(ids, "ids")
    store.drop(near, far, groups, some, reps, live)
    store.remove(spark, uri)
    out = signed.join(ids, F.col("node") == F.col("of"), "left")
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return out.select("doc_id", "said", "at", F.col("n").alias("n_shingles"), n_links, "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def group_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each document: n_links are the other documents, copies included, that
    it links with."""
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def count_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, n_links) for each document."""
    return _grouped(docs).select("doc_id", "n_shingles", "n_links")


def _unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for x in names:
        while x in taken:
            x = f"_{x}"
        taken.add(x)
        out.append(x)
    return out


def _write_lists(rows: DataFrame, uri: str) -> DataFrame:
    """Write one file for each path of rows (at): the sorted numbers of its rows; gives (path, n)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator) -> Iterator:
        def one(own: list[tuple]) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            fs, path = store.filesystem(f"{uri}/{own[0][0]}.rows")
            fs.create_dir(posixpath.dirname(path), recursive=True)
            draft = f"{path}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                out.write(np.array([r for _, r in own], "<i8").tobytes())
            fs.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([own[0][0]], pa.int64()), pa.array([len(own)], pa.int64())], ["path", "n"])

        yield from by_first(batches, one)

    return rows.select("at.path", "at.row").repartition(n, "path").sortWithinPartitions("path", "row").mapInArrow(write, "path long, n long")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest (doc_id, hash of the text), of its repeated rows one.
    Documents with an empty set all stay. Columns may bear any name.

    Rows are known by their file and their number in it, so the rows that go are listed by file, and every task that reads a part of
    docs looks its file's list up: no text is shuffled. A table that is not read from files is written first.
    """
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = store.materialise(docs, "docs")
    meta = docs.metadataColumn("_metadata")
    at = F.struct(F.xxhash64(meta["file_path"]).alias("path"), meta["row_index"].alias("row"))
    rows = store.materialise(_grouped(docs, at).where(F.col("label").isNotNull()).select("doc_id", "said", "at", "label"), "grouped")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "said", "at")).alias("first")).withColumnRenamed("label", "l")
    gone = rows.join(first, F.col("label") == F.col("l")).where(F.col("at") != F.col("first.at"))
    uri = store.new_dir(spark, "gone")
    store.drop(store.materialise(_write_lists(gone, uri), "gone-lists"), rows)
    names, (p, r) = docs.columns, _unused(docs, "own_path", "own_row")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as pafs

        path, lost = None, np.zeros(0, "<i8")
        for batch in batches:
            own, number = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            ok = np.ones(len(own), bool)
            for x in np.unique(own).tolist():
                if x != path:
                    fs, name = store.filesystem(f"{uri}/{x}.rows")
                    path, lost = x, np.zeros(0, "<i8")
                    if fs.get_file_info(name).type != pafs.FileType.NotFound:
                        with fs.open_input_file(name) as f:
                            lost = np.frombuffer(f.read(), "<i8")
                if len(lost):
                    k = np.minimum(np.searchsorted(lost, number), len(lost) - 1)
                    ok &= (own != x) | (lost[k] != number)
            yield batch.select(list(range(len(names)))).filter(pa.array(ok))

    placed = docs.select("*", at["path"].alias(p), at["row"].alias(r))
    return placed.mapInArrow(keep, docs.schema)
