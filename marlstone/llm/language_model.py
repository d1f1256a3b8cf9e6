"""N-gram language model in Elias-Fano trie levels.

Texts are tokenised once, into chunk files of local word numbers. Then the orders follow each other: every chunk sends its
distinct n-grams, with how often its training texts have them, to the parts that own them by the hash of the whole n-gram, so
neither a frequent word nor its many successors meet in one task. A part adds up, writes its level and answers every
chunk's n-grams from it. So look-ups are shuffled to the part that owns the key, and no task holds more than one part.

* words: their hashes as a monotone Elias-Fano sequence, and exact counts;
* each higher order: context hashes (Elias-Fano), monotone pointers to each context's successors (Elias-Fano), the
  successors made monotone by their context's rank (Elias-Fano), and each one's smoothed probability as one byte, quantised in
  the logarithm.

An n-gram that holds a shorter one of which the whole corpus has a single occurrence, in a training text, is known to occur once
without being sent, so it is neither sent nor stored: levels above the first hold n-grams whose parts occur twice or more.

Levels are memory-mapped where the shared folder is a mounted one. A query finds the context's rank, takes the pointers'
range and searches the successor in it. Probabilities are Dirichlet-smoothed from order to order:
p(w | h) = (c(h, w) + MASS * p(w | shorter h)) / (c(h) + MASS), the shorter one as quantised in its level, and at the bottom
p(w) = (c(w) + 1) / (N + V + 1). Texts begin with ORDER - 1 start marks.

Words are 64-bit hashes; within a part a context is told by 32 bits and its successor by 16.

Defined results: a null or empty text is only its end; a null id is learnt as the text ''; repeated rows are learnt
and scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import posixpath
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .blocks import by_first, planes, squeeze, unplanes, unsqueeze
from .words import _finish, word_hashes, words

FOLDS, HELD_OUT = 7, 2
ORDER = 3
MASS = 8.0
#: What one task holds at a time.
CHUNK_TOKENS, CHUNK_TEXTS = 1_000_000, 20_000
_END, _START = np.uint64(0x8000000000000001), np.uint64(0x8000000000000003)
#: Steps of the quantised natural logarithm of a probability: 255 of them reach below e^-25.
_STEP = 0.1
_MAGIC = b"MRLL0002"
_CONTEXT, _SUCC = np.uint64(32), np.uint64(16)


class EliasFano:
    """A monotone sequence: low bits in whole bytes, high bits in unary with a count of ones before each 64-bit word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        #: Zeros before each word.
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        """values: sorted unsigned integers below or at top."""
        n = len(values)
        spread = max(1, int(top) // max(1, n))
        bits = min(56, -(-max(0, spread.bit_length() - 1) // 8) * 8)
        kind = {0: "<u1", 8: "<u1", 16: "<u2"}.get(bits, "<u4" if bits <= 32 else "<u8")
        values = values.astype(np.uint64)
        low = (values & np.uint64((1 << bits) - 1)).astype(kind) if bits else np.zeros(0, "<u1")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(top) >> bits) + n + 1
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.zeros(len(high) + 1, "<i8")
        np.cumsum(flags.reshape(-1, 64).sum(axis=1, dtype=np.int64), out=ones[1:])
        return cls(n, bits, low, high, ones)

    def write(self, out: io.BytesIO) -> None:
        out.write(struct.pack("<QQQQQ", self.n, self.bits, self.low.dtype.itemsize, len(self.low), len(self.high)))
        for x in (self.low, self.high, self.ones):
            out.write(x.tobytes())
            out.write(b"\0" * (-out.tell() % 8))

    @classmethod
    def read(cls, raw, at: int) -> tuple[EliasFano, int]:
        n, bits, width, n_low, n_high = struct.unpack_from("<QQQQQ", raw, at)
        at += 40
        parts = []
        for kind, count in ((f"<u{width}", n_low), ("<u8", n_high), ("<i8", n_high + 1)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += count * int(kind[-1])
            at += -at % 8
        return cls(n, bits, *parts), at

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero) in the high bits."""
        word = np.searchsorted(counts, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        bits = self.high[word]
        if flip:
            bits = ~bits
        left, at = k - counts[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= low
            left = np.where(beyond, left - low, left)
            at = np.where(beyond, at + width, at)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.low[i].astype(np.uint64) if self.bits else high

    def find(self, x: np.ndarray, begin=None, end=None) -> np.ndarray:
        """Index of each value within [begin, end), -1 if it isn't there: only the elements that share its high bits are looked at."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = h < self.zeros[-1]
        h = np.where(inside, h, 0)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - np.maximum(h - 1, 0), 0)
        hi = np.where(inside, self._select(h, self.zeros, True) - h, lo)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        if not self.bits:
            return np.where(hi > lo, lo, -1)
        want = (x & np.uint64((1 << self.bits) - 1)).astype(self.low.dtype)
        left, right = lo.copy(), np.maximum(hi, lo)
        while np.any(open_ := left < right):
            mid = (left + right) // 2
            less = self.low[np.minimum(mid, self.n - 1)] < want
            left = np.where(open_ & less, mid + 1, left)
            right = np.where(open_ & ~less, mid, right)
        return np.where((left < hi) & (self.low[np.minimum(left, self.n - 1)] == want), left, -1)


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log(p) / _STEP), 0, 255).astype("<u1")


def _decode(code: np.ndarray) -> np.ndarray:
    return np.exp(-_STEP * code.astype(np.float64))


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and its last word."""
    with np.errstate(over="ignore"):
        return _finish(_finish(context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + word)


def _value(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What a level tells an n-gram by: its context, then its successor."""
    with np.errstate(over="ignore"):
        return ((_finish(context + np.uint64(7)) >> _CONTEXT) << _SUCC) | (_finish(word + np.uint64(11)) >> np.uint64(48))


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


_OWN = "struct<words: bigint, ids: bigint, doc_ids: array<bigint>, held: array<boolean>, n: array<bigint>>"
_KEY = "struct<file: bigint, start: bigint>"


def tokenise(docs: DataFrame, uri: str) -> DataFrame:
    """(key, own) of each chunk of texts: where its words and word numbers are, and its texts' ids, folds and lengths."""
    most, most_texts = CHUNK_TOKENS, CHUNK_TEXTS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file, out, at = TaskContext.get().taskAttemptId(), None, 0  # a file for each attempt
        kinds = pa.struct([("file", pa.int64()), ("start", pa.int64())]), pa.struct([("words", pa.int64()), ("ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64()))])
        ids, held, each, size = [], [], [], 0
        pad = np.array([_START] * (ORDER - 1), np.uint64)

        def flush():
            nonlocal at
            every = np.concatenate([y for x in each for y in (pad, x, [_END])])
            local, number = np.unique(every, return_inverse=True)
            a, b = squeeze(local), planes(number.astype(np.uint64))
            out.write(a + b)
            own = {"words": len(a), "ids": len(b), "doc_ids": ids, "held": held, "n": [len(x) + 1 for x in each]}
            batch = pa.RecordBatch.from_arrays([pa.array([{"file": file, "start": at}], kinds[0]), pa.array([own], kinds[1])], ["key", "own"])
            at += len(a) + len(b)
            return batch

        for batch in batches:
            if out is None:
                fs, path = store.filesystem(f"{uri}/{file}.chunks")
                fs.create_dir(posixpath.dirname(path), recursive=True)
                out = fs.open_output_stream(path)
            for doc, out_of, text in zip(*(c.to_pylist() for c in batch.columns)):
                x = word_hashes(words(text))
                if each and (size + len(x) > most or len(each) >= most_texts):
                    yield flush()
                    ids, held, each, size = [], [], [], 0
                ids.append(doc), held.append(out_of), each.append(x)
                size += len(x)
        if each:
            yield flush()
        if out is not None:
            out.close()

    return docs.select("doc_id", _held_out().alias("held"), "text").mapInArrow(run, f"key {_KEY}, own {_OWN}")


class Chunk:
    """One chunk's n-grams: distinct ones of each order with their context and last word, and which one each token ends."""

    def __init__(self, uri: str, key: dict, own: dict):
        fs, path = store.filesystem(f"{uri}/{key['file']}.chunks")
        with fs.open_input_file(path) as f:
            raw = f.read_at(own["words"] + own["ids"], key["start"])
        self.words, ids = unsqueeze(raw[: own["words"]]), unplanes(raw[own["words"] :]).astype(np.int64)
        self.n = np.array(own["n"], np.int64)
        starts = np.cumsum(self.n + ORDER - 1) - (self.n + ORDER - 1)
        token = np.ones(len(ids), bool)
        for k in range(ORDER - 1):
            token[starts + k] = False
        self.first = np.cumsum(self.n) - self.n
        self.train = np.repeat(~np.array(own["held"], bool), self.n)
        self.last = ids[token]
        self.start = int(np.searchsorted(self.words, _START))
        #: By order: hashes of contexts and of n-grams, each n-gram's context and last word, each token's n-gram.
        self.grams = {1: self.words}
        self.context, self.word, self.of = {}, {1: np.arange(len(self.words))}, {1: self.last}

    def order(self, k: int) -> None:
        """Make order k from order k - 1. The n-grams of start marks alone are contexts without a token: they come last."""
        if k in self.grams:
            return
        self.order(k - 1)
        before, lower = self.of[k - 1], len(self.grams[k - 1])
        if k == 2:
            hashes, begin = self.words, self.start
        else:
            alone = np.array([_START], np.uint64)
            for _ in range(k - 2):
                alone = _mix(alone, np.array([_START], np.uint64))
            hashes, begin = np.concatenate([self.grams[k - 1], alone]), lower
        context = np.empty(len(before), np.int64)
        context[1:] = before[:-1]
        context[self.first] = begin
        each, of = np.unique(context * len(self.words) + self.last, return_inverse=True)
        self.context[k], self.word[k], self.of[k] = each // len(self.words), each % len(self.words), of
        self.grams[k] = _mix(hashes[self.context[k]], self.words[self.word[k]])
        self.hashes = hashes

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each n-gram is in training texts, and in others."""
        n = len(self.grams[k])
        train = np.bincount(self.of[k], weights=self.train, minlength=n).astype(np.int64)
        return train, np.bincount(self.of[k], minlength=n) - train

    def lower(self, k: int) -> np.ndarray:
        """The next shorter n-gram that ends with the same word, of each n-gram of order k: any token that ends one ends the other."""
        first = np.zeros(len(self.grams[k]), np.int64)
        first[self.of[k]] = self.of[k - 1]
        return first

    def dealt(self, k: int, parts: int, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which n-grams of order k are sent, in order; what tells them; bounds of the parts)."""
        i = np.flatnonzero(sent)
        value = self.words[i] if k == 1 else _value(self.hashes[self.context[k][i]], self.words[self.word[k][i]])
        part = (_finish(self.grams[k][i]) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((value, part))
        return i[order], value[order], np.searchsorted(part[order], np.arange(parts + 1))


class Scores:
    """What a chunk knows of its n-grams from the answers of the levels so far: counts, probabilities, and which are alone, that
    is, have one occurrence in all, and that in a training text."""

    def __init__(self, chunk: Chunk, answers: list[tuple], parts: int, totals: tuple[int, int, int]):
        """answers: (order, found, code) in order of parts."""
        self.chunk, (total, vocabulary, self.texts) = chunk, totals
        self.count, self.p, self.alone = {}, {}, {}
        for k in range(1, max([a[0] for a in answers], default=0) + 1):
            chunk.order(k)
            sent = self.sent(k)
            order, _, _ = chunk.dealt(k, parts, sent)
            own = [a for a in answers if a[0] == k]
            # What was not sent occurs once.
            count, alone = (~sent).astype(np.int64), ~sent
            found = np.concatenate([unplanes(a[1]) for a in own]).astype(np.int64) if own else np.zeros(0, np.int64)
            count[order], alone[order] = found >> 1, (found & 1).astype(bool)
            self.count[k], self.alone[k] = count, alone
            if k == 1:
                self.p[1] = (count + 1) / (total + vocabulary + 1)
                continue
            code = np.zeros(len(sent), np.uint8)
            code[order] = np.concatenate([unplanes(a[2]) for a in own]) if own else 0
            seen = (np.where(sent, 0, count) + MASS * self.below(k)) / (self.context(k) + MASS)
            self.p[k] = np.where(sent & (count > 0), _decode(code), seen)

    def sent(self, k: int) -> np.ndarray:
        """Which n-grams of order k are sent: those of which no shorter part is alone."""
        if k == 1:
            return np.ones(len(self.chunk.words), bool)
        alone = self.alone[k - 1]
        context = np.append(alone, False)[self.chunk.context[k]] if k > 2 else alone[self.chunk.context[k]]
        return ~(context | alone[self.chunk.lower(k)])

    def context(self, k: int) -> np.ndarray:
        """How often the context of each n-gram of order k was seen."""
        lower = self.count[k - 1]
        if k == 2:
            lower = lower.copy()
            lower[self.chunk.start] = self.texts
        else:
            lower = np.append(lower, self.texts)
        return lower[self.chunk.context[k]]

    def below(self, k: int) -> np.ndarray:
        """The probability of the last word of each n-gram of order k in the next shorter context, as far as levels hold it."""
        return self.p[k - 1][self.chunk.lower(k)]


def _chunks(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Chunks with their answers, by chunk: key, order (0 is the chunk's own row), part, found, code, own."""
    own = chunks.select("key", F.lit(0).alias("order"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("found"), F.lit(None).cast("binary").alias("code"), "own")
    for a in answers:
        own = own.unionByName(a.where(F.col("key").isNotNull()).select("key", "order", "part", "found", "code", F.lit(None).cast(_OWN).alias("own")))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "key").sortWithinPartitions("key", "order", "part")


def send(chunks: DataFrame, answers: list[DataFrame], k: int, uri: str, parts: int, totals: tuple[int, int, int]) -> DataFrame:
    """(part, key, value, times, others, context, below): each chunk's distinct n-grams of order k by part, with counts in training and
    other texts, counts of their contexts and the codes of their shorter probabilities."""

    def one(rows: list[tuple]) -> Iterator:
        import pyarrow as pa

        key, own = rows[0][0], rows[0][5]
        chunk = Chunk(uri, key, own)
        scores = Scores(chunk, [(r[1], r[3], r[4]) for r in rows[1:]], parts, totals)
        chunk.order(k)
        order, value, cuts = chunk.dealt(k, parts, scores.sent(k))
        columns = [c[order] for c in chunk.counts(k)]
        if k > 1:
            columns += [scores.context(k)[order], _code(scores.below(k))[order]]
        some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
        cut = lambda x, f: [f(x[cuts[p] : cuts[p + 1]]) for p in some]
        made = [cut(value, squeeze), *(cut(c.astype(np.uint64), planes) for c in columns)]
        made += [[None] * len(some)] * (5 - len(made))
        kind = pa.struct([("file", pa.int64()), ("start", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key] * len(some), kind), *(pa.array(m, pa.binary()) for m in made)], ["part", "key", "value", "times", "others", "context", "below"])

    return _chunks(chunks, answers).mapInArrow(lambda batches: by_first(batches, one), f"part int, key {_KEY}, value binary, times binary, others binary, context binary, below binary")


class Level:
    """One part's level of one order, memory-mapped where the file system is local."""

    def __init__(self, uri: str, k: int, part: int):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, path = store.filesystem(f"{uri}/level-{k}-{part:06d}.trie")
        raw = memoryview(pa.memory_map(path).read_buffer() if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path).read_buffer())
        if bytes(raw[:8]) != _MAGIC:
            raise ValueError("not a level")
        self.k = k
        self.contexts, at = EliasFano.read(raw, 8)
        if k == 1:
            self.counts = np.frombuffer(raw, "<u8", self.contexts.n, at)
            return
        self.pointers, at = EliasFano.read(raw, at)
        self.successors, at = EliasFano.read(raw, at)
        self.codes = np.frombuffer(raw, "<u1", self.successors.n, at)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each n-gram in the level, -1 for those that are not in it."""
        if self.k == 1:
            return self.contexts.find(value)
        out = np.full(len(value), -1, np.int64)
        if not self.successors.n:
            return out
        rank = self.contexts.find(value >> _SUCC)
        seen = np.flatnonzero(rank >= 0)
        rank = rank[seen]
        begin, end = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        low = value[seen] & np.uint64((1 << int(_SUCC)) - 1)
        out[seen] = self.successors.find((rank.astype(np.uint64) << _SUCC) | low, begin, end)
        return out


def _write_level(uri: str, k: int, part: int, value: np.ndarray, told: np.ndarray) -> None:
    """value: ascending; told: counts of words or codes of probabilities."""
    from pyspark import TaskContext

    out = io.BytesIO()
    out.write(_MAGIC)
    if k == 1:
        EliasFano.build(value, (1 << 64) - 1).write(out)
        out.write(told.astype("<u8").tobytes())
    else:
        contexts, begin = np.unique(value >> _SUCC, return_index=True)
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(begin, len(value))))
        low = value & np.uint64((1 << int(_SUCC)) - 1)
        EliasFano.build(contexts, (1 << int(_CONTEXT)) - 1).write(out)
        EliasFano.build(np.append(begin, len(value)), len(value)).write(out)
        EliasFano.build((rank << _SUCC) | low, max(1, len(contexts)) << int(_SUCC)).write(out)
        out.write(told.tobytes())
    fs, path = store.filesystem(f"{uri}/level-{k}-{part:06d}.trie")
    fs.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(draft) as f:
        f.write(out.getbuffer())
    fs.move(draft, path)


def answer(sent: DataFrame, k: int, uri: str) -> DataFrame:
    """Write each part's level and answer every chunk's n-grams from it: (key, order, part, found, code); and one row a part
    without a key: its tokens, n-grams and ends of text."""
    names = ["key", "order", "part", "found", "code", "tokens", "grams", "ends"]

    def one(rows: list[tuple]) -> Iterator:
        import pyarrow as pa

        part = rows[0][0]
        each = [unsqueeze(r[2]) for r in rows]
        times, others = (np.concatenate([unplanes(r[c]) for r in rows]).astype(np.int64) for c in (3, 4))
        value, first, of = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        total = np.bincount(of, weights=times, minlength=len(value)).astype(np.int64)
        alone = (total == 1) & (np.bincount(of, weights=others, minlength=len(value)) == 0)
        seen, ends = total > 0, 0
        if k == 1:
            told, ends = total[seen], int(total[value == _END].sum())
        else:
            context, below = (np.concatenate([unplanes(r[c]) for r in rows])[first] for c in (5, 6))
            told = _code((total + MASS * _decode(below)) / (context.astype(np.float64) + MASS))[seen]
        _write_level(uri, k, part, value[seen], told)
        level, total, told = Level(uri, k, part), total[seen], (total[seen] << 1) | alone[seen]
        found, code = [], []
        for x in each:
            i = level.find(x)
            at = np.maximum(i, 0)
            found.append(planes(np.where(i >= 0, told[at], 0).astype(np.uint64) if len(total) else np.zeros(len(x), np.uint64)))
            code.append(None if k == 1 else planes(np.where(i >= 0, level.codes[at], 0).astype(np.uint64) if len(total) else np.zeros(len(x), np.uint64)))
        n, kind = len(rows), pa.struct([("file", pa.int64()), ("start", pa.int64())])
        own = [None] * n
        columns = [[*(r[1] for r in rows), None], [k] * (n + 1), [part] * (n + 1), [*found, None], [*code, None], [*own, int(total.sum())], [*own, len(total)], [*own, ends]]
        kinds = (kind, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(n, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: by_first(batches, one), f"key {_KEY}, order int, part int, found binary, code binary, tokens long, grams long, ends long")


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model score of every text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri, made = store.new_dir(spark, "trie"), store.new_dir(spark, "chunks")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    chunks = store.materialise(tokenise(slim, made), "chunk-rows")
    answers, totals = [], (0, 0, 0)
    for k in range(1, ORDER + 1):
        answers.append(store.materialise(answer(send(chunks, answers, k, made, parts, totals), k, uri), f"answers-{k}"))
        if k == 1:
            sums = answers[0].where(F.col("key").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "grams", "ends")])
            totals = tuple(sums.first())  # one row
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def one(rows: list[tuple]) -> Iterator:
        import pyarrow as pa

        own = rows[0][5]
        chunk = Chunk(made, rows[0][0], own)
        scores = Scores(chunk, [(r[1], r[3], r[4]) for r in rows[1:]], parts, totals)
        add = lambda x: np.add.reduceat(x, chunk.first)
        known, base = scores.count[1] > 0, np.log10(scores.p[1])
        sums = add(known[chunk.last].astype(np.int64)), np.full(len(chunk.n), totals[0], np.int64), add(base[chunk.last]), add(np.log10(scores.p[ORDER])[chunk.of[ORDER]])
        yield pa.RecordBatch.from_arrays([pa.array(own["doc_ids"], pa.int64()), pa.array(own["held"], pa.bool_()), pa.array(chunk.n), *map(pa.array, sums)], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _chunks(chunks, answers).mapInArrow(lambda batches: by_first(batches, one), schema)
