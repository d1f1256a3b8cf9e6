"""Token ids of whole texts, by the tokenizers library.

The byte-level pre-tokenizer never joins text across a single space or line
end that stands between two visible characters. So a text is cut there, each
distinct piece is encoded once per worker, and a text's ids are the pieces'
ids in turn: the same ids as encoding the whole text, at a fraction of the work.
Some texts at a time are cut together, so that a piece is asked for once among them, and marks at
a word's end are parted from it, so that a word is learnt once with whatever marks follow.
A text with any other white space, or with a special token of the tokenizer
written out in it, is encoded whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np

#: Pieces kept per worker in each of two generations. Bounds memory, not results.
CACHE_PIECES = 300_000
#: Characters of texts that are cut together; a longer text is cut alone. Bounds memory, not results.
CHARS_AT_ONCE = 4_000_000
#: A longer run of marks stays with its word.
_LONGEST_RUN = 16
#: Below this code point all versions of Unicode since 7.0 have the same letters.
_LETTERS_AGREE = "\u0530"
_IS_MARK = np.array([chr(b) in string.punctuation for b in range(256)])
_IS_LETTER = np.array([chr(c).isalpha() for c in range(ord(_LETTERS_AGREE))])
_IS_DIGIT = np.array([chr(b) in string.digits for b in range(128)])


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _ends(words) -> tuple:
    """(words, ends) of words (a large string array): the run of ASCII marks at a word's end, which the pre-tokenizer parts from
    a letter or digit before it, and the word without; an empty end where there is no such run."""
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets, data = np.frombuffer(words.buffers()[1], "<i8", len(words) + 1), np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    starts, stops = offsets[:-1], offsets[1:].copy()
    left = np.flatnonzero(stops > starts)
    for _ in range(_LONGEST_RUN):
        left = left[_IS_MARK[data[stops[left] - 1]]]
        stops[left] -= 1
        left = left[stops[left] > starts[left]]
    last, lead = data[stops - 1].astype(np.int64), data[stops - 2].astype(np.int64)
    # A character below U+0800 has one byte, or a first one of 0xC2 to 0xDF and a second.
    code = np.where(last < 128, last, np.where((lead >= 0xC2) & (lead <= 0xDF), (lead & 31) << 6 | last & 63, len(_IS_LETTER)))
    known = code < len(_IS_LETTER)
    known[known] = _IS_LETTER[code[known]] | _IS_DIGIT[np.minimum(code[known], 127)]
    sizes = np.where(known & (stops > starts), offsets[1:] - stops, 0)
    upto = np.cumsum(sizes)
    runs = data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(offsets[1:] - upto, sizes)]
    ends = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], upto]).astype("<i8")), pa.py_buffer(runs))
    return pc.if_else(pa.array(sizes > 0), pc.ascii_rtrim(words, characters=string.punctuation), words), ends


class _Pieces(dict):
    """Ids of pieces, learnt when first asked for; None, not kept, for a piece that learn knows nothing of. When a generation is
    full it becomes the old one, from which pieces that are still asked for come back."""

    def __init__(self, learn):
        self.learn, self.old = learn, {}

    def __missing__(self, piece: str) -> bytes | None:
        found = self.old.get(piece)
        if found is None:
            found = self.learn(piece)
        if found is not None:
            self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.line_end = self._whole("\n")
        self.pieces = _Pieces(self._learn)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, raw: str) -> bytes:
        """Ids of one run of the pre-tokenizer, in the byte-level alphabet."""
        known = self.bytes
        return b"".join([known[t.id] for t in self.model.tokenize(raw)])

    def _raw(self, text: str) -> str:
        """text in the byte-level alphabet; ASCII letters stand for themselves."""
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def _learn(self, piece: str) -> bytes | None:
        """A piece is a word that a space precedes, or a mark and a word: "\n" after a line end, "\r" at the text's begin. None
        for one that stands for other white space than one space or line end between words."""
        if piece.isalpha() and (piece.isascii() or max(piece) < _LETTERS_AGREE):
            return self._run("\u0120" + self._raw(piece))  # the space's letter
        first = piece[:1]
        if first == "\n" or first == "\r":
            word, before, space, begin = piece[1:], "", "", self.line_end if first == "\n" else b""
        else:
            word, before, space, begin = piece, " ", "\u0120", b""
        if word.split() != [word]:
            return None
        if word.isalpha() and (word.isascii() or max(word) < _LETTERS_AGREE):
            return begin + self._run(space + self._raw(word))
        return begin + self._whole(before + word)

    def _marked(self, text: str) -> str | None:
        """text with a space before each piece but the first; None if it must be encoded whole, as far as a glance tells."""
        if "\r" in text or "\t" in text or any(x in text for x in self.special):
            return None
        # A line's first word keeps its line end, and the text's first word gets a mark of its own.
        marked = "\r" + text.replace("\n", " \n")
        if "  " in marked or "\n " in marked or marked[1] == " " or marked[-1] in " \n":
            return None
        return marked

    def _together(self, texts: list[str | None]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = [self._marked(t) if t else None for t in texts]
        parts = pc.split_pattern(pa.array([m for m in marked if m], pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        words, ends = (x.dictionary_encode() for x in _ends(coded.dictionary))
        # to_numpy makes the strings at a fraction of to_pylist's time.
        found = pa.array([self.pieces[p] for p in words.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary())
        self.pieces.turn()
        runs = pa.array([self._whole(x) for x in ends.dictionary.to_pylist()], pa.large_binary())
        ids = pc.binary_join_element_wise(found.take(words.indices), runs.take(ends.indices), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        firsts = parts.offsets.to_numpy()
        cuts = np.frombuffer(ids.buffers()[1], "<i8")[firsts].tolist() if len(parts) else []
        odd = np.add.reduceat(ids.is_null().to_numpy(zero_copy_only=False), firsts[:-1], dtype=np.int64).tolist() if ids.null_count else [0] * len(parts)
        held, k = memoryview(ids.buffers()[2] or b"").cast("B"), 0
        for text, m in zip(texts, marked):
            whole = m is None
            if m:
                whole = odd[k] > 0
                own = b"" if whole else bytes(held[cuts[k] : cuts[k + 1]])
                k += 1
            yield (self._whole(text) if text else b"") if whole else own

    def stream(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; those of texts that are cut together are held at a time."""
        first, chars = 0, 0
        for k, t in enumerate(texts):
            n = len(t or "")
            if chars + n > CHARS_AT_ONCE and first < k:
                yield from self._together(texts[first:k])
                first, chars = k, 0
            chars += n
        if first < len(texts):
            yield from self._together(texts[first:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.stream(texts))


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
