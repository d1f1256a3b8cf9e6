"""SQL expressions over arrays that the operators without Python share."""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """Evaluate value once and use it as name in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, zero: str, merge: str) -> str:
    """For each place of an array the merge of all values before it. merge is SQL over a and x.

    An array cannot be appended to in place, so a fold would copy n times n values. Here the array is cut into blocks of
    its root's length: a place takes its blocks' merge and at most one block of values, n times root of n in all.
    """
    fold = lambda of: f"aggregate({of}, {zero}, (a, x) -> {merge})"
    blocks = f"transform(sequence(0, cast(size(v) div k as int)), b -> {fold('slice(v, b * k + 1, k)')})"
    before = f"transform(s, (y, b) -> {fold('slice(s, 1, b)')})"
    own = f"aggregate(slice(v, cast(i div k as int) * k + 1, i % k), o[cast(i div k as int)], (a, x) -> {merge})"
    return let(values, "v", let("greatest(1, cast(ceil(sqrt(size(v))) as int))", "k", let(blocks, "s", let(before, "o", f"transform(v, (y, i) -> {own})"))))


_CUT = 1024


def pieces(text: str) -> str:
    """A text in pieces of _CUT code points, from which cut() takes parts without counting from the text's begin."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_CUT}}}', 0)"


def cut(of: str, begin: str, end: str) -> str:
    """Code points [begin, end) of a text in pieces."""
    first, last = f"cast(({begin}) div {_CUT} as int)", f"cast((({end}) - 1) div {_CUT} as int)"
    part = f"substring({of}[j], cast(greatest(({begin}) - j * {_CUT}, 0) as int) + 1, cast(least(({end}) - j * {_CUT}, {_CUT}) - greatest(({begin}) - j * {_CUT}, 0) as int))"
    return f"if(({end}) <= ({begin}), '', array_join(transform(sequence({first}, {last}), j -> {part}), ''))"
