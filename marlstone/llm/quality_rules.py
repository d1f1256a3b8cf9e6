"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets counts; per language and source mergeable KLL quantile sketches of each ratio and of the documents'
sizes give that group's own fences, and the counts are joined with the fences to reach a verdict.

A fence lies SPREADS spreads beyond the quartile. A spread is the group's interquartile range, or, if that is larger, what
EVENTS events (one symbol, one repeated line, one repeated window) make of the ratio in the group's median document. Nothing
in it is a cutoff of its own: ratios, their spread and the size of a document all come from the sketches. Fences of a small
group lean on those of its language, and these on those of all documents, with weight SHRINK / (n + SHRINK): continuous in n.

Defined results: a null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows count as often as
they occur; an empty table gives an empty result; extra columns are kept by
``filter_quality`` and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .expressions import let

#: White space that parts words: \x20 and \x09-\x0D.
_SPACE = r"[\\x20\\x09-\\x0D]+"
_WINDOW = 5

#: Ratio, the size that its events are counted against, and what one event adds to the numerator; mean_word has no events.
RATIOS = {"symbol_ratio": ("n_words", 1), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", 2 * _WINDOW), "mean_word": None}
#: Spreads between quartile and fence, and events that make a spread at least. mean_word has a lower fence too.
SPREADS, EVENTS = 3.0, 1.0
#: Documents of its own that a group's fences need to weigh as much as those of its language.
SHRINK = 50.0
SKETCH_K = 2000


def _repeat_sql() -> str:
    """Words within windows that occur twice or more, from the word hashes h.

    A text with few distinct repeated windows looks its windows up in their list; one with many
    sorts (window, place) pairs instead, so the work stays n log n for any text.
    """
    hashed = ", ".join(f"h[i + {k}]" for k in range(_WINDOW))
    shingles = f"transform(sequence(0, size(h) - {_WINDOW}), i -> xxhash64({hashed}))"
    repeated = let("sort_array(sh)", "o", "array_distinct(filter(o, (g, i) -> i > 0 and o[i - 1] = g))")
    looked_up = "array_remove(transform(sh, (g, i) -> if(array_contains(r, g), i, -1)), -1)"
    marked = (
        "sort_array(filter(transform(s, (x, j) -> if((j > 0 and s[j - 1].g = x.g) or "
        "(j < size(s) - 1 and s[j + 1].g = x.g), x.i, -1)), p -> p >= 0))"
    )
    by_order = let("sort_array(transform(sh, (g, i) -> struct(g as g, i as i)))", "s", marked)
    covered = (
        f"aggregate(transform(d, (p, k) -> if(k = size(d) - 1, {_WINDOW}, "
        f"least({_WINDOW}, d[k + 1] - p))), 0L, (a, x) -> a + x)"
    )
    found = let(repeated, "r", let(f"if(size(r) <= 64, {looked_up}, {by_order})", "d", covered))
    return f"if(size(h) < {_WINDOW}, 0L, " + let(shingles, "sh", f"if(size(array_distinct(sh)) = size(sh), 0L, {found})") + ")"


def counts(text: str = "text") -> F.Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text column."""
    q = "`" + text.replace("`", "``") + "`"
    words = f"array_remove(split(coalesce({q}, ''), '{_SPACE}', -1), '')"
    lines = f"filter(split(coalesce({q}, ''), '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    of_words = let(
        words,
        "w",
        "struct(cast(size(w) as bigint) as n_words, cast(length(concat_ws('', w)) as bigint) as word_chars, "
        + let("transform(w, x -> xxhash64(x))", "h", _repeat_sql())
        + " as n_repeat_words)",
    )
    of_lines = let(lines, "l", "struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines)")
    symbols = f"cast(length(regexp_replace(coalesce({q}, ''), '[^#*$%&|<>]+', '')) as bigint)"
    return F.expr(
        let(
            f"struct({of_words} as a, {of_lines} as b, {symbols} as c)",
            "m",
            "struct(m.a.n_words as n_words, m.a.word_chars as word_chars, m.c as n_symbols, m.b.n_lines as n_lines, "
            "m.b.n_dup_lines as n_dup_lines, m.a.n_repeat_words as n_repeat_words)",
        )
    )


def base_failed(m: str = "m") -> F.Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def _ratio(m: str) -> dict[str, F.Column]:
    c = lambda k: F.col(f"{m}.{k}")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": part(c("n_symbols"), c("n_words")),
        "dup_line_ratio": part(c("n_dup_lines"), c("n_lines")),
        "repeat_ratio": part(c("n_repeat_words"), c("n_words")),
        "mean_word": part(c("word_chars"), c("n_words")),
    }


def _key(column: F.Column) -> F.Column:
    """A string that tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit("null"))


_SIZES = ("n_words", "n_lines")


def _fences(sketch) -> dict[str, F.Column]:
    """Fences read from one family of sketches: sketch(name) is the column of a ratio's or a size's."""
    q = lambda k, p: F.kll_sketch_get_quantile_double(sketch(k), F.lit(p))
    out = {}
    for k, event in RATIOS.items():
        spread = q(k, 0.75) - q(k, 0.25)
        if event:
            spread = F.greatest(spread, EVENTS * event[1] / F.greatest(q(event[0], 0.5), F.lit(1.0)))
        out[f"hi_{k}"] = q(k, 0.75) + SPREADS * spread
        if not event:
            out[f"lo_{k}"] = q(k, 0.25) - SPREADS * spread
    return out


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) of measured (m, lang, source): fences from its sketches, leaning on the merged ones.

    Sketches of documents failing the base rule are left out, so junk does not widen the fences.
    """
    held = _ratio("m") | {k: F.col(f"m.{k}").cast("double") for k in _SIZES}
    k = F.lit(SKETCH_K)
    built = measured.where(~base_failed("m")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(v, k).alias(f"s_{x}") for x, v in held.items()])
    built = store.materialise(built, "sketches")
    merged = lambda to: [F.sum("n").alias(f"{to}_n"), *[F.kll_merge_agg_double(f"s_{x}", k).alias(f"{to}_{x}") for x in held]]
    whole = built.agg(*merged("a"))  # one row
    by_lang = built.groupBy("lang").agg(*merged("l")).withColumnRenamed("lang", "of")
    joined = built.join(by_lang, F.col("lang") == F.col("of")).join(F.broadcast(whole))
    own, of_lang, of_all = (_fences(lambda x, t=t: F.col(f"{t}_{x}")) for t in "sla")
    weight = lambda n: F.col(n) / (F.col(n) + SHRINK)
    blend = lambda w, x, y: y + w * (x - y)
    return joined.select("lang", "source", *[blend(weight("n"), own[x], blend(weight("l_n"), of_lang[x], of_all[x])).alias(x) for x in own])


def _tick(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc (a struct of the keep columns of docs, all by default), m (counts), failed (base rule) and kept (verdict)."""
    keep = docs.columns if keep is None else keep
    measured = docs.select(
        F.struct(*[_tick(c).alias(c) for c in keep]).alias("doc"),
        counts(text).alias("m"),
        _key(_tick(lang).cast("string")).alias("lang"),
        _key(_tick(source).cast("string")).alias("source"),
    )
    held = store.materialise(measured, "measured")
    fences = store.materialise(thresholds(held), "fences")
    f = fences.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.struct(*fences.columns[2:]).alias("f"))
    ratios = _ratio("m")
    bad = F.coalesce(ratios["mean_word"] < F.col("f.lo_mean_word"), F.lit(False))
    for k, v in ratios.items():
        bad = bad | F.coalesce(v > F.col(f"f.hi_{k}"), F.lit(False))
    joined = held.join(f, (F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source")), "left")
    return joined.select("doc", "m", base_failed("m").alias("failed"), (~base_failed("m") & ~bad).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document; the text goes no further than the counts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(docs, ["doc_id"])
    return judged.select("doc.doc_id", *[F.col(f"m.{c}").alias(c) for c in names], F.col("failed").alias("base_failed"), "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    names = docs.columns
    return judge(docs).where("kept").select(*[F.col("doc.`" + c.replace("`", "``") + "`").alias(c) for c in names])
