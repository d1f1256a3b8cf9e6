"""Corpus-wide ownership frequency of secret candidates (DataFrame functions only).

Every text is searched for candidates. Their hashes are aggregated by distinct
owner and repository: a value that many owners or many repositories hold is a
widely copied example, one that few hold looks live.

Defined results: a null or empty text has no spans; a null owner or repository
counts as one of its own; repeated rows are scanned each, and a repeat adds no
owner; an empty table gives an empty result; extra columns are ignored by
``secret_report`` and kept by ``mask_live``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .expressions import cut, let, pieces, running

#: The kinds in the order of listing, their patterns, the group that must be long, and its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})", 1, 20),
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
]
BASE = 3
#: A value held by this many owners is a copied example.
COPIED_OWNERS = 3
#: So is a value held by this many repositories, whoever owns them.
COPIED_REPOS = 4


def _quote(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _spans_of(kind: int, text: str) -> str:
    """SQL for the array of (start, kind, end, hash) of one kind: the pieces between matches and the matches, in turn."""
    _, pattern, group, least = KINDS[kind]
    p = _quote(pattern)
    gaps, whole = f"split({text}, '{p}', -1)", f"regexp_extract_all({text}, '{p}', 0)"
    value = whole if group == 0 else f"regexp_extract_all({text}, '{p}', {group})"
    at = running("transform(m.w, (x, i) -> length(m.g[i]) + length(x))", "0", "a + x")
    start = "c[i] + length(m.g[i])"
    span = f"if(length(m.v[i]) >= {least}, named_struct('start', {start}, 'kind', {kind}, 'end', {start} + length(x), 'hash', sha2(m.v[i], 256)), null)"
    found = let(f"named_struct('g', {gaps}, 'w', {whole}, 'v', {value})", "m", let(at, "c", f"filter(transform(m.w, (x, i) -> {span}), x -> x is not null)"))
    return f"if({text} rlike '{p}', {found}, cast(array() as array<struct<start: int, kind: int, end: int, hash: string>>))"


def spans(text: str = "text") -> F.Column:
    """All spans of a text, by start and then by kind as listed; offsets in code points, end exclusive."""
    q = "`" + text.replace("`", "``") + "`"
    each = ", ".join(_spans_of(k, "t") for k in range(len(KINDS)))
    return F.expr(f"element_at(transform(array(coalesce({q}, '')), t -> sort_array(concat({each}))), 1)")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per candidate hash: distinct owners and repositories, pre-aggregated before each shuffle."""
    held = scanned.where(F.size("spans") > 0).select(F.explode("spans.hash").alias("hash"), "owner", "repo").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def classify(scanned: DataFrame) -> DataFrame:
    """scanned (row, spans, owner, repo; written) with shared: owners and repositories of the hashes of its spans that more than
    one repository holds; and copied: those hashes that many owners or repositories hold."""
    wide = store.materialise(ownership(scanned).where("repos > 1"), "owners").withColumnRenamed("hash", "wide_hash")
    each = scanned.where(F.size("spans") > 0).select("row", F.explode(F.array_distinct("spans.hash")).alias("hash"))
    held = F.struct("hash", "owners", "repos")
    hits = each.join(wide, F.col("hash") == F.col("wide_hash")).groupBy("row").agg(F.collect_set(held).alias("shared"))
    hits = hits.withColumnRenamed("row", "__row")
    joined = scanned.join(hits, F.col("row") == F.col("__row"), "left").drop("__row")
    joined = joined.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<hash: string, owners: bigint, repos: bigint>>")))
    return joined.withColumn("copied", F.expr(f"filter(shared, h -> h.owners >= {COPIED_OWNERS} or h.repos >= {COPIED_REPOS}).hash"))


def _repository(owner: F.Column, repo: F.Column) -> F.Column:
    """A string for an owner's part of a repo value that tells null from any value."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return F.concat(told(owner), F.lit("/"), told(repo))


_NAMES = "array(" + ", ".join(f"'{k[0]}'" for k in KINDS) + ")"


def _listed(column: str) -> str:
    return f"array_join(transform({column}, s -> concat({_NAMES}[s.kind], ':', s.start, ':', s.end)), ',')"


def secret_report(docs: DataFrame, owner: str = "source", repo: str = "lang") -> DataFrame:
    """Spans, their counts and digest, how many look live or copied, and the owners/repositories that hold each, for each document.

    A repository is an owner's part of one repo value.
    """
    scanned = docs.select("doc_id", spans().alias("spans"), F.col(owner).alias("owner"), _repository(F.col(owner), F.col(repo)).alias("repo"))
    held = store.materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "spans")
    out = classify(held)
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)")
    base = F.expr(_listed(f"filter(spans, s -> s.kind < {BASE})"))
    live = F.expr("cast(size(filter(spans, s -> not array_contains(copied, s.hash))) as bigint)")
    holders = "coalesce(get(transform(filter(shared, h -> h.hash = s.hash), h -> concat(h.owners, '/', h.repos)), 0), '1/1')"
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("spans").cast("long") - live).alias("n_copied"),
        F.expr(f"array_join(transform(spans, s -> {holders}), ',')").alias("holders"),
    )


def mask_live(docs: DataFrame, owner: str = "source", repo: str = "lang", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every live-looking span of the text replaced by mask; copied examples stay."""
    tick = lambda c: F.col("`" + c.replace("`", "``") + "`")
    packed = F.struct(*[tick(c).alias(c) for c in docs.columns]).alias("doc")
    scanned = docs.select(packed, spans(text).alias("spans"), tick(owner).alias("owner"), _repository(tick(owner), tick(repo)).alias("repo"))
    held = store.materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "spans")
    rest = classify(held.where(F.size("spans") > 0)).drop("shared").unionByName(held.where(F.size("spans") == 0).withColumn("copied", F.array().cast("array<string>")))
    q = "doc.`" + text.replace("`", "``") + "`"
    # Spans may overlap: a span that begins inside what is masked already adds nothing but its end.
    live = "filter(spans, s -> not array_contains(copied, s.hash))"
    ends = running("transform(l, s -> s.end)", "0", "greatest(a, x)")
    each = f"if(s.start >= e[i], concat({cut('p', 'e[i]', 's.start')}, '{mask}'), '')"
    tail = cut("p", "array_max(transform(l, s -> s.end))", f"length({q})")
    whole = f"array_join(concat(transform(l, (s, i) -> {each}), array({tail})), '')"
    masked = F.expr(f"if(size({live}) = 0, {q}, {let(live, 'l', let(ends, 'e', let(pieces(q), 'p', whole)))})")
    return rest.select(*[(masked if c == text else F.col("doc.`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns])
