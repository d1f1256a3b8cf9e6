"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three definitions of CJK, not to be merged. The filter's has punctuation, the search's only the main block.
FILTER_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{2E80}-\x{2EFF}\x{3000}-\x{303F}]"
SEARCH_CJK = r"[\x{4E00}-\x{9FFF}]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EE5F}\x{2F800}-\x{2FA1F}\x{30000}-\x{323AF}]"
KANA = r"[\x{3031}-\x{3035}\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}\x{1B000}-\x{1B16F}]"
HANGUL = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{D7B0}-\x{D7FF}\x{FFA0}-\x{FFDC}]"

#: Categories by the first pattern that a lower-cased name has.
CATEGORIES = [
    (r"s\d{1,2}e\d|season|episode", "Series"),
    (r"\.(flac|mp3|m4a|aac|ogg|wav)", "Music"),
    (r"\.(iso|dmg|exe|msi|rar|zip|7z|deb|rpm)|(setup|install|crack|keygen)", "Software"),
    (r"game|gog|steam|epic", "Game"),
    (r"\.(pdf|epub|mobi)", "Books"),
    (r"\.(mkv|mp4|avi|mov|bluray|web-dl|bdrip|1080p|2160p|x265|x264)", "Movie"),
]


def script_signals(c: Column) -> dict[str, Column]:
    han, kana, hangul = c.rlike(HAN), c.rlike(KANA), c.rlike(HANGUL)
    return {"han": han, "kana": kana, "hangul": hangul, "chinese_proxy": han & ~kana & ~hangul}


def base_name(path: Column) -> Column:
    return F.trim(F.substring_index(path, "/", -1))


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def ascii_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def normal_path(c: Column) -> Column:
    """Forward slashes, no NUL, no outer spaces or slashes; '_' for nothing."""
    clean = F.regexp_replace(F.trim(F.replace(F.make_valid_utf8(c), F.lit("\\"), F.lit("/"))), r"^/+|/+$", "")
    return F.coalesce(F.nullif(F.replace(clean, F.lit("\0"), F.lit("")), F.lit("")), F.lit("_"))


def bounded(c: Column, most: int) -> Column:
    """At most most bytes of UTF-8, cut between characters: a character is kept if it ends within the bound."""
    clean = F.trim(F.replace(F.make_valid_utf8(c), F.lit("\0"), F.lit("")))
    raw = F.substring(clean.cast("binary"), 1, most)
    # A broken last character becomes one U+FFFD when made valid; a U+FFFD of the text's own stays.
    cut = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\x{FFFD}$", ""))
    return F.when(F.octet_length(clean) <= most, clean).otherwise(cut)


def extension_key(path: Column) -> Column:
    """Lower-case extension of at most 32 bytes, '(none)' without one."""
    ext = bounded(F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1), 32)
    return F.coalesce(F.nullif(ext, F.lit("")), F.lit("(none)"))


def padding_file(c: Column) -> Column:
    return c.startswith("_____padding_file_") & (F.length(c) > 10)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def join_path(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "/")


def fix_encoding(raw: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else GBK, which the JVM's own decode does not offer. Only the invalid bytes go to Python."""
    import pandas as pd

    def gbk(batch):
        return batch.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    gbk.__annotations__ = {"batch": pd.Series, "return": pd.Series}

    said = raw.cast("string")
    valid = F.is_valid_utf8(said)
    return F.when(valid, F.trim(said)).otherwise(F.trim(F.pandas_udf(gbk, "string")(F.when(~valid, raw))))


def human_size(c: Column, largest: str = "TB") -> Column:
    """Units of 1024 up to the largest, with one decimal; bytes without."""
    units = ["KB", "MB", "GB", "TB"]
    units = units[: units.index(largest) + 1]
    step = lambda k: F.concat(F.format_string("%.1f", F.round(c / float(1024**k), 1)), F.lit(f" {units[k - 1]}"))
    chain = F.when(c.isNull() | (c <= 0), "0 B").when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k in range(1, len(units)):
        chain = chain.when(c < 1024 ** (k + 1), step(k))
    return chain.otherwise(step(len(units)))


def relative_time(seconds: Column) -> Column:
    """An age in seconds in words."""
    age = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    chain = F.when(seconds < 0, "").when(seconds < 60, "just now").when(seconds < 3600, age(60, "m ago")).when(seconds < 86400, age(3600, "h ago"))
    return chain.when(seconds < 30 * 86400, age(86400, "d ago")).otherwise(age(30 * 86400, "mo ago"))


def category(name: Column) -> Column:
    low, chain = F.lower(name), None
    for pattern, label in CATEGORIES:
        chain = F.when(low.rlike(pattern), label) if chain is None else chain.when(low.rlike(pattern), label)
    return chain.otherwise("")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(c: Column, query: str) -> Column:
    """The escaped text with every case-insensitive match marked."""
    import re

    return F.regexp_replace(html_escape(c), "(?i)(" + re.sub(r"([^\w\s])", r"\\\1", query) + ")", "<mark>$1</mark>")


def magnet(info_hash: Column, name: Column | None = None) -> Column:
    link = F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash)
    return link if name is None else F.concat(link, F.lit("&dn="), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def parse_size(c: Column) -> Column:
    """'12.3MiB' as bytes."""
    units = F.create_map(*[F.lit(x) for k, u in enumerate(["B", "KiB", "MiB", "GiB", "TiB"]) for x in (u, float(1024**k))])
    number, unit = F.regexp_extract(c, r"^\s*([0-9.]+)\s*([KMGT]?i?B)\s*$", 1), F.regexp_extract(c, r"^\s*([0-9.]+)\s*([KMGT]?i?B)\s*$", 2)
    return F.when(number != "", (number.cast("double") * units[unit]).cast("long"))


def key_values(c: Column) -> Column:
    """'k=v ...' as a map of numbers; true and false are 1 and 0, other words are left out."""
    pairs = F.str_to_map(c, F.lit(" "), F.lit("="))
    value = lambda _, v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    return F.map_filter(F.transform_values(pairs, value), lambda _, v: v.isNotNull())


#: The icon of a file by its extension.
ICONS = {
    "mkv": "🎬", "mp4": "🎬", "avi": "🎬", "mov": "🎬", "flac": "🎵", "mp3": "🎵", "m4a": "🎵", "iso": "💿", "exe": "⚙️", "rar": "📦", "zip": "📦", "7z": "📦",
    "pdf": "📕", "epub": "📚", "jpg": "🖼️", "png": "🖼️", "txt": "📝", "srt": "💬", "sfv": "✅",
}


def file_icon(name: Column) -> Column:
    """The icon of what stands after the last dot; that of any file for an unknown extension or none."""
    known = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))), F.lit("📄"))


def set_path(options: Column, path: str, value: Column) -> Column:
    """A map of dotted paths to values with one path set: what lay below it goes, and a plain value above it gives way."""
    parts = path.split(".")
    above = [".".join(parts[:k]) for k in range(1, len(parts))]
    kept = F.map_filter(options, lambda k, _: (k != path) & ~k.startswith(path + ".") & ~k.isin(above))
    return F.map_concat(kept, F.create_map(F.lit(path), value))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def composite_key(*columns: Column) -> Column:
    """Parts as one key, with their lengths, so that different parts never make the same key."""
    told = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("/", *told)
