"""Chat formatting by schema fingerprint (DataFrame functions only).

The nested field paths of a record that any layout names are hashed; the hash selects a declarative
mapping that yields canonical turns (role, text). Tables are told by their schema, JSON records row by row by
their own paths; key and order columns of a table are no part of the fingerprint. A template writes the turns
as one text with a run-length loss mask, and can be read back.

Defined results: a null role or text is empty; turns of row layouts are ordered by the order column, null
first, then by role and text, so repeated rows give repeated turns; a record
of an unknown layout, or one that mixes the paths of two, raises no error and gives null turns; an empty table
gives an empty result; columns that no mapping names are ignored. All turns of
one conversation make one text, which is the only thing held per conversation.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout name: its field paths and what they mean. "each" turns every element of an array into a turn, by the fields for role
#: and text and other names of roles; "fixed" lists roles and the fields whose lines make the text; "row" is one turn a row.
LAYOUTS = {
    "turn_rows": (("role", "text"), ("row", "role", "text")),
    "messages": (("messages[].role", "messages[].content"), ("each", "messages", "role", "content", {})),
    "conversations": (("conversations[].from", "conversations[].value"), ("each", "conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "instruction": (("instruction", "input", "output"), ("fixed", [("user", ["instruction", "input"]), ("assistant", ["output"])])),
    "bare_instruction": (("instruction", "output"), ("fixed", [("user", ["instruction"]), ("assistant", ["output"])])),
    "prompt": (("prompt", "completion"), ("fixed", [("user", ["prompt"]), ("assistant", ["completion"])])),
}
_TURNS = "array<struct<role: string, text: string>>"


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _turns(mapping: tuple, record: str) -> str:
    """SQL for the turns that a mapping makes of a record: a struct that has the layout's fields."""
    kind, *told = mapping
    if kind == "row":
        role, text = told
        return f"array(struct({record}.{_tick(role)} as role, {record}.{_tick(text)} as text))"
    if kind == "each":
        top, role, text, names = told
        said = f"m.{_tick(role)}"
        named = f"case {said} {' '.join(f"when '{k}' then '{v}'" for k, v in names.items())} else {said} end" if names else said
        return f"transform({record}.{_tick(top)}, m -> struct({named} as role, m.{_tick(text)} as text))"
    lines = lambda fields: f"array_join(filter(array({', '.join(f'{record}.{_tick(x)}' for x in fields)}), (x, i) -> i = 0 or x <> ''), '\\n', '')"
    return "array(" + ", ".join(f"struct('{role}' as role, {lines(fields)} as text)" for role, fields in told[0]) + ")"


def _clean(turns: str) -> str:
    return f"transform({turns}, t -> struct(coalesce(t.role, '') as role, coalesce(t.text, '') as text))"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves; [] marks an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else [at]


_KNOWN = sorted({p for named, _ in LAYOUTS.values() for p in named})


def fingerprint(paths) -> str:
    """Hash of the sorted paths that any layout names; others do not matter."""
    return sha256("\n".join(sorted(set(paths) & set(_KNOWN))).encode()).hexdigest()


_BY_PRINT = {fingerprint(named): name for name, (named, _) in LAYOUTS.items()}


def layout_of(df: DataFrame, *apart: str) -> str | None:
    """The layout whose fingerprint df's schema has, the columns set apart left out."""
    return _BY_PRINT.get(fingerprint(field_paths(T.StructType([f for f in df.schema.fields if f.name not in apart]))))


def _json_print(variant: str) -> str:
    """SQL for the fingerprint of a JSON record, from its own nested paths."""
    keys = lambda x: f"coalesce(map_keys(try_variant_get({x}, '$', 'map<string, variant>')), array())"
    inner = f"array_distinct(flatten(transform(try_variant_get(e.value, '$', 'array<variant>'), x -> {keys('x')})))"
    paths = (
        "case when schema_of_variant(e.value) like 'ARRAY<OBJECT<%' "
        f"then transform({inner}, n -> concat(e.key, '[].', n)) "
        "when schema_of_variant(e.value) like 'ARRAY<%' then array(concat(e.key, '[]')) "
        f"when schema_of_variant(e.value) like 'OBJECT<%' then transform({keys('e.value')}, n -> concat(e.key, '.', n)) else array(e.key) end"
    )
    found = f"flatten(transform(map_entries(try_variant_get({variant}, '$', 'map<string, variant>')), e -> {paths}))"
    known = ", ".join(f"'{p}'" for p in _KNOWN)
    return f"sha2(array_join(array_sort(array_intersect({found}, array({known}))), '\n'), 256)"


def _json_schema(named: tuple) -> str:
    """DDL of the struct that holds a layout's paths, all leaves as text."""
    tops: dict[str, list[str]] = {}
    for p in named:
        top, _, leaf = p.partition("[].")
        tops.setdefault(top, []).extend([leaf] if leaf else [])
    kind = lambda leaves: f"array<struct<{', '.join(f'{_tick(x)}: string' for x in leaves)}>>" if leaves else "string"
    return ", ".join(f"{_tick(top)} {kind(leaves)}" for top, leaves in tops.items())


def json_turns(column: str) -> F.Column:
    """Canonical turns of JSON records of mixed layouts, each by the mapping that its fingerprint selects."""
    q, chain = _tick(column), f"cast(null as {_TURNS})"
    for named, mapping in LAYOUTS.values():
        record = f"element_at(transform(array(from_json({q}, '{_json_schema(named)}')), r -> {_clean(_turns(mapping, 'r'))}), 1)"
        chain = f"if(p = '{fingerprint(named)}', {record}, {chain})"
    return F.expr(f"if(try_parse_json({q}) is null, null, element_at(transform(array({_json_print(f'try_parse_json({q})')}), p -> {chain}), 1))")


def canonical(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, turns) of a table in any layout; the turns of a row layout are gathered by key, all others are a conversation a row."""
    name = layout_of(df, key, order)
    if name is None:
        return df.select(F.col(_tick(key)).alias(key), F.lit(None).cast(_TURNS).alias("turns"))
    named, mapping = LAYOUTS[name]
    tops = dict.fromkeys(p.partition("[]")[0] for p in named)
    record = F.struct(*[F.col(_tick(t)).alias(t) for t in tops]).alias("record")
    if mapping[0] != "row":
        return df.select(F.col(_tick(key)).alias(key), record).select(_tick(key), F.expr(_clean(_turns(mapping, "record"))).alias("turns"))
    held = df.select(F.col(_tick(key)).alias(key), F.col(_tick(order)).alias("at"), record)
    held = held.select(_tick(key), "at", F.expr(_clean(_turns(mapping, "record"))).alias("own"))
    gathered = held.groupBy(_tick(key)).agg(F.collect_list(F.struct("at", "own")).alias("all"))
    return gathered.select(_tick(key), F.expr("flatten(transform(sort_array(all), x -> x.own))").alias("turns"))


#: Template marks. A mark begins with "<|"; escaping leaves no "<" and no "[" in a text, so none can be in it.
OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"


def unescaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&lb;', '['), '&lt;', '<'), '&amp;', '&')"


def formatted(turns: str = "turns") -> F.Column:
    one = f"concat('{OPEN}', {escaped("coalesce(x.role, '')")}, '{SAYS}', {escaped("coalesce(x.text, '')")}, '{CLOSE}')"
    return F.expr(f"array_join(transform({turns}, x -> {one}), '')")


def loss_mask(turns: str = "turns") -> F.Column:
    """The loss mask as runs, one struct for each turn, in code points of the formatted text: so many outside the mask, so many
    inside (an assistant's text), so many outside again."""
    role, text = (f"cast(length({escaped(f"coalesce(x.{c}, '')")}) as bigint)" for c in ("role", "text"))
    head, tail, said = len(OPEN + SAYS), len(CLOSE), "x.role <=> 'assistant'"
    return F.expr(f"transform({turns}, x -> struct({head} + {role} + if({said}, 0, {text}) as before, if({said}, {text}, 0) as inside, {tail} as after))")


def under_mask(text: str = "formatted", mask: str = "mask") -> F.Column:
    """The parts of a formatted text inside its mask, unescaped, in order. Turns end at CLOSE marks, so no run is counted from the
    text's begin and the work is linear."""
    parts = f"split({text}, '<\\\\|end\\\\|>', -1)"
    return F.expr(f"filter(zip_with({mask}, slice({parts}, 1, size({mask})), (m, p) -> if(m.inside > 0, {unescaped('substr(p, cast(m.before + 1 as int), cast(m.inside as int))')}, null)), x -> x is not null)")


def read_back(text: str = "formatted") -> F.Column:
    """The turns of a formatted text."""
    parts = f"array_remove(split({text}, '<\\\\|end\\\\|>', -1), '')"
    role = unescaped(f"substring_index(substr(p, {len(OPEN) + 1}), '{SAYS}', 1)")
    said = unescaped(f"substr(p, instr(p, '{SAYS}') + {len(SAYS)})")
    return F.expr(f"transform({parts}, p -> struct({role} as role, {said} as text))")


def chat_report(rows: DataFrame) -> DataFrame:
    """Format every conversation and give digests of what reading the output back yields."""
    made = canonical(rows).select("conv_id", formatted().alias("formatted"), loss_mask().alias("mask"))
    read = made.select("conv_id", "formatted", read_back().alias("back"), F.array_join(under_mask(), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(back, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
