"""Each operator against brute force, on a supplied table and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("marlstone.llm")

from marlstone.llm import (  # noqa: E402
    chat_format, decontaminate, jaccard_join, language_model, license_scan, packing, quality_rules, queries, secret_scan, store, token_ids, token_store, warc,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, m int, spans int"
LONG = "gnu general public license " + "word " * 30_000 + "password=abcdef123"
AWKWARD = [
    (1, None, "en", "a", 0, "x", 1, 1), (2, "", None, None, 0, "x", 1, 1), (3, "one two", "en", "a", 7, None, None, None), (3, "one two", "en", "a", 7, None, None, None),
    (None, "A null id has a text with more than five words", "en", "a", 1, "x", 1, 1), (5, LONG, "en", "a", len(LONG), "x", 1, 1),
    (6, "\t\n  \r\n", "en", "b", 6, "x", 1, 1), (7, "a b c d e f g a b c d e", "de", "b", 1, "x", 1, 1), (8, "Key: AKIA" + "Z" * 20 + " é𝒳 api_key='short' token: " + "f" * 30, "en", "c", 1, "x", 1, 1),
    (9, "one two", "fr", "b", 7, "x", 1, 1), (10, "a\nb c\n\nb c\n x  　 y", "fr", "b", 7, "x", 1, 1),
]


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA)


def tables(spark):
    return [spark.read.parquet(f"{SF}/documents.parquet"), awkward(spark)]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return [w.decode() for w in t.encode().lower().split()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("k", [0, 1])
def test_secret_spans(spark, k):
    df, want = tables(spark)[k], []
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for doc, t in texts(df):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(x[1] for x in found)
        listed = ",".join(f"{('assign', 'access', 'hex')[x[1]]}:{x[0]}:{x[2]}" for x in sorted(found))
        want.append((doc, kinds[0], kinds[1], kinds[2], hashlib.sha256(listed.encode()).hexdigest()))
    got = secret_scan.secret_report(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    same(map(tuple, got.collect()), want)


def test_spans_of_all_kinds_and_what_is_masked(spark):
    """Dense texts against brute force: spans of every kind, overlaps, holders, copied and live ones, and the masked text."""
    rng = np.random.default_rng(9)
    parts = ["password=hunter2", "token: Bearer abcdefghijklmnopqrstuv", "api_key='example1'", "AKIA" + "B" * 18, "gh" + "p_" + "A1" * 20, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh123", "0123456789abcdef" * 2, "é𝒳", "plain words", "secret=" + "f" * 30, "\n", "bearer " + "x" * 24]
    rows = [(i, "".join(parts[k] + ("" if rng.random() < 0.2 else " ") for k in rng.integers(0, len(parts), rng.integers(0, 25))), ["en", "de", None][i % 3], ["a", "b", None][i // 3 % 3], 1, "x", 1, 1) for i in range(60)]
    found, holders = [], {}
    for _, t, lang, source, *_ in rows:
        own = []
        for kind, (_, pattern, group, least) in enumerate(secret_scan.KINDS):
            own += [(m.start(), kind, m.end(), m[group]) for m in re.finditer(pattern.replace("(?i:", "(?ai:"), t) if len(m[group]) >= least]
        found.append(sorted(own))
        for *_, v in own:
            holders.setdefault(v, set()).add((source, lang))
    owners = lambda v: len({s for s, _ in holders[v]})
    copied = {v for v in holders if owners(v) >= secret_scan.COPIED_OWNERS or len(holders[v]) >= secret_scan.COPIED_REPOS}
    assert copied and len(copied) < len(holders)
    names, want, masked = [k[0] for k in secret_scan.KINDS], [], {}
    for (d, t, *_), own in zip(rows, found):
        live = [x for x in own if x[3] not in copied]
        want.append((d, ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in own), len(live), len(own) - len(live), ",".join(f"{owners(v)}/{len(holders[v])}" for *_, v in own)))
        at, out = 0, ""
        for a, _, b, _ in live:
            out, at = (out + t[at:a] + "[secret]" if a >= at else out), max(at, b)
        masked[d] = out + t[at:]
    got = secret_scan.secret_report(awkward(spark, rows)).select("doc_id", "spans", "n_live", "n_copied", "holders")
    same(map(tuple, got.collect()), want)
    assert {r.doc_id: r.text for r in secret_scan.mask_live(awkward(spark, rows)).collect()} == masked


def test_a_text_of_many_spans_takes_little_time(spark):
    import time

    text = "".join(f"password=value{i}x " for i in range(20_000))
    rows = [(1, text, "en", "a", 1, "x", 1, 1)]
    began = time.time()
    r = secret_scan.secret_report(awkward(spark, rows)).first()
    assert r.n_assign == 20_000 and secret_scan.mask_live(awkward(spark, rows)).first().text == "[secret] " * 20_000
    assert time.time() - began < 40


def test_copied_examples_stay_and_live_secrets_go(spark):
    rows = [(i, f"password=example123 and token=live{i}abcdef", "en", f"s{i}", 1, "x", 1, 1) for i in range(4)]
    out = {r.doc_id: r.text for r in secret_scan.mask_live(awkward(spark, rows)).collect()}
    assert out == {i: "password=example123 and [secret]" for i in range(4)}
    report = secret_scan.secret_report(awkward(spark, rows)).collect()
    assert all(r.n_copied == 1 and r.n_live == 1 for r in report)


def test_many_repositories_of_one_owner_make_a_copied_example(spark):
    text = "password=example123 and token={}abcdef"
    rows = [(i, text.format(f"live{i}"), f"l{i}", "hot", 1, "x", 1, 1) for i in range(secret_scan.COPIED_REPOS)]
    rows += [(10 + i, "password=fewer12345", f"l{i}", f"s{i % 2}", 1, "x", 1, 1) for i in range(secret_scan.COPIED_REPOS - 1)]
    out = {r.doc_id: r.text for r in secret_scan.mask_live(awkward(spark, rows)).collect()}
    assert all(out[i] == "password=example123 and [secret]" for i in range(secret_scan.COPIED_REPOS))
    assert all(out[10 + i] == "[secret]" for i in range(secret_scan.COPIED_REPOS - 1))
    report = {r.doc_id: r for r in secret_scan.secret_report(awkward(spark, rows)).collect()}
    assert (report[0].n_copied, report[0].n_live, report[0].holders) == (1, 1, "1/4,1/1")
    assert (report[10].n_copied, report[10].n_live, report[10].holders) == (0, 1, "2/3")


@pytest.mark.parametrize("k", [0, 1, 2])
def test_language_model(spark, monkeypatch, k):
    if k == 2:  # many chunks
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", 3000)
    df = tables(spark)[k % 2]
    each = [(d, words(t) + [None], zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in texts(df)]
    c = Counter(w for _, ws, out in each if not out for w in ws)
    pairs = Counter(x for _, ws, out in each if not out for x in zip([0, *ws], ws))
    threes = Counter(x for _, ws, out in each if not out for x in zip([0, 0, *ws], [0, *ws], ws))
    n, v, starts = sum(c.values()), len(c), sum(not out for *_, out in each)
    want = {}
    for d, ws, out in each:
        p1 = [(c[w] + 1) / (n + v + 1) for w in ws]
        p2 = [(pairs[x] + 8 * p) / ((starts if x[0] == 0 else c[x[0]]) + 8) for x, p in zip(zip([0, *ws], ws), p1)]
        exact = [(threes[x] + 8 * p) / ((starts if x[1] == 0 else pairs[x[:2]]) + 8) for x, p in zip(zip([0, 0, *ws], [0, *ws], ws), p2)]
        want.setdefault(d, []).append((out, len(ws), sum(c[w] > 0 for w in ws), n, sum(map(math.log10, p1)), sum(map(math.log10, exact))))
    for r in language_model.score_documents(df).collect():
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4]) and abs(r.score - w[5]) <= 0.03 * w[1]


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 1 << 63), (1000, 1 << 64), (5000, 6000), (300, 300)):
        x = np.unique(rng.integers(0, top - 1, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        ef = language_model.EliasFano.build(x, top - 1 if top == 1 << 64 else top)
        assert (ef.find(x) == np.arange(len(x))).all()
        assert not len(x) or (ef.get(np.arange(len(x))) == x).all()
        other = np.setdiff1d(rng.integers(0, top - 1, 500, dtype=np.uint64), x)
        assert (ef.find(other) == -1).all()


@pytest.mark.parametrize("k", [0, 1])
def test_license_phrases(spark, k):
    df, want = tables(spark)[k], []
    lower = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
    for d, t in texts(df):
        w = re.findall(license_scan.WORD, t.translate(lower))
        hits = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want.append((d, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    got = license_scan.license_report(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(map(tuple, got.collect()), want)


def as_pattern(template):
    """A template as a regular expression over words that each end with a space."""
    out = []
    for mark, word in re.findall(r"<<(opt|end|var:\d+)>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)", template.lower()):
        out.append(re.escape(word) + " " if word else "(?:" if mark == "opt" else ")?" if mark == "end" else r"(?:[^ ]+ ){0,%s}" % mark[4:])
    return re.compile("".join(out))


def test_template_labels_and_scores_against_patterns():
    rng = np.random.default_rng(6)
    patterns = [(as_pattern(t), label) for t, label in license_scan.TEMPLATES]
    labels, made = {x for _, x in license_scan.TEMPLATES}, ["", "nothing at all", "licensed under the apache license version 2"]
    for t, _ in license_scan.TEMPLATES:  # each wording with regions left out or filled, and with a word changed
        for k in range(6):
            said = re.sub(r"<<var:(\d+)>>", lambda m: " ".join(f"w{i}" for i in range(int(rng.integers(0, int(m[1]) + 1)))), t)
            while "<<opt>>" in said:
                said = re.sub(r"<<opt>>((?:(?!<<opt>>|<<end>>).)*)<<end>>", lambda m: m[1] if rng.random() < 0.5 else "", said, flags=re.S)
            ws = re.findall(license_scan.WORD, said.lower())
            if k == 5:
                ws[int(rng.integers(len(ws)))] = "changed"
            made.append(" ".join(["before"] * int(rng.integers(3)) + ws + ["after"] * int(rng.integers(3))))
    found = set()
    for text in made:
        ws = text.split()
        more, covered = set(), 0
        for pattern, label in patterns:
            for i in range(len(ws)):
                tail = "".join(w + " " for w in ws[i:])
                if not pattern.match(tail):
                    continue
                j = next(j for j in range(len(ws), i - 1, -1) if pattern.fullmatch("".join(w + " " for w in ws[i:j])))
                if j > i:
                    more.add(label)
                    covered = max(covered, j - i)
        base = {label for phrase, label in license_scan.PHRASES if f" {phrase} " in f" {text} "}
        *_, got_base, got, score = license_scan.Scanner().scan(text.upper())
        assert got == ",".join(sorted(base | more)), text
        assert score == pytest.approx(0 if not base | more else 0.5 if not more else 0.5 + 0.5 * covered / len(ws))
        found |= more
    assert found == labels


def test_template_regions():
    a = license_scan.Automaton("x <<opt>>y <<end>>z <<var:2>> w")
    for yes in ("x z w", "x y z w", "x z q w", "x y z q r w"):
        assert a.accepts(yes.split(), 0) == len(yes.split())
    for no in ("x w", "x y w", "x z q r s w", "x y y z w", "y z w"):
        assert a.accepts(no.split(), 0) is None


def test_chat_layouts_give_the_same_turns(spark):
    import json

    turns = [("user", "hi <|end|> & [x]"), ("assistant", "yes")]
    layouts = [
        {"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": "human", "value": turns[0][1]}, {"from": "gpt", "value": "yes"}]},
        {"instruction": turns[0][1], "input": "", "output": "yes"}, {"prompt": turns[0][1], "completion": "yes"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in layouts] + [("{\"other\": 1}",), ("broken",), (None,)], "j string").select(chat_format.json_turns("j").alias("turns"))
    got = [r.turns for r in df.collect()]
    assert [[tuple(t) for t in x] for x in got[:4]] == [turns] * 4 and got[4:] == [None] * 3
    back = df.where("turns is not null").select(chat_format.formatted().alias("formatted")).select(chat_format.read_back().alias("b"), "formatted").collect()
    assert all([tuple(t) for t in r.b] == turns and r.formatted.count("<|end|>") == 2 for r in back)


def test_chat_tables_of_every_layout(spark):
    turns = [("user", "hi"), ("assistant", "yes")]
    said = {"messages": "array(struct('user' as role, 'hi' as content), struct('assistant' as role, 'yes' as content)) as messages", "prompt": "'hi' as prompt, 'yes' as completion",
            "conversations": "array(struct('human' as `from`, 'hi' as value, 1 as weight), struct('gpt' as `from`, 'yes' as value, 2 as weight)) as conversations", "bare_instruction": "'hi' as instruction, 'yes' as output",
            "instruction": "'hi' as instruction, cast(null as string) as input, 'yes' as output"}
    for name, sql in said.items():
        df = spark.sql(f"select 5L as conv_id, {sql}, 'x' as m, 1 as record, 2 as turns")
        assert chat_format.layout_of(df, "conv_id") == name
        assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in chat_format.canonical(df).collect()] == [(5, turns)]
    rows = spark.sql("select 5L as conv_id, 2 as turn, 'assistant' as role, 'yes' as text, 0 as at union all select 5L, 1, 'user', 'hi', 0")
    assert [[tuple(t) for t in r.turns] for r in chat_format.canonical(rows).collect()] == [turns]
    odd = spark.sql("select 5L as conv_id, array(struct('user' as `from`, 'hi' as value)) as messages")
    assert [tuple(r) for r in chat_format.canonical(odd).collect()] == [(5, None)]


def test_json_with_other_nested_fields_has_no_turns(spark):
    import json

    odd = [{"messages": [{"from": "user", "value": "x"}]}, {"messages": ["x"]}, {"messages": {"role": "user", "content": "x"}}, {"prompt": "x", "completion": "y", "messages": [{"role": "user", "content": "x"}]}, [1], "x", {}]
    fine = {"id": 7, "messages": [{"role": "user", "content": "[a]", "name": "n"}, {"role": None, "content": None}], "meta": {"k": [1]}}
    df = spark.createDataFrame([(json.dumps(x),) for x in [*odd, fine]], "j string").select(chat_format.json_turns("j").alias("turns"))
    got = [r.turns for r in df.collect()]
    assert got[:-1] == [None] * len(odd) and [tuple(t) for t in got[-1]] == [("user", "[a]"), ("", "")]


def test_chat_mask_covers_the_assistants_text(spark):
    rows = [(1, k, ["user", "assistant", "system", None][k % 4], f"<|end|> & turn [{k}] é𝒳" * (k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = chat_format.canonical(df).select(chat_format.formatted().alias("formatted"), chat_format.loss_mask().alias("mask"))
    r = made.select("formatted", "mask", chat_format.under_mask().alias("loss")).first()
    runs = [n for m in r["mask"] for n in (m.before, m.inside, m.after)]
    assert sum(runs) == len(r.formatted)
    at, inside = 0, []
    for k, n in enumerate(runs):
        inside += [r.formatted[at : at + n]] if k % 3 == 1 and n else []
        at += n
    plain = lambda x: x.replace("&lb;", "[").replace("&lt;", "<").replace("&amp;", "&")
    assert list(map(plain, inside)) == list(r.loss) == [t for _, k, role, t in rows if role == "assistant" and t]


def test_chat_awkward_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 5), (1, 1, "assistant", "a", 5), (1, 1, "assistant", "a", 5), (None, None, "user", "", None), (2, 1, "assistant", "<|says|>&lt;", 1)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.chat_report(rows).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\na\nassistant\na\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"<|says|>&lt;").hexdigest() and got[None].loss_chars == 0
    assert chat_format.chat_report(rows.limit(0)).count() == 0


def components(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    of = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    least = {}
    for (d, _), c in zip(docs, of):
        if d is not None and (c not in least or d < least[c]):
            least[c] = d
    return [(d, len(s), least.get(c)) for (d, _), s, c in zip(docs, sets, of)]


def near(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.integers(len(out))] = f"w{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("k", [0, 1, 2])
def test_jaccard_components(spark, k):
    if k < 2:
        df = tables(spark)[k]
    else:  # chains of near copies at the threshold, a shared passage, and one large group
        rng, rows = np.random.default_rng(5), []
        shared = [f"p{i}" for i in range(60)]
        for g in range(12):
            base = [f"g{g}x{i}" for i in range(100)] + shared
            for e in range(12):
                rows.append((len(rows), near(rng, base, e), "en", "a", 1, "x", 1, 1))
                base = base if e % 3 else near(rng, base, 3).split()
        df = awkward(spark, rows)
    same(map(tuple, jaccard_join.group_documents(df).select("doc_id", "n_shingles", "component_id").collect()), components(texts(df)))


@pytest.mark.parametrize("k", [0, 1, 2])
def test_every_link_is_counted(spark, k):
    if k < 2:
        df = tables(spark)[k]
    else:  # one large group of near copies, and some of them twice
        rng = np.random.default_rng(8)
        base = [f"x{i}" for i in range(200)]
        made = [near(rng, base, i % 9) for i in range(120)]
        df = awkward(spark, [(i, t, "en", "a", 1, "x", 1, 1) for i, t in enumerate(made + made[:30])])
    docs, sets = texts(df), []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    linked = lambda a, b: bool(a and b) and 4 * len(a & b) >= 3 * len(a | b)
    want = [(d, len(s), sum(linked(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(docs, sets))]
    same(map(tuple, jaccard_join.count_links(df).collect()), want)


@pytest.mark.parametrize("small", [False, True])
def test_large_groups_and_a_common_passage(spark, monkeypatch, small):
    """2,600 documents: one group of near copies below and above the threshold, hubs, copies, and a passage that all share."""
    if small:  # many chunks, cells and hot lists
        for name, n in {"CELL_NODES": 50, "LIST_NODES": 16, "CHUNK_SHINGLES": 9000, "CHUNK_NODES": 40, "PART_SHINGLES": 7000}.items():
            monkeypatch.setattr(jaccard_join, name, n)
    rng, made = np.random.default_rng(3), []
    base, passage = [f"x{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    made += [near(rng, base, i % 6) for i in range(700)]
    made += [near(rng, [f"h{g}x{i}" for i in range(100)], e % 4) for g in range(40) for e in range(12)]
    made += [" ".join([f"u{k}a{i}" for i in range(40)] + passage + [f"u{k}b{i}" for i in range(40)]) for k in range(800)]
    made += [" ".join(passage)] * 120 + [" ".join(passage + [f"t{k}"]) for k in range(200)] + made[:300]
    rng.shuffle(made)
    docs = [(i, t) for i, t in enumerate(made)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.group_documents(df).collect()}
    sets, where = [], {}
    for i, t in docs:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
        for x in sets[-1]:
            where.setdefault(x, []).append(i)
    root, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if j != i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert got == {i: (len(s), top(i), links[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("small", [False, True])
def test_links_between_clusters_make_no_row_a_pair(spark, monkeypatch, small):
    """Every node its own cluster, so that all links are found in lists: the rows follow the nodes, and no link is lost or counted twice."""
    if small:
        monkeypatch.setattr(jaccard_join, "LIST_NODES", 16)
    rng, rows = np.random.default_rng(11), []
    base = [f"x{i}" for i in range(300)]
    made = [near(rng, base, i % 7) for i in range(300)]
    docs = [(i, t) for i, t in enumerate(made + made[:40] + [f"alone{i} a b c d e" for i in range(20)])]
    spread = lambda f: lambda *a: rows.append(store.materialise(f(*a), "counted")) or rows[-1]
    monkeypatch.setattr(jaccard_join, "clusters", lambda live: store.materialise(live.select("node", F.col("node").alias("label")), "clusters"))
    monkeypatch.setattr(jaccard_join, "across_clusters", spread(jaccard_join.across_clusters))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.group_documents(df).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in docs]
    linked = [[4 * len(a & b) >= 3 * len(a | b) for b in sets] for a in sets]
    group = {d: c for d, _, c in components(docs)}
    assert got == {i: (group[i], sum(x) - 1) for i, x in enumerate(linked)}
    pairs = sum(map(sum, linked)) // 2
    assert pairs > 20_000 and (small or rows[0].count() < pairs // 10)


def test_keys_are_counted_by_ranges(monkeypatch):
    rng = np.random.default_rng(6)
    each = [np.sort(rng.integers(0, top, n).astype(np.uint64)) for n, top in ((1, 5), (400, 90), (3000, 1 << 48), (700, 300))] + [np.full(500, 7, np.uint64)]
    each[2][:200] = each[1][:200]
    each[2].sort()
    times = Counter(np.concatenate(each).tolist())
    for held in (1, 100, 1_000_000):
        monkeypatch.setattr(jaccard_join, "COUNT_KEYS", held)
        for x, got in zip(each, jaccard_join.times_of(each), strict=True):
            assert got.tolist() == jaccard_join._classes(np.array([times[k] for k in x.tolist()])).tolist()
    assert [len(x) for x in jaccard_join.times_of(each[:1])] == [1]


def test_lists_in_many_steps_find_each_link_once(monkeypatch):
    """The links of lists are the same however many pairs are held at a time; blocks of a split list meet across only."""
    rng = np.random.default_rng(2)
    common = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(common, 38, replace=False), rng.integers(0, 1 << 63, k % 8).astype(np.uint64)])) for k in range(60)]
    entries, files = [], {}
    for k, s in enumerate(sets):
        prefix = s[: len(s) - -(-3 * len(s) // 4) + 1]  # any order common to all will do
        files[0, 1000 * k] = s
        files[1, 1000 * k] = np.concatenate([np.array([0, 1000 * k], np.uint64), prefix])
        entries += [(t, p, len(s), 1 + k % 3, 1, 1000 * k, len(prefix), k, k) for p, t in enumerate(prefix)]
    e = np.array(entries, jaccard_join._POSTING)
    read = lambda file, start, n: files[file, start][:n]
    want = [[i != j and jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    total = lambda who: {i: n for i in range(60) if (n := sum(1 + j % 3 for j in who(i) if want[i][j]))}
    for held in (1, 3000, 10_000_000):
        monkeypatch.setattr(jaccard_join, "PAIR_SHINGLES", held)
        (out,) = jaccard_join._links_of(e, read)
        assert dict(zip(out["node"].to_pylist(), out["others"].to_pylist())) == total(lambda i: range(60))
        (out,) = jaccard_join._links_of(e, read, e["node"] % 2)
        assert dict(zip(out["node"].to_pylist(), out["others"].to_pylist())) == total(lambda i: range(1 - i % 2, 60, 2))
    assert set(out["root"].to_pylist()) == {0}


def test_equal_empty_rows_stay_and_names_may_clash(spark):
    rows = [(1, "", "a", "x"), (1, "", "a", "x"), (2, None, "b", "y"), (3, "a b c d e f", "c", "z"), (3, "a b c d e f", "c", "z"), (4, "a b c d e f", "d", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id string, label string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    same(map(tuple, kept.collect()), [rows[0], rows[1], rows[2], rows[3]])
    none = jaccard_join.keep_one(docs.limit(0))
    assert none.columns == docs.columns and none.count() == 0


def test_rows_that_go_are_told_by_their_file(spark, tmp_path):
    """Several files with the same rows in each; of all copies one row stays, wherever it is."""
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "", "z"), (4, "other words that stand for themselves", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for k in range(3):
        df.withColumn("doc_id", F.col("doc_id") + 10 * (2 - k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    kept = jaccard_join.keep_one(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.columns == df.columns
    same(map(tuple, kept.collect()), [(1, "a b c d e f g", "x"), (3, "", "z"), (13, "", "z"), (23, "", "z"), (4, rows[3][1], "w")])


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 1, 2, 3, 5, 6, 7, 8, 10]


def tokenised(t):
    from tokenizers import Tokenizer

    if not hasattr(tokenised, "t"):
        tokenised.t = Tokenizer.from_file(queries.tokenizer_path())
    return tokenised.t.encode(t, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("k", [0, 1])
def test_packing(spark, k):
    df = tables(spark)[k]
    rows = packing.pack_documents(df, queries.tokenizer_path()).collect()
    want = Counter()
    for d, t in texts(df):
        ids = tokenised(t) + [0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want.update((d, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 2048 * 1.02) + 1


@pytest.mark.parametrize("text", ["a b\tc\n", "a b\tc", "a\n\nb\u00a0c", "a \t b\tc", " a\tb", "a  b\u3000c d", "a\nb c", "x, y\nz."])
def test_ids_of_mixed_white_space(text):
    whole = np.array(tokenised(text), "<u4").tobytes()
    assert token_ids.encoder(queries.tokenizer_path()).encode([text, "a b", text]) == [whole, np.array(tokenised("a b"), "<u4").tobytes(), whole]


def test_ids_of_random_texts():
    """20,000 texts dense in white space of all kinds, marks, contractions and special tokens, against whole-text encoding."""
    rng = np.random.default_rng(11)
    some = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", "a", "b", "Zoé", "naïve", "é²", "中文", "e\u0301", "7", "42", "²", ".", ",", "'s",
            "'", "don't", "!?", "#x", "<|endoftext|>", "<|endoftext", "|>", "𝒳", "\u200b", "ß", "İ", "\u1c89"]
    enc = token_ids.Encoder(queries.tokenizer_path())
    made = ["".join(some[i] for i in rng.integers(0, len(some) if k % 2 else 25, rng.integers(1, 12))) for k in range(20_000)]
    for t, ids in zip(made, enc.encode(made)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenised(t), t


def test_pieces_of_two_generations(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE_PIECES", 5)
    enc = token_ids.Encoder(queries.tokenizer_path())
    made = [f"w{k % 7} common word number {k}" for k in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(made)] == [tokenised(t) for t in made]


def test_a_word_is_learnt_once_with_whatever_marks_follow():
    """distinct marked words were each tokenized, and each place in a text asked for its piece."""
    enc = token_ids.Encoder(queries.tokenizer_path())
    ends = ["", ",", ".", "***", "!!", ".###", "')", "''"]
    words = ["go", "größer", "ciónes", "x7", "don't", "naïve"]
    made = [f"go {w}{e} {v} {w}{e}" for e in ends for w in words for v in words] * 3
    learnt, learn = [], enc.pieces.learn
    enc.pieces.learn = lambda piece: learnt.append(piece) or learn(piece)
    got = enc.encode(made)
    assert sorted(learnt) == sorted([*words, "\rgo"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenised(t) for t in made]


@pytest.mark.parametrize("chars", [1, 40, 4_000_000])
def test_ids_of_texts_cut_together(monkeypatch, chars):
    """Marks after every kind of character, and texts of all kinds in a group, against whole-text encoding."""
    monkeypatch.setattr(token_ids, "CHARS_AT_ONCE", chars)
    monkeypatch.setattr(token_ids, "CACHE_PIECES", 500)
    rng = np.random.default_rng(13)
    some = ["a", "Zo", "é", "ß", "Ж", "Ա", "中", "𝒳", "e\u0301", "\u200b", "…", "²", "½", "7", "٣", "_", "'s", "'", "''", ",", ".", "***", "!" * 16, "-" * 17, "~", "|", "<", "\x7f", "\x00", "×", "ª"]
    gaps = [" "] * 40 + ["\n"] * 4 + ["  ", "\t", "\u00a0", "\r", "\n\n"]
    made = [None, "", " ", "\n", "\r", ".", "a", "a\n", " a", "\na"]
    for _ in range(3_000):
        words = ["".join(some[i] for i in rng.integers(0, len(some), rng.integers(1, 5))) for _ in range(rng.integers(1, 7))]
        made.append("".join(w + gaps[i] for w, i in zip(words, rng.integers(0, len(gaps), len(words))))[: None if rng.integers(3) == 0 else -1])
    enc = token_ids.Encoder(queries.tokenizer_path())
    for t, ids in zip(made, enc.encode(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenised(t or ""), t
    assert enc.encode([]) == [] and enc.encode([None, "a  b"])[0] == b""


@pytest.mark.parametrize("per_packer", [100_000, 8_000])
def test_packing_of_more_long_pieces_than_open_bins(spark, per_packer):
    rng = np.random.default_rng(11)
    long, short = rng.integers(1025, 2048, 8_000), rng.integers(1, 1025, 16_000)
    lengths = [int(x) for x in np.concatenate([long, short])]
    held = spark.createDataFrame([(d, 0, 0, n, d) for d, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(held, per_packer=per_packer).select("doc_id", "length", "sequence_id", "offset").collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(by) <= math.ceil(sum(lengths) / 2048) * 1.02


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert fit.place(3) == (0, 6)
    with pytest.raises(ValueError):
        fit.place(11)


@pytest.mark.parametrize("k", [0, 1])
def test_token_store(spark, k):
    df = tables(spark)[k]
    at, want = 0, []
    for d, t in sorted(texts(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = tokenised(t) + [2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    same(map(tuple, token_store.store_and_read(df, queries.tokenizer_path()).collect()), want)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    for n in (0, 1, 2, 7, 3000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        ix = token_store.Index(token_store.write_index(keys, np.arange(len(keys)), np.arange(len(keys)) * 3, np.arange(len(keys))))
        slots = ix.find(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        assert (ix.find(keys ^ np.uint64(1 << 40 | 7)) >= 0).sum() <= 1


def test_pages_and_oracle(spark):
    big, rows = "x" * 150, []
    rows = [(1, "http://a/", None, 3), (2, None, "", 3), (3, "http://b/?q=1\r\nX", big, 3), (4, "http://b/", big, 3), (4, "http://b/", big, 3), (None, "http://c", big, 3), (6, "bad[", "é" * 60, 3), (7, "u", "short", 3), (8, "u", "short", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = [tuple(r)[:5] for r in warc.archive_and_read(df).collect()]
    want = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        again = html == big and p != 3
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    same(got, want)
    assert warc.archive_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("fan_in", [512, 3])
def test_history_is_in_global_order(spark, monkeypatch, fan_in):
    """Many small runs, one hot URL, repeated captures; with a small fan-in runs are merged in two passes."""
    from marlstone.llm import store

    for name, n in {"BLOCK": 7, "PER_RANGE": 90, "FAN_IN": fan_in}.items():
        monkeypatch.setattr(warc, name, n)
    rng = np.random.default_rng(12)
    urls = ["http://hot.example/"] + [f"https://www{k % 3}.h{k % 9}.example/{k}?q={k}" for k in range(60)]
    rows = [(int(p), urls[0] if p % 3 == 0 else urls[int(rng.integers(len(urls)))], "x" * int(p % 5)) for p in rng.permutation(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(11)
    uri = store.new_dir(spark, "warc")
    directory = store.materialise(warc.write_archives(warc.roles(df), uri), "runs")
    assert directory.select("run").distinct().count() > 3
    got = sorted(warc.merge_runs(directory, uri).collect(), key=lambda r: (r.range, r.nth))
    assert [(r.urlkey, r.page_id) for r in got] == sorted((warc.url_key(u), p) for p, u, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.range, []).append(r.nth)
    assert all(x == list(range(len(x))) for x in by.values()) and len(by) > 2
    places = {r.page_id: r.place for r in warc.archive_and_read(df).collect()}
    assert [p for p, _ in sorted(places.items(), key=lambda x: x[1])] == [r.page_id for r in got]


def test_loser_tree_merges():
    rng = np.random.default_rng(2)
    for k in (0, 1, 2, 5, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)), 9), (2, None, 9), (3, "", 9), (4, "tiny item", 9)], "item_id long, text string, coverage int")
    q = [f"q{i}" for i in range(20)]
    rows = [
        (1, "x " + " ".join(q) + " y"), (2, " ".join(q[10:] + ["z"] + q[:10])), (3, " ".join(q[:6])), (4, "nothing to see here at all"), (5, None), (6, ""), (7, "a tiny item here"), (8, " ".join(w for x in q for w in (x, "z"))), (None, " ".join(q).upper()),
    ]
    df = awkward(spark, [(d, t, "en", "a", 1, "x", 1, 1) for d, t in rows])
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1): (1.0, 1), (2, 1): (1.0, 2), (7, 4): (1.0, 1), (None, 1): (1.0, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def tiled(item, doc, least):
    """Greedy string tiling by looking at every pair of places."""
    used_i, used_d, tiles, least = [0] * len(item), [0] * len(doc), [], min(least, len(item))
    while least:
        best, found = 0, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                best, found = (n, [(i, j)]) if n > best else (best, found + [(i, j)]) if n == best else (best, found)
        if best < least:
            break
        for i, j in found:
            if not any(used_i[i : i + best]) and not any(used_d[j : j + best]):
                tiles.append((i, j, best))
                used_i[i : i + best] = used_d[j : j + best] = [1] * best
    return tiles


def test_tiles_of_random_sequences():
    rng = np.random.default_rng(1)
    for _ in range(800):
        item, doc = (rng.integers(0, rng.integers(1, 5), rng.integers(0, n)) for n in (24, 40))
        least = int(rng.integers(1, 6))
        assert decontaminate.tile(item, doc, least) == tiled(item.tolist(), doc.tolist(), least)


def test_tiles_of_long_repeats_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    ones = decontaminate.tile(np.ones(1000), np.ones(20_000), 5)
    gaps = decontaminate.tile(np.ones(1000), np.where(np.arange(20_000) % 6 == 5, np.arange(20_000), 1), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ones == [(0, 0, 1000)] and len(gaps) == 200 and most < 20_000_000


def test_leaks_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = [(r.item_id, words(r.text or "")) for r in items.collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = []
    for d, t in texts(docs):
        w = words(t)
        for item, x in held:
            if grams(x) & grams(w):
                tiles = tiled(x, w, 5)
                if 2 * sum(n for *_, n in tiles) >= len(x):
                    want.append((d, item, sum(n for *_, n in tiles) / len(x), len(tiles), sum(n for *_, n in tiles)))
    assert all(len(x) >= 5 for _, x in held) and want
    same(map(tuple, decontaminate.leaks(docs, items).collect()), want)
    gone = {x[0] for x in want}
    same((r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()), [d for d, _ in texts(docs) if d not in gone])


@pytest.mark.parametrize("k", [0, 1])
def test_quality_counts(spark, k):
    df, want = tables(spark)[k], []
    for d, t in texts(df):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    got = quality_rules.quality_report(df)
    same(map(tuple, got.drop("kept").collect()), want)
    assert got.where("base_failed and kept").count() == 0


def test_quality_fences_of_each_group(spark):
    """Verdicts against exact quantiles, where sources differ in what is ordinary and groups are small and large."""
    rng, rows = np.random.default_rng(4), []
    for source, n, size, marks in [("a", 150, 4, 0.0), ("b", 60, 9, 0.3), ("c", 7, 5, 0.0), (None, 3, 5, 0.1)]:
        for k in range(n):
            ws = ["".join(rng.choice(list("abcdefghij"), max(1, int(rng.normal(size, 1))))) + ("#" if rng.random() < marks else "") for _ in range(int(rng.integers(10, 80)))]
            ws = ws + ["###"] * (k % 13) if k % 6 == 0 else [x * 3 for x in ws] if k % 17 == 0 else ws
            rows.append((len(rows), " ".join(ws) + "\n" + ("same line\n" * (k % 5) if k % 8 == 0 else ""), "en" if k % 3 else None, source, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = []
    for d, t, lang, source, _ in rows:
        w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        ratios = [len(re.findall(r"[#*$%&|<>]", t)) / len(w), (len(lines) - len(set(lines))) / len(lines), len(covered) / len(w), sum(map(len, w)) / len(w)]
        m.append((d, (lang, source), failed, ratios, len(w), len(lines)))

    def fences(some):
        q = lambda v, p: sorted(v)[max(1, math.ceil(p * len(v))) - 1]
        words, lines = q([x[4] for x in some], 0.5), q([x[5] for x in some], 0.5)
        out = []
        for k, event in enumerate([1 / words, 1 / lines, 10 / words, 0]):
            v = [x[3][k] for x in some]
            spread = max(q(v, 0.75) - q(v, 0.25), event)
            out += [q(v, 0.75) + 3 * spread, q(v, 0.25) - 3 * spread]
        return np.array(out)

    good = [x for x in m if not x[2]]
    want, verdicts = {}, {}
    for d, key, failed, ratios, _, _ in m:
        own, lang = [x for x in good if x[1] == key], [x for x in good if x[1][0] == key[0]]
        if key not in want and own:
            of_all = fences(good)
            of_lang = of_all + len(lang) / (len(lang) + 50) * (fences(lang) - of_all)
            want[key] = of_lang + len(own) / (len(own) + 50) * (fences(own) - of_lang)
        f = want.get(key)
        verdicts[d] = not failed and not (any(r > f[2 * k] for k, r in enumerate(ratios)) or ratios[3] < f[7])
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(df).collect()}
    assert got == verdicts and 10 <= sum(not v for v in verdicts.values()) < 150  # both verdicts occur
    assert max(abs(want["en", "a"][0] - want["en", "b"][0]), 0) > 0.05  # the sources' fences differ


def test_quality_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, "en", "a", 1, 2, 3, 4, 5)], "doc_id long, text string, lang string, source string, m long, doc long, f long, failed long, hi_mean_word long")
    assert [tuple(r) for r in quality_rules.filter_quality(df).collect()] == [(1, text, "en", "a", 1, 2, 3, 4, 5)]


def test_quality_verdicts_agree_with_labels(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.quality_report(df).join(labels, "doc_id").collect()
    assert not [r for r in judged if r.quality == 1 and not r.base_failed and not r.kept]
    assert [r for r in judged if r.quality == 0 and not r.kept]


def test_empty_tables(spark):
    none = awkward(spark, [])
    path = queries.tokenizer_path()
    for df in (
        secret_scan.secret_report(none), secret_scan.mask_live(none), language_model.score_documents(none), license_scan.license_report(none), jaccard_join.group_documents(none), packing.pack_documents(none, path),
        token_store.store_and_read(none, path), quality_rules.quality_report(none), quality_rules.filter_quality(none),
    ):
        assert df.count() == 0
