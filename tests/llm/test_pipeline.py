import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("marlstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from marlstone.llm import quality_rules, secret_scan, store  # noqa: E402

from .test_contracts import components, crc, texts, tiled, tokenised, words  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns_and_its_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and after
        if k < 3:
            assert all(before[d] == t for d, t in after.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)


def test_run_gives_what_brute_force_gives_stage_by_stage(spark, tmp_path):
    """Each stage's own decision anew in plain Python, on what the plain stages before it kept. Some texts get secrets."""
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" password=live"), "doc_id", F.lit(" end"))).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("api_key=example1 "), "text"))
    docs.withColumn("text", F.coalesce(said, "text")).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_report(docs).collect() if r.kept}  # held to exact quantiles in its own tests
    rows = [(d, t) for d, t in texts(docs) if d in kept]
    own = {d: c for d, _, c in components(rows)}
    rows = [(d, t) for d, t in rows if own[d] == d]
    items = [words(t) for _, t in [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    leaks = lambda w: any(grams(x) & grams(w) and 2 * sum(n for *_, n in tiled(x, w, 5)) >= len(x) for x in items)
    rows = [(d, t) for d, t in rows if not leaks(words(t))]
    of = {r.doc_id: (r.source, r.lang) for r in docs.select("doc_id", "source", "lang").collect()}
    found, holders = {}, {}
    for d, t in rows:
        found[d] = sorted((m.start(), k, m.end(), m[g]) for k, (_, p, g, least) in enumerate(secret_scan.KINDS) for m in re.finditer(p.replace("(?i:", "(?ai:"), t) if len(m[g]) >= least)
        for *_, v in found[d]:
            holders.setdefault(v, set()).add(of[d])
    copied = {v for v, h in holders.items() if len({s for s, _ in h}) >= secret_scan.COPIED_OWNERS or len(h) >= secret_scan.COPIED_REPOS}
    want = Counter()
    for d, t in rows:
        at, out = 0, ""
        for a, _, b, v in found[d]:
            if v not in copied:
                out, at = (out + t[at:a] + "[secret]" if a >= at else out), max(at, b)
        ids = tokenised(out + t[at:]) + [0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want.update((d, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert any(found.values()) and copied and len(copied) < len(holders) and len(rows) < len(kept)
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_empty_documents_run_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_tables_go_with_their_scope(spark):
    import os

    store.enter_scope("stage-x", spark.range(1))
    t = store.materialise(spark.range(3), "kept")
    gone, path = store.new_dir(spark, "gone"), t.inputFiles()[0].split("://")[-1]
    os.makedirs(gone.split("://")[-1])
    store.release(spark, t, scope="stage-x")
    assert not os.path.exists(gone.split("://")[-1]) and t.count() == 3
    store.release(spark, scope="stage-x")
    store.leave_scope()
    assert not os.path.exists(path)
