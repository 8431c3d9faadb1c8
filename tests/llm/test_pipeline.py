"""The pipeline on the smallest table, each stage held against what its input says."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from busvitals.llm.mixing import mix
from busvitals.llm.quality_rules import quality_rules
from busvitals.llm.suffix_dedup import repeated_passages
from busvitals.llm.tokens import ids

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {"raw": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    rows = {name: df.collect() for name, df in seen.items()}

    kept = {r.doc_id for r in quality_rules(seen["raw"]).where("kept").collect()}
    assert sorted(r.doc_id for r in rows["quality"]) == sorted(kept)

    # what went has a smaller near copy; what stayed has none that is clearly one
    left = {r.doc_id: shingles(r.text) for r in rows["near_duplicates"]}
    before = {r.doc_id: shingles(r.text) for r in rows["quality"]}
    alike = lambda a, b: len(a & b) / len(a | b)
    assert left.keys() <= before.keys()
    assert all(max(alike(s, before[j]) for j in before if j != i) >= 0.8 for i, s in before.items() if i not in left)
    assert all(alike(left[i], left[j]) < 0.8 for i in left for j in left if j < i)

    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeated_passages(seen["near_duplicates"]).collect()}
    for r in rows["repeated_passages"]:
        n, removed = cut[r.doc_id]
        assert n - removed - 6 <= len(r.text.encode()) <= n - removed and r.n_chars == len(r.text)

    copies = {r.doc_id: r.copies for r in mix(seen["repeated_passages"]).collect()}
    assert Counter(r.doc_id for r in rows["mixing"]) == Counter({i: c for i, c in copies.items() if c})

    encoder, want = ids(), Counter()
    for r in rows["mixing"]:
        want[r.doc_id] += len(encoder.exactly(r.text or "")) + 1
    got = Counter()
    for r in rows["packing"]:
        got[r.doc_id] += r.length
    assert got == want
    sizes = Counter()
    for r in rows["packing"]:
        sizes[r.sequence_id] += r.length
    assert all(n == 1024 for s, n in sizes.items() if s != max(sizes))


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_near_copies_keep_the_values_of_clashing_columns(spark):
    from busvitals.llm.simhash import one_of_each
    from tests.llm.tables import documents

    names = ["_r", "_k", "_h", "_id", "_hash", "kept_id", "kept_hash", "own_id", "own_hash", "place", "place_"]
    docs = documents(spark)
    docs = docs.drop(*[c for c in names if c in docs.columns]).selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(names)])
    out = one_of_each(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}
