import re

import corpus_pipeline
from test_dedup import brute_minhash
from test_text import check_packing

from veilwright.llm import quality, queries


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, now, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == columns and now.dtypes == docs.dtypes
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, queries.quality_model(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = {i: t for i, t in texts.items() if scores[i]}
    assert kept["quality_classifier"] == expected
    groups = {}
    for i, t in expected.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    expected = {i: expected[i] for i in (min(g)[1] for g in groups.values())}
    assert kept["exact_dedup"] == expected
    found = brute_minhash(list(expected.items()), 5)
    expected = {i: t for i, t in expected.items() if found[i][2]}
    assert kept["minhash_near_dedup"] == expected
    expected = {i: re.sub(r'(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t) for i, t in expected.items()}
    assert kept["secret_scans"] == expected
    rows = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    check_packing(rows, list(expected.items()))


def test_stages_take_odd_rows(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h long"
    rows = [(1, None, None, None, None, True, 1), (2, "", "en", "s", 0, True, 1), (3, "a b c", "en", "s", 5, True, 1), (3, "a b c", "en", "s", 5, True, 1), (4, "abc", "en", "s", 3, False, 2), (None, "x", "en", "s", 1, None, None), (5, "w " * 50_000, "en", "s", 100_000, True, 1)]
    spark.createDataFrame([(3, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for made in (rows, []):
        now = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "best_fit_packing":
                assert now.columns == [c.split()[0] for c in schema.split(", ")]
                now = spark.createDataFrame(now.collect(), schema)
        assert (now.count() > 0) == bool(made)
