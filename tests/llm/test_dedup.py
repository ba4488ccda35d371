import hashlib
import random
import re

import numpy as np
import pytest
from oracle import compare

from veilwright.llm import embeddings, exact, minhash, queries
from veilwright.llm.graph import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


EDGE = "id long, text string, source string, n long, h long, rep long"


def edge_rows():
    base = " ".join(f"w{i}" for i in range(60))
    return [
        (1, base, "s", 0, 0, 0), (2, base + " tail", "s", 0, 0, 0), (2, base + " tail", "s", 0, 0, 0), (3, None, None, None, None, None), (4, "", "s", 0, 0, 0),
        (5, " \n\t", "s", 0, 0, 0), (None, base, "s", 0, 0, 0), (6, "ein zwei", "s", 0, 0, 0), (7, "EIN\x0bzwei", "s", 0, 0, 0), (8, "x" * 300_000, "s", 0, 0, 0),
        (9, " ".join(f"v{i}" for i in range(40_000)), "s", 0, 0, 0), (10, "e\u00a0f g", "s", 0, 0, 0),
    ]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 1)], "src long, dst long")).collect()}
    assert got == components({n for e in links for n in e}, links)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_minhash(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, i == c) for i, c in components(ids, links).items()}


def test_minhash_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op10_minhash(spark, sf_dir).collect()}
    assert got == brute_minhash([(r["doc_id"], r["text"]) for r in docs.collect()], 4)


def test_minhash_across_components(spark):
    """Variants of one text whose similarities lie around the threshold."""
    rng = random.Random(3)
    rows = []
    for i in range(80):
        words = [f"w{k}" for k in range(90)]
        for k in rng.sample(range(90), rng.randint(0, 5)):
            words[k] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute_minhash(rows, 4)


def test_minhash_edge_rows(spark):
    got = minhash.near_duplicates(spark.createDataFrame(edge_rows(), EDGE), "id", words=4).collect()
    assert len(got) == len(edge_rows())
    by = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (57, 1, True) and by[2] == (58, 1, False) and by[3] == (0, 3, True) and by[5] == (0, 5, True)
    assert by[None] == (57, None, True) and by[7] == (1, 6, False) and by[10][0] == 1
    assert minhash.near_duplicates(spark.createDataFrame([], EDGE), "id").count() == 0


def test_exact_agrees_with_sql(spark, sf_dir):
    compare(spark, sf_dir, queries.op2_exact, exact.EXACT_SQL)


def test_exact_edge_rows(spark):
    rows = [*edge_rows(), (11, "a b", "s", 0, 0, 0), (12, "a  b", "s", 0, 0, 0), (13, "ab", "s", 0, 0, 0)]
    for hash_all in (False, True):
        got = exact.exact_duplicates(spark.createDataFrame(rows, EDGE), "id", hash_all=hash_all).collect()
        assert len(got) == len(rows)
        by = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got}
        assert by[11] == by[13][:2] + (False,) == (12, 3, False) and by[12] == (12, 3, True)
        assert by[3] == (5, 3, False) and by[5] == (5, 3, True) and by[2] == (2, 2, True) and by[None] == (1, 2, False) and by[6] == (6, 1, True)
    digest = {r["id"]: r["text_sha256"] for r in got}
    assert digest[4] == hashlib.sha256(b"").hexdigest() and digest[11] == hashlib.sha256(b"ab").hexdigest()
    assert exact.exact_duplicates(spark.createDataFrame([], EDGE), "id").count() == 0
    kept = exact.drop_exact_duplicates(spark.createDataFrame(rows, EDGE), "id")
    assert kept.columns == [c.split()[0] for c in EDGE.split(", ")]
    assert sorted(r["id"] for r in kept.where("id is not null").collect()) == sorted({i for i, v in by.items() if i is not None and v[2]})


def brute_vectors(rows, threshold):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float)
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold]
    all_ids = [i for i, _ in rows if i is not None]
    return {i: (sum(i in e for e in links), c, i == c) for i, c in components(all_ids, links).items()}


def test_embeddings_equal_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_embeddings(spark, sf_dir).collect()}
    assert got == brute_vectors(rows, 0.95)


def test_embeddings_edge_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.35])]) for i in range(60)]
    rows += [(70, None), (71, [0.0] * 16), (72, [float("nan")] * 16), (73, [None] * 16), (74, []), (75, rows[0][1]), (76, rows[0][1]), (77, [1.0, 2.0]), (78, [2.0, 4.0]), (79, [1e30] * 16), (80, [1e-30] * 16), (81, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, copies int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got == brute_vectors(rows, 0.95)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    null = embeddings.near_vectors(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>")).first()
    assert (null["n_links"], null["component_id"], null["kept"]) == (0, None, True)
    with pytest.raises(ValueError):
        embeddings.plan(10, 2.0)


def test_an_id_with_two_texts_loses_and_joins_nothing(spark):
    texts = [(1, "alpha beta"), (1, "only copy of this"), (2, "alpha beta"), (None, "no id"), (None, "no id"), (None, "no  id too")]
    kept = exact.drop_exact_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "no  id too"), (0, "no id"), (1, "alpha beta"), (1, "only copy of this")]
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (1, other), (3, other + " tail"), (4, base + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, words=4).collect()}
    assert got == {(1, 57, 1), (3, 58, 1), (4, 58, 1)}
    left = minhash.drop_near_duplicates(df, words=4).collect()
    assert sorted(r["text"] for r in left) == sorted([base, other])
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    vectors = spark.createDataFrame([(1, x), (1, y), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    links = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(vectors).collect())
    assert links == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_buckets_of_several_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(12)
    rows = [(i, [float(x) for x in base + rng.standard_normal(12) * 0.25]) for i in range(120)]
    monkeypatch.setattr(embeddings, "TILE", 7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_vectors(rows, 0.95)
