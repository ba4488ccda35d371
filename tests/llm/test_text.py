import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from veilwright.llm import bpe, chat, lexicon, packing, quality, queries, secrets, urls

tokenizers = pytest.importorskip("tokenizers")
ODD = [None, "", " ", "\n\n a  b\t", "it's I'LL 12,345.6", "<|endoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "Ünïcodé ⅷ x\u0301 Σας\u00a0ß\u2003y", "\x1c\x1d a\x85b", "emoji 👩‍👩‍👧 é", "z" * 5000, "don't!!! ###token = \"ab12\"###"]
EDGE = "doc_id long, text string, source string, lang string, label int, score double, h long, n long, ids string"


def edge(spark):
    rows = [(i, t, "s", "en", 1, 0.5, 1, 1, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b", None, None, None, None, None, None, None)], EDGE)


def test_ids_are_decoded(spark):
    own = bpe.Coder(queries.BYTE_BPE)
    plain, other = own.merge(b"word")[0], own.merge(b"other")[0]
    own.tokens[plain] = own.tokens[other]
    assert own.code("a word")[1] != b"a word" or own.merge(b" word") != [plain]
    assert own.code("word")[1] == b"other"


def test_other_signs_and_digits_are_seen_whole():
    tokens = quality.ChunkTokens()
    assert tokens[b"!!!!!?"] != tokens[b"!!!!!!"] and tokens[b"123456789"] != tokens[b"1234567890"] and tokens[b"12"] == tokens[b"34"]


def test_lexicon():
    rng = random.Random(4)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 7))): [rng.randint(0, 9) for _ in range(rng.randint(0, 3))] for _ in range(500)}
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(lexicon.build(words.items()))
        f.flush()
        made = lexicon.Lexicon(f.name)
        assert made.words == len(words) and made.states < sum(map(len, words))
        assert all(made.get(w) == ids for w, ids in words.items())
        assert made.get(b"abcdabcdabcd") is None and made.get(b"x") is None


def reference(path):
    made = tokenizers.Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def check_bpe(rows, texts):
    made = reference(queries.BYTE_BPE)
    for r in rows:
        ids = made.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids), r["doc_id"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest(), r["doc_id"]


def test_bpe_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_bpe(queries.op8_bpe(spark, sf_dir).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    texts = dict(enumerate(ODD)) | {None: "a b"}
    rows = bpe.encode_decode(edge(spark), queries.BYTE_BPE).collect()
    check_bpe(rows, texts)
    assert len(rows) == len(ODD) + 2 and all(r["decoded"] == (texts[r["doc_id"]] or "") for r in rows)
    assert bpe.encode_decode(edge(spark).limit(0), queries.BYTE_BPE).count() == 0


def test_unseen_words_merge_exactly():
    made, own, rng = reference(queries.BYTE_BPE), bpe.Coder(queries.BYTE_BPE), random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("abcdefghé ß1!") for _ in range(rng.randint(1, 120)))
        assert own.encode(word) == made.encode(word, add_special_tokens=False).ids
        assert own.decode(own.encode(word)) == word


def check_packing(rows, texts, capacity=4096):
    made = reference(queries.WORD_BPE)
    expected = set()
    for key, text in texts:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected.add((key, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op9_packing(spark, sf_dir).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= sum(r["length"] for r in rows) / 4096 * 1.02 + 1
    odd = [*enumerate(ODD), (4, ODD[4]), (None, "a b")]
    rows = packing.pack_documents(edge(spark), queries.WORD_BPE).collect()
    assert len(rows) >= len(odd)
    check_packing(rows, odd)
    assert packing.pack_documents(edge(spark).limit(0), queries.WORD_BPE).count() == 0


def test_groups_pack_like_one(spark):
    texts = spark.range(900).selectExpr("id AS doc_id", "repeat('word ', CAST(1 + id * 7919 % 900 AS INT)) AS text")
    rows = packing.pack_documents(texts, queries.WORD_BPE, capacity=1024, group=150).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024 and len(used) <= sum(used.values()) / 1024 * 1.03 + 1


def test_two_replace_the_smallest():
    bins, _, fill = packing.best_two_fit([60, 30, 22, 17, 16], 100)
    assert fill[0] == 99 and bins[0] == bins[2] == bins[3]


def test_quality_held_out(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.op5_quality(spark, path).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    held = [(r["predicted"], r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([p == y for p, _, y in held]) >= 0.95
    good, bad = ([s for _, s, y in held if y == c] for c in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_quality_edge_rows(spark):
    docs = edge(spark)
    model = quality.fit(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))
    rows = quality.quality_scores(docs, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    single = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert all(r["predicted"] == 1 for r in quality.quality_scores(docs, single).collect())
    assert quality.quality_scores(docs.limit(0), model).count() == 0
    assert quality.drop_rejected(docs, single).count() == len(ODD) + 2 and quality.drop_rejected(docs, single).columns == docs.columns


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 8), [45 + (i % 2)]])) for i in range(80)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(80)])
    index, n = np.concatenate(rows), np.array([len(r) for r in rows])
    w, bias = quality.dual_coordinate_descent(index, n, y, np.ones(50), np.ones(80))
    assert (np.sign(quality.margins(w, bias, index, n)) == y).all()


def test_urls_agree_with_sql(spark, sf_dir):
    compare(spark, sf_dir, queries.op7_urls, urls.URLS_SQL)


def test_url_rules_and_reputation(spark):
    pages = [(i, f"http://bad.spam.org/{i}") for i in range(40)] + [(100 + i, f"http://h{i}.fine.org/") for i in range(40)]
    pages += [(200, "HTTP://WWW.Example.COM/en/x?q=/"), (201, "https://a.example.com/en/"), (202, "x://net/es/1"), (203, "x://a.net/de/"), (204, None), (205, "no scheme"), (206, "x://com"), (206, "x://com"), (None, "x://new.spam.org/"), (207, "")]
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i in [*range(40), *range(100, 140)]] + [(None, 1), (3, None)], "page_id long, bad int")
    df = spark.createDataFrame([(*p, "h", "r", True) for p in pages], "page_id long, url string, host string, rule string, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, outcomes, urls.RULES).collect()}
    assert got[5] == ("bad.spam.org", "/5", None, "block") and got[105] == ("h5.fine.org", "/", None, "allow")
    assert got[200] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[201][2:] == ("example.com/en/", "block")
    assert got[202][2:] == ("net/es/", "block") and got[203][2:] == (None, "allow") and got[204] == got[205] == got[207] == ("", "", None, "allow") and got[206] == ("com", "", None, "allow")
    assert urls.filter_urls(df, outcomes, urls.RULES).count() == len(pages)
    assert urls.filter_urls(df.limit(0), outcomes.limit(0), urls.RULES).count() == 0


def test_chat_agrees_with_sql(spark, sf_dir):
    compare(spark, sf_dir, queries.op3_preferences, chat.CHAT_SQL)


def test_chat_prefix_and_masks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "a"), (4, None, None, None), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "user", "q"), (6, 0, "user", "q")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, side int")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 8, 9), (None, 1, 2), (5, 1, None)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in chat.preference_pairs(turns, pairs).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one["n_prefix"], one["prompt"], one["chosen"], one["usable"]) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", True)
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["yes<|end|>"]
    assert got[2]["n_prefix"] == 0 and got[2]["rejected"] == "<||>\n<|end|>\n" and not got[2]["usable"]
    assert got[3]["n_prefix"] == 2 and got[3]["chosen"] == got[3]["rejected"] == "" and got[4]["prompt"] == ""
    assert chat.preference_pairs(turns.limit(0), pairs.limit(0)).count() == 0


def test_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = secrets.secret_findings(docs).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["candidate"] for r in found)
    import re

    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert planted and {(r["doc_id"], r["start"]) for r in found if r["secret"]} == planted
    out = secrets.redact_secrets(docs, secrets.secret_findings(docs))
    assert out.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(clean) == len(texts) and all(clean[i] == re.sub(r'(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t) for i, t in texts.items())


def test_secret_edge_rows(spark):
    hexa = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'a token = "{hexa}" b token = "{hexa[::-1]}"', None), (1, f'password: "{hexa}"', "s"), (2, None, "s"), (3, "", "s"), (4, f"é commit {hexa} ok", "s"), (5, "internationalization_of_everything_everywhere", "s"), (None, f'secret = "{hexa}"', "s"), (6, "y" * 200_000, "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, start int, h int")
    found = secrets.secret_findings(df).collect()
    assert sorted((r["doc_id"] or 0, r["start"]) for r in found if r["secret"]) == [(0, 10), (1, 11), (1, 11), (1, 64)]
    out = secrets.redact_secrets(df, secrets.secret_findings(df)).collect()
    assert len(out) == len(rows) and {r["text"] for r in out if r["doc_id"] == 1} == {'a token = "[SECRET]" b token = "[SECRET]"', 'password: "[SECRET]"'}
    assert secrets.secret_findings(df.limit(0)).count() == 0


def test_neighbours_of_candidates_hold_other_candidates(spark):
    runs = [hashlib.sha256(str(k).encode()).hexdigest()[: 16 + k] for k in range(9)]
    texts = [f"é AWS_SECRET_ACCESS_KEY={runs[8]}{runs[7]}", f'aws_secret_access_key = "{runs[8]}"', f"sha256-checksum-digest {runs[6]}", ";".join(runs), " ".join(f"{r}==" for r in runs) + "="]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.candidates(df).collect()
    assert len(rows) == 2 * 3 + 2 * len(runs)
    for r in rows:
        text = texts[r["id"]]
        assert r["candidate"] == text[r["start"] : r["end"]]
        assert r["before"] == text[max(r["start"] - secrets.AROUND, 0) : r["start"]] and r["after"] == text[r["end"] : r["end"] + secrets.AROUND]
    seen = {r["id"]: r for r in secrets.with_features(secrets.candidates(df), []).where("id < 3").orderBy("start").collect()}  # the last of each
    assert seen[0]["f_keyword"] == seen[0]["f_assigned"] == seen[1]["f_keyword"] == seen[1]["f_assigned"] == seen[2]["f_harmless"] == 1


def test_introduced_values_of_any_length_are_candidates(spark):
    values = {'password = "hunter2secret"': "hunter2secret", "see postgres://app:s3cr3tpw@db/main": "s3cr3tpw", "Authorization: Bearer aB3xY9kQ2z": "aB3xY9kQ2z", "api_key='p4$$ w0rd!x'": "p4$$ w0rd!x", "client_secret: q7#Lm!92z, next": "q7#Lm!92z"}
    plain = ["the password is required", "the bearer of news", "token = None", "a: b = c", "password: required"]
    df = spark.createDataFrame(list(enumerate([*values, *plain])), "doc_id long, text string")
    found = secrets.secret_findings(df)
    rows = found.collect()
    texts = [*values, *plain]
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["candidate"] for r in rows)
    assert {(r["doc_id"], r["candidate"]) for r in rows if r["secret"]} == set(enumerate(values.values()))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, found).collect()}
    assert clean == {i: t.replace(values[t], secrets.MARK) if t in values else t for i, t in enumerate(texts)}


def test_long_runs_of_letters_are_seen_whole():
    tokens = quality.ChunkTokens()
    assert tokens["語".encode() * 40 + "前".encode() * 30] != tokens["語".encode() * 40 + "後".encode() * 30]
    assert len(tokens["語".encode() * 70]) == 2 * len(tokens["語".encode() * 40]) == 8
    assert tokens[b"a" * 40 + b"b"] == tokens[b"a" * 40] + tokens[b"b"]


def test_owners_of_hosts(spark):
    expected = {
        "a.co.uk": ("co.uk", "a.co.uk"), "x.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1": ("[ip]", "10.0.0.1"), "9.9.0.1:80": ("[ip]", "9.9.0.1"), "[::1]:8080": ("[ip]", "[::1]"),
        "u:p@www.example.com:8080": ("com", "example.com"), "www.example.com": ("com", "example.com"), "localhost": ("localhost", "localhost"), "": ("", ""), "nco.uk": ("uk", "nco.uk"), "example.co": ("co", "example.co"),
    }
    df = spark.createDataFrame([(h,) for h in expected], "host string")
    assert {r["host"]: (r["suffix"], r["domain"]) for r in df.withColumns(dict(zip(("suffix", "domain"), urls.owner_of(df["host"])))).collect()} == expected
    pages = spark.createDataFrame([(i, "bad.co.uk") for i in range(40)] + [(i, "good.co.uk") for i in range(40, 80)] + [(80, "www.good.co.uk")], "id long, host string")
    rates = {r["host"]: r["rate"] for r in urls.reputation(pages, spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "id long, bad int")).collect()}
    assert rates["www.good.co.uk"] < 0.3


def test_many_secrets_in_one_text(spark):
    values = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(16_000)]
    text = "\n".join(f'token = "{v}"' for v in values)
    df = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    found = secrets.staged(secrets.secret_findings(df), "found")
    begun = time.time()
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, found).collect()}
    assert time.time() - begun < 15 and found.where("doc_id = 1 and secret").count() == 16_000
    assert out[1] == "\n".join([f'token = "{secrets.MARK}"'] * 16_000)


def test_forest_on_findings_it_has_not_seen(spark):
    words = "the of and to in that was his with for had you not are but from".split()
    rows = secrets.labelled_findings(spark, words)
    half = F.xxhash64("candidate", "before") % 2 == 0
    model = secrets.train(rows.where(half), words)
    score = secrets.scored(secrets.with_features(rows.where(~half), words), model)
    by_kind = {r["kind"]: (r["label"], r["hit"]) for r in score.groupBy("kind").agg(F.max("label").alias("label"), F.avg((F.col("score") >= secrets.CUT).cast("int")).alias("hit")).collect()}
    assert len(by_kind) == 20
    recall, alarms = [h for y, h in by_kind.values() if y], [h for y, h in by_kind.values() if not y]
    assert min(recall) >= 0.8 and np.mean(recall) >= 0.95 and max(alarms) <= 0.2 and np.mean(alarms) <= 0.05
