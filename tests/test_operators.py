import pytest
from pyspark.sql import functions as F

from veilwright.config import ScanConfig, parse_scan_and_transform, parse_transform
from veilwright.errors import PrivacyError
from veilwright.kernels import markers
from veilwright.operators import algebra, evaluate, models, scan, structured, tokens
from veilwright.plans import catalog
from veilwright.sources import io
from veilwright.streaming import restore as streaming
from veilwright.workspace import aliases as ws
from veilwright.workspace import history, policy

REDACT = {"default": {"strategy": "redact"}}


def frame(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_protect_null_empty_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "mail ann@example.com"), (4, "x" * 500_000 + " 10.0.0.1")]
    out = {r["id"]: r for r in scan.protect(frame(spark, rows), parse_scan_and_transform({"transform": REDACT})).collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[3]["text"] == "mail [EMAIL]" and out[4]["text"].endswith(" [IP_ADDRESS]")
    assert [len(out[i]["transformations"]) for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert scan.findings(frame(spark, []), "id").count() == 0


def test_prefilter_never_drops_a_finding(spark):
    text = "call ٢٠٢5550143 or 202-555-0143"
    rows = frame(spark, [(1, text), (2, "Authorization: Bearer abc"), (3, "plain words")])
    assert {r["id"] for r in scan.findings(rows, "id").collect()} == {1, 2}


def test_conflicts_are_quarantined(spark):
    finding = lambda s, e, label: (label, "abcdef"[s:e], s, e, None, None, None, "t", "1")
    rows = spark.createDataFrame([(1, "abcdef", [finding(0, 3, "A"), finding(2, 5, "B")]), (2, "abcdef", [finding(0, 3, "A")]), (3, "abcdef", None)], "id long, text string, findings array<struct<entity_type:string,matched_text:string,start:long,end:long,byte_start:long,byte_end:long,confidence:float,detector_name:string,detector_version:string>>")
    out = {r["id"]: r for r in scan.transform(rows, parse_transform(REDACT), on_error="quarantine").collect()}
    assert out[1]["error"]["code"] == "review_conflict" and out[1]["text"] is None and out[2]["text"] == "[A]def" and out[3]["text"] == "abcdef"


def test_tokens_are_idempotent_and_scoped(spark):
    config = parse_scan_and_transform({"transform": {"default": {"strategy": "tokenize", "token_ref": "v"}}})
    rows = frame(spark, [(1, "a@b.co a@b.co"), (2, "none"), (3, None), (4, "DFTOKENv broken a@b.co")])
    made = [tokens.tokenize(rows, config, "s", b"k", on_error="quarantine").select("id", "text", "error.code", "issued") for _ in range(2)]
    first, second = ({r["id"]: r for r in df.collect()} for df in made)
    assert {i: r["text"] for i, r in first.items()} == {i: r["text"] for i, r in second.items()}
    assert first[4]["code"] == "invalid_token" and first[2]["text"] == "none"
    vault = tokens.vault_rows(made[0], "s")
    assert vault.count() == 1
    back = {r["id"]: r["text"] for r in tokens.restore(made[0].where("id < 4").select("id", "text"), vault, "s", "id").collect()}
    assert back == {1: "a@b.co a@b.co", 2: "none", 3: None}
    other = tokens.restore(made[0].where("id = 1").select("id", "text"), vault, "other", "id", on_error="quarantine").first()
    assert other["text"] is None and other["error"]["code"] == "token_not_found"
    with pytest.raises(PrivacyError):
        tokens.restore(rows, vault, " ", "id")


def test_session_resolves_keys_first(spark):
    config = parse_scan_and_transform({"transform": {"default": {"strategy": "pseudonymize", "key_ref": "k"}}})
    with pytest.raises(PrivacyError) as error:
        tokens.PrivacySession().scan_and_transform(frame(spark, []), config)
    assert error.value.code == "key_provider_required"
    with pytest.raises(PrivacyError) as error:
        tokens.PrivacySession(lambda ref, version: ("1", b"short")).scan_and_transform(frame(spark, []), config)
    assert error.value.code == "invalid_key_material"


def test_structured_restore(spark):
    config = parse_transform({"default": {"strategy": "redact"}})
    rows = frame(spark, [(1, '{"surname":"Lee","n":1.5,"x":[null,true,"a@b.co"]}'), (2, "[1"), (3, None)])
    out = {r["id"]: r for r in structured.protect(rows, "text", config, on_error="quarantine").collect()}
    assert out[1]["text"] == '{"surname":"[PERSON]","n":1.5,"x":[null,true,"[EMAIL]"]}' and out[2]["error"]["code"] and out[3]["text"] is None


def test_aliases_keep_codes_and_counters(spark):
    none = frame(spark, [], ws.ALIAS_SCHEMA)
    found = frame(spark, [("P", "Ann  Lee", 1, 0), ("P", "ann lee", 2, 0), ("P", "Bob", 1, 9), ("Q", "Bob", 3, 0), ("P", " ", 4, 0)], "entity_type string, matched_text string, id long, start long")
    first = ws.issue(found, none, b"\1" * 16, b"\0" * 16, ["id", "start"])
    rows = {(r["entity_type"], r["identity"]): r for r in first.collect()}
    assert {k: r["counter"] for k, r in rows.items()} == {("P", "ann lee"): 1, ("P", "bob"): 2, ("Q", "bob"): 1}
    assert rows["P", "ann lee"]["display"] == "Ann  Lee" and rows["P", "bob"]["code"] == markers.code(b"\1" * 16, b"\0" * 16, "P", 2, 0)
    more = ws.issue(found.union(frame(spark, [("P", "Cy", 9, 0)], found.schema)), first, b"\1" * 16, b"\2" * 16, ["id", "start"]).collect()
    assert [(r["identity"], r["counter"]) for r in more] == [("cy", 3)]


def test_taken_codes_are_drawn_again(spark):
    taken = markers.code(b"\1" * 16, b"\0" * 16, "P", 1, 0)
    found = frame(spark, [("P", "Ann", 1, 0)], "entity_type string, matched_text string, id long, start long")
    retired = frame(spark, [(taken, "P")], ws.RETIRED_SCHEMA)
    row = ws.issue(found, frame(spark, [], ws.ALIAS_SCHEMA), b"\1" * 16, b"\0" * 16, ["id", "start"], retired).first()
    assert row["code"] == markers.code(b"\1" * 16, b"\0" * 16, "P", 1, 1)


def test_recall_matches_words_only(spark):
    known = frame(spark, [("P", "ann lee", "Ann Lee", "000000", 1), ("Q", "lee", "Lee", "000001", 1)], ws.ALIAS_SCHEMA)
    rows = frame(spark, [(1, "ANN\n lee, Leeds, [[LEE_000000]] lee_"), (2, None)])
    got = {(r["entity_type"], r["start"], r["end"]) for r in ws.recall(rows, known, "id").collect()}
    assert got == {("P", 0, 8), ("Q", 5, 8)}


def test_versions_compare_and_swap(spark, tmp_path):
    versions = history.Versions(spark, f"file://{tmp_path}/v")
    assert versions.head() is None
    table = frame(spark, [("P", "a", "A", "000000", 1)], ws.ALIAS_SCHEMA)
    first = versions.commit({"aliases": table}, None)
    assert versions.head()["commit_id"] == first["commit_id"] and versions.read("aliases", ws.ALIAS_SCHEMA).count() == 1
    with pytest.raises(PrivacyError):
        versions.commit({"aliases": table}, None)
    assert versions.commit({"aliases": table}, first)["revision"] == 2


def test_operations_limits(spark):
    rows = frame(spark, [("a", "k", -1, None, 1, 1, "ok")], history.OPERATION_SCHEMA)
    with pytest.raises(PrivacyError):
        history.append_operations(rows.limit(0), rows)
    assert history.append_operations(rows.limit(0), rows.withColumn("at_ms", F.lit(1).cast("long"))).count() == 1


def test_pending_conversations_block(spark):
    rows = frame(spark, [("c", "1", "pending", "m", 0), ("c", "1", "observed_sent", "m", 1), ("d", "1", "pending", "n", 0)], history.INTENT_SCHEMA)
    assert [r[0] for r in history.blocked_conversations(rows).collect()] == ["d"]
    assert [tuple(r) for r in history.memberships(rows).collect()] == [("c", "m")]


def test_policy_edits(spark):
    rules = frame(spark, [("A", "keep"), ("B", "keep")], "entity_type string, rule string")
    edits = frame(spark, [("A", None), ("C", "hide")], "entity_type string, rule string")
    assert {tuple(r) for r in policy.edit(rules, edits, ["entity_type"], "rule").collect()} == {("B", "keep"), ("C", "hide")}


def test_islands_and_allowlists(spark):
    schema = "id long, entity_type string, start long, end long, matched_text string"
    rows = frame(spark, [(1, "A", 0, 3, "aaa"), (1, "B", 2, 6, "bbbb"), (1, "A", 6, 8, "cc"), (2, "A", 0, 1, "a")], schema)
    assert {(r["id"], r["start"], r["end"], r["entity_type"]) for r in algebra.islands(rows, "id").collect()} == {(1, 0, 6, "B"), (1, 6, 8, "A"), (2, 0, 1, "A")}
    allowed = frame(spark, [("A", "aaa"), ("B", "aaa")], "entity_type string, value string")
    assert algebra.without_allowed(rows, allowed).count() == 3 and algebra.without_matching(rows, "A", "[ac]+").count() == 1
    assert algebra.keep_entities(rows, ["B"]).count() == 1


def test_scores(spark):
    schema = "id long, label string, start long, end long"
    found = frame(spark, [(1, "A", 0, 4), (1, "A", 3, 9), (2, "A", 0, 2)], schema)
    gold = frame(spark, [(1, "A", 2, 4), (1, "A", 0, 3), (3, "B", 0, 1)], schema)
    rows = {r["label"]: r for r in evaluate.overlap_scores(found, gold, "id").collect()}
    assert (rows["A"]["tp"], rows["A"]["fp"], rows["A"]["fn"]) == (2, 1, 0) and rows["B"]["fn"] == 1 and rows["B"]["precision"] is None
    exact = evaluate.exact_scores(found, gold, "id")
    assert {r["label"]: r["tp"] for r in exact.collect()} == {"A": 0, "B": 0}
    verdicts = evaluate.gate(exact, evaluate.overlap_scores(found, gold, "id")).where("label = 'A' and metric = 'recall'").first()
    assert verdicts["verdict"] == "fail"
    assert [evaluate.bench_gate(x, 100) for x in (89, 94, 100, 106)] == ["fail", "warn", "ok", "improved"]


def test_model_spans_are_checked():
    contract = models.ModelContract("m", {"n": "PERSON"}, "byte", {"n": 0.5})
    assert models.converted("é Ann", [("n", 3, 6, 0.9), ("n", 0, 2, 0.1)], contract) == [("PERSON", "Ann", 2, 5, 0.9)]
    for bad in [("x", 0, 1, None), ("n", 0, 1, 0.9), ("n", 0, 99, 0.9), ("n", 0, 2, 2.0)]:
        with pytest.raises(PrivacyError):
            models.converted("é Ann", [bad], contract)
    assert models.route(["PERSON", "EMAIL"], contract) == (["EMAIL"], ["PERSON"])


def test_sources_round_trip(spark, tmp_path):
    rows = frame(spark, [(1, 'a "quoted"\nline'), (2, "ü")])
    for fmt in ("parquet", "orc", "json"):
        rows.write.format(fmt).save(f"{tmp_path}/{fmt}")
        assert sorted(map(tuple, io.read_documents(spark, f"{tmp_path}/{fmt}", fmt, "id", "text").collect())) == [(1, 'a "quoted"\nline'), (2, "ü")]
    rows.write.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert {r["text"] for r in io.read_documents(spark, f"{tmp_path}/csv", "csv", "id", "text").collect()} == {'a "quoted"\nline', "ü"}
    io.write_findings(scan.findings(frame(spark, [(1, "a@b.co 10.0.0.1")]), "id", config=ScanConfig()), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").where("entity_type = 'EMAIL'").count() == 1


def test_any_number_of_retired_codes_is_told_from_unknown_ones(spark, sf_dir, tmp_path):
    from veilwright.streaming import restore as streaming
    from veilwright.plans.catalog import aliased

    one, two = aliased(spark, sf_dir)[0].select("entity_type", "code").limit(2).collect()
    retired = spark.createDataFrame([(f"X{i}", "ORG") for i in range(ws.MAX_ENTRIES)] + [(one["code"], one["entity_type"])], ws.RETIRED_SCHEMA).coalesce(1)
    texts = {k: f"to [[{x['entity_type']}_{x['code']}]]." for k, x in (("gone", one), ("never", two))} | {"plain": "to you."}
    spark.createDataFrame([(k, 0, t.encode(), True) for k, t in texts.items()], streaming.CHUNK_SCHEMA).write.parquet(f"{tmp_path}/in")
    out = streaming.progressive(io.stream_documents(spark, f"{tmp_path}/in", streaming.CHUNK_SCHEMA), spark.createDataFrame([], ws.ALIAS_SCHEMA), retired)
    io.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.schema(streaming.OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert out.columns == [c.split()[0] for c in streaming.OUTPUT.split(", ")]
    assert {r["response_id"]: (r["failure"], r["text"]) for r in rows} == {"gone": ("expired", None), "never": ("unknown", None), "plain": (None, "to you.")}


@pytest.fixture
def odd(spark, tmp_path):
    """Documents of which two share an id and two have no text."""
    rows = [(1, "a@mail1.example.com", "en", "s"), (1, "b@mail2.example.com c@mail1.example.com", "en", "s"), (2, None, "en", "s"), (3, "none", "de", "s"), (2, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_that_share_an_id_are_counted_apart(spark, odd):
    assert sorted(map(tuple, catalog.QUERIES["email_counts"](spark, odd).collect())) == [(1, 1), (1, 2)]


def test_texts_that_share_an_id_are_ranked_apart(spark, odd):
    assert list(map(tuple, catalog.QUERIES["top_documents"](spark, odd).collect())) == [(1, 2), (1, 1)]


def test_texts_that_are_missing_have_no_count_of_addresses(spark, odd):
    rows = [tuple(r) for r in catalog.QUERIES["redact_documents"](spark, odd).collect()]
    assert sorted(rows, key=str) == [(1, "[EMAIL] [EMAIL]", 2), (1, "[EMAIL]", 1), (2, None, None), (2, None, None), (3, "none", 0)]


def test_texts_that_are_missing_have_no_count_of_findings(spark, odd):
    rows = [tuple(r) for r in catalog.QUERIES["protect_documents"](spark, odd).collect()]
    assert sorted(rows, key=str) == [(1, "[EMAIL] [EMAIL]", 2), (1, "[EMAIL]", 1), (2, None, None), (2, None, None), (3, "none", 0)]


def test_any_number_of_aliases_is_restored_progressively(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "MAX_ENTRIES", 5)
    known, rows = catalog.aliased(spark, sf_dir)
    assert known.count() > 5
    catalog.chunked(rows).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("never", 0, b"to [[ORG_000000]].", True)], streaming.CHUNK_SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    out = streaming.progressive(io.stream_documents(spark, f"{tmp_path}/in", streaming.CHUNK_SCHEMA), known)
    io.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    given = spark.read.schema(streaming.OUTPUT).parquet(f"{tmp_path}/out")
    assert [r["failure"] for r in given.where("response_id = 'never'").collect()] == ["unknown"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    whole = ws.restore_report(rows, known, "id")[0].select(F.col("id").cast("string").alias("response_id"), "text")
    joined = given.where("response_id <> 'never'").groupBy("response_id").agg(text.alias("text"))
    assert sorted(joined.collect()) == sorted(whole.collect())


def test_names_of_the_package():
    import veilwright

    assert all(getattr(veilwright, name) is not None for name in veilwright.__all__)
    with pytest.raises(AttributeError):
        _ = veilwright.nothing


def test_providers_that_answer_too_little(spark):
    class Short:  # sent to the workers by value
        def tokenize_batch(self, scope, items):
            return []

        def restore_batch(self, scope, items):
            return [None] * len(items)

    config = parse_scan_and_transform({"transform": {"default": {"strategy": "tokenize", "token_ref": "v"}}})
    rows = frame(spark, [(1, "a@b.co x@y.co"), (2, "none"), (3, None)])
    with pytest.raises(Exception, match="invalid_provider_response"):
        tokens.tokenize_with(rows, config, Short(), "s", "id").collect()
    items = tokens.required_tokenization_items(rows, config, "id").collect()
    assert [(r["id"], r["ord"], r["value"]) for r in items] == [(1, 0, "a@b.co"), (1, 1, "x@y.co")]
    results = spark.createDataFrame([(1, 0, "1", b"p")], "id long, ord int, version string, payload binary")
    out = {r["id"]: r for r in tokens.transform_with_provider_results(rows, config, results, "id", on_error="quarantine").collect()}
    assert out[1]["error"]["code"] == "invalid_provider_response" and out[2]["text"] == "none" and out[3]["text"] is None
    held = tokens.tokenize(rows, config, "s", b"k").select("id", "text")
    back = {r["id"]: r for r in tokens.restore_with(held, Short(), "s", "id", on_error="quarantine").collect()}
    assert back[1]["error"]["code"] == "token_not_found" and back[2]["text"] == "none" and back[3]["text"] is None


def test_restoring_texts_that_share_a_key(spark):
    aliases = spark.createDataFrame([("P", "ann", "Ann", "000000", 1)], ws.ALIAS_SCHEMA)
    texts = spark.createDataFrame([(1, "x [[P_000000]]"), (1, "[[P_000000]] yyy zzz"), (2, None), (2, "[[P_000001]]")], "id long, text string")
    restored, issues = ws.restore_report(texts, aliases, "id")
    assert sorted((r["id"], r["text"]) for r in restored.collect() if r["text"]) == [(1, "Ann yyy zzz"), (1, "x Ann")]
    assert [(r["id"], r["kind"]) for r in issues.collect()] == [(2, "unknown")]
    found = spark.createDataFrame([(1, 0, 1, "P", "ann")], "id long, start long, end long, entity_type string, matched_text string")
    with pytest.raises(Exception, match="repeated key"):
        ws.replace_with_aliases(texts, found, aliases, "id").collect()


def test_responses_that_are_not_utf8(spark):
    aliases = spark.createDataFrame([("P", "ann", "Ann", "000000", 1)], ws.ALIAS_SCHEMA)
    chunks = spark.createDataFrame([("a", 0, bytearray(b"\xff\xfe"), True), ("b", 0, bytearray(b"hi [[P_00"), False), ("b", 1, bytearray(b"0000]]"), True)], streaming.CHUNK_SCHEMA)
    restored, issues = streaming.buffered(chunks, aliases)
    assert {r["response_id"]: r["text"] for r in restored.collect()} == {"a": None, "b": "hi Ann"}
    assert [(r["response_id"], r["kind"]) for r in issues.collect()] == [("a", "invalid_encoding")]


def test_findings_of_json_by_path(spark):
    config = parse_transform({"default": {"strategy": "tokenize", "token_ref": "v"}})
    rows = frame(spark, [(1, '{"a":"x@y.co","b":["x@y.co","z"]}'), (2, "not json"), (3, None)])
    out = {r["id"]: r for r in structured.protect(rows, "text", config, on_error="quarantine", scope="s", token_key=b"k").collect()}
    assert len(out[1]["issued"]) == 1 and len(out[1]["transformations"]) == 2 and out[2]["error"] is not None and out[3]["text"] is None
    held = structured.protect(rows.where("id = 1"), "text", config, scope="s", token_key=b"k")
    back = structured.restore(held.select("id", "text"), tokens.vault_rows(held, "s"), "s", "id", "text").first()
    assert back["text"] == '{"a":"x@y.co","b":["x@y.co","z"]}'


def test_conversations(spark):
    sends = frame(spark, [("c", "1", "pending", "m", 0), ("c", "1", "observed_sent", "m", 1), ("d", "1", "pending", "n", 0), ("e", "1", "pending", None, 0), ("e", "1", "definitely_not_sent", None, 1)], history.INTENT_SCHEMA)
    known = frame(spark, [("c", "web", "s1"), ("d", "web", "s2"), ("e", "web", None), ("f", "web", "s1")], history.CONVERSATION_SCHEMA)
    assert {r[0]: tuple(r)[3:] for r in history.conversation_states(known, sends).collect()} == {"c": (0, 1), "d": (1, 0), "e": (0, 0), "f": (0, 0)}
    wanted = frame(spark, [("web", "s1"), ("web", "S2"), ("", "s1"), ("web", None)], "surface string, site_id string")
    assert {(r["surface"], r["site_id"]): (r["conversation_id"], r["error"]) for r in history.conversations_for_sites(wanted, known).collect()} == {
        ("web", "s1"): ("c", None), ("web", "S2"): (None, "conversation_unknown"), ("", "s1"): (None, "invalid_conversation"), ("web", None): (None, "invalid_conversation"),
    }
    assert [tuple(r) for r in history.open_conversation(known, sends, "c").collect()] == [("c", "m")]
    for name, code in (("d", "conversation_pending"), ("e", "conversation_unknown"), ("g", "conversation_unknown")):
        with pytest.raises(PrivacyError) as error:
            history.open_conversation(known, sends, name)
        assert error.value.code == code
    assert history.conversation_states(known.limit(0), sends).count() == 0


def test_a_new_head_ends_a_stream(spark, tmp_path):
    versions = history.Versions(spark, f"file://{tmp_path}/versions")
    known = spark.createDataFrame([("P", "ann", "Ånn 𝒳", "000000", 1)], ws.ALIAS_SCHEMA)
    head = versions.commit({"aliases": known}, None)
    pieces = lambda key: spark.createDataFrame([(key, 0, bytearray(b"hi [[P_00"), False), (key, 1, bytearray(b"0000]]"), True)], streaming.CHUNK_SCHEMA)
    stream = lambda: streaming.progressive(io.stream_documents(spark, f"{tmp_path}/in", streaming.CHUNK_SCHEMA), versions.read("aliases", ws.ALIAS_SCHEMA, head))
    run = lambda: streaming.deliver(stream(), versions, head, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    pieces("a").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("response_id", "seq").collect()
    assert [(r["text"], r["n_markers"], r["n_bytes"], r["n_code_points"], r["n_utf16"]) for r in rows] == [("hi ", 0, 3, 3, 3), ("Ånn 𝒳", 1, 9, 5, 6)]
    versions.commit({"aliases": known}, head)
    pieces("b").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="workspace_conflict|another version was committed"):
        run()
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("response_id").collect()} == {"a"}


def test_taggers_see_long_texts_in_windows():
    texts = ["", "  ", "Ann " * 700, "x " * 300 + "Ann."]
    words = lambda t: [(i, i + len(w)) for i, w in _starts(t)]
    seen = []

    def score(window):
        seen.append(len(window))
        return [[0, 5, 0] if w.startswith("Ann") else [5, 0, 0] for w in window]

    out = list(models.Tagger(("PERSON",), words, score).spans(texts, ["PERSON"]))
    assert [len(x) for x in out] == [0, 0, 700, 1] and out[3] == [("PERSON", 600, 603, None)] and max(seen) == 256
    assert list(models.Tagger(("PERSON",), words, score).spans(["Ann"], [])) == [[]]


def test_models_run_on_all_cores_over_a_small_file(spark, tmp_path):
    frame(spark, [(i, f"Customer#{i} lives at 12 Main St, they say") for i in range(40)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = models.model_findings(spark.read.parquet(f"{tmp_path}/in"), "id", catalog._tagger, models.ModelContract("tagger", {"PERSON": "PERSON"}), ["PERSON"])
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r["id"] for r in found.collect()) == list(range(40))


def _starts(text):
    at = 0
    for word in text.split():
        at = text.index(word, at)
        yield at, word
        at += len(word)
