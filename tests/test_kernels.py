import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwright.config import ScanConfig, parse_scan, parse_scan_and_transform, parse_transform
from veilwright.errors import PrivacyError
from veilwright.kernels import markers, tagging, tree
from veilwright.kernels.envelope import envelope, parse_tokens
from veilwright.kernels.spans import Finding, Policy, Scanner, _resolve_by_pairs, byte_offsets, merge, resolve, rewrite, select, utf16_range, validate


def labels(text, **config):
    return [(f.entity_type, f.matched_text) for f in Scanner.of(ScanConfig(**config))(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("write to ann.lee@example.com, now", [("EMAIL", "ann.lee@example.com")]),
        ("user=ann@example.com&x", [("EMAIL", "ann@example.com")]),
        ("'ann@example.com'", [("EMAIL", "ann@example.com")]),
        ("...ann@example.com", [("EMAIL", "ann@example.com")]),
        ("メールはann@example.comです", [("EMAIL", "ann@example.com")]),
        ("call (212) 555-0123 or +44 20 7946 0958", [("PHONE", "(212) 555-0123"), ("PHONE", "+44 20 7946 0958")]),
        ("3.2025550143 is pi", []),
        ("card 4111 1111 1111 1111 123", [("CREDIT_CARD", "4111 1111 1111 1111")]),
        ("4111111111111112", []),
        ("born 1990-02-29 or 1992-02-29", [("DATE", "1992-02-29")]),
        ("due March 5, 2026.", [("DATE", "March 5, 2026")]),
        ("ZIP 12345-6789, not 12345-67", [("ZIP_CODE", "12345-6789")]),
        ("at 10.0.0.1 and ::1 and 10.0.0.256", [("IP_ADDRESS", "10.0.0.1"), ("IP_ADDRESS", "::1")]),
        ("SSN 123-45-6789, not 000-12-3456", [("SSN", "123-45-6789")]),
        ("Account number: 1234567", [("ACCOUNT_NUMBER", "1234567")]),
        ("acct ending in 4321", [("ACCOUNT_NUMBER", "4321")]),
        ("Billing address: 12 High Street, Flat 3\n", [("STREET_ADDRESS", "12 High Street, Flat 3")]),
        ("Authorization: Bearer abc.def-1", [("BEARER_TOKEN", "abc.def-1")]),
        ("NPI: 1234567893", [("NPI", "1234567893"), ("PHONE", "1234567893")][:1]),
        ("key ghp_" + "a1" * 18 + ".", [("API_KEY", "ghp_" + "a1" * 18)]),
    ],
)
def test_default_labels(text, expected):
    found = labels(text)
    assert [f for f in found if f[0] in {e[0] for e in expected} or not expected] == expected


def test_activation():
    text = "DE89370400440532013000 and 123e4567-e89b-42d3-a456-426614174000"
    assert {x[0] for x in labels(text, locale=" DE-de ", detect_uuid=True)} >= {"DE_IBAN", "UUID"}
    assert not {"DE_IBAN", "UUID"} & {x[0] for x in labels(text)}
    assert labels("a@b.co 10.0.0.1", entities=("EMAIL",)) == [("EMAIL", "a@b.co")]


def test_formats():
    assert labels("export MAIL=ann@example.com # bob@example.com", format="env", entities=("EMAIL",)) == [("EMAIL", "ann@example.com"), ("EMAIL", "bob@example.com")]
    assert labels("select 'ann@example.com' /* x /* bob@example.com */ */", format="sql", entities=("EMAIL",)) == [("EMAIL", "ann@example.com"), ("EMAIL", "bob@example.com")]


def test_denylist_overlaps_and_boundaries():
    deny = parse_scan({"deny": [{"phrase": "aba", "boundary": "substring"}, {"phrase": "Cat", "case_sensitive": False}]}).deny
    assert labels("ababa cat concat", deny=deny) == [("DENYLIST", "aba"), ("DENYLIST", "aba"), ("DENYLIST", "cat")]


@pytest.mark.parametrize(
    "value, code, path",
    [
        ({"x": 1}, "unknown_field", "/x"),
        ({"entities": []}, "empty_value", "/entities"),
        ({"entities": ["EMAIL", "EMAIL"]}, "duplicate_value", "/entities/1"),
        ({"locale": "xx"}, "invalid_value", "/locale"),
        ({"detect_uuid": 1}, "invalid_type", "/detect_uuid"),
        ({"deny": [{"phrase": " "}]}, "empty_value", "/deny/0/phrase"),
    ],
)
def test_scan_errors(value, code, path):
    with pytest.raises(PrivacyError) as error:
        parse_scan(value)
    assert (error.value.reason, error.value.path) == (code, path)


def test_combined_errors_are_prefixed():
    with pytest.raises(PrivacyError) as error:
        parse_scan_and_transform({"transform": {"default": {"strategy": "mask", "character": " "}}})
    assert error.value.path == "/transform/default/character"


def _finding(start, end, label="A", confidence=None, name="d"):
    return Finding(label, "x" * (end - start), start, end, confidence, name)


def test_fast_resolution_equals_pairwise():
    rng = random.Random(5)
    for _ in range(300):
        rows = {}
        for _ in range(rng.randint(1, 9)):
            s = rng.randint(0, 12)
            f = _finding(s, s + rng.randint(1, 6), rng.choice("AB"), rng.choice([0.1, 0.5]), rng.choice("de"))
            rows[f.entity_type, f.start, f.end] = f
        ordered = sorted(rows.values(), key=lambda f: (f.start, f.end, f.entity_type))
        assert resolve(ordered) == _resolve_by_pairs(ordered)


def test_conflict_and_merge():
    policy = Policy(parse_transform({"default": {"strategy": "redact"}}))
    text, rows = "x" * 10, [_finding(0, 5), _finding(3, 9, "B")]
    with pytest.raises(PrivacyError) as error:
        select(rows, policy)
    assert error.value.code == "review_conflict"
    joined = merge(text, rows, policy)
    assert [(f.start, f.end, f.entity_type) for f in joined] == [(0, 9, "B")]
    assert rewrite(text, select(joined, policy), policy.config).text == "[B]x"


def test_validation_reports_the_first_bad_finding():
    with pytest.raises(PrivacyError) as error:
        validate("hello", [Finding("A", "he", 0, 2), Finding("A", "xx", 2, 4)])
    assert (error.value.reason, error.value.index) == ("matched_text_mismatch", 1)


@given(st.text(max_size=60), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_ranges_agree(text, a, b):
    start, end = sorted((min(a, len(text)), min(b, len(text))))
    at = byte_offsets(text, [start, end])
    assert text.encode("utf-8", "surrogatepass")[at[start] : at[end]].decode("utf-8", "surrogatepass") == text[start:end]
    u = utf16_range(text, start, end)
    assert text.encode("utf-16-le", "surrogatepass")[2 * u[0] : 2 * u[1]].decode("utf-16-le", "surrogatepass") == text[start:end]


@given(st.lists(st.sampled_from(["ann@example.com", "10.0.0.1", " and ", "123-45-6789", "é", "\n", "x"]), max_size=8).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_redacted_text_has_no_finding_left(text):
    policy, scanner = Policy(parse_transform({"default": {"strategy": "redact"}})), Scanner.of()
    out = rewrite(text, select(merge(text, scanner(text), policy), policy), policy.config)
    assert not scanner(out.text)
    for row in out.rows:
        assert out.text[row["output_start"] : row["output_end"]] == row["replacement"]


@given(st.text(min_size=1).filter(lambda s: s.strip()), st.binary(min_size=1))
@settings(max_examples=100, deadline=None)
def test_envelopes_round_trip(ref, payload):
    try:
        ref.encode()
    except UnicodeEncodeError:
        return
    made = envelope(ref, "1", payload)
    tokens = parse_tokens("a " + made + made)
    assert [(t.token_ref, t.payload, t.envelope) for t in tokens] == [(ref, payload, made)] * 2


@pytest.mark.parametrize("text", ["DFTOKENv", "DFTOKENv1(3):a.b", "DFTOKENv1(05):aa.aa", "DFTOKENv1(8):YQ.MQ.YR", "DFTOKENv1(99):YQ.MQ.YQ"])
def test_malformed_tokens(text):
    with pytest.raises(PrivacyError) as error:
        parse_tokens(text)
    assert error.value.code == "invalid_token"


def test_other_token_version():
    with pytest.raises(PrivacyError) as error:
        parse_tokens("DFTOKENv2(8):YQ.MQ.YQ")
    assert error.value.code == "unsupported_token_version"


def test_tree():
    data = tree.parse_json('{"b": ["x", {"a/~": "y"}], "a": 1, "Authorization": "Bearer t1"}')
    assert [(x.path, x.value) for x in tree.leaves(data)] == [("/Authorization", "Bearer t1"), ("/b/0", "x"), ("/b/1/a~1~0", "y")]
    leaf = next(tree.leaves(data))
    assert [f.matched_text for f in tree.scan_leaf(leaf, tree.StructuredConfig(), Scanner.of())] == ["t1"]
    for bad in ("1", "NaN", '{"a": 1e400}', '{"a": 9007199254740992}', "[" * 200 + "]" * 200):
        with pytest.raises(PrivacyError):
            list(tree.leaves(tree.parse_json(bad)))


def test_identity_lower_cases_by_character():
    assert markers.identity_key("  ΑΣ  B ") == "ας b".replace("ς", "σ")


VALUES = {"[[PERSON_ABC123]]": "Ann", "[[A_B_000000]]": "Bob"}
STREAMS = ["Dear [[PERSON_ABC123]], hi", "[[person_abcl23]] [[a_b_oooooo]]", "[[[PERSON_ABC123]]] [x] [[y]] a_b word", "[[PERSON_ABC123]", "x [[A_", "[[P_UUUUUU]]", "PERSON_ABC123", "[[PERSON_000000]]", "w" * 100 + " [[PERSON_ABC123]]"]


def _streamed(pieces):
    run, out = markers.ProgressiveRestore(VALUES.get), []
    try:
        for piece in pieces:
            out.append(run.feed(piece))
        out.append(run.finish())
    except markers.StreamFailure as failure:
        return None, failure.kind
    return "".join(out), None


@pytest.mark.parametrize("text", STREAMS)
def test_every_chunking_of_a_stream_agrees(text):
    whole = _streamed([text])
    for i in range(len(text) + 1):
        assert _streamed([text[:i], text[i:]]) == whole
    assert _streamed(list(text)) == whole


def test_stream_results():
    assert _streamed(["Dear [[PERSON_ABC123]]!"]) == ("Dear Ann!", None)
    assert _streamed(["[[PERSON_000000]]"]) == (None, "unknown")
    assert _streamed(["a PERSON_ABC123 b"]) == (None, "unbracketed")
    assert _streamed(["x [[A_"]) == (None, "damaged")


def test_best_tags_equal_brute_force():
    rng = np.random.default_rng(5)
    legal = lambda path: all(t not in (2, 4) or before in (t, t - 1) for before, t in zip((0, *path), path))
    paths = {n: [p for p in itertools.product(range(5), repeat=n) if legal(p)] for n in range(1, 5)}
    for _ in range(200):
        scores = rng.normal(0, 3, (rng.integers(1, 5), 5)).astype(np.float32)
        best = max(paths[len(scores)], key=lambda p: sum(float(scores[i][t]) for i, t in enumerate(p)))
        assert tagging.best_tags(scores) == list(best)
    assert tagging.best_tags(np.zeros((0, 5))) == [] and tagging.best_tags(np.zeros((3, 5))) == [0, 0, 0]
    with pytest.raises(PrivacyError):
        tagging.best_tags(np.array([[np.nan] * 5]))


def test_tags_of_many_texts_equal_those_of_each():
    rng = np.random.default_rng(6)
    many = [np.round(rng.normal(0, 2, (n, 5))).astype(np.float32) for n in (3, 0, 1, 40, 40, 2, 0, 257)]
    assert tagging.best_tags_of(many) == [tagging.best_tags(scores) for scores in many]
    assert tagging.best_tags_of([]) == []


@pytest.mark.parametrize("n", [0, 1, 64, 65, 255, 256, 257, 448, 449, 1000, 8192])
def test_windows_tile_the_tokens(n):
    made = list(tagging.windows(n))
    assert [i for _, own in made for i in range(own.start, own.stop)] == list(range(n))
    assert all(seen.start <= own.start and own.stop <= seen.stop and seen.stop - seen.start <= tagging.WINDOW for seen, own in made)
    with pytest.raises(PrivacyError):
        list(tagging.windows(8193))


def test_runs_of_tags():
    text = "Ann Lee, of 12 Main St. -- Bob"
    tokens = [(0, 3), (4, 8), (9, 11), (12, 14), (15, 19), (20, 23), (24, 26), (27, 30)]
    spans = tagging.tagged_spans(text, tokens, [1, 2, 0, 3, 4, 4, 1, 3], ["PERSON", "ADDRESS"])
    assert [(label, text[a:b]) for label, a, b in spans] == [("PERSON", "Ann Lee"), ("ADDRESS", "12 Main St"), ("ADDRESS", "Bob")]
