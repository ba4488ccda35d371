"""Secret scans: candidate strings judged by a random forest trained on labelled findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .filters import marked

#: A run of key material of so many characters is a candidate wherever it stands.
LEAST = 16
_KEY = r"(?i:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_.\-]?key|(?:access|private|client|auth)[_.\-]?key|credentials?|auth|bearer)[A-Za-z0-9_.\-]{0,24}['\"]?\s{0,2}(?:=>|:=|=|:)\s{0,2}"
_NO_URI = r"(?![A-Za-z][A-Za-z0-9+.\-]{0,20}://)"
RUN = r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{%d,}={0,2}" % LEAST
#: Values of any length that a Bearer header, a URI's user or a key's assignment introduces, then runs.
#: Short looks back come before each long one, for speed.
CANDIDATE = r"(?<=[=:>\"'\s])(?<=[=:>rR]\s{0,4}[\"']?)(?:%s)|%s" % ("|".join([
    r"(?<=(?i:bearer)\s{1,2})[A-Za-z0-9._~+/\-]*[A-Za-z0-9_~+/\-]={0,2}",
    r"(?<=:)(?<=://[^\s/:@]{0,255}:)[^\s@/]+(?=@)",
    *[rf"(?<={q})(?<={_KEY}{q}){_NO_URI}(?!(?i:bearer)\s)[^{q}\r\n]+(?={q})" for q in "\"'"],
    rf"(?<={_KEY}){_NO_URI}(?!(?i:bearer)\s)[^\s\"'`<>,;()\[\]{{}}]*[^\s\"'`<>,;()\[\]{{}}.:!?]",
]), RUN)
#: Code points of text kept on either side of a candidate.
AROUND = 48
DICTIONARY = 400
CUT = 0.5
MARK = "[SECRET]"

_KEYWORDS = r"(?i)(secret|token|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key|client.?key)"
_ASSIGNED = r"(?i)[A-Za-z_\-.]*(secret|token|passw|pwd|key|auth|bearer|credential)[A-Za-z_\-.]*['\"]?\s*(=|:|=>|\s)\s*['\"]?(bearer\s+)?$"
_HARMLESS = r"(?i)(sha\d*|md5|commit|checksum|digest|integrity|hash|uuid|guid|revision|etag|fingerprint|example|sample|dummy|placeholder|fake)"
_TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/|spec)"

FEATURES = [
    "f_length", "f_distinct", "f_digits", "f_upper", "f_lower", "f_hex", "f_classes", "f_vowels", "f_pairs",
    "f_longest_letters", "f_repeat", "f_words", "f_keyword", "f_assigned", "f_harmless", "f_quoted", "f_prefix", "f_test_path", "f_slashes",
]


def _by_pattern(text: Column, of) -> Column:
    introduced = text.contains("=") | text.contains(":") | F.lower(text).contains("bearer")  # else only runs are there
    return F.when(introduced, of(CANDIDATE)).otherwise(of(RUN))


def _pieces(text: Column) -> tuple[Column, Column]:
    """The candidates of a text in order, and what stands between them: one piece more."""
    return _by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), 0)).alias("found"), _by_pattern(text, lambda p: F.split(text, p, -1)).alias("between")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, h, nth, start, end, candidate, before, after, path) for each candidate of each text.

    ``nth`` counts a text's candidates from 0. Offsets are code points. ``before`` and ``after`` are the AROUND code points on either side,
    with any other candidates that they hold. ``h`` is a hash of id and text, so that rows that repeat an id with
    another text are told apart.
    """
    text = F.col("text")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), path.alias("path"))
    rows = rows.where(_by_pattern(text, lambda p: text.rlike(p)))
    rows = rows.select("id", F.xxhash64("id", "text").alias("h"), "path", *_pieces(text))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "h", "path", "row", "found", "between", F.posexplode("found").alias("i", "candidate"))
    i = F.col("i")
    reach = AROUND // 3  # so many candidates, with what introduces the short ones, are at least AROUND long
    piece = lambda name, at, start: F.coalesce(F.substring(F.get(name, at), start, AROUND), F.lit(""))
    before = F.concat(*[piece(name, i - k, -AROUND) for k in range(reach, 0, -1) for name in ("between", "found")], piece("between", i, -AROUND))
    after = F.concat(piece("between", i + 1, 1), *[piece(name, i + k + int(name == "between"), 1) for k in range(1, reach + 1) for name in ("found", "between")])
    rows = rows.select(
        "id", "h", "row", "path", "i", "candidate", (F.length("candidate") + F.length(F.get("between", i))).cast("long").alias("size"),
        F.substring(before, -AROUND, AROUND).alias("before"), F.substring(after, 1, AROUND).alias("after"),
    )
    end = F.sum("size").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).select("id", "h", F.col("i").alias("nth"), (F.col("end") - F.length("candidate")).alias("start"), "end", "candidate", "before", "after", "path")


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 12 ASCII letters over all texts; at most ``limit`` reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^a-z]+")).alias("w")).where("length(w) between 3 and 12")
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(limit).collect()]


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n  # noqa: E731  what a negated class leaves
    words = sorted(dictionary, key=lambda w: (-len(w), w)) or ["\\b\\B"]
    cover = 1 - F.length(F.regexp_replace(F.lower(c), "(" + "|".join(words) + ")", "")) / n
    switches = F.size(F.regexp_extract_all(c, F.lit(r"(?:[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z]))"), 0)) / n
    vowels = F.length(F.regexp_replace(F.lower(c), "[^aeiou]", "")) / F.greatest(F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(1))
    pairs = F.size(F.regexp_extract_all(F.lower(c), F.lit("(?:[aeiou][bcdfghjklmnpqrstvwxyz]|[bcdfghjklmnpqrstvwxyz](?=[aeiou]))"), 0)) / n
    near = F.concat("before", "after")
    columns = {
        "f_length": n, "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "f_digits": share("[^0-9]"), "f_upper": share("[^A-Z]"), "f_lower": share("[^a-z]"),
        "f_hex": share("[^0-9a-fA-F]"), "f_classes": switches, "f_vowels": vowels, "f_pairs": pairs,
        "f_longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)), "f_repeat": c.rlike(r"(.)\1{3}"), "f_words": cover,
        "f_keyword": near.rlike(_KEYWORDS), "f_assigned": F.col("before").rlike(_ASSIGNED), "f_harmless": F.concat(near, F.lit(" "), c).rlike(_HARMLESS),
        "f_quoted": F.col("before").rlike(r"['\"`]$") & F.col("after").rlike(r"^['\"`]"), "f_prefix": c.rlike(r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abp]-|[sr]k_(live|test)_|AIza|ya29|eyJ)"),
        "f_test_path": F.col("path").rlike(_TEST_PATH), "f_slashes": share("[^/_\\-]"),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(spark: SparkSession, dictionary: list[str], rows: int = 4000) -> DataFrame:
    """A made set of labelled findings (candidate, before, after, path, label, kind) for training.

    Twenty kinds in turn, half of them secrets, drawn by hashing the row number, so it is the
    same at every call. Callers with reviewed findings of their own pass those instead.
    """
    words = F.array(*[F.lit(w) for w in (dictionary or ["the"])])
    i = F.col("id")
    draw = lambda k, n: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n)).cast("int")
    hexa = lambda k, n: F.substring(F.sha2(F.concat(i.cast("string"), F.lit(k)), 512), 1, n)
    base = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(hexa(k, 128))), "[+/=]", "x"), 1, n)
    word = lambda k: F.get(words, draw(k, max(len(dictionary), 1)))
    run = lambda sep, n: F.concat_ws(sep, *[word(f"w{j}") for j in range(n)])
    cased = lambda c: F.when(draw("cap", 2) == 1, F.initcap(c)).otherwise(c)
    keys = F.array(*map(F.lit, ["token", "secret", "password", "api_key", "auth_token", "client_secret", "access_key"]))
    key = F.get(keys, draw("key", 7))
    sep = F.get(F.array(*map(F.lit, [' = "', "=", ': "', " ", " = '", ": "])), draw("sep", 6))
    quote = F.when(F.endswith(sep, F.lit('"')), '"').when(F.endswith(sep, F.lit("'")), "'").otherwise(" ")
    lead, tail = F.concat(word("a"), F.lit(" "), word("b"), F.lit(" ")), F.concat(F.lit(" "), word("c"))
    assigned, plain = F.concat(lead, key, sep), F.concat(lead, F.get(F.array(F.lit(""), F.lit("("), F.lit("> ")), draw("pre", 3)))
    hashed = F.concat(lead, F.get(F.array(*map(F.lit, ["commit ", "sha256:", "md5=", "checksum: ", "digest ", "revision "])), draw("hash", 6)))
    live = F.get(F.array(*map(F.lit, ["AKIA", "sk_live_", "ghp_", "AIza"])), draw("live", 4))
    odd = F.get(F.array(*map(F.lit, ["!", "#", "@", "$", "."])), draw("odd", 5))
    stands = F.get(F.array(*map(F.lit, ["None", "null", "true", "false", "required", "string", "********", "xxxxxx", "changeme", "${TOKEN}", "$SECRET", "self.token", "your-password"])), draw("stands", 13))
    uri, bearer = F.concat(lead, F.get(F.array(*map(F.lit, ["postgres://app:", "mysql://root:", "https://user:", "redis://:"])), draw("uri", 4))), F.concat(lead, F.get(F.array(F.lit("Authorization: Bearer "), F.lit("bearer ")), draw("head", 2)))
    length = lambda *ns: F.get(F.array(*map(F.lit, ns)), draw("n", len(ns)))
    cases = [
        (1, hexa("h", 40), assigned), (0, cased(run("", 6)), plain), (1, F.substring(base("k", 86), F.lit(1), length(20, 24, 32, 40, 64)), assigned),
        (0, hexa("g", 40), hashed), (1, F.substring(hexa("j", 128), F.lit(1), length(32, 40, 48, 64)), assigned), (0, run("_", 5), assigned),
        (1, F.concat(live, base("l", 36)), plain), (0, F.concat_ws("-", hexa("u", 8), hexa("v", 4), hexa("x", 4), hexa("y", 4), hexa("z", 12)), plain),
        (1, hexa("m", 40), assigned), (0, F.concat(F.lit("your_"), key, F.lit("_goes_here")), assigned), (1, F.concat(live, base("q", 24)), assigned),
        (0, F.concat_ws("/", run("/", 5), hexa("p", 2)), plain),
        (1, F.concat(word("d"), draw("e", 9000).cast("string"), word("f")), assigned), (0, cased(word("i")), assigned),
        (1, F.concat(F.substring(base("r", 12), F.lit(1), length(5, 6, 8, 10, 12)), odd, F.substring(hexa("s", 4), 1, 4)), assigned), (0, stands, assigned),
        (1, F.concat(F.substring(hexa("t", 20), F.lit(1), length(6, 8, 10)), word("o")), uri), (0, F.get(F.array(*map(F.lit, ["password", "pass", "PASSWORD", "pw"])), draw("y", 4)), uri),
        (1, F.substring(base("A", 15), F.lit(1), length(8, 10, 12, 15)), bearer), (0, cased(word("B")), bearer),
    ]
    kind = (i % len(cases)).cast("int")
    pick = lambda at: F.get(F.array(*[c[at] if isinstance(c[at], Column) else F.lit(c[at]) for c in cases]), kind)
    path = F.get(F.array(*map(F.lit, ["", "src", "app/settings.py", "tests/data.json"])), draw("path", 4))
    made = spark.range(0, rows, 1, 1).select(pick(1).alias("candidate"), pick(2).alias("before"), F.when(kind.isin(16, 17), F.concat(F.lit("@db/main"), tail)).otherwise(F.concat(quote, tail)).alias("after"), path.alias("path"), pick(0).cast("double").alias("label"), kind.alias("kind"))
    return made.withColumns({"before": F.substring("before", -AROUND, AROUND), "after": F.substring("after", 1, AROUND)})


def train(findings: DataFrame, dictionary: list[str], trees: int = 40, depth: int = 6, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest over labelled findings; their number is the caller's bound."""
    rows = with_features(findings, dictionary)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)


def scored(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``rows``, which have the features, with the forest's vote for a secret as ``score``."""
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return rows.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def secret_findings(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = CUT) -> DataFrame:
    """(id, h, nth, start, end, candidate, score, secret) for each candidate of each text.

    Every run of at least LEAST characters of key material is a candidate, and so is a value of
    any length that an assignment to a key name, a URI's user or ``Bearer`` introduces; the
    forest's vote is its score, and ``secret`` says whether it reaches ``cut``. ``findings`` are labelled rows
    (candidate, before, after, path, label); without any, ``labelled_findings`` are used. The
    dictionary is the corpus' own most frequent words.

    Null and empty texts have no candidates; a null path is empty; null and repeated ids are
    returned as they are. An empty table gives no rows. Other columns are ignored.
    """
    dictionary = frequent_words(docs, text_col)
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession, dictionary), dictionary)
    rows = with_features(candidates(docs, id_col, text_col, path_col), dictionary)
    rows = scored(rows, model)
    return rows.select(F.col("id").alias(id_col), "h", "nth", "start", "end", "candidate", "score", (F.col("score") >= cut).alias("secret"))


def redact_secrets(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with each secret of ``found`` replaced by ``mark``; all columns and rows stay.

    ``found`` is what ``secret_findings`` gave for ``docs``. Only rows that may hold a secret
    are joined, so the rest of the texts is not shuffled. A text is taken apart at its
    candidates once and put together again, in steps linear in its length.
    """
    flags = found.groupBy(F.col("h").alias("_found")).agg(F.array_sort(F.collect_set(F.struct("nth", "secret"))).alias("_flags"), F.max("secret").alias("_any"))
    flags = staged(flags.where("_any").select("_found", F.col("_flags.secret").alias("_flags")), "secret-flags")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = marked(docs.withColumn("_key", F.xxhash64(F.col(id_col), text)), "_key", flags, "_found")
    parts = F.array(F.struct(*_pieces(text), F.col("_flags").alias("flags")))  # bound once by the lambda
    piece = lambda p, b, i: F.concat(b, F.coalesce(F.when(F.get(p["flags"], i), F.lit(mark)).otherwise(F.get(p["found"], i)), F.lit("")))
    whole = F.transform(parts, lambda p: F.array_join(F.transform(p["between"], lambda b, i: piece(p, b, i)), ""))
    hit = rows.where("_maybe").join(flags, F.col("_key") == F.col("_found"), "left")
    hit = hit.withColumn(text_col, F.when(F.col("_flags").isNull(), F.col(text_col)).otherwise(F.get(whole, F.lit(0)))).select(*docs.columns)
    return rows.where("not _maybe").select(*docs.columns).unionByName(hit)
