"""Secret scan, with DataFrame functions only: candidates by pattern, false positives removed by a random forest.

Candidates are runs of A-Z a-z 0-9 + / _ - in the words of the whole text, with or without a digit: all of 12 characters
or more, and those of any length that follow a credential word, directly or after one more word of letters. A run goes on
over a full stop with eight such characters or more behind it (web tokens), and has the one or two = that end it (padded
base64). The forest's
features are the candidate's length, its character classes and the transitions between them, its vowels and consonant
clusters, the share of its characters that dictionary words cover, its path, and the words before and after it.

Defined results: null and empty texts have no candidate; a null path counts as an empty one; every candidate is returned
with its score, secret or not. Repeated rows give repeated findings; an empty table gives none. Offsets count characters
(UTF-16 units) from 0. Only the named columns are read; they may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Possessive, as nothing behind a group asks for less of it: a greedy group takes a stack frame for each time it is repeated.
RUN = r"[A-Za-z0-9][A-Za-z0-9+/_\-]*+(?:\.[A-Za-z0-9+/_\-]{8,}+)*+(?:={1,2}(?![A-Za-z0-9=]))?"
#: What a text with a run of 12 characters or more has.
CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9+/_\-.=]{11,}"

#: Words of a text that are looked at in one row, so that the work on a word does not grow with its text.
SECTION = 256
#: Characters of a word above which it is cut into segments of RUNS runs, each a row, so that the work on a run does not grow with its word.
LONG_WORD, RUNS = 2_048, 64
SEGMENT = rf"((?:[^A-Za-z0-9]*+{RUN}){{1,{RUNS}}}+|[^A-Za-z0-9]++)"
#: Characters on either side of a candidate that are returned and looked at.
CONTEXT = 64

#: Dictionary words, and the words that speak for or against a secret beside a candidate.
DICTIONARY = ("access", "admin", "account", "article", "client", "code", "config", "content", "data", "default", "demo", "dummy", "example", "file", "group", "html", "http", "image", "index", "item", "key", "link", "list", "local", "main", "model", "name", "order", "page", "part", "password", "path", "placeholder", "private", "public", "report", "sample", "secret", "section", "server", "service", "table", "test", "text", "time", "title", "token", "type", "user", "value", "version", "www", "your")
CREDENTIAL = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
#: How a run's text before it ends, if a shorter run is a candidate too.
AFTER_CREDENTIAL = rf"({CREDENTIAL})\w*\W*([a-z]+\W+)?$"
HARMLESS = "example|sample|dummy|placeholder|fake|sha1|sha256|md5|hash|commit|checksum|digest|uuid|guid|isbn|order|invoice|card|phone|version|page|figure|article"
TEST_PATH = "test|spec|example|sample|fixture|docs?/|mock"
CONFIG_PATH = r"\.(env|pem|cfg|conf|ini|ya?ml|json|properties|toml|tf)$"

#: What the default labelled table's letter-only words are made of.
SYLLABLES = ("an", "er", "tion", "ing", "ment", "ver", "ein", "lich", "pro", "con", "re", "sta", "ble", "ung", "com", "ter", "schaft", "eau", "lles", "ique", "the", "and", "ou", "heit", "ly", "di", "ra", "no")
COMMON = ("of", "is", "the", "and", "for", "in", "was", "required", "string", "null", "none", "true", "reset", "field", "must", "manager", "invalid", "optional", "expired", "policy")

FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "distinct", "hexadecimal", "known_prefix", "coverage", "credential_near", "harmless_before", "harmless_after", "assigned", "quoted", "test_path", "config_path", "vowels", "clusters")


def share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def features(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """before, after: the text on either side of the candidate; path: of the file or source."""
    low = F.lower(before)
    flag = lambda x: x.cast("double")
    return {
        "length": F.length(c).cast("double"),
        "digits": share(c, "[0-9]"),
        "uppers": share(c, "[A-Z]"),
        "lowers": share(c, "[a-z]"),
        "symbols": share(c, "[^A-Za-z0-9]"),
        "transitions": share(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "hexadecimal": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "known_prefix": flag(c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk_(live|test)_|^xox[abp]-|^AIza|^eyJ")),
        "coverage": (F.length(c) - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))) / F.length(c),
        "credential_near": flag(low.rlike(CREDENTIAL)),
        "harmless_before": flag(low.rlike(HARMLESS)),
        "harmless_after": flag(F.lower(after).rlike(HARMLESS)),
        "assigned": flag(low.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(low.rlike(r"[\"']$")),
        "test_path": flag(F.lower(path).rlike(TEST_PATH)),
        "config_path": flag(F.lower(path).rlike(CONFIG_PATH)),
        "vowels": share(c, "[AEIOUYaeiouy]"),
        "clusters": share(c, "[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]{4}"),
    }


#: Where the default labelled table's findings are: in tests and documents, in settings, elsewhere.
TEST_PATHS = ("tests/fixture.json", "docs/readme.md", "spec/login.rb", "examples/demo.py", "mock_data.csv")
CONFIG_PATHS = ("settings.env", "deploy/app.yaml", "conf/site.ini", "certs/server.pem", "infra/main.tf")
OTHER_PATHS = ("", "src3", "src/main.py", "web", "chat/17", "lib/core.c")
#: What follows a finding: words that call it harmless, other words, the end of a quotation.
DENIALS = (" # example only", " (placeholder)", " <- dummy value", " is a sample")
OTHERS = (" and", " end", "", " now please", " to log in")


def labelled_findings(spark: SparkSession, rows: int = 8_600) -> DataFrame:
    """The default labelled table, made by rule from hashes of row numbers: candidate, before, after, path, label (1: secret).

    A kind of finding is a secret wherever it is, nowhere, or where its path and the words behind it say so: keys with a
    known prefix are secrets but for denials behind them; random values after a credential word are, unless a denial
    follows or the path is one of tests or documents; random values without such a word are, where the path is one of
    settings and no denial follows; the other kinds never are."""
    hexed = F.concat(F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))
    mixed = F.translate(F.translate(F.regexp_replace(F.base64(F.unhex(hexed)), "=", ""), "+", "x"), "/", "Q")
    upper = F.upper(F.regexp_replace(mixed, "[^A-Za-z0-9]", "7"))
    digits = F.translate(hexed, "abcdef", "314159")
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    n = lambda k, low, span: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(span)) + low).cast("int")
    cut = lambda text, size: F.substr(text, F.lit(1), size)
    plain = F.lit("of the ")
    letters = F.translate(mixed, "0123456789", "kWmXqZvJhG")
    one_of = lambda k, values: F.element_at(F.array(*map(F.lit, values)), n(k, 1, len(values)))
    spoken = lambda k, syllables: F.concat(*(one_of(k + i, SYLLABLES) for i in range(syllables)))
    secret, valued, found, never = "secret", "valued", "found", "never"
    kinds = [
        (F.concat(F.lit("AKIA"), cut(upper, F.lit(16))), F.lit("the thing "), secret),
        (F.concat(F.lit("AKIA"), cut(upper, F.lit(16))), F.lit("access key = "), secret),
        (cut(hexed, F.lit(40)), F.lit('token = "'), valued),
        (cut(hexed, n(1, 16, 25)), F.lit("password="), valued),
        (cut(hexed, n(2, 24, 41)), F.lit("api_key: "), valued),
        (cut(F.upper(hexed), F.lit(40)), F.lit('TOKEN = "'), valued),
        (cut(mixed, n(3, 20, 60)), F.lit("secret = '"), valued),
        (cut(mixed, F.lit(40)), F.lit("Authorization: Bearer "), valued),
        (F.concat(F.lit("ghp_"), cut(mixed, F.lit(36))), plain, secret),
        (F.concat(F.lit("sk_live_"), cut(mixed, F.lit(24))), F.lit("with "), secret),
        (cut(digits, F.lit(16)), plain, never),
        (cut(digits, n(4, 12, 10)), F.lit("card number "), never),
        (cut(hexed, F.lit(40)), F.lit("commit "), never),
        (cut(hexed, F.lit(64)), F.lit("sha256: "), never),
        (F.concat(F.lit("eyJ"), cut(mixed, n(150, 17, 10)), F.lit("."), F.substr(mixed, F.lit(20), n(151, 20, 20)), F.lit("."), F.substr(mixed, F.lit(40), F.lit(27))), one_of(152, ("Bearer ", "token: ", "with ", "cookie ")), secret),
        (F.concat(cut(mixed, n(153, 22, 20)), one_of(154, ("=", "=="))), one_of(155, ("secret = ", "password: ", "api_key=")), valued),
        (F.concat_ws(".", spoken(156, 2), spoken(160, 5), spoken(166, 5)), one_of(172, ("see ", "of the ", "in ")), never),
        (F.concat(spoken(173, 3), F.lit("."), one_of(177, ("properties", "template", "manifest"))), one_of(178, ("open ", "the file ", "secret ")), never),
        # known by their place alone
        (cut(hexed, F.lit(40)), one_of(140, ("value ", "= ", "x: ")), found),
        (cut(mixed, n(141, 24, 30)), one_of(142, ("set ", "= ", "id ")), found),
        (cut(mixed, F.lit(32)), plain, found),
        # without a digit, or short
        (F.concat(F.lit("AKIA"), cut(F.upper(letters), F.lit(16))), one_of(30, ("the thing ", "access key = ")), secret),
        (F.concat(F.lit("sk_live_"), cut(letters, F.lit(24))), F.lit("with "), secret),
        (cut(letters, n(31, 12, 20)), one_of(32, ("password=", "secret = '", "token: ")), valued),
        (cut(F.lower(letters), n(33, 8, 12)), one_of(34, ("password=", "password: ", 'pwd = "')), valued),
        (cut(mixed, n(35, 6, 6)), one_of(36, ("password=", "password: ", "the password is ")), valued),
        (F.concat(spoken(40, 2), n(43, 10, 9990).cast("string")), one_of(44, ("password=", "password: ", "the password is ")), valued),
        (F.concat_ws("-", spoken(45, 2), spoken(48, 2), spoken(51, 2), spoken(54, 2)), one_of(57, ("password=", "passwd: ")), valued),
        (spoken(60, 5), one_of(66, ("of the ", "", "the token ", "and ")), never),
        (F.initcap(spoken(70, 5)), one_of(76, ("of the ", "", "secret ", "and ")), never),
        (F.upper(spoken(80, 5)), one_of(86, ("OF THE ", "", "AND ")), never),
        (F.concat_ws("-", spoken(90, 3), spoken(94, 3)), plain, never),
        (F.concat_ws("/", spoken(100, 2), spoken(103, 3), word(107)), F.lit("see "), never),
        (F.concat(word(110), F.initcap(word(111)), F.initcap(word(112))), F.lit("call "), never),
        (F.concat(F.lit("your_"), word(113), F.lit("_here")), F.lit('password = "'), never),
        (one_of(114, COMMON), one_of(115, ("the token ", "password ", "a secret ", "the password is ", "password: ")), never),
        (spoken(120, 2), one_of(123, ("the token ", "password ", "a secret ", "private ")), never),
        (F.concat_ws("-", cut(hexed, F.lit(8)), F.substr(hexed, F.lit(9), F.lit(4)), F.substr(hexed, F.lit(13), F.lit(4)), F.substr(hexed, F.lit(17), F.lit(4)), F.substr(hexed, F.lit(21), F.lit(12))), F.lit("uuid = "), never),
        (F.concat(word(5), F.lit("_"), word(6), F.lit("_"), n(7, 1, 99).cast("string"), F.lit("_example")), F.lit("token = "), never),
        (F.concat(F.lit("your_"), word(8), F.lit("_key_"), n(9, 100, 900).cast("string")), F.lit('password = "'), never),
        (F.concat(word(10), F.initcap(word(11)), n(12, 1, 9).cast("string"), F.initcap(word(13))), F.lit("call "), never),
        (F.concat(word(14), F.lit("/"), n(15, 1990, 40).cast("string"), F.lit("/"), word(16), F.lit("-"), n(17, 1, 31).cast("string")), F.lit("see "), never),
        (F.concat(word(18), F.lit("-"), word(19), F.lit("-"), n(20, 10, 5000).cast("string")), plain, never),
    ]
    pick = F.pmod("id", F.lit(len(kinds)))
    choose = lambda k: F.coalesce(*(F.when(pick == i, x[k] if isinstance(x[k], Column) else F.lit(x[k])) for i, x in enumerate(kinds)))
    place, denied = n(21, 0, 3), n(22, 0, 4) == 0
    path = F.when(place == 0, one_of(23, TEST_PATHS)).when(place == 1, one_of(24, CONFIG_PATHS)).otherwise(one_of(25, OTHER_PATHS))
    before, kind = choose(1), choose(2)
    after = F.concat(F.when(before.rlike("\"$"), '"').when(before.rlike("'$"), "'").otherwise(""), F.when(denied, one_of(26, DENIALS)).otherwise(one_of(27, OTHERS)))
    label = F.when(kind == never, False).when(kind == secret, ~denied).when(kind == valued, ~denied & (place != 0)).otherwise(~denied & (place == 1))
    return spark.range(0, rows, 1, 1).select(choose(0).alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), label.cast("double").alias("label"))


def train_forest(labelled: DataFrame, trees: int = 40, depth: int = 9, seed: int = 5, bound: int = 100_000) -> RandomForestClassificationModel:
    """labelled: candidate, before, after, path, label. bound: the most labelled findings; more are an error, not a cut."""
    if labelled.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} labelled findings")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = features(F.col("candidate"), text("before"), text("after"), text("path"))
    table = labelled.filter("label is not null and length(candidate) > 0").select(*(c.alias(k) for k, c in made.items()), "label")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="5").fit(table)


def ends(lengths: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def sections(docs: DataFrame) -> DataFrame:
    """docs: id, path, text, near_credential. Rows id, path, near_credential, at (of the section in the text), words, lead
    and own: the words are `lead` ones of the section before, `own` ones of the section, and up to two of the next one."""
    docs = docs.withColumn("parts", F.regexp_extract_all("text", F.lit(rf"((?:\S*+\s){{{SECTION}}}|[\s\S]+)"), F.lit(1)))
    docs = docs.withColumn("ats", ends(F.transform("parts", F.length)))
    part = lambda i: F.get("parts", i)
    cut = F.transform("parts", lambda p, i: F.struct(p.alias("part"), part(i - 1).alias("last"), part(i + 1).alias("next"), F.get("ats", i).alias("at")))
    rows = docs.select("id", "path", "near_credential", F.explode(F.filter(cut, lambda x: F.col("near_credential") | x["part"].rlike(CANDIDATE))).alias("x")).select("id", "path", "near_credential", "x.*")
    none = F.array().cast("array<string>")
    # a section that another one follows ends with white space, behind which there is no word of its own
    own = F.when(F.col("next").isNull(), F.split("part", r"\s")).otherwise(F.slice(F.split("part", r"\s"), 1, SECTION))
    lead = F.when(F.col("last").isNull(), none).otherwise(F.slice(F.split("last", r"\s"), SECTION - 2, 3))
    rest = F.when(F.col("next").isNull(), none).otherwise(F.slice(F.split("next", r"\s", 3), 1, 2))
    rows = rows.select("id", "path", "near_credential", "at", own.alias("own"), lead.alias("lead"), rest.alias("rest"))
    return rows.select("id", "path", "near_credential", "at", F.concat("lead", "own", "rest").alias("words"), F.size("lead").alias("lead"), F.size("own").alias("own"))


def candidates(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """Rows id, path, start, candidate, before, after. Before and after hold two words and the rest of the candidate's own
    word, CONTEXT characters at most."""
    split = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"), F.col(text_col).rlike(f"(?i){CREDENTIAL}").alias("near_credential"))
    split = sections(split.filter(F.col("near_credential") | F.col("text").rlike(CANDIDATE)))
    around = lambda i: F.array_join(F.slice("words", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)) + 1), " ")
    found = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: (x["i"] >= F.col("lead")) & (x["i"] < F.col("lead") + F.col("own")) & ((F.length(x["w"]) >= 12) & x["w"].rlike(CANDIDATE) | F.col("near_credential") & x["w"].rlike(RUN) & around(x["i"]).rlike(f"(?i){CREDENTIAL}")),
    )
    placed = F.transform(
        found,
        lambda x: F.struct(
            x["w"].alias("w"),
            (F.col("at") + F.length(F.array_join(F.slice("words", F.col("lead") + 1, x["i"] - F.col("lead")), " ")) + F.when(x["i"] > F.col("lead"), 1).otherwise(0)).alias("start"),
            F.array_join(F.slice("words", F.greatest(x["i"] - 2, F.lit(1)), F.least(x["i"], F.lit(3))), " ").alias("before"),
            F.array_join(F.slice("words", x["i"] + 2, F.lit(2)), " ").alias("after"),
        ),
    )
    rows = split.select("id", "path", F.explode(placed).alias("x")).select("id", "path", "x.*")
    rows = rows.select("id", "path", "start", "w", F.when(F.col("before") != "", F.concat(F.right("before", F.lit(CONTEXT)), F.lit(" "))).otherwise("").alias("before"), F.left("after", F.lit(CONTEXT)).alias("after"))
    rows = segments(rows)
    # the runs of a segment, in order, with what of it is before them
    runs, gaps = F.regexp_extract_all("w", F.lit(f"({RUN})"), F.lit(1)), F.split(F.col("w"), RUN, -1)
    rows = rows.withColumn("runs", runs).withColumn("sums", ends(F.zip_with("runs", gaps, lambda r, g: F.coalesce(F.length(r), F.lit(0)) + F.length(g))))
    each = F.transform("runs", lambda r, k: F.struct(r.alias("candidate"), (F.get("sums", k + 1) - F.length(r)).alias("lead")))
    rows = rows.select("start", "id", "path", "w", "before", "after", F.explode(each).alias("x")).select("*", "x.*")
    near = F.least("lead", F.lit(CONTEXT))
    before = F.right(F.concat("before", F.substr("w", F.col("lead") - near + 1, near)), F.lit(CONTEXT))
    after = F.left(F.concat(F.substr("w", F.col("lead") + 1 + F.length("candidate"), F.lit(CONTEXT)), F.lit(" "), "after"), F.lit(CONTEXT))
    rows = rows.select("id", "path", (F.col("start") + F.col("lead")).cast("long").alias("start"), "candidate", before.alias("before"), after.alias("after"))
    return rows.filter((F.length("candidate") >= 12) | F.lower("before").rlike(AFTER_CREDENTIAL))


def segments(rows: DataFrame) -> DataFrame:
    """Rows start, w, before, after and others, long words cut between runs: before and after hold what is beside a segment."""
    rows = rows.withColumn("cut", F.when(F.length("w") > LONG_WORD, F.regexp_extract_all("w", F.lit(SEGMENT), F.lit(1))).otherwise(F.array("w")))
    rows = rows.withColumn("ats", ends(F.transform("cut", F.length)))
    side = lambda i: F.coalesce(F.get("cut", i), F.lit(""))
    part = F.transform("cut", lambda w, i: F.struct(w.alias("w"), F.get("ats", i).alias("at"), F.right(side(i - 1), F.lit(CONTEXT)).alias("last"), F.left(side(i + 1), F.lit(CONTEXT)).alias("next")))
    rows = rows.select("id", "path", "start", F.col("before").alias("lead"), F.col("after").alias("rest"), F.explode(part).alias("x")).select("*", "x.*")
    after = F.when(F.col("next") == "", F.col("rest")).otherwise(F.concat("next", F.lit(" "), "rest"))
    return rows.select("id", "path", (F.col("start") + F.col("at")).alias("start"), "w", F.concat("lead", "last").alias("before"), after.alias("after"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows id, start, length, candidate, before, after, score (1: a secret), is_secret, for every candidate."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = candidates(docs, id_col, text_col, path)
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = rows.select("id", "start", "candidate", "before", "after", *(c.alias(f"f_{k}") for k, c in made.items()))
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)
    scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select(F.col("id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"), "candidate", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """labelled: candidate, before, after, path, label, to learn from instead of the default table."""
    model = train_forest(labelled if labelled is not None else labelled_findings(spark))
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, path_col="source")
