"""Secret findings and the removal of false ones, with DataFrame functions alone.

Candidates are runs of 16 or more characters that keys and tokens are made of,
with base64 padding but without the full stops after them, and shorter values
that are assigned to a secret's name.  Features of a candidate: its length, the
rates of its character transitions (between lower case, upper case, digits and
signs; and the share of letter pairs that are common in prose), how much of it
words of a small dictionary cover, whether it is part of a path, and the words
before and after it, by kind and by hash.  A random forest, trained on labelled
findings, scores them.

There is no table of labelled findings: ``example_findings`` makes them by
rule, so accuracy on held-out ones says that the forest has learned the rules.
Users with findings of their own pass them to ``train``.

The main path has no Python workers: extraction, features and scoring run in
the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LONG = r"[A-Za-z0-9+/_.\-]{16,}+(?:={1,2}(?![=A-Za-z0-9+/_\"'`\-]))?+"
#: A shorter value assigned to a secret's name; the value is the group.
ASSIGNED = r"""(?i:passw|pwd|secret|token|api.?key|access.?key|credential|auth)\w{0,20}["'`]?\s{0,2}[:=]\s{0,2}["'`]?([^\s"'`,;<>(){}\[\]]{6,15})(?![^\s"'`,;<>(){}\[\]])"""
CANDIDATE = f"{LONG}|{ASSIGNED}"
LEAST = 16
#: Characters before and after a candidate that its neighbouring words come from.
CONTEXT = 48
#: Hash buckets of a neighbouring word.
BUCKETS = 32
#: Candidates whose places are counted together; see ``_starts``.
TOGETHER = 256
TREES, DEPTH, SEED = 40, 8, 42
SECRET_FROM = 0.5
#: Labelled findings that `example_findings` makes.
FINDINGS = 6000

#: Words that candidates which are no secrets are often made of.
DICTIONARY = [
    "about", "access", "account", "action", "address", "admin", "agent", "apache", "archive", "article", "assets", "author", "backup", "balance", "batch", "bench", "block", "board", "branch", "browser", "build", "business", "button", "cache", "center", "change", "channel", "child",
    "class", "client", "cloud", "cluster", "code", "color", "column", "command", "comment", "commit", "common", "company", "component", "config", "connect", "contact", "container", "content", "context", "control", "core", "count", "country", "create", "current", "customer", "data", "database",
    "date", "debug", "default", "delete", "deploy", "description", "design", "detail", "develop", "device", "display", "document", "domain", "download", "driver", "dummy", "editor", "element", "email", "engine", "error", "event", "example", "export", "feature", "field", "file", "filter", "folder", "font", "form",
    "format", "function", "general", "global", "group", "handler", "header", "home", "http", "image", "import", "index", "info", "input", "install", "item", "java", "label", "layer", "layout", "library", "license", "line", "link", "list", "load", "local", "login", "main", "manager", "master", "message",
    "method", "model", "module", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "param", "parent", "path", "placeholder", "platform", "plugin", "point", "policy", "private", "process", "product", "profile", "project", "public", "python", "query", "record",
    "release", "report", "request", "resource", "response", "result", "role", "sample", "schema", "script", "search", "section", "server", "service", "session", "setting", "source", "static", "status", "string", "style", "system", "table",
]
#: Letter pairs that are common in prose.
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce"]

_NAMED = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|auth|credential|bearer|private.?key|client.?key)\W{0,3}\w*\W{0,4}$"
_ASSIGNED = r"""[=:]\s*["'`]?$"""
_HARMLESS = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|example|sample|dummy|placeholder|etag|revision|fixture|test)\W{0,3}\w*\W{0,4}$"

_KINDS = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "sign": "^A-Za-z0-9"}
TRANSITIONS = {f"{a}_{b}": f"(?<=[{_KINDS[a]}])(?=[{_KINDS[b]}])" for a in _KINDS for b in _KINDS if a != b}
#: The last word before, the one before that, and the first word after.
NEIGHBOURS = {"last": ("before", r"([A-Za-z]+)[^A-Za-z]*$"), "second": ("before", r"([A-Za-z]+)[^A-Za-z]+[A-Za-z]+[^A-Za-z]*$"), "next": ("after", r"^[^A-Za-z]*([A-Za-z]+)")}
FEATURES = [
    "length", "digits", "uppers", "signs", "prose_pairs", "distinct", "hex", "covered", "slashes", "in_path", "named", "assigned", "quoted", "harmless", "uuid",
    *TRANSITIONS, *[f"{n}_{k}" for n in NEIGHBOURS for k in range(BUCKETS)],
]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(steps: Column) -> Column:
    """The sum of all steps before each. Sums run over blocks, then within them, so that no long array grows one by one."""
    def running(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
        )

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / TOGETHER).cast("int")), lambda b: F.slice(steps, b * TOGETHER + 1, TOGETHER))
    sums = lambda some: running(F.transform(some, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
    return _let(chunks, lambda some: _let(sums(some), lambda start: F.flatten(F.transform(some, lambda c, b: running(c, F.get(start, b))))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, candidate, before, after`` for every candidate in every whole text; ``start`` counts code points from 0.

    Null and empty texts have none; repeated rows are searched each for itself;
    a text's cost grows with its length and little more, however many
    candidates it has; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    pieces = F.struct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between"))

    def one(p: Column, start: Column, i: Column) -> Column:
        match, gap = F.get(p["found"], i), F.get(p["between"], i)
        short = F.regexp_extract(match, f"^{ASSIGNED}$", 1)
        own = F.when(F.length(short) > 0, short).otherwise(F.rtrim(match, F.lit(".")))
        lead = F.when(F.length(short) > 0, F.substring(match, F.lit(1), F.length(match) - F.length(short))).otherwise(F.lit(""))
        tail = F.when(F.length(short) > 0, F.lit("")).otherwise(F.substring(match, F.length(own) + 1, F.length(match)))
        return F.struct(
            (start + F.length(gap) + F.length(lead)).alias("start"), own.alias("candidate"),
            F.right(F.concat(F.coalesce(F.get(p["found"], i - 1), F.lit("")), gap, lead), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(tail, F.get(p["between"], i + 1), F.coalesce(F.get(p["found"], i + 1), F.lit(""))), F.lit(CONTEXT)).alias("after"),
            ((F.length(own) >= LEAST) | (F.length(short) > 0)).alias("kept"),
        )

    steps = lambda p: F.transform(p["found"], lambda m, i: F.length(F.get(p["between"], i)) + F.length(m))
    every = _let(pieces, lambda p: _let(steps(p), lambda s: F.transform(_starts(s), lambda start, i: one(p, start, i))))
    return rows.select("id", F.explode(F.filter(every, lambda x: x["kept"])).alias("x")).select("id", "x.start", "x.candidate", "x.before", "x.after")


def _count(column: Column, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows with candidate, before and after; null context is empty."""
    c, before, after = F.coalesce("candidate", F.lit("")), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    flag = lambda x: x.cast("double")
    return found.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _count(c, "[0-9]") / n,
            "uppers": _count(c, "[A-Z]") / n,
            "signs": _count(c, "[^A-Za-z0-9]") / n,
            "prose_pairs": _count(F.lower(c), f"(?={'|'.join(PAIRS)})") / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
            "hex": flag(c.rlike(r"^([0-9a-f]+|[0-9A-F]+)$")),
            "covered": (n - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / n,
            "slashes": _count(c, "/") / n,
            "in_path": flag(before.rlike(r"(://|www\.|[/\\~])\S*$") | c.rlike(r"(/[A-Za-z0-9_.\-]+){2,}|\.(html?|php|py|js|css|png|jpe?g|gif|txt|md|com|org|net|json|xml)$")),
            "named": flag(before.rlike(_NAMED)),
            "assigned": flag(before.rlike(_ASSIGNED)),
            "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "harmless": flag(before.rlike(_HARMLESS) | F.lower(c).rlike("example|sample|dummy|placeholder|xxxx|your.?(api|key|token)")),
            "uuid": flag(c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
            **{name: _count(c, pattern) / n for name, pattern in TRANSITIONS.items()},
            **{f"_{name}": _bucket(before if side == "before" else after, pattern) for name, (side, pattern) in NEIGHBOURS.items()},
        }
    ).withColumns({f"{name}_{k}": (F.col(f"_{name}") == k).cast("double") for name in NEIGHBOURS for k in range(BUCKETS)})


def _bucket(context: Column, pattern: str) -> Column:
    """The hash bucket of a neighbouring word; -1 where there is none."""
    word = F.lower(F.regexp_extract(context, pattern, 1))
    return F.when(word == "", F.lit(-1)).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


def example_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """``candidate, before, after, label``: made findings, about half of them secrets, the same for each seed.

    Secrets are random keys in the alphabets that services use, after a name or
    an assignment.  Others are words, paths, addresses, numbers, rules and
    identifiers, and random values that their neighbours call a checksum,
    commit, example or the like.
    """
    bit = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed * 1000 + k)), F.lit(m))
    pick = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (bit(k, len(values)) + 1).cast("int"))
    digest = lambda k: F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed * 1000 + k))), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest(1))), "=", "")
    alphanumeric = F.regexp_replace(base64, "[+/]", "k")
    take = lambda text, k, low, high: F.substring(text, F.lit(1), (F.lit(low) + bit(k, high - low + 1)).cast("int"))
    secret = F.element_at(
        F.array(digest(2), F.substring(digest(2), 1, 32), F.substring(digest(2), 1, 40), F.upper(F.substring(digest(2), 1, 32)), base64, take(base64, 3, 20, 40), take(alphanumeric, 4, 20, 40), F.concat(pick(5, ["sk_live_", "ghp_", "xoxb-", "AKIA", "pk-", "glpat-"]), take(alphanumeric, 6, 16, 32))),
        (bit(7, 8) + 1).cast("int"),
    )
    short_secret = F.concat(take(alphanumeric, 60, 7, 13), pick(61, ["!", "#", "", "_9", "$x"]))
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "API_KEY", "client_secret", "SECRET_KEY", "credentials"]
    near = F.concat(pick(8, ["it was ", "", "set ", "const ", "the ", "export "]), pick(9, names), pick(10, [" = ", "=", ": ", " = \"", "=\"", ": '", "\": \"", " "]))
    harmless_near = F.concat(pick(11, ["in ", "", "the ", "see "]), pick(12, ["commit", "sha256", "md5", "checksum", "digest", "hash", "uuid", "example", "ETag", "revision", "commit id"]), pick(13, [" ", ": ", "=", " = \"", "\": \""]))
    word = lambda k: pick(k, DICTIONARY)
    pair = lambda k: pick(k, PAIRS)
    uuid = F.concat_ws("-", F.substring(digest(14), 1, 8), F.substring(digest(14), 9, 4), F.substring(digest(14), 13, 4), F.substring(digest(14), 17, 4), F.substring(digest(14), 21, 12))
    invented = F.concat(*[pair(20 + k) for k in range(9)])
    # words of prose, as many as there are buckets and more, stand before findings of either kind
    prose = F.concat(pair(32), pair(33), pick(34, ["", "s", "ing", "ly"]), pick(35, [" ", ", ", ". ", " \""]))
    short_other = F.element_at(F.array(F.substring(F.concat(word(62), word(63)), 1, 15), F.rpad(word(62), 6, "x"), F.substring(invented, 1, 10), F.lit("required"), F.lit("undefined"), F.lit("changeme"), F.lit("xxxxxxxx"), F.lit("<value>"), F.lit("string;")), (bit(64, 9) + 1).cast("int"))
    plain_near = F.concat(pick(30, ["the ", "of ", "", "and ", "see ", "is ", "(", "\n", "http://", "https://www.", "/", "file "]), pick(31, ["", "", "a ", "for "]))
    other = F.element_at(
        F.array(
            F.concat_ws("_", word(40), word(41), word(42)), F.concat(word(40), F.initcap(word(41)), F.initcap(word(42)), F.initcap(word(43))), F.concat_ws("/", word(40), word(41), word(42), F.concat(word(43), F.lit(".html"))), F.concat_ws(".", word(40), word(41), F.lit("example.com/x")),
            F.concat(bit(44, 10**9).cast("string"), bit(45, 10**9).cast("string")), F.repeat(pick(46, ["=", "-", "_", ".", "*=", "-="]), (bit(47, 40) + 16).cast("int")), uuid, invented, F.concat_ws("-", word(40), bit(48, 1000).cast("string"), word(41), word(42)), F.concat_ws("-", invented, word(40)), F.lit("your_api_key_goes_here"), F.concat(F.lit("xxxxxxxxxxxxxxxx"), word(40)),
        ),
        (bit(49, 12) + 1).cast("int"),
    )
    kind = bit(50, 12)
    rows = spark.range(n).select(
        F.when(kind < 5, secret).when(kind == 10, short_secret).when(kind == 11, short_other).when(kind < 7, F.element_at(F.array(digest(2), F.substring(digest(2), 1, 40), F.substring(digest(2), 1, 32), uuid), (bit(51, 4) + 1).cast("int"))).otherwise(other).alias("candidate"),
        F.when((kind < 5) | (kind >= 10), F.concat(F.when(bit(54, 2) == 0, prose).otherwise(""), near)).when(kind < 7, harmless_near).when(bit(52, 6) == 0, near).when(bit(52, 6) < 4, prose).otherwise(plain_near).alias("before"),
        F.concat(pick(53, ["\"", "'", " ", "\n", ",", ". ", "\" ", ""]), F.when(bit(55, 2) == 0, F.concat(pair(36), pair(37))).otherwise("")).alias("after"),
        ((kind < 5) | (kind == 10)).cast("double").alias("label"),
    )
    return rows


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A random forest on labelled findings (candidate, before, after, label 0 or 1)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings.where("label is not null")))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors.select("features", "label").coalesce(1))


def score(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``found`` with ``score``, the forest's probability that a finding is a secret."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(with_features(found))
    model = model.copy({model.featuresCol: "_features", model.probabilityCol: "_probability", model.rawPredictionCol: "_raw", model.predictionCol: "_prediction"})
    return model.transform(vectors).select(*found.columns, F.element_at(vector_to_array("_probability"), 2).alias("score"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, candidate, before, after, score`` of every candidate.

    Null and empty texts have none; repeated rows are scanned each for itself.
    """
    return score(candidates(docs, id_col, text_col), model)


_fitted: dict[str, RandomForestClassificationModel] = {}


def standard_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest trained on ``example_findings``, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _fitted:
        _fitted.clear()
        _fitted[app] = train(example_findings(spark))
    return _fitted[app]


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, secret_sha256, score, is_secret`` of every candidate in all documents; candidates themselves are not shown."""
    found = scan(docs, standard_model(spark))
    return found.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), "score", (F.col("score") >= SECRET_FROM).alias("is_secret"))
