"""Secrets in texts, with a random forest that removes false findings. DataFrame functions only.

A candidate is a value assigned to a credential's name, of any characters but white space and quotes; a
run of at least 12 letters, digits and ``+ / _ -`` with a digit in it; or an access key id. Each is described by its
length, the shares of kinds of characters, the transitions from one kind to another, how much of it
known words cover, where it comes from and the words around it. A random forest trained on
labelled findings gives the probability that it is a secret.

Without findings of the user's own, findings are planted: values of known kinds are made by a seeded rule and
put into pieces of the table's texts. What kind a value is decides its label, not what stands around it. Secrets come with and without
a credential's name; so do the others, which are digests, numbers, identifiers, paths, placeholders and words.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import small, stored

NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credentials?)"
ASSIGNED = NAME + r"""["'`]?\s{0,3}(?:=>|:=|[:=])\s{0,3}["'`]?"""
RUN = r"(?<![A-Za-z0-9+/_-])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}={0,2})"
CANDIDATE = ASSIGNED + r"""[^\s"'`<>]{4,}|""" + RUN
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credential)"
HARMLESS = r"(?i)(sha\d*|md5|commit|uuid|isbn|digest|checksum|example|sample|dummy|test|phone|card|order)"
#: Most labelled findings of each label that the forest is trained on.
FINDINGS_PER_LABEL = 5000
#: Findings planted, and most pieces of texts that they are planted into.
PLANTED = 3900
CONTEXTS = 500
TREES = 30
DEPTH = 9
#: How often a run of letters stands as a word of its own, in parts of the number of documents, to be a known word; twice at least.
KNOWN_SHARE = 0.002
#: Buckets of the words before and after a candidate.
BEFORE, AFTER = 16, 8

_KINDS = str.maketrans({**dict.fromkeys(string.ascii_uppercase, "U"), **dict.fromkeys(string.ascii_lowercase, "L"), **dict.fromkeys(string.digits, "D"), **dict.fromkeys("+/_-=", "S")})
_ALPHABET = string.ascii_letters + string.digits + "+/_-="
STEPS = ["UU", "UL", "UD", "US", "LU", "LL", "LD", "LS", "DU", "DL", "DD", "DS", "SU", "SL", "SD", "SS"]


def candidates(docs: DataFrame, path: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: ``doc_id``, ``ordinal``, ``begin``, ``value``, ``before``, ``after``, ``path``, and the columns ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    d = docs.select("doc_id", *keep, text.alias("_text"), where.alias("path")).filter(F.col("_text").rlike(CANDIDATE))
    d = d.select("doc_id", *keep, "path", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("_text", CANDIDATE, -1).alias("_gaps"))
    # what stands around each candidate, and how far it and the gap before reach; the name of a value is no part of it
    name = lambda v: F.regexp_extract(v, "^" + ASSIGNED, 0)
    near = F.transform(
        "_found",
        lambda v, i: F.struct(
            F.substr(v, F.length(name(v)) + 1).alias("rest"), F.length(name(v)).alias("named"), F.length(v).alias("whole"),
            F.concat(F.right(F.get("_gaps", i), F.lit(80)), name(v)).alias("left"), F.left(F.get("_gaps", i + 1), F.lit(80)).alias("right"),
            F.length(F.get("_gaps", i)).alias("gap"),
        ),
    )
    begins = F.aggregate(
        "_near",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["whole"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"] + x["named"]).alias("out")),
        lambda a: a["out"],
    )
    d = d.select("doc_id", *keep, "path", near.alias("_near")).withColumn("_begins", begins)
    d = d.select("doc_id", *keep, "path", "_begins", F.posexplode("_near").alias("ordinal", "_x"))
    # marks at the end of an assigned value belong to the sentence
    bare = F.regexp_replace("_x.rest", r"[.,;:)\]}]+$", "")
    value = F.when((F.col("_x.named") > 0) & (F.length(bare) >= 4), bare).otherwise(F.col("_x.rest"))
    return d.select(
        "doc_id", *keep, "ordinal", F.get("_begins", F.col("ordinal")).cast("long").alias("begin"), value.alias("value"),
        F.regexp_extract("_x.left", r"((?:\S+\s+){0,2}\S*)$", 1).alias("before"), F.regexp_extract("_x.right", r"^(\S*\s*\S*)", 1).alias("after"), "path",
    )


def known_words(docs: DataFrame, found: DataFrame, share: float = KNOWN_SHARE) -> DataFrame:
    """Runs of letters in candidates that are words of the corpus: ``run``, one row each, counted over all texts; stored.

    A word stands there ``share`` times a document, so a text is judged alike in tables of any size.
    """
    runs = found.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run")).distinct()
    runs = stored(runs, "letter-runs")
    least = max(2.0, share * docs.count())
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+")).alias("run"))
    counted = words.filter(F.length("run") >= 3).join(small(runs), "run", "left_semi").groupBy("run").count()
    return stored(counted.filter(F.col("count") >= least).select("run"), "known-words")


def _share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.length(value)


def _bucket(word: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(n))


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the numbers the forest judges by; the names are in ``FEATURES``."""
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    covered = runs.join(small(words), "run").groupBy("value").agg(F.sum(F.length("run")).alias("_covered"))
    kinds = F.translate("value", _ALPHABET, _ALPHABET.translate(_KINDS))
    d = found.join(covered, "value", "left").withColumn("_kinds", kinds)
    # one candidate may be all there is; its share of changes is then 0
    pairs = F.greatest(F.length("value") - 1, F.lit(1))
    steps = {f"step_{s}": F.regexp_count("_kinds", F.lit(f"{s[0]}(?={s[1]})")) / pairs for s in STEPS}
    numbers = {
        "length": F.length("value").cast("double"),
        "upper": _share(F.col("value"), "[A-Z]"), "lower": _share(F.col("value"), "[a-z]"), "digits": _share(F.col("value"), "[0-9]"),
        "hex": _share(F.col("value"), "[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        **steps,
        "coverage": F.coalesce(F.col("_covered") / F.length("value"), F.lit(0.0)),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "path_harmless": F.col("path").rlike(HARMLESS).cast("double"),
        "path_config": F.col("path").rlike(r"(?i)(\.env|config|settings|\.ya?ml|\.ini|\.pem)").cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "credential": F.col("before").rlike(CREDENTIAL).cast("double"),
        "harmless": (F.col("before").rlike(HARMLESS) | F.col("after").rlike(HARMLESS)).cast("double"),
        "other": _share(F.col("value"), "[^A-Za-z0-9+/_=-]"),
        **{f"before_{k}": (_bucket(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1), BEFORE) == k).cast("double") for k in range(BEFORE)},
        **{f"after_{k}": (_bucket(F.regexp_extract("after", r"^[^\p{L}]*(\p{L}+)", 1), AFTER) == k).cast("double") for k in range(AFTER)},
    }
    return d.withColumns(numbers).drop("_covered", "_kinds")


FEATURES = [
    "length", "upper", "lower", "digits", "hex", "distinct", *(f"step_{s}" for s in STEPS), "coverage", "path_depth", "path_harmless", "path_config",
    "assigned", "quoted", "credential", "harmless", "other", *(f"before_{k}" for k in range(BEFORE)), *(f"after_{k}" for k in range(AFTER)),
]


def _pick(n: Column, *choices) -> Column:
    return F.element_at(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), (F.pmod(n, F.lit(len(choices))) + 1).cast("int"))


def planted(docs: DataFrame, path: str = "source", rows: int = PLANTED) -> DataFrame:
    """Texts with a planted value each: ``doc_id``, ``text``, ``source``, and of the value ``label``, ``at``, ``size`` and ``kind``.

    Made by a rule from the number of the row, and from at most ``CONTEXTS`` pieces of texts, the first by a hash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    d = docs.select(text.alias("t"), where.alias("source")).filter(F.length("t") >= 20).withColumn("h", F.xxhash64(F.lit("plant"), "t"))
    cut = F.pmod("h", F.greatest(F.length("t") - 60, F.lit(1))).cast("int") + 1
    pieces = d.select("h", "source", F.substr("t", cut, F.lit(60)).alias("left"), F.substr("t", cut + 60, F.lit(60)).alias("right")).orderBy("h", "left", "source").limit(CONTEXTS)
    pieces = stored(pieces, "contexts")
    n = pieces.count()
    if not n:
        pieces, n = spark.range(1).select(F.lit(0).alias("h"), *[F.lit("").alias(c) for c in ("source", "left", "right")]), 1
    numbered = pieces.select("source", "left", "right", (F.row_number().over(W.orderBy("h", "left", "source")) - 1).alias("nth"))  # CONTEXTS rows at most
    # candidates of the piece's own are taken out
    plain = [F.regexp_replace(F.regexp_replace(c, CANDIDATE, " "), NAME, " ").alias(c) for c in ("left", "right")]
    r = spark.range(rows).withColumn("nth", F.col("id") % n).join(F.broadcast(numbered.select("nth", "source", *plain)), "nth")
    digits = lambda salt: F.sha2(F.concat(F.lit(f"finding {salt} "), F.col("id").cast("string")), 256)
    r = r.withColumns({"h": digits(1), "g": digits(2)})
    # parts that several kinds are made of
    words = F.filter(F.split(F.concat_ws(" ", "left", "right", F.lit("other words name text")), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    r = r.withColumns(
        {"code": F.translate(F.base64(F.unhex("h")), "\r\n=", ""), "number": F.translate(F.substring("h", 1, 16), "abcdef", "012345"), "words": words}
        | {f"d{k}": F.conv(F.substring("g", 1 + 4 * k, 4), 16, 10).cast("long") for k in range(8)}
    )
    r = r.withColumn("letters", F.translate("code", "0123456789+/", "qwertyuiopas"))
    h, code, letters, number = (F.col(c) for c in ("h", "code", "letters", "number"))
    dice = lambda k: F.col(f"d{k}")
    word = lambda k: F.element_at("words", (F.pmod(dice(k), F.size("words").cast("long")) + 1).cast("int"))
    credential = _pick(dice(0), "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access-key", "auth", "Bearer", "TOKEN", "Password", "credentials")
    named = F.concat(credential, _pick(dice(1), ": ", "=", " = ", ' = "', ": '", '="', " : "))
    neutral = _pick(dice(1), "", "", "see ", "with ", "id ", "value: ", "x = ", '"')
    size = lambda low, high: (F.lit(low) + F.pmod(dice(2), F.lit(high - low + 1))).cast("int")
    kinds = [
        ("access key id", 1, neutral, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(code, 1, 16), "+/", "XZ")))),
        ("named code", 1, named, F.substr(code, F.lit(1), size(16, 42))),
        ("named hex", 1, named, F.substr(h, F.lit(1), _pick(dice(2), 32, 40, 40, 64))),
        ("named password", 1, named, F.concat(F.substr(code, F.lit(1), size(3, 6)), _pick(dice(3), "!", "@", "#", "$", "-", "."), F.substr(code, F.lit(9), size(3, 6)))),
        ("named letters", 1, named, F.concat(F.substr(letters, F.lit(1), size(6, 16)), _pick(dice(3), "", "!", "?x", "%u"))),
        ("code alone", 1, neutral, F.substr(code, F.lit(1), size(30, 42))),
        ("marked code", 1, neutral, F.concat(_pick(dice(3), "ghp_", "xoxb-", "sk_live_", "glpat-"), F.translate(F.substring(code, 1, 36), "+/", "ab"))),
        ("digest", 0, F.concat(_pick(dice(1), "sha256", "sha1", "md5", "commit", "digest", "checksum", "etag"), _pick(dice(0), " ", ": ", "=", ' "')), F.substr(h, F.lit(1), _pick(dice(2), 32, 40, 40, 64))),
        ("uuid", 0, neutral, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))),
        ("number", 0, _pick(dice(0), neutral, "card ", "order ", "phone ", "no. "), _pick(dice(3), number, F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4)), F.concat_ws("-", F.substring(number, 1, 8), F.substring(number, 9, 6)))),
        ("identifier", 0, neutral, F.concat_ws("_", word(3), word(4), F.lit("v2"), F.substring(number, 1, 3))),
        ("path", 0, neutral, F.concat_ws("/", word(3), F.lit("2021"), word(4), F.substring(number, 1, 6))),
        ("placeholder or word", 0, named, _pick(dice(3), "changeme", "required", "your_password_here", "xxxxxxxx", "example", "none", "********", "YOUR-TOKEN", word(4), word(5), word(6), word(7))),
    ]
    chosen = _pick(F.col("id"), *[F.struct(F.lit(k).alias("kind"), F.lit(y).alias("label"), b.alias("before"), v.alias("value")) for k, y, b, v in kinds])
    r = r.select("id", "source", "left", "right", chosen.alias("p"))
    close = F.when(F.col("p.before").rlike("[\"']$"), F.right("p.before", F.lit(1))).otherwise(F.lit(""))
    return r.select(
        F.col("id").alias("doc_id"), F.concat("left", F.lit(" "), "p.before", "p.value", close, F.lit(" "), "right").alias("text"), "source", "p.label", "p.kind",
        (F.length("left") + 1 + F.length("p.before")).cast("long").alias("at"), F.length("p.value").cast("long").alias("size"),
    )


def planted_findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """Candidates that cover a planted value, with its ``label`` and ``kind``; stored."""
    found = candidates(stored(planted(docs, path), "planted"), "source", ("label", "kind", "at", "size"))
    covers = (F.col("begin") <= F.col("at") + 2) & (F.col("begin") + F.length("value") >= F.col("at") + F.col("size") - 2)
    return stored(found.filter(covers).drop("at", "size"), "planted-findings")


def train(labelled: DataFrame, per_label: int = FINDINGS_PER_LABEL) -> RandomForestClassificationModel | None:
    """A forest from described findings with ``label``, at most ``per_label`` of each, the first by a hash.

    None unless there are findings of both labels.
    """
    at = F.xxhash64("value", "before", "after")
    sides = [labelled.filter(F.col("label") == y).select("label", *FEATURES, at.alias("_at")).orderBy("_at", *FEATURES).limit(per_label) for y in (0, 1)]
    sample = stored(sides[0].unionByName(sides[1]), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    sample = sample.repartition(1).sortWithinPartitions("_at", "label", *FEATURES)  # at most 2 * per_label rows; same forest on every run
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5).fit(ready)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Described findings with ``score`` (probability of a secret) and ``secret``; without a model all count as secrets."""
    if model is None:
        return found.withColumns({"score": F.lit(0.5), "secret": F.lit(True)})
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn("secret", F.col("score") >= 0.5).drop("features", "rawPrediction", "probability", "prediction")


def held_back(labelled: DataFrame, every: int = 5) -> DataFrame:
    """A forest's verdicts on every fifth of some labelled findings, by a hash of the value, after training on the others."""
    held = F.pmod(F.xxhash64(F.lit("held"), "value"), F.lit(every)) == 0
    return judge(labelled.filter(held), train(labelled.filter(~held)))


def find_secrets(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: ``doc_id``, ``ordinal``, ``begin``, ``length``, ``value_sha256``, ``score``, ``secret``.

    ``docs`` has ``doc_id``, ``text`` and perhaps ``path``. ``labelled`` are described
    findings with ``label``; without them, planted ones are learned from. Null and empty texts have no candidates, a null
    path counts as empty, repeated rows are scanned each. The values
    themselves are not returned. An empty table has none.
    """
    found = stored(candidates(docs, path), "candidates")
    taught = planted_findings(docs, path) if labelled is None else None
    both = found.select("value") if taught is None else found.select("value").unionByName(taught.select("value"))
    words = known_words(docs, both)
    about = stored(described(found, words), "described")
    model = train(labelled if taught is None else described(taught, words))
    return judge(about, model).select(
        "doc_id", "ordinal", "begin", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret"
    )
