"""Operator 3: secret scan with a random forest against false positives.

1. Candidates are headers of private keys, what follows a credential key (any run without
   blanks), passwords in URLs, and elsewhere runs of twelve or more credential characters
   with a digit in them.
2. Features of a candidate: its length; character transitions (changes of character class,
   and how likely its letter pairs are in the corpus' words); dictionary coverage (share
   of its letters in words that ``COMMON`` documents have); path and address marks; the
   word in front, hashed, and how it is joined to the candidate.
3. A random forest is trained on labelled findings: a table given by the caller, or else
   those that the rules in `rule_labels` are sure of. Of either class ``TRAINING_ROWS``
   distinct values at most (those with the smallest hashes) train it, so rare secrets all
   do, and both classes weigh the same. It decides on every candidate, except that what
   the rules are sure is a secret stays one, unless the caller's labels say otherwise.

All by built-in functions and the DataFrame API of the ML library. Without labels of both
classes nothing can be trained, and the rules alone decide.

Cases: null and empty texts have no candidates; rows are judged each by itself, repeated
ones too; other columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.pii import document_words
from cohortlab.llm.spans import matches
from cohortlab.session import run_folder, staged

#: A word is in the dictionary when this many documents have it.
COMMON = 20
#: Distinct values of each class that the forest learns from, at most.
TRAINING_ROWS = 20_000
TREES, DEPTH = 20, 6
WORD_PLACES = 16

_WORDS = r"(?i:token|password|passwd|secret|api_?key|access_?key|auth)"
_HEADER = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"
# the first look-behind is quick and keeps most places from the second; what closes or
# ends a list or a sentence in brackets behind the value is not of it
_GIVEN = r"(?<=[:=]\s{0,8}[\"']?)(?=[^\s\"'])(?<=" + _WORDS + r"[\"']?\s{0,8}[:=]\s{0,8}[\"']?)\S+?(?=[\"'][\s,;:)\]}>]|[\"']?[,;)\]}>]{0,8}(?:\s|\z))"
_IN_URL = r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s/?#]+(?=@)"
_RUN = r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*+[0-9])[A-Za-z0-9+/_.@-]{12,}+={0,2}"
CANDIDATE = f"{_HEADER}|{_GIVEN}|{_IN_URL}|{_RUN}"
_KEY = _WORDS + r"[\"']?\s*[:=]\s*[\"']?$"
_KNOWN = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+|-----BEGIN .*)$"
#: Words and calls that code has after a key; the forest decides on them.
_NO_VALUE = r"(?i)^(?:none|null|nil|true|false|undefined|[<\[{$%*(].*|.*\(.*)$"
_HARMLESS = r"^(?:[^@]+@[A-Za-z0-9.-]+|[0-9.+/-]+|[0-9]+(?:\.[0-9]+)+|(?:www\.|https?:).*|/?(?:[a-z0-9_.-]+/)+[a-z0-9_.-]*)$"

NUMBERS = ["length", "switches", "pair_fit", "coverage", "slashes", "at", "dots", "digits", "joined", "quoted"]


def rule_labels(value: Column, before: Column, after: Column) -> Column:
    """1 for a known format, a value given to a key or a password in a URL, 0 for addresses and
    numbers, else null.

    After a key it has to look given: six characters with a digit, or joined by a bare
    equals sign or quoted. A word after a colon can be prose, and the forest decides.
    """
    key = F.rlike(before, F.lit(_KEY))
    given = (F.length(value) >= 6) & F.rlike(value, F.lit("[0-9]")) | F.rlike(before, F.lit(r"(?:[^\s]=|[\"'])$"))
    url = F.rlike(before, F.lit(r"://[^\s:/@]*:$")) & F.startswith(after, F.lit("@"))
    secret = F.rlike(value, F.lit(_KNOWN)) | key & given & ~F.rlike(value, F.lit(_NO_VALUE)) | url
    return F.when(secret, F.lit(1.0)).when(~key & F.rlike(value, F.lit(_HARMLESS)), F.lit(0.0))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``row`` and the ``found`` candidates with the text before and after."""
    rest = [c for c in docs.columns if c not in ("text", "row", "found")]
    text = F.col("text")

    def around(m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - 40, F.lit(0)) + 1, F.least(m["start"], F.lit(40)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), before.alias("before"), F.substring(text, m["end"] + 1, F.lit(8)).alias("after"))

    found = F.transform(matches(F.coalesce(text, F.lit("")), CANDIDATE), around)
    return docs.select(F.monotonically_increasing_id().alias("row"), *rest, found.alias("found"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.greatest(whole, F.lit(1)), F.lit(0.0))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """One row per candidate (row, start, end, value, before, after) with its features and ``word_k`` places.

    ``words`` is the dictionary: (term, n_docs).
    """
    rows = found.select("row", F.explode("found").alias("c")).select("row", "c.*")
    value = F.col("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    word = F.lower(F.regexp_extract("before", r"([\p{L}_]+)[^\p{L}_]*$", 1))
    size = F.length("value")
    rows = rows.select(
        "row", "start", "end", "value", "before", "after",
        size.cast("double").alias("length"),
        _share(F.length(classes) - 1, size - 1).alias("switches"),
        _share(F.length(F.regexp_replace(value, "[^/]", "")), size).alias("slashes"),
        F.contains(value, F.lit("@")).cast("double").alias("at"),
        _share(F.length(F.regexp_replace(value, "[^.]", "")), size).alias("dots"),
        _share(F.length(F.regexp_replace(value, "[^0-9]", "")), size).alias("digits"),
        F.rlike("before", F.lit(r"[:=]\s*[\"']?$")).cast("double").alias("joined"),
        (F.rlike("before", F.lit("[\"']$")) & F.rlike("after", F.lit("^[\"']"))).cast("double").alias("quoted"),
        *((F.pmod(F.xxhash64(word), F.lit(WORD_PLACES)) == k).cast("double").alias(f"word_{k}") for k in range(WORD_PLACES)),
    )
    return rows.join(_coverage(rows, words), ["row", "start"], "left").join(_pair_fit(rows, words), ["row", "start"], "left").fillna(0.0, ["coverage", "pair_fit"])


def _coverage(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Share of a candidate's letters that are in dictionary words."""
    runs = F.regexp_extract_all(F.lower("value"), F.lit(r"[a-z]{3,}"), F.lit(0))
    each = rows.select("row", "start", "length", F.explode(runs).alias("term"))
    hit = each.join(words.select("term"), "term", "left_semi")
    return hit.groupBy("row", "start").agg((F.sum(F.length("term")) / F.max("length")).alias("coverage"))


def _pair_fit(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Mean log-probability of a candidate's letter pairs, as the dictionary's words have them."""

    def pairs(text: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2)), lambda p: F.rlike(p, F.lit("^[a-z]{2}$")))

    counted = words.select("n_docs", F.explode(pairs(F.col("term"))).alias("pair")).groupBy("pair").agg(F.sum("n_docs").alias("n"))
    first = counted.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("of"))
    fit = counted.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a")).select("pair", F.log(F.col("n") / F.col("of")).alias("fit"))
    each = rows.select("row", "start", F.explode(pairs(F.lower("value"))).alias("pair"))
    known = each.join(F.broadcast(fit), "pair", "left")  # 26 x 26 rows at most
    return known.groupBy("row", "start").agg(F.avg(F.coalesce("fit", F.lit(-10.0))).alias("pair_fit"))


def training_sample(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """(label, value, weight, ``names``): ``most`` distinct values of each label at most.

    Which values, and the one row of features of each, depend on contents alone and not on
    how the table is dealt to files.
    """
    values = rows.where("label IS NOT NULL").groupBy("label", "value").agg(F.min(F.struct(*names)).alias("f"))
    values = staged(values.select("label", "value", "f.*"), "labelled")
    sample = [values.where(F.col("label") == k).orderBy(F.xxhash64("value"), "value").limit(most) for k in (0.0, 1.0)]
    sample = staged(sample[0].union(sample[1]).coalesce(1), "training")
    sizes = sample.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weights = sizes.crossJoin(total).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
    return sample.join(F.broadcast(weights), "label")


def _stored(forest: RandomForestClassificationModel, spark: SparkSession) -> RandomForestClassificationModel:
    """The forest by way of the shared folder: without the training summary, which holds the session."""
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}/forest"
    forest.save(path)
    return RandomForestClassificationModel.load(path)


def scan(docs: DataFrame, labelled: DataFrame | None = None, common: int = COMMON, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without text, with ``n_candidates`` and ``secrets``.

    ``secrets`` is array<struct<start, end, probability>>, places in code points.
    ``labelled`` (value, label) gives the labelled findings; by default the rules do.
    """
    docs = docs.drop("n_candidates", "secrets")
    rest = [c for c in docs.columns if c not in ("text", "row", "found")]
    found = staged(candidates(docs), "candidates")
    words = staged(document_words(docs.select("text")).where(F.col("n_docs") >= common), "words")
    rows = features(found, words)
    rule = rule_labels(F.col("value"), F.col("before"), F.col("after"))
    if labelled is None:
        rows = rows.withColumn("label", rule)
    else:
        given = labelled.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(given, "value", "left")
    names = [*NUMBERS, *(f"word_{k}" for k in range(WORD_PLACES))]
    vector = VectorAssembler(inputCols=names, outputCol="features")
    rows = staged(rows.withColumn("rule", rule).select("row", "start", "end", "value", "label", "rule", *names), "features")
    training = staged(training_sample(rows, names, training_rows), "training")
    classes = training.groupBy("label").count().count()
    if classes == 2:
        forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(vector.transform(training))
        rows = _stored(forest, docs.sparkSession).transform(vector.transform(rows))
        sure = (F.col("rule") == 1) & (F.coalesce("label", F.lit(1.0)) == 1)
        rows = rows.withColumn("probability", F.when(sure, F.lit(1.0)).otherwise(vector_to_array("probability")[1]))
    else:
        rows = rows.withColumn("probability", F.coalesce("rule", F.lit(0.0)))
    hits = rows.where("probability > 0.5").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "probability"))).alias("secrets"))
    out = found.withColumn("n_candidates", F.size("found").cast("long")).drop("found").join(hits, "row", "left")
    none = F.array().cast(hits.schema["secrets"].dataType)
    return out.select(*rest, "n_candidates", F.coalesce("secrets", none).alias("secrets"))
