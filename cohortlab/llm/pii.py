"""Operator 1: personal data, and words that give it away.

Base findings are emails, addresses, cards and phones by pattern. The method adds terms:
an entity is a value found by a pattern, or what it shares with others (the domain of an
email, the network of an address, the first digits of a card or phone); its terms are the
words within ``CONTEXT`` code points of it. Over the corpus,

    disclosure(t, e) = PMI(t, e) / IC(e) = log(N n_te / (n_t n_e)) / log(N / n_e)

is the share of the entity's information that the term gives away: 1 if every document
with the term has the entity beside it, 0 if the term tells nothing. n counts documents:
with the entity, with the term beside it, with the term anywhere in the text, and all. A
term seen beside the entity in ``support`` documents or more is *generalised* from
``least`` on and *removed* from ``remove`` on. With ``everywhere`` that is so in every
document that has the term, whether it names the entity or not; otherwise where a document
that has the entity has the term. With a support of 1 a word that is found nowhere but
beside an entity (a name, mostly) identifies it and goes.

All by built-in functions. Words are counted with map-side sums; the joins are by entity,
by term and by a hash of the text, where adaptive execution splits hot keys. What is added
to a text follows from the text, so texts are read again instead of stored, and move once.

Cases: null and empty texts have no findings; rows are documents, repeated ones count
each; an entity in every document discloses nothing; a term of several entities counts by
the strongest; very long texts are one row's arrays, never cut; an empty table gives an
empty one; other columns pass through, and those named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.spans import let, matches
from cohortlab.session import staged

CONTEXT = 64
SUPPORT = 3
GENERALISE, REMOVE = 0.6, 0.9
#: Hashes of terms are told apart up to this many; so many numbers are broadcast at most.
PLACES = 1 << 21

# The patterns of the contract. Possessive repeats match the same and need no stack; the
# look-behinds keep a failed run from being tried again from each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TERMS = ["generalise", "remove"]
_PART = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _kind(text: Column, kind: str) -> Column:
    """The findings of one kind; a quick look keeps most texts from the pattern."""
    if kind == "email":
        found = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL))
    elif kind == "ip":
        found = F.filter(matches(text, IP), lambda m: F.rlike(m["value"], F.lit(_PART)))
    elif kind == "card":
        fine = lambda d: F.length(d).between(14, 19) & luhn(d)
        found = F.filter(matches(text, CARD), lambda m: let(digits(m["value"]), fine))
    else:
        found = F.filter(F.when(F.contains(text, F.lit("+")), matches(text, PHONE)), lambda m: F.length(digits(m["value"])).between(10, 15))
    kind_no = F.lit(KINDS.index(kind))
    row = lambda m: F.struct(m["start"].alias("start"), kind_no.alias("kind_no"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    return F.coalesce(F.transform(found, row), F.array()).cast(SPANS)


def base_spans(text: Column) -> Column:
    """All base findings, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.flatten(F.array(*(_kind(text, k) for k in KINDS))))


def _entity(span: Column) -> Column:
    """The protected value: the same number or address written in another way is the same."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _kin(span: Column) -> Column:
    """What the value shares with others: domain, network, issuer or area."""
    number, value = digits(span["value"]), F.lower(span["value"])
    shared = (
        F.when(span["kind"] == "email", F.substring_index(value, "@", -1))
        .when(span["kind"] == "ip", F.substring_index(value, ".", 2))
        .when(span["kind"] == "card", F.substring(number, 1, 6))
        .otherwise(F.substring(number, 1, 4))
    )
    return F.concat(span["kind"], F.lit("/"), shared)


def _terms(text: Column, span: Column) -> Column:
    """Words of three letters or more around a finding, cut-off words left out."""
    left = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    left = F.when(span["start"] > CONTEXT, F.regexp_replace(left, r"^[\p{L}\p{M}]+", "")).otherwise(left)
    right = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"[\p{L}\p{M}]+$", "")).otherwise(right)
    words = F.regexp_extract_all(F.lower(F.concat(left, F.lit(" "), right)), F.lit(r"\p{L}[\p{L}\p{M}]{2,}"), F.lit(0))
    return F.array_distinct(words)


def words_of(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}]+"))


def document_words(docs: DataFrame) -> DataFrame:
    """(term, n_docs): in how many documents each word is."""
    rows = docs.select(F.explode(words_of(F.col("text"))).alias("term")).where(F.length("term") >= 3)
    return rows.groupBy("term").agg(F.count("*").alias("n_docs"))


def disclosing_terms(found: DataFrame, docs: DataFrame, support: int, least: float) -> DataFrame:
    """(entity, term, disclosure) from the corpus; ``found`` has row and entities."""
    total = found.count()
    beside = found.select("row", F.explode("entities").alias("e")).select("row", "e.entity", F.explode("e.terms").alias("term")).distinct()
    pairs = beside.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    entities = found.select("row", F.explode("entities.entity").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = pairs.join(entities, "entity").join(document_words(docs), "term")
    gain = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_docs") * F.col("n_entity")))
    known = F.log(F.lit(float(total)) / F.col("n_entity"))
    share = F.when(known > 0, F.round(gain / known, 9)).otherwise(0.0)
    return pairs.withColumn("disclosure", share).where(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def _added(text: Column, base: Column, terms: Column, remove: float) -> Column:
    """Findings of the document's disclosing terms, outside the base findings."""
    words = matches(text, r"\p{L}[\p{L}\p{M}]*+")

    def one(m: Column) -> Column:
        strongest = F.array_max(F.transform(F.filter(terms, lambda t: t["term"] == F.lower(m["value"])), lambda t: t["disclosure"]))
        kind_no = F.when(strongest >= remove, F.lit(5)).otherwise(F.lit(4))
        kind = F.when(strongest >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
        return F.struct(m["start"].alias("start"), kind_no.alias("kind_no"), kind.alias("kind"), m["end"].alias("end"), m["value"].alias("value"))

    listed = F.transform(terms, lambda t: t["term"])
    hit = F.filter(words, lambda m: F.array_contains(listed, F.lower(m["value"])))
    clear = F.filter(hit, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.transform(clear, one).cast(SPANS)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with findings replaced by their kind, removed terms by nothing."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", F.lit("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), mark)
        inside = s["start"] < done["at"]
        return F.struct(F.when(inside, done["at"]).otherwise(s["end"]).alias("at"), F.when(inside, done["out"]).otherwise(out).alias("out"))

    return F.aggregate(spans, begin, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def _owned(found: DataFrame, risky: DataFrame) -> DataFrame:
    """(key, term, disclosure) of the texts that have the entity."""
    owners = found.select("key", F.explode("entities.entity").alias("entity")).distinct()
    rows = owners.join(risky, "entity")
    return rows.groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))


def _anywhere(texts: DataFrame, risky: DataFrame) -> DataFrame:
    """(key, term, disclosure) of all texts that have the term."""
    strongest = staged(risky.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "terms")
    words = texts.select("key", F.explode(words_of(F.col("text"))).alias("term"))
    # few words are terms: most others stay where they are, also when there are too many terms to broadcast
    place = F.pmod(F.xxhash64("term"), F.lit(PLACES))
    places = strongest.select(place.alias("place")).distinct()
    return words.join(F.broadcast(places), place == F.col("place"), "left_semi").join(strongest, "term")


def sanitise(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE, remove: float = REMOVE, everywhere: bool = False) -> DataFrame:
    """``docs`` without text, with ``base``, ``spans`` (base and terms) and ``sanitised``.

    ``sanitised`` is null where nothing was found: the text stays as it is.
    """
    docs = docs.drop("base", "spans", "sanitised", "row", "entities", "terms")
    rest = [c for c in docs.columns if c != "text"]
    # a text's own words decide in the end, so a short hash does; entities are not compared again
    key = F.xxhash64("text") if everywhere else F.sha2("text", 256)
    base = base_spans(F.col("text")).alias("base")

    def named(s: Column) -> Column:
        terms = _terms(F.col("text"), s)
        return F.array(*(F.struct(name.alias("entity"), terms.alias("terms")) for name in (_entity(s), _kin(s))))

    entities = F.flatten(F.transform("base", named)).alias("entities")
    found = docs.select(key.alias("key"), "text", base).select(F.monotonically_increasing_id().alias("row"), "key", entities)
    found = staged(found, "findings")
    risky = disclosing_terms(found.select("row", "entities"), docs.select("text"), support, least)
    marks = _anywhere(docs.select(key.alias("key"), "text"), risky) if everywhere else _owned(found, risky)
    # texts may be repeated; stored, so that adaptive execution sees a plain join and splits their key
    terms = staged(marks.groupBy("key").agg(F.collect_set(F.struct("term", "disclosure")).alias("terms")), "marks")
    # without ``everywhere`` only texts with a finding are needed again
    text = F.col("text") if everywhere else F.when(F.size("base") > 0, F.col("text")).alias("text")
    out = docs.select(key.alias("row"), *rest, "text", base).select("row", *rest, text, "base")
    # by one kind of join at every size, so that what moves stays in proportion to the texts
    out = out.join(terms.withColumnRenamed("key", "row").hint("merge"), "row", "left")
    added = F.when(F.col("terms").isNotNull(), _added(F.col("text"), F.col("base"), F.col("terms"), remove)).otherwise(F.array().cast(SPANS))
    out = out.withColumn("spans", F.array_sort(F.concat("base", added)))
    changed = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans")))
    return out.withColumn("sanitised", changed).select(*rest, "base", "spans", "sanitised")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
