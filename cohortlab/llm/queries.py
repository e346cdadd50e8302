"""The corpus operators as registered queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import conversations, decontamination, language, line_dedup, neighbours, pii, repeats, secret_scan, sentencepiece_codec, sharding, simhash, spelling, token_counts
from cohortlab.llm.common import table
from cohortlab.session import shared_dir

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern, and the words that give it away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a word counts from its first place beside an entity, so it has to give nearly all of it away
    out = pii.sanitise(docs, support=1, least=0.85, remove=0.95, everywhere=True)
    counts = [pii.number_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece_codec.round_trip(docs, PIECE_MODEL)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of credentials in every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan(docs)
    places = F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return out.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(places, ",").alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from two thirds of the documents, predicted for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out())
    model = language.learn(docs.where(~F.col("held_out")))
    out = language.identify(docs.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("id") % 20 == 0, k=20)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that a smaller document has go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs, length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, words=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ten-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = decontamination.contamination(docs, items, window=10)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = decontamination.words_hit(F.col("hits")).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), places AS (
  SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT DISTINCT n FROM sized) z
  WHERE i + z.n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, places.n, item_id FROM places JOIN wins ON places.win = wins.win AND places.n = wins.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts through a digest cache of this run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_dir(spark).rstrip('/')}/token_counts/{uuid.uuid4().hex}"
    out = token_counts.count_tokens(docs, cache, PIECE_MODEL)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


#: SQL of the checksum of a text: half a byte at a time, with the 16 fixed values of the polynomial 0xEDB88320.
def crc32_sql(text: str) -> str:
    values = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948]
    values += [3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
    table = "[" + ", ".join(f"{v}::UINTEGER" for v in values) + "]"
    half = lambda c: f"xor(({c}) >> 4, {table}[(({c}) & 15)::INT + 1])"
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UINTEGER)"
    return f"xor(list_reduce(list_prepend(4294967295::UINTEGER, {numbers}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295::UINTEGER)::BIGINT"


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words of the documents' words, with some letters left out, and their forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(spelling.with_slips(spelling.runs(docs))))


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), coded AS (
  SELECT run, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs WHERE length(run) >= 6
), words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), places AS (
  SELECT word, n, unnest(range(0, length(word))) AS i FROM words
), holes AS (
  SELECT word, n, left(word, i) || '?' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS shorter FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word
), near AS (
  SELECT word, count(*) AS n_near, min({{'lost': -n, 'word': other}}) AS best FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.lost >= 5 * w.n THEN best.word END AS form,
         CASE WHEN -best.lost >= 5 * w.n THEN -best.lost END AS form_n
  FROM words w LEFT JOIN near ON w.word = near.word
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, form, c.root, n, n_near, form_n FROM formed f JOIN chain c ON f.word = c.word WHERE c.next IS NULL
"""


SHARDS = 16


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 16 shards by their ids, and to 17."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.deal(docs, sharding.even(SHARDS), {str(SHARDS): 1.0})
    out = sharding.numbered(dealt, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP12_SQL = f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         coalesce('=' || doc_id, '') AS k
  FROM documents
), scored AS (
  SELECT *, list_transform(range(0, {SHARDS + 1}), lambda s:
         -1 / ln((('0x' || left(md5(k || '/' || s), {sharding.DIGITS}))::BIGINT + 0.5::DOUBLE) / 16::DOUBLE ** {sharding.DIGITS})) AS scores
  FROM sized
), dealt AS (
  SELECT *, (list_position(scores[1:{SHARDS}], list_max(scores[1:{SHARDS}])) - 1)::INTEGER AS shard,
         (list_position(scores, list_max(scores)) - 1)::INTEGER AS grown_shard
  FROM scored
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':=' || text_crc32 || ':=' || size)) - 1 AS slot, grown_shard
FROM dealt
"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their cheapest repair and its digest."""
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(rows)


_SAID_SQL = "[2, 2, 3, 2][c.q + 1]"
_PUT_IN = (
    "{'q': " + _SAID_SQL + ", 'cost': c.cost + 2, 'audit': c.audit || 'I', "
    "'out': list_append(c.out, CASE " + _SAID_SQL + " WHEN 2 THEN 'user:' ELSE 'assistant:' END)}"
)
_NO_ROW = "{'q': 0, 'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]}"
OP13_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, (SELECT unnest([0, 1]) AS copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped, left(role, 1) AS initial
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS said
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND said || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), every AS (
  SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(n, 0) AS n, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
         coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
), repaired AS (
  SELECT conv_id, 0 AS i, unnest([{_NO_ROW}, {{'q': 2, 'cost': 2::BIGINT, 'audit': 'I', 'out': ['user:']}},
         {{'q': 3, 'cost': 4::BIGINT, 'audit': 'II', 'out': ['user:', 'assistant:']}}]) AS c
  FROM every
  UNION ALL
  SELECT conv_id, i, min({{'cost': c.cost, 'audit': c.audit, 'q': c.q, 'out': c.out}})::STRUCT(cost BIGINT, audit VARCHAR, q INTEGER, out VARCHAR[]) AS b
  FROM (
    SELECT conv_id, i, unnest([c, d, e]) AS c FROM (
      SELECT conv_id, i, c, d, {_PUT_IN.replace("c.", "d.")} AS e FROM (
        SELECT conv_id, i, c, {_PUT_IN} AS d FROM (
          SELECT p.conv_id, p.i + 1 AS i, unnest(list_filter([
            {{'q': c.q, 'cost': c.cost + 3, 'audit': c.audit || 'D', 'out': c.out}},
            CASE WHEN fault NOT IN ('b', 'd') AND kept IS NOT NULL THEN
              {{'q': kept, 'cost': c.cost + (fault = 't')::INT, 'audit': c.audit || 'K', 'out': list_append(c.out, role || ':' || text)}} END,
            CASE WHEN fault NOT IN ('b', 'd') THEN
              {{'q': {_SAID_SQL}, 'cost': c.cost + 2 + (fault = 't')::INT, 'audit': c.audit || 'R',
                'out': list_append(c.out, CASE {_SAID_SQL} WHEN 2 THEN 'user:' ELSE 'assistant:' END || text)}} END
          ], lambda x: x IS NOT NULL)) AS c
          FROM (SELECT r.conv_id, r.i, r.c, f.fault, f.role, f.text,
                       CASE WHEN f.initial = 's' AND r.c.q = 0 THEN 1 WHEN f.initial = 'u' AND r.c.q IN (0, 1, 3) THEN 2
                            WHEN f.initial = 'a' AND r.c.q = 2 THEN 3 END AS kept
                FROM repaired r JOIN faulty f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1) p))))
  GROUP BY conv_id, i, c.q
), least AS (
  SELECT r.conv_id, min({{'cost': c.cost, 'audit': c.audit, 'out': c.out}}) AS c
  FROM repaired r JOIN every e ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.n WHERE c.q IN (0, 3) GROUP BY r.conv_id
)
SELECT e.conv_id, gaps, blank, duplicate, truncated, illegal, c.cost AS cost, c.audit AS audit,
       sha256(array_to_string(c.out, chr(10))) AS repaired_sha256
FROM every e JOIN least l ON e.conv_id IS NOT DISTINCT FROM l.conv_id
"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secrets": op3_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_neighbours": op6_neighbours,
    "op7_repeats": op7_repeats,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_spelling": op11_spelling,
    "op12_sharding": op12_sharding,
    "op13_conversations": op13_conversations,
}

ORACLES = {"op4_line_dedup": OP4_SQL, "op9_decontamination": OP9_SQL, "op11_spelling": OP11_SQL, "op12_sharding": OP12_SQL, "op13_conversations": OP13_SQL}
