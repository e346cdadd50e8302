"""Operator 11: spelling variants of the corpus' words, by permuterm rotations.

Two words are near when one inserted, deleted or replaced character makes them equal.

1. Words are counted map-side and sorted; their ids keep the order.
2. Every rotation of a word with its end marked, ``elling$sp`` of *spelling*, is taken
   twice: whole, and without its last character. Without it, a word's rotations meet those
   of all words that differ in just this character, whatever its place, since rotating has
   brought it to the end; and they meet the whole rotation of the word that lacks it. So
   near words are the rows of one prefix. A character deleted from a run of equal ones
   counts once, at the run's first.
3. Each group of a prefix is scanned in order of (most frequent, first): every member gets
   the number of its near words there and the best of them. That is one row a member, never
   a pair, and a group has no more members than there are characters.
4. A word's *form* is its best near word if that is ``ratio`` times as frequent. Frequencies
   grow along forms, so the last form, the *root*, is found by pointers that double.

Prefixes longer than ``LONG`` code points travel as their MD5. Words must not hold the end mark ``END``.

Cases: null and empty texts have no words; very long runs of letters are words like any
other (their rotations are hashed one after the other, in time that grows with the square
of the length); ties go to the word first in code-point order; repeated rows count each;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import lowered
from cohortlab.session import staged

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
END = "$"
LONG = 64


def runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without text, one row per maximal run of letters of the least length; A-Z lower-cased."""
    rest = [c for c in docs.columns if c not in ("text", "run")]
    found = F.regexp_extract_all(lowered(F.col("text")), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    return docs.select(*rest, F.explode(found).alias("run"))


def with_slips(rows: DataFrame, every: int = 199) -> DataFrame:
    """(word) of (doc_id, run), in some of which a letter is left out.

    By the CRC-32 h of ``doc_id:run``: where ``every`` divides it, the code point at h
    modulo the length goes. A null id is an empty one.
    """
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", code).select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, word, n) of the words long and frequent enough; ids in order of the words."""
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_chars))
    return staged(staged(counted, "counted").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, id, n, whole, first): all rotations, whole and without their last character."""
    word, size = F.col("word"), F.length("word")

    def rotated(before: Column, after: Column) -> Column:
        """The text after a place, the end mark, and the text before it."""
        turned = F.concat(F.substring(word, after + 1, size), F.lit(END), F.substring(word, F.lit(1), before))
        return F.when(size + 1 - (after - before) > LONG, F.md5(turned)).otherwise(turned)

    def cut(i: Column) -> Column:
        first = (i == 0) | (F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1)))
        return F.struct(rotated(i, i + 1).alias("prefix"), F.lit(False).alias("whole"), first.alias("first"))

    def whole(i: Column) -> Column:
        return F.struct(rotated(i, i).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))

    every = F.concat(F.transform(F.sequence(F.lit(0), size - 1), cut), F.transform(F.sequence(F.lit(0), size), whole))
    rows = words.where(size > 0).select("id", "n", F.explode(every).alias("r"))
    return rows.select("r.prefix", "id", "n", "r.whole", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n, n_near, best) of the words that have near words; best is struct<lost, id> with lost = -n."""
    member = F.struct((-F.col("n")).alias("lost"), "id", "whole", "first")
    groups = rotations(words).groupBy("prefix").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    place = lambda m: F.struct(m["lost"].alias("lost"), m["id"].alias("id"))
    cut = F.transform(F.filter("members", lambda m: ~m["whole"]), place)
    first = F.transform(F.filter("members", lambda m: m["first"]), place)
    whole = F.transform(F.filter("members", lambda m: m["whole"]), place)
    groups = groups.select("members", cut.alias("cut"), first.alias("firsts"), whole.alias("wholes"))
    top = lambda column, at: F.get(column, F.lit(at))

    def near(m: Column) -> Column:
        # words as long: all the others without the same character; longer and shorter: through the whole rotation
        alike = F.when(top("cut", 0)["id"] == m["id"], top("cut", 1)).otherwise(top("cut", 0))
        shorter = F.when(m["first"], top("wholes", 0))
        many = F.when(m["whole"], F.size("firsts")).otherwise(F.size("cut") - 1 + F.when(m["first"], F.size("wholes")).otherwise(0))
        best = F.when(m["whole"], top("firsts", 0)).otherwise(F.least(alike, shorter))
        return F.struct(m["id"].alias("id"), (-m["lost"]).alias("n"), many.cast("long").alias("many"), best.alias("best"))

    rows = groups.select(F.explode(F.transform("members", near)).alias("m")).select("m.*").where("many > 0")
    return rows.groupBy("id", "n").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): the last of the forms of forms; those of 1, 2, 4, ... steps in turn."""
    steps = staged(forms.select("id", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        steps = staged(steps.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "steps")
        moved = not steps.where("moved").isEmpty()
        steps = steps.select("id", "root")
        if not moved:
            return steps


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all rows of :func:`vocabulary`."""
    near = staged(neighbours(words), "near")
    forms = near.where(-F.col("best.lost") >= ratio * F.col("n")).select("id", F.col("best.id").alias("form"), (-F.col("best.lost")).alias("form_n"))
    # what is named is looked up once: the strings of forms and of roots
    chains = forms.join(roots(forms), "id")
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    chains = chains.join(named, "form").join(named.toDF("root", "root_word"), "root").select("id", "form_word", "root_word", "form_n")
    out = words.join(near.select("id", "n_near"), "id", "left").join(chains, "id", "left")
    return out.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )
