"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from cohortlab.llm import queries, spelling
from conftest import TESTDATA


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        close = [o for o in counts if near(w, o)]
        best = min(close, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(close))
    rows = {}
    for w, (n, many) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w] = (forms[w], root, n, many, counts[forms[w]] if forms[w] else None)
    return rows


def table(spark, counts):
    rows = [(i, w, counts[w]) for i, w in enumerate(sorted(counts))]
    return spark.createDataFrame(rows, "id long, word string, n long")


def got_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(500)}
    long = "".join(rng.choice("xyÿ") for _ in range(spelling.LONG))
    for base in (long, long[:-1], long + "x", long * 3, "aaaaaaaa", "a" * 70):
        words |= {base, base[1:], "z" + base, base + "z", base[:3] + base[4:], base[:5] + "ß" + base[6:]}
    counts = {w: rng.choice([1, 1, 2, 5, 5, 10, 25, 60, 300, 1500]) for w in words}
    assert got_of(spelling.variants(table(spark, counts))) == plain_variants(counts)


def test_chains_of_forms_and_frequent_ones(spark):
    chain = {"w" * k: 5**k for k in range(1, 12)}
    crowd = {f"hub{c}": 1 for c in map(chr, range(0x61, 0x7B))} | {"hub": 5, "hubs!": 9}
    counts = chain | crowd
    got = got_of(spelling.variants(table(spark, counts)))
    assert got == plain_variants(counts)
    assert got["w"][1] == "w" * 11 and got["huba"] == ("hub", "hub", 1, 26, 5)


def test_a_prefix_has_one_row_a_member(spark):
    counts = {f"stem{chr(c)}ing": 7 for c in range(0x61, 0x7B)}
    rows = spelling.rotations(table(spark, counts))
    assert rows.count() == sum(2 * len(w) + 1 for w in counts)
    assert rows.groupBy("prefix").count().agg({"count": "max"}).first()[0] <= 26


def test_words_of_texts(spark):
    texts = [None, "", "  ", "Straße STRASSE strasse", "naïve Àbcdéf àbcdéf × ÷abcdef", "short words only"] + ["Common, common; commen\ncommon_x"] * 6
    docs = spark.createDataFrame([(k, t, "r") for k, t in enumerate([*texts, "q" * 50_000])] + [(None, "common", "r"), (1, "common", "r")], "doc_id long, text string, run string")
    runs = sorted((r.doc_id or -1, r.run) for r in spelling.runs(docs).collect())
    expected = []
    for doc_id, text, _ in [tuple(r) for r in docs.collect()]:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        expected += [(doc_id or -1, w) for w in re.findall("[A-Za-zÀ-ÿ]+", low) if len(w) >= 6]
    assert runs == sorted(expected)
    words = spelling.vocabulary(spelling.runs(docs).withColumnRenamed("run", "word"))
    assert {r.word: r.n for r in words.collect()} == {w: n for w, n in Counter(w for _, w in expected).items() if n >= 5}
    assert [r.word for r in words.orderBy("id").collect()] == sorted(r.word for r in words.collect())
    assert spelling.variants(spelling.vocabulary(spelling.with_slips(spelling.runs(docs.limit(0))))).collect() == []


def test_query_on_the_given_table(spark):
    counts = Counter()
    for doc_id, text in [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()]:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = got_of(queries.op11_spelling(spark, TESTDATA))
    assert {w: v[2] for w, v in got.items()} == counts
    some = random.Random(2).sample(sorted(counts), 150)
    expected = {w: [o for o in counts if near(w, o)] for w in some}
    for w in some:
        best = min(expected[w], key=lambda o: (-counts[o], o), default=None)
        form = best if best and counts[best] >= 5 * counts[w] else None
        assert got[w][3] == len(expected[w]) and got[w][0] == form
