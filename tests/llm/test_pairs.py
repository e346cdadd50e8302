"""SimHash near-dedup, components and benchmark decontamination against plain Python."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import decontamination, simhash
from cohortlab.llm.components import components


def least_reachable(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    return {x: top(x) for x in parent}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, rng.randint(1001, 1060)) for _ in range(80)]
    noise = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(90)]
    edges = [e for e in [*chain, *star, *noise, (160, -5)] if e[0] != e[1]]
    out = components(spark.createDataFrame([*edges, (7, 7)], "u long, v long"))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == least_reachable(edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_between_all_near_fingerprints(spark):
    rng = random.Random(2)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        centre = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 3, 4, 5):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), flips)))
    near = rng.getrandbits(64)
    fps += [near ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(0, 64, 5)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for radius in (1, 2, 3):
        links = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
        at = {f: i for i, f in enumerate(signed)}
        pairs = [(at[r.a], at[r.b]) for r in links.collect()]
        assert all((fps[i] ^ fps[j]).bit_count() <= radius for i, j in pairs)
        own = least_reachable([(i, i) for i in range(len(fps))] + pairs)
        assert [own[i] for i in range(len(fps))] == brute.components(fps, radius)


def test_near_duplicates_against_plain_python(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß\x0b", "a\tb"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(20)]
    texts = base + [b + " end" for b in base] + base[:5] + [None, "", " \n ", "one", "One", "two words", "A b C", "a  b\nc"]
    rows = [(i * 3 + 1, t, 0) for i, t in enumerate(texts)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    fps = [brute.fingerprint(t) for t in texts]
    own = brute.components(fps)
    expected = {rows[i][0]: (fps[i], rows[own[i]][0]) for i in range(len(rows))}
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in out.collect()} == expected


def test_near_duplicates_without_ids_and_repeated(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == [(5, 5), (5, 5), (9, 9), (None, 5), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def check(spark, texts, items, window=10):
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(docs, table, window)
    out = out.withColumn("n_hit", decontamination.words_hit(F.col("hits")))
    got = {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in out.collect()}
    assert got == {i: brute.contaminated(t, items, window) for i, t in enumerate(texts)}


def test_contamination_against_plain_python(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)] + ["Ünï", "x-y", "漢字"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.randint(1, 30))) for i in range(25)] + [(90, ""), (91, None), (92, "..."), (93, "W1"), (94, "w1, w2"), (94, "w1, w2"), (95, "w1 w2 w3 w4")]
    items += [(96, items[0][1]), (97, items[3][1] + " w1 w2")]
    texts = [some(rng.randint(0, 60)) for _ in range(60)]
    texts += [some(9) + " " + (items[rng.randrange(25)][1] or "").upper() + "\n" + some(3) for _ in range(60)]
    texts += [None, "", "!!", items[0][1] * 50]
    check(spark, texts, items)
    check(spark, texts, items, window=4)
    check(spark, texts[:5], [])
    check(spark, [], items[:4])


def test_passage_in_very_many_documents(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from here"
    check(spark, [f"t{i} {passage} u{i}" for i in range(300)] + ["the quick brown fox"], [(1, passage), (2, "an item that no document has in it at all")])


def test_shingles_stay_within_a_text():
    bounds = np.array([0, 2, 2, 3, 7])
    at, _ = decontamination._shingles(np.arange(7, dtype=np.uint64), bounds, 3)
    assert at.tolist() == [3, 4]
