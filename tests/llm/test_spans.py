"""Personal data and secrets: places, disclosure and the forest."""

import math
import os
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import pii, secret_scan
from cohortlab.llm.spans import matches
from cohortlab.session import run_folder
from conftest import TESTDATA

TEXTS = [
    None, "", "nothing here", "a@b.c", "a@b", "x a.b+c@d-e.f.g, y@z.w@q.r", "a@b.c_x@d.e", "@b.c a@.c", "é🙂 a@b.co 🙂 1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.999 0001.02.0255.4 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112 x 4111111111111111",
    "12 4111111111111111 34", "1" * 25, "0" * 14, "00000000000000 0000000", "4111 1111  1111 1111", "+1 (217) 555-0134 z", "+1 555", "+12345678901234567890",
    "++1 (2)3-4.5 6 7 8 9 0.", "+1 4111111111111111 a@1.2.3.4", "a" * 3000 + "@b.c", "9" * 3000, "1." * 1500, "a@" * 800, "+1" + " (" * 900, "x@y." * 700 + "z",
]


def test_matches_have_their_places(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1é🙂 ") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["1a" * 2000, "", "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for pattern in ("[0-9]+", "a+b?", "é"):
        out = df.select("i", matches(F.col("t"), pattern).alias("m"))
        for r in out.collect():
            assert [tuple(m) for m in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, texts[r.i])]


def test_base_findings_against_plain_python(spark):
    rng = random.Random(2)
    digits = ["".join(rng.choice("0123456789 -.") for _ in range(rng.randint(10, 60))) for _ in range(60)]
    mail = ["".join(rng.choice("ab1.@-_+ (") for _ in range(rng.randint(10, 60))) for _ in range(120)]
    texts = [*TEXTS, *digits, *mail]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    out = df.select("i", pii.base_spans(F.col("text")).alias("s"))
    assert {r.i: [(s.start, s.kind, s.end) for s in r.s] for r in out.collect()} == {i: brute.personal(t) for i, t in enumerate(texts)}


def corpus():
    rows = [(i, f"The usual zorblatt person ann@mail.org wrote note {i}. Zorblatt again") for i in range(4)]
    rows += [(10 + i, f"hinting often ann@mail.org says {i}") for i in range(3)] + [(20 + i, "hinting without anything else") for i in range(3)]
    rows += [(30 + i, f"the usual text number {i}") for i in range(40)] + [(90, None), (91, "")]
    return rows


def test_words_that_give_an_entity_away(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, spans string")
    out = pii.sanitise(docs)
    assert out.columns == ["doc_id", "base", "spans", "sanitised"]
    got = {r.doc_id: r for r in out.collect()}
    # plain counts of what the formula needs
    n, n_entity = len(rows), 7
    share = lambda both, term: math.log(n * both / (term * n_entity)) / math.log(n / n_entity)
    assert share(4, 4) == pytest.approx(1.0) and pii.GENERALISE <= share(3, 6) < pii.REMOVE and share(4, 44) < 0.3
    assert [(s.kind, s.value) for s in got[0].spans] == [("remove", "zorblatt"), ("remove", "person"), ("email", "ann@mail.org"), ("remove", "wrote"), ("remove", "note"), ("remove", "Zorblatt"), ("remove", "again")]
    assert got[0].sanitised == "The usual   [EMAIL]   0.  "
    assert [(s.kind, s.value) for s in got[10].spans if s.kind != "remove"] == [("generalise", "hinting"), ("email", "ann@mail.org")]
    assert all(not got[i].spans and got[i].sanitised is None for i in (20, 30, 90, 91))
    listed = out.where("doc_id = 0").select(pii.listed(F.col("spans"))).first()[0]
    assert listed.startswith("remove:10:18,remove:19:25,email:26:38")


def test_entity_in_every_document_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "word a@b.org")] * 5, "doc_id long, text string")
    out = pii.sanitise(docs).collect()
    assert len(out) == 5 and all([s.kind for s in r.spans] == ["email"] for r in out)
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_luhn(spark):
    rng = random.Random(8)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19))) for _ in range(300)]
    out = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii.luhn(F.col("n")).alias("ok"))
    for r in out.collect():
        d = [int(c) for c in reversed(r.n)]
        assert r.ok == ((sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0)


def findings(seed, n):
    """Documents with secrets in known places, and harmless look-alikes."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows, places = [], {}
    for i in range(n):
        kind = i % 6
        front = f"the words of text {i} "
        secret = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + hexes(16).upper()][kind % 3] if kind < 3 else ""
        harmless = ["", "", "", f"user{i}@mail{i}.example.com", f"/usr/share/lib64/python{i}/site", f"{rng.randint(10**14, 10**15)}"][kind]
        text = front + (secret or harmless) + " and more words"
        value = re.search(r"[0-9a-f]{18,}|AKIA[0-9A-F]{16}", secret)
        places[i] = [(len(front) + value.start(), len(front) + value.end())] if value else []
        rows.append((i, text, "x"))
    return rows, places


def test_secrets_on_texts_not_trained_on(spark):
    rows, places = findings(1, 240)
    other, true = findings(2, 120)
    docs = spark.createDataFrame([*rows, *((1000 + i, t, x) for i, t, x in other)], "doc_id long, text string, secrets string")
    labelled = []
    for i, text, _ in rows:
        spans = places[i] or [m.span() for m in re.finditer(r"\S{12,}", text)]
        labelled += [(text[a:b], 1.0 if places[i] else 0.0) for a, b in spans]
    labels = spark.createDataFrame(labelled, "value string, label double")
    for given in (labels, None):
        out = secret_scan.scan(docs, given, common=2)
        got = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in out.collect()}
        assert {i: got[1000 + i] for i in true} == true


def test_scan_without_training_data(spark):
    rows = [(1, None), (2, ""), (3, "password=abcdef123456789"), (3, "password=abcdef123456789"), (None, "no candidate"), (5, "x" * 50 + "1" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_candidates, len(r.secrets)) for r in secret_scan.scan(docs).collect()))
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (5, 1, 0)]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.secrets] for r in secret_scan.scan(docs, common=2).collect()}


def test_short_and_odd_values_after_a_key(spark):
    given = ["Hunter2!x", "Summer2024", "correct-horse-battery", "pass1234", "-----BEGIN RSA PRIVATE KEY-----", "p:w@1", "üé#9 x"[:4], "x9!"]
    texts = [f"password={given[0]} and", f"password: {given[1]}", f"x secret={given[2]}, and", f"go to db://user:{given[3]}@db.host/a1 now", f"{given[4]}\nabc", f"redis://:{given[5]}@h:6379", f'{{"token": "{given[6]}","user":"x"}}', f"(passwd='{given[7]}')"]
    plain = ["the password: none of them", "auth = None", "http://host:8080/path/to/12", "a@mail12.example.com"]
    alone = found_in(spark, texts + plain[:2])
    assert [alone[i] for i in range(len(texts))] == [[g] for g in given] and not any(alone[len(texts) + i] for i in range(2))
    rows, _ = findings(3, 240)
    got = found_in(spark, [*texts, *plain[2:], *(t for _, t, _ in rows)])
    assert [got[len(texts) + i] for i in range(2)] == [[], []]
    assert all(got[i] == [given[i]] for i in range(len(texts)))


def test_rare_secrets_train_and_sure_ones_stay(spark):
    rng = random.Random(5)
    key = "AKIA" + "".join(rng.choice("0123456789ABCDEF") for _ in range(16))
    texts = [f"mail user{i}@mail{i}.example.com now" for i in range(300)] + [f"my {key} here"] * 2
    for parts in (1, 5):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in secret_scan.scan(docs, common=2, training_rows=20).collect()}
        assert sorted(i for i in got if got[i]) == [300, 301]
        assert got[300] == [(3, 23)]
    rows = [(float(i == 7), f"value{i % 60}", i % 3 + 0.5) for i in range(300)]
    sample = [
        sorted(map(tuple, secret_scan.training_sample(spark.createDataFrame(rows, "label double, value string, x double").repartition(k), ["x"], 20).select("label", "value", "x", "weight").collect()))
        for k in (1, 7)
    ]
    assert sample[0] == sample[1] and [r[0] for r in sample[0]] == [0.0] * 20 + [1.0]
    assert sum(r[3] for r in sample[0] if r[0]) == pytest.approx(sum(r[3] for r in sample[0] if not r[0]))


def test_plans_have_no_python(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    for out in (pii.sanitise(docs), secret_scan.scan(docs, common=2)):
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        assert not re.search("Python|Pandas|Arrow", plan)


WORD = re.compile(r"[^\W\d_]+")


def plain_terms(texts, least):
    """term -> disclosure over (text,) rows, for emails alone: by value and by domain."""
    near, have, beside, anywhere = {}, {}, {}, {}
    for i, text in enumerate(texts):
        for w in set(WORD.findall((text or "").lower())):
            anywhere.setdefault(w, set()).add(i)
        for start, _, end in [s for s in brute.personal(text) if s[1] == "email"]:
            value = text[start:end].lower()
            left, right = text[max(0, start - pii.CONTEXT) : start], text[end : end + pii.CONTEXT]
            left = re.sub(r"^[^\W\d_]+", "", left) if start > pii.CONTEXT else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == pii.CONTEXT else right
            for e in (value, "@" + value.split("@")[-1]):
                have.setdefault(e, set()).add(i)
                for w in WORD.findall(f"{left} {right}".lower()):
                    if len(w) >= 3:
                        beside.setdefault((e, w), set()).add(i)
    n = len(texts)
    for (e, w), rows in beside.items():
        known = math.log(n / len(have[e]))
        share = round(math.log(n * len(rows) / (len(anywhere[w]) * len(have[e]))) / known, 9) if known > 0 else 0.0
        if share >= least:
            near[w] = max(near.get(w, 0.0), share)
    return near


def test_terms_everywhere_against_plain_counts(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + a)}{chr(97 + b)}é" for a in range(8) for b in range(8)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(150)]
    for i in range(0, 150, 4):
        at = rng.randint(0, len(texts[i]))
        name = rng.choice(["ann", "bob", "eve"])
        texts[i] = f"{texts[i][:at]} {name}ish {name}{i % 3}@{rng.choice('ab')}.org {rng.choice(['tell', 'ask'])} {texts[i][at:]}"
    texts += ["annish alone", "bobish and others", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = plain_terms(texts, pii.GENERALISE)
    assert terms
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.sanitise(docs, support=1, everywhere=True).collect()}
    for i, text in enumerate(texts):
        base = [(kind, start, end) for start, kind, end in brute.personal(text)]
        hit = [m for m in WORD.finditer(text or "") if m.group().lower() in terms]
        added = [("remove" if terms[m.group().lower()] >= pii.REMOVE else "generalise", m.start(), m.end()) for m in hit]
        added = [s for s in added if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
        assert sorted(got[i]) == sorted(base + added), text


def stored_bytes(spark):
    folder = run_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def marked_texts(n):
    """Texts that do not pack well, every tenth with an email beside two words of its own."""
    rng = random.Random(21)
    texts = ["".join(rng.choice("bcdfghjklmnpqrstvwxzéß    ") for _ in range(3000)) for _ in range(n)]
    return [f"{t} only{chr(97 + i // 10 % 26)}here x{i}@mail.org plain words {t[:200]}" if i % 10 == 0 else t for i, t in enumerate(texts)]


def test_texts_are_not_stored(spark):
    texts = marked_texts(200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for everywhere in (True, False):
        before = stored_bytes(spark)
        out = pii.sanitise(docs, support=1, least=0.85, everywhere=everywhere).select("doc_id", "base", "spans").collect()
        assert sum(len(r.base) for r in out) == 20 and sum(len(r.spans) for r in out) > 40
        assert stored_bytes(spark) - before < 0.1 * sum(map(len, texts))


def test_repeated_texts_are_marked_alike_without_broadcast(spark):
    texts = [*marked_texts(60), *marked_texts(1) * 40, "onlyahere and onlyahere alone", None, None, ""]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int").repartition(5)
    for everywhere in (True, False):
        seen = []
        for threshold in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            try:
                out = pii.sanitise(docs, support=1, least=0.5, everywhere=everywhere).collect()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert len(out) == len(texts) and all((r.doc_id is None) == (r["at"] % 7 == 0) for r in out)
            seen.append({r["at"]: ([tuple(s) for s in r.spans], r.sanitised) for r in out})
        assert seen[0] == seen[1]
        assert len({repr(seen[0][i]) for i in (0, *range(60, 100))}) == 1
        # the word is beside the entity in 41 of the 42 documents that have it
        first = [s[4] for s in seen[0][0][0] if s[2] in pii.TERMS]
        assert "onlyahere" in first
        assert [s[2:] for s in seen[0][100][0]] == ([("remove", 9, "onlyahere"), ("remove", 23, "onlyahere")] if everywhere else [])
        assert seen[0][101] == seen[0][102] == seen[0][103] == ([], None)


def test_terms_of_the_given_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text")
    out = pii.sanitise(docs, support=1, everywhere=True).collect()
    assert sum(s.kind in pii.TERMS for r in out for s in r.spans) > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        base = [(s.start, s.kind, s.end) for s in r.base]
        assert base == brute.personal(texts[r.doc_id])
        assert base == [(s.start, s.kind, s.end) for s in r.spans if s.kind not in pii.TERMS]


def test_forest_after_a_graph_query_on_the_larger_table(spark):
    from cohortlab.llm import queries, simhash

    larger = TESTDATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    assert simhash.near_duplicates(docs.select("doc_id", "text"), words=3, radius=3).count() == docs.count()
    rows = queries.op3_secrets(spark, larger).collect()
    assert len(rows) == docs.count() and sum(r.n_secrets for r in rows) > 0
