"""The pipeline's stages against plain Python, and the registered queries."""

import hashlib
import inspect

import __spark_entry__ as entry
import brute
import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece
from conftest import TESTDATA

from cohortlab.llm import language, queries


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and returned, as dicts by id."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, TESTDATA)
        done.write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append(({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in done.collect()}, done.columns))
        assert done.count() == len(out[-1][1])
        docs = done
    return out


def test_stages_in_their_order_with_the_columns_of_documents(steps):
    assert len(pipeline.STAGES) == 5
    assert all(columns == pipeline.COLUMNS for _, _, columns in steps[:-1])
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in pipeline.STAGES)


def test_language_stage_rejects_by_the_prediction(spark, steps):
    before, after, _ = steps[0]
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    out = language.identify(docs, language.learn(docs.where(~language.held_out()))).collect()
    assert set(after) == {r.doc_id for r in out if r.lang_pred != "und" and r.score >= 0.5}
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_line_stage(steps):
    before, after, _ = steps[1]
    kept = dict(zip(before, brute.lines([r.text for r in before.values()])))
    assert {i: r.text for i, r in after.items()} == {i: k[2] for i, k in kept.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_dedup_stage(steps):
    before, after, _ = steps[2]
    ids = sorted(before)
    own = brute.components([brute.fingerprint(before[i].text) for i in ids])
    assert set(after) == {ids[k] for k in set(own)}


def test_decontamination_stage(spark, steps):
    before, after, _ = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {i for i, r in before.items() if not brute.contaminated(r.text, items)[1]}


def test_token_stage(steps):
    before, after, _ = steps[4]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(before) == set(after)
    for r in after.values():
        ids = model.encode(r.text, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.round_trip) == (len(ids), model.decode(ids) == r.text)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None, 1), (None, "ein text", "de", "s", 8, 1), (3, "", "en", "s", 0, 1), (4, "12 34", "en", "s", 5, 1), (5, "some text " * 9, "en", "s", 90, 1), (5, "some text " * 9, "en", "s", 90, 1), (6, "wörter " * 4000, "de", None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, TESTDATA).cache()
        assert stage(spark, docs.limit(0), TESTDATA).count() == 0
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 5, 6]


def test_registered():
    assert [n for n in queries.QUERIES] == [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert entry.queries()["pipeline"] is pipeline.run


def test_entry_query_columns(spark):
    out = queries.QUERIES["op2_sentencepiece"](spark, TESTDATA).limit(3).collect()
    assert all(len(r.ids_sha256) == len(hashlib.sha256().hexdigest()) for r in out)
