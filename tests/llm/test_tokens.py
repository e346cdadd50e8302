"""SentencePiece codec and token counts against the libraries."""

import random
import struct

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from cohortlab.llm import sentencepiece_codec as codec
from cohortlab.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(5)
    some = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", " ▁ x", "\n", "a\nb\t c", "\0x", "naïve Übergrößen", "日本語 テキスト", "🙂🙂 ok 🧪", "<0x0A> <s> </s> <unk>", "the the  the   the", "x" * 3000]
    alphabets = ["ab ", "the and in re ", "aeiou\n .,", "0123456789 -", "éßñ абв 漢字 ", "▁ a", "\U0001f600\x07 q"]
    return some + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 120))) for _ in range(400)]


def test_ids_and_text_are_the_librarys(library):
    table = codec.PrefixTable(MODEL, kept_words=50)
    for text in texts():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert table.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
        assert table.decode(table.encode(text)) == library.decode(ids), text


def test_decode_of_any_ids(library):
    rng, table = random.Random(1), codec.PrefixTable(MODEL)
    for _ in range(300):
        # whole characters: the byte ids of a text in any company
        ids = [i for t in rng.choices(texts(), k=2) for i in library.encode(t)]
        assert table.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_tables_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = codec.decode(codec.encode(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, len(r.ids) // 4, r.decoded) for r in out.collect()))
    assert got == [(0, 2, ""), (1, len(library.encode("a b")) + 2, "a b"), (1, len(library.encode("a b")) + 2, "a b"), (2, 2, "")]
    both = codec.round_trip(docs, MODEL).select("ids", "decoded").collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, out.select("ids", "decoded").collect()))
    assert codec.round_trip(docs.limit(0), MODEL).count() == 0


def counted(spark, rows, cache, path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, id string")
    return token_counts.count_tokens(docs, cache, path)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    path, some = public_tokenizers.path(name), [*texts()[:60], "<|endoftext|> x"]
    if name.endswith(".json"):
        t = tokenizers.Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x))
    rows = [(i, t, "d", "e") for i, t in enumerate(some)]
    out = counted(spark, rows, str(tmp_path / "cache"), path)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out.collect()} == {i: (len(t.encode()), count(t)) for i, t in enumerate(some)}


def test_only_new_contents_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(1, "one text", "a", "b"), (2, "one text", "a", "b"), (None, None, None, None), (3, "", "", ""), (3, "", "", "")]
    out = counted(spark, rows, cache, MODEL)
    assert out.count() == 5
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    counted(spark, rows, cache, MODEL)
    assert spark.read.parquet(cache).count() == 2
    more = counted(spark, [*rows, (9, "new", "", "")], cache, MODEL)
    assert spark.read.parquet(cache).count() == 3
    assert more.where("doc_id = 9").first().n_tokens == 1
    # counts are read from the cache, and another tokenizer has its own
    stored.withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(str(tmp_path / "other"))
    assert {r.n_tokens for r in counted(spark, rows, str(tmp_path / "other"), MODEL).collect()} == {77}
    assert token_counts.version_of(MODEL) != token_counts.version_of(public_tokenizers.path("byte_bpe_50k.json"))
    assert counted(spark, [], cache, MODEL).count() == 0
