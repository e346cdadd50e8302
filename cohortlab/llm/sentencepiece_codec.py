"""Operator 2: SentencePiece encoding and decoding by a table over prefixes.

For merge-type models the segmentation of every prefix of a text ends in exactly one
token. The table keeps that token per prefix: an automaton lists the pieces that end at a
position, and the one whose left neighbour in the table is *compatible* (merging the two
pieces' text gives these two pieces back) is the prefix's last token. Reading the table
from the end recovers the ids, in time linear in the text.

No piece of the model has a word mark behind another character, so no merge crosses the
start of a word: texts are cut there, and a task keeps the ids of the words it has seen
(a bounded table). Words of any length are handled, also a text without blanks.

Cases: null and empty text give begin and end ids only and decode to the empty text;
characters outside the vocabulary become byte ids; U+2581 is a blank to the model and so
decodes to one; rows and other columns pass through unchanged, repeated ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlab.llm.common import slices

MARK = "▁"
#: Words whose ids a Python worker keeps, in each of two tables: when the new one is full it
#: becomes the old one, so frequent words are never forgotten.
KEPT_WORDS = 500_000
_RUNS = re.compile(" +[^ ]*")


def words(text: str) -> list[str]:
    """The text cut before each word, every word without the blank in front of it."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _RUNS.findall(" " + text)]


class PrefixTable:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model_path: str, kept_words: int = KEPT_WORDS):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.piece = {i: model.id_to_piece(i) for i in range(size) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in self.piece.values()):
            raise ValueError("a piece spans two words; this model needs uncut texts")
        self.ids = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {}
        self.raw = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte[value], self.raw[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif i in self.piece:
                self.raw[i] = self.piece[i].replace(MARK, " ").encode()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._merged(p) == [p]:  # else merging never makes this piece
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(self.piece.get(i, "")) for i in range(size)]
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_words = kept_words

    def _merged(self, text: str) -> list[str]:
        """Merge the best adjacent pair until none is a piece; for texts of one or two pieces."""
        parts, score = list(text), self.score
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        return self._merged(a + b) == [a, b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (given without the blank in front of it)."""
        text = MARK + word.replace(" ", MARK)
        last = [-1] * (len(text) + 1)  # by prefix length; -1: ends in an unknown character
        fits, size = self.fits, self.size
        for stop, token in self.automaton.iter(text):
            stop += 1
            if last[stop] >= 0:  # a prefix has one last token
                continue
            left = last[stop - size[token]]
            if left >= 0:
                pair = left << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(left, token)
                if not fit:
                    continue
            last[stop] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                out.extend(self.byte[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(token)
                at -= size[token]
        return out[::-1]

    def _packed(self, word: str) -> bytes:
        """The word's packed ids, from the older table or anew."""
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.kept) >= self.kept_words:
                self.older, self.kept = self.kept, {}
            self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, begin and end ids included."""
        parts = [np.uint32(self.begin).tobytes()]
        for word in words(text or ""):
            parts.append(self.kept.get(word) or self._packed(word))
        parts.append(np.uint32(self.end).tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; the blank the model puts in front goes."""
        raw, ids = self.raw, np.frombuffer(ids, "<u4").tolist()
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        first = next((i for i in ids if raw[i]), None)
        return text[1:] if self.piece.get(first, "")[:1] == MARK else text


_LOADED: dict[str, PrefixTable] = {}


def loaded(model_path: str) -> PrefixTable:
    """One table per worker process and model."""
    if model_path not in _LOADED:
        _LOADED[model_path] = PrefixTable(model_path)
    return _LOADED[model_path]


def _added(df: DataFrame, column: str, extra: list[T.StructField], row) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            made = list(zip(*map(row, batch.column(column).to_pylist())))
            kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in extra]
            arrays = [pa.array(list(v), k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


IDS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the packed ids of each text."""
    docs = docs.drop("ids")
    return _added(docs, text, [IDS], lambda t: (loaded(model_path).encode(t),))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of the packed ids."""
    encoded = encoded.drop("decoded")
    return _added(encoded, ids, [DECODED], lambda b: (loaded(model_path).decode(b or b""),))


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Both in one pass: ``ids`` and the text ``decoded`` from them."""

    def row(t):
        table = loaded(model_path)
        packed = table.encode(t)
        return packed, table.decode(packed)

    return _added(docs.drop("ids", "decoded"), text, [IDS, DECODED], row)
