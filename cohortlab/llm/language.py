"""Operator 5: language identification as a mixture of languages.

A language is a distribution over byte trigrams of lowered text, hashed into ``BUCKETS``
places so that the model has one size per language whatever the corpus; its counts cover
all labelled documents. A document's trigrams are drawn from a mixture: expectation
maximisation estimates the proportions, and languages join the set one by one while the
log-likelihood gains more than ``penalty`` x log(number of trigrams).

Cases: null texts and texts without a letter are ``und`` with score 0, and so is every
text when nothing labelled was learned; equal likelihoods go to the language first in
order; a null label isn't learned; repeated rows are judged each by itself; other columns
pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import slices, text_bytes

BUCKETS = 1 << 16
#: Pseudo-count of each bucket.
SMOOTHING = 0.1
PENALTY = 12.0
ROUNDS = 8
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are no letters are all one blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _grams(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram; blanks alone are none."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    x = _FOLD[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    keep = (owner[:-2] == owner[2:]) & (x[1:-1] != 32)
    gram = gram[keep]
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return owner[:-2][keep], bucket


class Model:
    """Log-probabilities of the buckets, languages in order of their names."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        if not names:
            return
        total = counts.sum(axis=1, keepdims=True)
        log_p = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS))
        # only the languages' likelihoods against each other matter
        self.ratio = np.ascontiguousarray(np.exp(log_p - log_p.max(axis=0)).T.astype(np.float32))

    @classmethod
    def of(cls, names: list[str], ratio: np.ndarray | None) -> Model:
        """The model of its plain values, as they are sent to the tasks."""
        out = cls([], np.zeros(0))
        out.names, out.ratio = names, ratio
        return out

    def mixtures(self, column, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Language proportions of each text, and the number of its trigrams."""
        texts, langs = len(column), len(self.names)
        owner, bucket = _grams(column)
        key = np.sort(owner.astype(np.uint64) << np.uint64(16) | bucket)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        times = np.diff(np.concatenate([first, [len(key)]])).astype(np.float32)
        owner, bucket = (key[first] >> np.uint64(16)).astype(np.int64), (key[first] & np.uint64(0xFFFF)).astype(np.int64)
        n = np.bincount(owner, times, texts)
        shares = np.zeros((texts, langs), np.float32)
        have = np.unique(owner)
        if len(have):
            starts = np.searchsorted(owner, have)
            doc = np.repeat(np.arange(len(have)), np.diff(np.concatenate([starts, [len(owner)]])))
            shares[have] = self._fit(self.ratio[bucket], times, doc, starts, n[have], penalty)
        return shares, n

    def _fit(self, ratio, times, doc, starts, n, penalty) -> np.ndarray:
        langs = ratio.shape[1]
        alone = np.add.reduceat(times[:, None] * np.log(ratio), starts, axis=0)
        best = alone.argmax(axis=1)
        chosen = np.zeros((len(starts), langs), bool)
        chosen[np.arange(len(starts)), best] = True
        shares, fit = chosen.astype(np.float32), alone.max(axis=1)
        everything, _ = _em(np.ones_like(chosen), ratio, times, doc, starts, n)
        open_ = np.arange(len(starts))
        for _ in range(langs - 1):
            # the most likely language outside the set
            outside = np.where(chosen[open_], -1.0, everything[open_])
            add = outside.argmax(axis=1)
            trial = chosen[open_].copy()
            trial[np.arange(len(open_)), add] = True
            rows = np.isin(doc, open_) if len(open_) < len(starts) else slice(None)
            doc_, starts_ = doc[rows], starts
            if len(open_) < len(starts):
                doc_ = np.searchsorted(open_, doc_)
                starts_ = np.searchsorted(doc_, np.arange(len(open_)))
            pi, like = _em(trial, ratio[rows], times[rows], doc_, starts_, n[open_])
            better = like - fit[open_] > penalty * np.log(n[open_] + 1)
            open_, pi, like, trial = open_[better], pi[better], like[better], trial[better]
            if not len(open_):
                break
            chosen[open_], shares[open_], fit[open_] = trial, pi, like
        return shares


def _em(allowed, ratio, times, doc, starts, n) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and the log-likelihood, by text."""
    pi = allowed / allowed.sum(axis=1, keepdims=True).astype(np.float32)
    pi = pi.astype(np.float32)
    for _ in range(ROUNDS):
        p = np.einsum("gl,gl->g", ratio, pi[doc])
        pi = pi * np.add.reduceat(ratio * (times / p)[:, None], starts, axis=0) / n[:, None].astype(np.float32)
    p = np.einsum("gl,gl->g", ratio, pi[doc])
    return pi, np.add.reduceat(times * np.log(p), starts)


def learn(labelled: DataFrame) -> Model:
    """The model of all rows of (text, lang) with a label."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            owner, bucket = _grams(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = bucket[(langs == lang)[owner]]
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(mine, minlength=BUCKETS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    rows = labelled.where("lang IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # BUCKETS rows a language at most
    names = sorted(got["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    for k, name in enumerate(names):
        part = got[got["lang"] == name]
        counts[k, part["bucket"]] = part["n"]
    return Model(names, counts)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages``, the set with its proportions."""
    docs = docs.drop("lang_pred", "score", "languages")
    extra = "lang_pred string, score double, languages map<string, double>"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(extra).fields])
    # plain values: a broadcast of this class would need the package on the workers' path
    shipped = docs.sparkSession.sparkContext.broadcast((model.names, getattr(model, "ratio", None)))

    def run(batches):
        model = Model.of(*shipped.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            readable = [bool(model.names) and t is not None and _LETTER.search(t) is not None for t in texts]
            shares, _ = model.mixtures(batch.column("text"), penalty) if model.names else (np.zeros((len(texts), 1)), 0)
            top = shares.argmax(axis=1)
            names, scores, sets = [], [], []
            for k, ok in enumerate(readable):
                share = float(min(1.0, shares[k, top[k]]))
                if ok and not share:  # letters, but no trigram: nothing tells the languages apart
                    share = 1.0 / len(model.names)
                names.append(model.names[top[k]] if ok else "und")
                scores.append(share if ok else 0.0)
                sets.append([(n, float(s)) for n, s in zip(model.names, shares[k]) if s > 0] if ok else [])
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether the checksum of the id as text leaves 1 on division by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1
