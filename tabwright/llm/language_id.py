"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.common import column, small_batches

UNKNOWN = "und"
ORDERS, BUCKET_BITS, SMOOTHING = (1, 2, 3), 16, 0.5
# Labelled documents that the model is fitted on, shared evenly among the languages. A bound on
# the sample; predictions and the counts of labels cover all rows.
TRAINING_DOCS = 20_000
# Steps of the share that is drawn: fine enough for 20,000 documents out of 10**15.
CHANCE_BITS = 56
# Characters worked on at a time; n-grams do not reach over the end of such a stretch.
STRETCH = 1 << 20
# Odd multipliers of the hash.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, bucket)`` of every n-gram of letters and word ends."""
    joined = "\n".join(texts).lower() + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    number = np.cumsum(codes == 10)
    number = number - (codes == 10)
    codes = np.where(letter, codes, np.uint32(32))
    owners, buckets = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        mixed = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        some = letter[:size].copy()
        for k in range(n):
            mixed = (mixed ^ codes[k : k + size]) * FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
            some |= letter[k : k + size]
        some &= number[:size] == number[n - 1 : n - 1 + size]
        owners.append(number[:size][some])
        buckets.append((mixed[some] * FACTORS[0]) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(owners), np.concatenate(buckets)


def _stretches(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts without line breaks, cut and gathered into stretches of bounded length."""
    at, held, room = [], [], STRETCH
    for i, text in enumerate(texts):
        for start in range(0, len(text), STRETCH):
            part = text[start : start + STRETCH].replace("\n", " ")
            if len(part) > room and held:
                yield at, held
                at, held, room = [], [], STRETCH
            at.append(i)
            held.append(part)
            room -= len(part)
    if held:
        yield at, held


def training_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, training_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their labelled documents, and n-gram counts ``[language, bucket]`` of the sample."""
    labelled = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")) & F.col("id").isNotNull()
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    if not langs:
        return langs, np.zeros(0), counts
    share = training_docs / len(langs)
    chance = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, share / sizes[lang]) * (1 << CHANCE_BITS))).cast("bigint"))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("training"), "id"), F.lit(1 << CHANCE_BITS)) < chance[F.col("lang")])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                sums = own.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for _, held in _stretches(part["text"].tolist()):
                    sums += np.bincount(_grams(held)[1], minlength=1 << BUCKET_BITS)
        for lang, sums in own.items():
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": sums[some]})

    found = sample.select("lang", "text").mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[found["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    return langs, np.array([sizes[lang] for lang in langs], float), counts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_docs: int = TRAINING_DOCS) -> Broadcast:
    """A broadcast ``(languages, log priors, log probabilities)``.

    Learned from rows with a label whose id is not held out; the matrix has one row of
    2**BUCKET_BITS numbers per language.
    """
    small_batches(docs.sparkSession)
    langs, sizes, counts = training_counts(docs, id_col, text_col, lang_col, training_docs)
    smooth = counts + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else smooth
    priors = np.log(sizes / sizes.sum()) if langs else sizes
    return docs.sparkSession.sparkContext.broadcast((langs, priors, logs))


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that is kept from the fit; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predictor(model: Broadcast):
    """A function of a text column: struct of ``lang`` and ``score``, from the text alone."""

    @F.pandas_udf("lang string, score double")
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, priors, logs = model.value
        for texts in columns:
            bodies = [t or "" for t in texts]
            sums = np.zeros((len(bodies), len(langs)))
            seen = np.zeros(len(bodies), bool)
            for at, held in _stretches(bodies):
                owner, bucket = _grams(held)
                if not len(owner):
                    continue
                where = np.array(at)[owner]
                seen[where] = True
                for i in range(len(langs)):
                    sums[:, i] += np.bincount(where, logs[i][bucket], len(bodies))
            if langs:
                sums += priors
                best = sums.argmax(axis=1)
                score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names = np.array(langs, object)[best]
            else:
                seen[:] = False
                names, score = np.full(len(bodies), UNKNOWN, object), np.zeros(len(bodies))
            yield pd.DataFrame({"lang": np.where(seen, names, UNKNOWN), "score": np.where(seen, score, 0.0)})

    return predict


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_docs: int = TRAINING_DOCS,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred`` and ``score``.

    ``lang_pred`` is the language of the largest posterior, ``score`` that posterior; a null
    text, one without letters, or a table without labels gives ``und`` with score 0. Ids may be
    null or repeat. Only the three named columns are read. Texts are scored whole, in stretches
    of bounded length, without a shuffle.
    """
    predict = predictor(fit(docs, id_col, text_col, lang_col, training_docs))
    scored = docs.select(column(id_col).cast("bigint").alias("doc_id"), predict(column(text_col).cast("string")).alias("p"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def reject_unknown(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language that the model holds likely, with their columns unchanged.

    Texts that are null, empty or without a letter have no language and go, as do all rows where
    no labelled text was there to learn from; a null id or label plays no part; repeated rows
    stay or go together; long texts are read whole.
    """
    predict = predictor(fit(docs, id_col, text_col, lang_col))
    names = docs.columns
    kept = docs.select("*", predict(column(text_col).cast("string")).alias("__language"))
    return kept.filter((F.col("__language.lang") != UNKNOWN) & (F.col("__language.score") >= least_score)).select(*[column(c) for c in names])
