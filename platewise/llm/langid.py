"""Language identification by error-correcting output codes.

Every language has a codeword of +1 / -1 bits.  A bit's classifier is a linear
function of character n-gram counts: the log-odds of an n-gram under the
languages whose bit is +1 against the others.  A text's margins are its mean
log-odds per n-gram; decoding sums the logistic loss of the margins against
each codeword, predicts the language of least loss, and flags a text as
ambiguous if the runner-up is about as near.

N-gram counts per language are summed by Spark over a bounded sample of
labelled rows; only that table (``BUCKETS`` rows a language) reaches the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.store import Scratch, small

#: labelled rows of a language that the classifiers are fitted on, whole texts
SAMPLE = 2000
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: margin per unit of mean log-odds
GAIN = 8.0
#: a text is ambiguous if the runner-up's mean loss is nearer than this
AMBIGUOUS = 0.02
UNKNOWN = "und"

_SEGMENT = 1 << 20
_ALPHA: list[np.ndarray] = []


def codewords(n: int) -> np.ndarray:
    """The code matrix of n languages (a row each): all splits into two parts up
    to seven languages, beyond that the best of 200 random codes."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        rest = list(itertools.product((1, -1), repeat=n - 1))[1:]  # the first language's bit is always 1
        return np.array([(1, *bits) for bits in rest], np.int8).T
    random, best = np.random.default_rng(4), (-1, None)
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, math.ceil(10 * math.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        near = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        best = max(best, (near, code), key=lambda x: x[0])
    return best[1]


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of lower-cased letters; a run of other characters is one space."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    counts = np.zeros(BUCKETS, np.float32)
    for at in range(0, len(text), _SEGMENT):
        part = " " + text[max(0, at - 2):at + _SEGMENT].lower() + " "
        chars = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
        letter = _ALPHA[0][chars]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of others
        keep[0] = True
        chars = np.where(letter, chars, 32)[keep].astype(np.uint32)
        mixed = np.zeros(len(chars), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            mixed = mixed[:len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1:]
            if n in ORDERS and len(mixed):
                place = ((mixed ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                counts += np.bincount(place, minlength=BUCKETS)
    return counts


def in_training(doc_id: Column) -> Column:
    """Whether crc32 of the id's text mod 4 is not 2 (a null id: yes)."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Languages, codewords and bit weights, from text and lang of the training rows.

    The sample is the ``sample`` rows of a language whose ids hash lowest (all,
    if it has fewer); rows without text or lang teach nothing.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    known = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # the lowest hashes of each language: a count by their leading 12 bits says
    # which rows can be among them, so no language is gathered whole in a task
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")) \
        .withColumn("lead", F.shiftrightunsigned("hash", 52)).distinct()
    leads = hashed.groupBy("lang", "lead").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))
    enough = leads.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < sample).groupBy("lang").agg(F.max("lead").alias("last"))
    low = hashed.join(small(scratch.write(enough, "leads")), "lang").where("lead <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.expr("shiftrightunsigned(hash, 1)"), "hash", "doc_id"))
    chosen = scratch.write(low.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang"), "chosen")
    picked = known.join(small(chosen), ["doc_id", "lang"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                if any(map(str.isalpha, text)):
                    totals[lang] = totals.get(lang, 0) + ngram_counts(text).astype(np.float64)
        for lang, total in totals.items():
            place = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "place": place, "count": total[place]})

    # a sum of whole numbers: the same in any order
    table = picked.select("lang", "text").mapInPandas(count, "lang string, place int, count double") \
        .groupBy("lang", "place").agg(F.sum("count").alias("count")).toPandas()
    languages = sorted(table["lang"].unique())
    totals = np.zeros((len(languages), BUCKETS))
    totals[[languages.index(x) for x in table["lang"]], table["place"].to_numpy(dtype=int)] = table["count"]
    code = codewords(len(languages))
    share = (totals + 0.5) / (totals + 0.5).sum(1, keepdims=True) if len(languages) else totals
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, other = share[code[:, bit] > 0].mean(0), share[code[:, bit] < 0].mean(0)
        weights[:, bit] = np.log(one) - np.log(other)
    return {"languages": languages, "code": code, "weights": weights}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[int, float, bool]:
    """The nearest codeword by logistic loss, its score (0 to 1) and whether it is ambiguous."""
    loss = np.logaddexp(0, -code * margins).sum(1)
    order = np.argsort(loss, kind="stable")
    score = 1 / np.exp(np.minimum(loss[order[0]] - loss, 0)).sum()
    near = len(order) > 1 and (loss[order[1]] - loss[order[0]]) / code.shape[1] < AMBIGUOUS
    return int(order[0]), float(min(1.0, max(0.0, score))), bool(near)


def predictor(model: dict):
    """A function of a text column: struct of lang_pred, score and ambiguous.

    Texts that are null or have no letter are ``und`` with score 0; with no
    language learned, so is every text, and a sole language takes them all.
    """
    languages, code, weights = model["languages"], model["code"], model["weights"]

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def predict(column: pa.Array) -> pa.Array:
        rows = []
        for scalar in column:  # one text at a time becomes a Python string
            text = scalar.as_py()
            if text is None or not languages or not any(map(str.isalpha, text)):
                rows.append((UNKNOWN, 0.0, False))
            elif len(languages) == 1:
                rows.append((languages[0], 1.0, False))
            else:
                counts = ngram_counts(text)
                best, score, near = decode(GAIN * (counts @ weights) / counts.sum(), code)
                rows.append((languages[best], score, near))
        said = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(said[0], pa.string()), pa.array(said[1], pa.float64()), pa.array(said[2], pa.bool_())],
                                          names=["lang_pred", "score", "ambiguous"])

    return predict


def identify(docs: DataFrame, carry: list[str], sample: int = SAMPLE) -> DataFrame:
    """row (a struct of the carried columns), held_out, lang_pred, score and ambiguous of every document.

    Rows stay one by one, also repeated ones; carried columns may have any name.
    """
    predict = predictor(fit(docs, sample))
    needed = list(dict.fromkeys([*carry, "doc_id", "text"]))  # a text is held once beside the Python worker
    said = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(needed))).withColumn("said", predict(f"__{needed.index('text')}"))
    row = F.struct(*(F.col(f"__{i}").alias(c) for i, c in enumerate(needed[:len(carry)])))
    return said.select(row.alias("row"), held_out(F.col(f"__{needed.index('doc_id')}")).alias("held_out"), "said.*")
