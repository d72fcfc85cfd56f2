"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of 1, 2 and 3 characters is hashed into one of ``2**bits`` buckets. The model is a
matrix of 32-bit log probabilities (buckets x languages), which is broadcast; beyond ``MODEL_BYTES`` fitting fails
and asks for fewer ``bits``. Scoring gathers the rows of a batch's n-grams and sums them per text in double
precision; whole texts are read, in pieces.

``keep_known`` also asks whether a text looks like its language at all: its mean log probability per n-gram must not be
more than ``SPREADS`` deviations below the language's own mean, both over the n-grams the language was
learned from. That does not depend on the text's length. Without any label there is no language to look like; then
every document with a letter stays.

Training uses at most ``PER_LANGUAGE`` texts per language in expectation, drawn by the hash of the id
(the documented bound of the sample); class shares come from all labelled rows.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text where nothing
could be learned. The score is the posterior probability of the predicted language. Equal scores go
to the first language in code-point order. Rows are judged one by one; other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import hex_unit, id_text, rows_packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 5_000
SMOOTHING = 0.5
MODEL_BYTES = 64 << 20
SPREADS = 1.5            # deviations below a language's mean log probability that are still its texts
PIECE = 1 << 17          # characters hashed at once
UNKNOWN = "und"
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
TRAIN_TASKS = 16


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, owners): at most PIECE characters of whole or cut texts.

    A cut text's next piece repeats its last two characters, so that no n-gram is lost; single
    characters and pairs inside that overlap belong to the earlier piece (see ``_grams``).
    """
    part, starts, owners, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), PIECE):
            chunk = t[max(0, a - 2):a + PIECE] if a else t[:PIECE]
            if size and size + len(chunk) > PIECE:
                yield "".join(part), starts, owners
                part, starts, owners, size = [], [], [], 0
            starts.append((size, min(a, 2)))
            owners.append(i)
            part.append(chunk)
            size += len(chunk)
    if part:
        yield "".join(part), starts, owners


def _grams(text: str, starts: list[tuple[int, int]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: (buckets, valid) for the n-gram that begins at each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    begin = np.array([s for s, _ in starts] + [n])
    for order in ORDERS:
        h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            h[:n - j] += codes[j:] * np.uint32(FACTORS[j])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        valid = np.ones(n, bool)
        for (s, seen), e in zip(starts, begin[1:]):
            valid[max(s, e - order + 1):e] = False          # runs past the end of the text
            if seen and order < 3:
                valid[s:s + min(seen, 3 - order)] = False   # counted by the earlier piece
        yield h >> np.uint32(32 - bits), valid


def count_grams(texts: list[str], bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    for text, starts, _ in _pieces([t.lower() for t in texts]):
        for h, ok in _grams(text, starts, bits) if text else ():
            total += np.bincount(h[ok], minlength=1 << bits)
    return total


def log_scores(texts: list[str], table: np.ndarray, prior: np.ndarray, bits: int) -> np.ndarray:
    """Log joint probabilities (texts x languages). ``table`` has a last row of zeros."""
    out = np.tile(prior, (len(texts), 1))
    none = len(table) - 1
    for text, starts, owners in _pieces([t.lower() for t in texts]):
        if not text:
            continue
        begin = np.array([s for s, _ in starts])
        some = np.flatnonzero(np.diff(np.append(begin, len(text))) > 0)
        for h, ok in _grams(text, starts, bits):
            h = np.where(ok, h, none)
            sums = np.add.reduceat(np.take(table, h, axis=0), begin[some], axis=0, dtype=float)
            np.add.at(out, np.array(owners)[some], sums)
    return out


def gram_counts(lengths: np.ndarray) -> np.ndarray:
    """How many n-grams texts of these lengths have."""
    return sum(np.maximum(lengths - order + 1, 0) for order in ORDERS)


class Model:
    """``floor``: the least mean log probability per n-gram of a text of each language."""

    def __init__(self, languages: list[str], bits: int, table: np.ndarray, prior: np.ndarray, floor: np.ndarray):
        self.languages, self.bits, self.table, self.prior, self.floor = languages, bits, table, prior, floor


def remainder(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.encode(id_text(id_col), "UTF-8")) % folds


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by = pd.DataFrame({"lang": b.column("lang").to_pylist(), "text": b.column("text").to_pylist()})
            for lang, texts in by.groupby("lang")["text"]:
                sums[lang] = sums.get(lang, 0) + count_grams(list(texts), bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            ["lang", "counts"])
    return run


def _add_up(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in part["counts"])
    return pd.DataFrame({"lang": part["lang"][:1], "counts": [total.tobytes()]})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE, bits: int = BITS) -> Model | None:
    """Train on the rows of ``labelled`` with a label and a text; None without any."""
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text].alias("text"), labelled[lang].alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    shares = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "shares")
    sizes = {r.lang: r.n for r in shares.collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    if (1 << bits) * len(languages) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages with 2**{bits} buckets need over {MODEL_BYTES} bytes; give fewer bits")
    drawn = hex_unit(F.md5(F.concat(id_text(F.col("id")), F.lit(":language"))))
    sample = (rows.join(shares, "lang").where(drawn * F.col("n") < per_language)
                  .select("lang", "text").repartition(TRAIN_TASKS))
    counts = (sample.mapInArrow(_counter(bits), "lang string, counts binary")
                    .groupBy("lang").applyInPandas(_add_up, "lang string, counts binary"))
    table, floor = np.zeros(((1 << bits) + 1, len(languages)), np.float32), np.zeros(len(languages))
    for r in counts.toLocalIterator():
        c, k = np.frombuffer(r.counts, np.int64), languages.index(r.lang)
        logs = np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
        table[:-1, k] = logs
        if c.sum():
            mean = (c * logs).sum() / c.sum()
            floor[k] = mean - SPREADS * np.sqrt((c * (logs - mean) ** 2).sum() / c.sum())
    seen = ~(table[:-1] == 0).all(axis=0)      # a language whose drawn sample is empty cannot be predicted
    prior = np.where(seen, np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values())), -np.inf)
    return Model(languages, bits, table, prior, floor)


def predictor(spark, model: Model | None):
    """A column function: text -> struct(lang, score, like); ``like`` tells whether the text looks like its language."""
    schema = "lang string, score double, like boolean"
    if model is None:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                                     F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("like"))
    shared = spark.sparkContext.broadcast((model.languages, model.bits, model.table, model.prior, model.floor))

    @F.pandas_udf(schema)
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, bits, table, prior, floor = shared.value
        for texts in parts:
            known = texts.notna().to_numpy()
            whole = texts.where(known, "").tolist()
            s = log_scores(whole, table, prior, bits)
            best = s.argmax(axis=1) if len(s) else np.zeros(0, int)
            top = s[np.arange(len(s)), best][:, None]
            n = np.maximum(gram_counts(np.array([len(t.lower()) for t in whole], np.int64)), 1)
            yield pd.DataFrame({"lang": np.array(languages, object)[best], "score": 1.0 / np.exp(s - top).sum(axis=1),
                                "like": (top[:, 0] - prior[best]) / n >= floor[best]})

    def column(text: Column) -> Column:
        lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        made = scored(F.when(lettered, text))
        return F.struct(F.when(lettered, made["lang"]).otherwise(F.lit(UNKNOWN)).alias("lang"),
                        F.when(lettered, made["score"]).otherwise(F.lit(0.0)).alias("score"),
                        (lettered & F.coalesce(made["like"], F.lit(False))).alias("like"))
    return column


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(row, lang, score, like): each whole row as a struct beside its prediction."""
    column = predictor(docs.sparkSession, model)
    return (rows_packed(docs).withColumn("p", column(F.col(f"row.`{text}`")))
            .select("row", F.col("p.lang").alias("lang"), F.col("p.score").alias("score"), F.col("p.like").alias("like")))


def keep_known(docs: DataFrame, model: Model | None, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The documents that look like a learned language, unchanged; without a model those with a letter."""
    known = F.lit(True) if model is None else F.col("score") >= min_score
    return predict(docs, model, text).where(F.col("like") & known).select("row.*")


def predictions(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    model = fit(docs.where(remainder(docs[id_col]) != 0), text, lang, id_col)
    out = predict(docs, model, text)
    return out.select(F.col(f"row.`{id_col}`").alias("doc_id"),
                      (remainder(F.col(f"row.`{id_col}`")) == 0).alias("held_out"),
                      F.col("lang").alias("lang_pred"), "score")
