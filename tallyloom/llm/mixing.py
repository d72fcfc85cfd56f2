"""Mixing sources to target weights by repetition rates.

Tokens are summed per source (partial sums before the shuffle). Every source aims at its share of all tokens
by weight; a target stops at ``cap`` times the source's tokens and the excess is shared out again by
weight until no target is above its stop. A document is emitted floor(rate) times plus once more when
its hash draw falls below the fraction, rate being target / tokens. Draws depend on the seed, the id, the text and,
among rows that agree in both, on a number, so reruns agree, lost tasks repeat their rows, and rows without an id
do not fall together.

Defined cases: a null or empty text has size 0 and is emitted like the other documents of its source;
a null source is a source of its own, ordered last; a source without tokens has target 0 and emits nothing.
Rows that agree in id and text draw one by one. Other columns are carried along unread. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise, running_total
from tallyloom.llm.common import hex_unit, id_text, numbered, rows_packed, text_of, words_of

SEED = "mix"
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Only two sums per round reach the driver; a round fixes every source now above its stop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(totals.withColumn("absent", F.col("source").isNull()), [],
                           ["absent", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = materialise(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")),
                        "sources")
    stop = F.col("source_size") * cap
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share = whole[0] or 0, whole[1] or 0
    level, fixed = (left / share if share else 0.0), -1
    while True:
        over = stop < F.lit(level) * F.col("weight")
        n, taken, used = table.where(over).agg(F.count(F.lit(1)), F.sum(stop), F.sum("weight")).first()
        if n == fixed or not n or used == share:
            break
        fixed, level = n, (left - taken) / (share - used)
    return table.select("source", "source_size",
                        F.least(F.lit(float(level)) * F.col("weight"), stop.cast("double")).alias("target"))


def copies(id_col: Column, text_hash: Column, nth: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    """floor(rate) plus one with the probability of the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    draw = hex_unit(F.md5(F.concat_ws(":", id_text(id_col), text_hash, nth.cast("string"), F.lit(seed))))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))


def mix_plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, source."""
    sizes = materialise(docs.select(docs[id_col].alias("doc_id"), docs[source].alias("source"),
                                    F.size(words_of(docs[text])).cast("bigint").alias("size"),
                                    F.md5(text_of(docs[text])).alias("h")), "sizes")
    targets = source_targets(sizes, weights).withColumnRenamed("source", "of")
    rows = numbered(sizes, ["doc_id", "h"], "nth")
    return (rows.join(targets, rows.source.eqNullSafe(targets.of))
                .withColumn("copies", copies(F.col("doc_id"), F.col("h"), F.col("nth"), F.col("target"),
                                             F.col("source_size"), seed))
                .select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """The mixed documents: every column as it was, each row as often as its copies."""
    sizes = materialise(docs.select(docs[source].alias("source"),
                                    F.size(words_of(docs[text])).cast("bigint").alias("size"))
                            .groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    targets = source_targets(sizes, weights).withColumnRenamed("source", "of")
    rows = rows_packed(docs).select("row", F.col(f"row.`{id_col}`").alias("id"),
                                    F.md5(text_of(F.col(f"row.`{text}`"))).alias("h"))
    joined = numbered(rows, ["id", "h"], "nth").join(targets, F.col(f"row.`{source}`").eqNullSafe(targets.of))
    n = copies(F.col("id"), F.col("h"), F.col("nth"), F.col("target"), F.col("source_size"), seed).cast("int")
    return (joined.withColumn("n", n).where("n > 0")
                  .select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
                  .select("row.*"))
