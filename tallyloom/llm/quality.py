"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: its words and the words inside five-word windows found twice or more.
The corpus rule hashes normalised lines, counts the distinct documents (distinct texts, so that copies of
one document count once) that hold a line per host, takes away the lines found in more than
``max_docs`` of them, and rejects documents that keep too little.

Lines are hashed before any shuffle and counted with partial aggregates (host, line, text) then
(host, line), so neither a hot host nor a line that every document holds ends up in one task.

Defined cases: a null text has no words (all counts 0, base_failed); a null host is a host of its own.
Lines without a word are neither counted nor removed. Rows that repeat an id or a text are judged one by
one. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import BREAK, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10            # of the base rules, and of what line removal must leave
MAX_REPEAT_PERCENT = 20
MAX_DOCS = 20             # distinct documents of a host that may hold one line
MIN_LEFT_PERCENT = 30     # words that line removal must leave


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """ASCII lower case, single spaces, digits as 0."""
    flat = F.trim(F.regexp_replace(line, BREAK, " "))
    return F.regexp_replace(F.translate(flat, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                            "[0-9]", "0")


def _windows(words: Column) -> Column:
    """A 64-bit hash per five-word window, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(WINDOW - 1)),
                       lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int"))
                                              for j in range(WINDOW)]))


def repeated_words(df: DataFrame, windows: str, out: str) -> DataFrame:
    """Adds the number of words inside windows found twice or more in the row's own array.

    Windows are sorted by hash, equal neighbours give the repeated starts, and the starts in order give
    the covered words; rows whose windows are all distinct skip that.
    """
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_placed", placed)
    same = F.when(F.col("_placed").isNotNull(), F.zip_with(
        F.col("_placed"), F.slice(F.col("_placed"), 2, F.size("_placed")),
        lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same"))))
    df = df.withColumn("_same", same)
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(
        F.filter("_same", lambda x: x["same"]), lambda x: F.array(x["i"], x["j"])))))
    df = df.withColumn("_starts", starts)
    steps = F.zip_with(F.col("_starts"), F.slice(F.col("_starts"), 2, F.size("_starts")),
                       lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return (df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint"))
              .drop("_placed", "_same", "_starts"))


def base_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source") -> DataFrame:
    """Per row: ids, counts of the base rules and the array of its lines (hash, words)."""
    t = text_of(docs[text])
    df = docs.select(docs[id_col].alias("doc_id"), docs[host].alias("host"), t.alias("body"),
                     words_of(t).alias("words"), _lines(t).alias("lines"))
    df = df.select(
        "doc_id", "host", F.xxhash64("body").alias("text_hash"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("body", BREAK, "")).cast("bigint").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, _windows(F.col("words")))
         .otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"),
                                                F.size(words_of(x)).alias("words"))).alias("held"))
    return repeated_words(df, "windows", "n_repeat_words").drop("windows")


def _line_tables(base: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(host, text, line, words over all copies of the text) and the lines above the limit."""
    held = base.select("host", "text_hash", F.explode("held").alias("x"))
    lines = materialise(held.groupBy("host", "text_hash", F.col("x.line").alias("line"))
                            .agg(F.sum("x.words").alias("words")), "lines")
    common = (lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
                   .where(F.col("n_docs") > max_docs)
                   .select(F.col("host").alias("of"), F.col("line").alias("common")))
    common = materialise(common, "common_lines")
    hit = lines.join(common, lines.host.eqNullSafe(common.of) & (lines.line == common.common))
    return hit, common


def _per_text(base: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of a stored table (host, text_hash, ...) without its keys."""
    table = table.select(F.col("host").alias("_host"), F.col("text_hash").alias("_text"),
                         *[c for c in table.columns if c not in ("host", "text_hash")])
    on = base.host.eqNullSafe(table["_host"]) & (base.text_hash == table["_text"])
    return base.join(table, on, "left").drop("_host", "_text")


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source",
                  max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Per document the base counts, base_failed, kept, and the words left after line removal."""
    base = materialise(base_counts(docs, text, id_col, host), "quality")
    hit, _ = _line_tables(base, max_docs)
    copies = base.groupBy("host", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    gone = hit.groupBy("host", "text_hash").agg(F.sum("words").alias("gone"))
    gone = _per_text(copies, materialise(gone, "gone")).where("gone is not null")
    gone = materialise(gone.select("host", "text_hash", F.expr("gone div copies").alias("removed")), "removed")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words")
                                               > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * min_left_percent)
    return (_per_text(base.drop("held"), gone)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("n_left")))


def clean_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source",
                max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, host, text): the texts without the lines above the limit."""
    t = text_of(docs[text])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host].alias("host"), t.alias("text"),
                       F.xxhash64(t).alias("text_hash"))
    base = rows.withColumn("held", F.transform(_lines(F.col("text")), lambda x: F.struct(
        F.xxhash64(normal_line(x)).alias("line"), F.size(words_of(x)).alias("words"))))
    hit, _ = _line_tables(base, max_docs)
    bad = materialise(hit.groupBy("host", "text_hash").agg(F.collect_set("line").alias("bad")), "bad_lines")
    stay = F.filter(F.split("text", "\n", -1),
                    lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(normal_line(x))))
    return _per_text(rows, bad).select(
        "doc_id", "host", F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
        .alias("text"))
