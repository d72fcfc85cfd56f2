"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every text to ``HASHES`` positions, counts the rows per position (map-side combined) and
keeps the positions hit more than once as a bitmap of 4 KB buckets. Pass 2 probes that bitmap: a text
with a position hit only once is certainly unique and passes straight through; the other rows shuffle
by SHA-256 and are grouped exactly. False positives only make a few more rows shuffle.

The bitmap has ``BITS_PER_ROW`` positions a row, at most ``MAX_BITS``; it is the one thing broadcast and
never exceeds ``HASHES * MAX_BITS / 8`` bytes (64 MB). A fuller bitmap lets more rows through to the
exact grouping, it never changes a result.

Defined cases: a null text counts as empty and equals an empty one. Rows with a null id lose against
any id. Rows that agree in id and text are one document written twice: one of them stays. Other columns,
whatever their names, are carried along unread. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import rows_packed, text_of

HASHES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 28
BUCKET = 32_768     # positions of one native bitmap


def _positions(h: Column, bits: int) -> list[Column]:
    """One position per hash function, each in its own stretch of ``bits`` positions."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) + F.lit(i * bits) for i in range(HASHES)]


def hit_bitmap(df: DataFrame, h: str, bits: int, least: int) -> DataFrame:
    """(bucket, bitmap) of the positions that ``least`` rows or more hit."""
    hit = (df.select(F.explode(F.array(*_positions(F.col(h), bits))).alias("pos"))
             .groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    return (hit.groupBy((F.shiftright("pos", 15)).alias("bucket"))
               .agg(F.bitmap_construct_agg(F.col("pos") % BUCKET).alias("bitmap")))


def flag_repeats(df: DataFrame, h: str, bits: int) -> DataFrame:
    """Adds ``maybe``: false only for rows whose hash certainly occurs once."""
    return probe_bitmap(df, h, materialise(hit_bitmap(df, h, bits, 2), "bloom"), bits)


def probe_bitmap(df: DataFrame, h: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe``: false only for rows with a position that is not in the stored bitmap."""
    maybe = F.lit(True)
    for i, pos in enumerate(_positions(F.col(h), bits)):
        side = F.broadcast(bitmap.select(F.col("bucket").alias(f"_b{i}"),
                                         F.col("bitmap").alias(f"_m{i}")))
        df = (df.withColumn(f"_p{i}", pos)
                .join(side, F.shiftright(f"_p{i}", 15) == F.col(f"_b{i}"), "left"))
        byte = F.expr(f"cast(conv(hex(substring(_m{i}, cast((_p{i} % {BUCKET}) div 8 as int) + 1, 1)), "
                      f"16, 10) as int)")
        bit = F.expr(f"cast(pow(2, _p{i} % 8) as int)")
        maybe = maybe & F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    extra = [c for i in range(HASHES) for c in (f"_p{i}", f"_b{i}", f"_m{i}")]
    return df.withColumn("maybe", maybe).drop(*extra)


def filter_bits(rows: int) -> int:
    bits = BUCKET
    while bits < min(MAX_BITS, rows * BITS_PER_ROW):
        bits *= 2
    return bits


def _flagged(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    slim = docs.select(docs[id_col].alias("doc_id"), F.sha2(text_of(docs[text]), 256).alias("sha"),
                       F.xxhash64(text_of(docs[text])).alias("h"))
    slim = materialise(slim, "hashes")
    return materialise(flag_repeats(slim, "h", filter_bits(slim.count())).drop("h"), "flagged")


def _groups(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per text and id, rows and largest id per text), of the possibly repeated rows."""
    pairs = materialise(flagged.where("maybe").groupBy("sha", "doc_id")
                               .agg(F.count(F.lit(1)).alias("n")), "pairs")
    texts = pairs.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return pairs, materialise(texts, "texts")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged = _flagged(docs, text, id_col)
    single = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    pairs, texts = _groups(flagged)
    written = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("at")
    grouped = (pairs.join(texts, "sha")
                    .select("doc_id", "keep_id", "group_size", "sha", written)
                    .select("doc_id", "keep_id", "group_size",
                            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == 1))
                            .alias("kept"), F.col("sha").alias("text_sha256")))
    return single.unionByName(grouped)


def drop_exact(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, all columns as they were; unique texts never shuffle."""
    rows = rows_packed(docs)
    body = text_of(F.col(f"row.`{text}`"))
    hashed = rows.select("row", F.xxhash64(body).alias("h"))
    bits = filter_bits(docs.count())
    flagged = flag_repeats(hashed, "h", bits)
    single = flagged.where(~F.col("maybe")).select("row")
    some = flagged.where("maybe").select(F.col(f"row.`{id_col}`").alias("doc_id"),
                                         F.sha2(body, 256).alias("sha"), "row")
    pairs = materialise(some.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n")), "pairs")
    keep = pairs.groupBy("sha").agg(F.max(F.struct("doc_id", "n")).alias("top"))
    keep = materialise(keep.select("sha", F.col("top.doc_id").alias("keep_id"), "top.n"), "keep")
    stay = some.join(keep, [some.sha == keep.sha, some.doc_id.eqNullSafe(keep.keep_id)])
    once = stay.where("n = 1").select("row")
    out = single.unionByName(once)
    if not keep.where("n > 1").isEmpty():
        twice = (stay.where("n > 1").groupBy(some.sha)
                     .agg(F.first("row").alias("row")).select("row"))
        out = out.unionByName(twice)
    return out.select("row.*")
