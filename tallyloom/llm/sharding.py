"""Jump consistent hashing onto numbered shards, in DataFrame operations only.

The published generator (multiply by 2862933555777941757, add 1, modulo 2**64) is seeded with the key.
Each draw gives the next shard count at which the key would move; the shard is the last one below the
number of shards, so one run of the generator answers for ``n`` and ``n + 1`` shards at once, no ring
table exists, and adding a shard moves rows only into it.

Spark's multiplication fails on overflow, hence the 64-bit product is built from 32- and 16-bit parts.

Defined cases: a null text has no bytes; a null key is hashed like the number 0; rows with equal keys share a
shard. Other columns are carried along unread by ``assign``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_text, rows_packed, sliced_rank, text_of

MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _times(part: Column, factor: int) -> Column:
    """(part * factor) modulo 2**32 for two 32-bit numbers."""
    high = (part * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (part * F.lit(factor & 0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW))


def next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, as a signed long."""
    low, high = key.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(key, 32)
    c_low, c_high = MULTIPLIER & LOW, MULTIPLIER >> 32
    upper = low * F.lit(c_low >> 16)
    sum_low = low * F.lit(c_low & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftrightunsigned(sum_low, 32) + F.shiftrightunsigned(upper, 16)
    top = (carry + _times(high, c_low) + _times(low, c_high)).bitwiseAND(F.lit(LOW))
    return F.shiftleft(top, 32).bitwiseOR(sum_low.bitwiseAND(F.lit(LOW)))


def jump_shards(key: Column, n: int) -> Column:
    """struct(shard, grown): the shard among ``n`` and among ``n + 1``.

    The candidate rises with every draw, so ``n`` draws always suffice; a key that is done keeps its
    state through the rest.
    """
    def draw(state: Column, _: Column) -> Column:
        key = next_state(state["key"])
        step = F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + F.lit(1)).cast("double")
        then = F.floor((state["at"] + F.lit(1)).cast("double") * step).cast("bigint")
        going = state["at"] <= F.lit(n)
        return F.struct(
            F.when(going, key).otherwise(state["key"]).alias("key"),
            F.when(going, then).otherwise(state["at"]).alias("at"),
            F.when(going & (then < F.lit(n)), then).otherwise(state["shard"]).alias("shard"),
            F.when(going & (then <= F.lit(n)), then).otherwise(state["grown"]).alias("grown"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(key.alias("key"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, draw,
                       lambda s: F.struct(s["shard"].cast("int").alias("shard"),
                                          s["grown"].cast("int").alias("grown")))


def stable_key(col: Column, kind: str) -> Column:
    """Whole numbers are their own key, other values are hashed by their text."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(col.cast("bigint"), F.lit(0).cast("bigint"))
    return F.xxhash64(col.cast("string"))


def assign(df: DataFrame, key: str, n: int = 16, shard: str = "shard") -> DataFrame:
    """All columns plus ``shard``; no shuffle."""
    kind = dict(df.dtypes)[key]
    return (rows_packed(df)
            .withColumn("_s", jump_shards(stable_key(F.col(f"row.`{key}`"), kind), n)["shard"])
            .select("row.*", F.col("_s").alias(shard)))


def write_shards(df: DataFrame, key: str, path: str, n: int = 16, files: int = 64) -> None:
    """One folder per shard; each shard's rows are dealt over ``files`` writers by row content."""
    out = assign(df, key, n, "_shard")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    out.repartition("_shard", spread).write.partitionBy("_shard").parquet(path)


def manifest(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.encode(text_of(docs[text]), "UTF-8")
    kind = dict(docs.dtypes)[id_col]
    both = jump_shards(stable_key(docs[id_col], kind), n)
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(body).cast("bigint") + 1).alias("size"),
                       F.crc32(body).alias("text_crc32"), both.alias("to"),
                       F.md5(F.concat(id_text(docs[id_col]), F.lit(":"), F.crc32(body).cast("string"))).alias("digest"))
    rows = rows.select("doc_id", "size", "text_crc32", "to.shard", "to.grown", "digest")
    ranked = sliced_rank(rows, ["shard"], "digest", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         F.col("grown").alias("grown_shard"))
