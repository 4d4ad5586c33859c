"""Exact deduplication by radix partitioning, most significant bytes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import ascii_lower, cut

FIRST_DIGIT = 64  # bytes of the first digit; each later digit is GROWTH times as wide
GROWTH = 8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with its group of equal texts: (id, keep_id, group_size, kept, text_sha256).

    The key of a document is its length in bytes followed by its bytes. A round splits every open group by the next
    digit, a run of bytes whose width grows, so that rounds grow with the logarithm of the longest text that has a
    twin. Groups that are singletons or have ended leave; only open ones carry the rest of their text on. Texts are
    equal because all their bytes were compared; the digest is output only.

    Equal: identical after lower-casing A-Z; null counts as empty. The largest id of a group stays; null ids sort
    below all, and a group of null ids only has keep_id null and kept false. Rows that repeat id and text are one
    group and are all marked kept or all not. Other columns are not read. Empty tables give no rows.
    """
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = (docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), text.alias("t"))
            .select("id", "rid", F.unhex(F.sha2("t", 256)).alias("sha"), F.encode("t", "utf-8").alias("rest"))
            .withColumn("grp", F.octet_length("rest").cast("long")))
    done, width = None, FIRST_DIGIT
    while True:
        cutting = rows.withColumn("digit", F.substring("rest", 1, width))
        keys = ["grp", "digit"]
        sizes = cutting.groupBy(*keys).agg(F.min("rid").alias("low"), F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        split = cutting.join(sizes.select(F.col("grp").alias("g2"), F.col("digit").alias("d2"), "low", "keep", "size"),
                             (F.col("grp") == F.col("g2")) & (F.col("digit") == F.col("d2")))
        over = (F.col("size") == 1) | (F.octet_length("rest") <= width)
        state = cut(split.select("id", "rid", "sha", F.col("low").alias("grp"), "keep", "size", over.alias("over"),
                                 F.when(~over, F.expr(f"substring(rest, {width + 1})")).alias("rest")))
        ended = state.where("over").select("id", "keep", "size", "sha")
        done = ended if done is None else done.unionByName(ended)
        rows = state.where("not over").select("id", "rid", "sha", "rest", "grp")
        if rows.isEmpty():
            break
        width *= GROWTH
    return done.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                       F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
