"""Exact duplicates with two Bloom filter passes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import join_groups, lower_ascii, stored, text_or_empty

#: Filter bits per row, and bits set per row: about one row in a hundred without a copy passes the filter by chance.
BITS_PER_ROW, BITS_SET = 32, 3
#: A filter of more words (16 bytes each) than this is joined by shuffle instead of broadcast.
BROADCAST_WORDS = 2_000_000


def exact_groups(docs: DataFrame, text: Column | None = None, doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are equal when their texts (default: column ``text``, A-Z lower-cased, null as empty) have the same SHA-256. The
    row with the largest id of a group stays; of rows repeated with the same id one stays; a null id counts as smallest.

    Pass one sets bits of every digest in a filter of words and keeps the bits that were set more than once. Pass two
    probes every row: a row with a bit that nobody else set has no copy and passes straight through. Only the others
    shuffle, map-side combined, and their groups join back without gathering a hot group. The filter grows with the row
    count and is broadcast only while its measured size is below a fixed bound. Empty tables give no rows.
    """
    text = lower_ascii(text_or_empty()) if text is None else F.coalesce(text, F.lit(""))
    keys = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "exact-keys",
    )
    total = keys.count()
    words = max(1024, total * BITS_PER_ROW // 64)
    hashed = keys.select("*", F.pmod(F.xxhash64("digest"), F.lit(words)).alias("word"), F.xxhash64("digest", F.lit(1)).alias("h"))
    bits = [F.shiftrightunsigned("h", 6 * i).bitwiseAND(63).cast("int") for i in range(BITS_SET)]

    seen = hashed.select("word", F.explode(F.array_distinct(F.array(*bits))).alias("bit")).groupBy("word", "bit").count()
    repeated = seen.where("count > 1").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set_twice"))
    repeated = stored(repeated, "exact-filter")
    small = repeated.count() <= BROADCAST_WORDS

    mask = F.lit(0).cast("long")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    probed = hashed.join(F.broadcast(repeated) if small else repeated, "word", "left")
    maybe = F.coalesce(F.col("set_twice").bitwiseAND(mask) == mask, F.lit(False))
    probed = stored(probed.select("doc_id", "digest", "row", maybe.alias("maybe")), "exact-probed")

    single = probed.where(~F.col("maybe")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    suspects = probed.where("maybe").drop("maybe")
    best = suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    grouped = join_groups(suspects, stored(best, "exact-groups"), "digest", "group_size", total).select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")
    )
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
