"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm._common import WS, join_groups, materialize, tidy
from tracelight.llm._common_rows import BROADCAST_IDS

PREFIX_CHARS = 256


def normalized(text):
    """Text with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")


def _digest(norm):
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


@tidy
def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digests: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_bytes``.

    Texts are equal when they are after white space runs become one space (null is the empty text).
    The first scan derives narrow keys (normalised byte length, hash of the first ``prefix_chars``
    characters); only rows whose length repeats reach the prefix hash, and only those whose length
    and prefix repeat are read again for their SHA-256. With ``digests`` every row is to have its
    ``text_sha256``, which is then taken in the first scan; without, it is null for rows that were
    not read again. No text is ever shuffled, but for the second scan where over BROADCAST_IDS ids meet it.

    Ties and repeated rows: a row repeated with the same id is kept whenever that id is the smallest
    of its group. Null ids never win over others; a group of null ids only has a null ``keep_id``,
    and its rows are kept. Further columns are ignored, whatever their names. Empty in, empty out."""
    norm = df.select(F.col(id_col).alias("_id"), normalized(F.col(text_col)).alias("_norm"))
    narrow = ["_id", F.octet_length("_norm").alias("_n"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix")]
    keys = materialize(norm.select(*narrow, _digest(F.col("_norm")).alias("_full")) if digests else norm.select(*narrow), "exact-keys")
    total = keys.count()
    lengths = keys.groupBy("_n").agg(F.count("*").alias("_m")).where("_m > 1")
    by_length = join_groups(keys, lengths, ["_n"], "_m", total, F.col("_id")).where("_m is not null").drop("_m")
    prefixes = by_length.groupBy("_n", "_prefix").agg(F.count("*").alias("_m")).where("_m > 1")
    by_prefix = join_groups(by_length, prefixes, ["_n", "_prefix"], "_m", total, F.col("_id")).where("_m is not null").drop("_m")
    alone = None
    if not digests:
        left = materialize(by_prefix.select("_id", "_n", "_prefix").distinct(), "exact-left")
        again = norm.join(_small(left.select(F.col("_id").alias("_l")).distinct()), F.col("_id").eqNullSafe(F.col("_l")), "left_semi")
        again = again.select(*narrow, _digest(F.col("_norm")).alias("_full"))
        same = lambda rows: [rows[c].eqNullSafe(left[c]) for c in left.columns]
        few = _small(left)
        by_prefix = materialize(again.join(few, same(again), "left_semi"), "exact-again")
        alone = keys.join(few, same(keys), "left_anti").withColumn("_full", F.lit(None).cast("binary"))
        keys = by_prefix
    groups = by_prefix.groupBy("_n", "_prefix", "_full").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    groups = materialize(groups, "exact-groups")
    out = join_groups(keys, groups, ["_n", "_prefix", "_full"], "_size", total, F.col("_id"))
    if alone is not None:
        out = out.unionByName(alone, allowMissingColumns=True)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
        F.col("_n").cast("long").alias("n_bytes"),
    )


def without_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that ``exact_dedup`` keeps, with all their columns.

    A row goes by its id and text: another text of the same id is judged for itself. Digests are
    taken of rows whose id is that of a copy, no others. Rows with a null id stay."""
    copies = exact_dedup(df, id_col=id_col, text_col=text_col, digests=False).where(F.col(id_col).isNotNull() & ~F.col("kept"))
    copies = materialize(copies.groupBy(F.col(id_col).alias("_copy")).agg(F.collect_set("text_sha256").alias("_texts")), "exact-copies")
    joined = df.join(_small(copies), df[id_col] == copies["_copy"], "left")
    digest = F.sha2(normalized(df[text_col]).cast("binary"), 256)
    gone = F.when(F.col("_texts").isNull(), False).otherwise(F.array_contains("_texts", digest))
    return joined.where(~gone).select(*[df[c] for c in df.columns])
