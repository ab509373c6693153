"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical after deleting ASCII white space (0x20, 0x09-0x0D); they are compared by the
SHA-256 of what is left. Misra-Gries counters (``DataFrame.stat.freqItems``, the Karp-Shenker-Papadimitriou
form) propose the digests that may hold more than ``support`` of the rows. Their exact counts and winners are
computed by partial aggregation and broadcast, at most ``1/support`` rows, so copies in large groups are
decided on the map side and never meet in one task. Other digests are aggregated likewise and joined by their key.

Defined results: null text counts as empty; all empty texts are one group; a null doc_id loses to any other;
of repeated identical rows exactly one is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize

_SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")


def without_spaces(text: Column) -> Column:
    """``text`` without the characters 0x20 and 0x09-0x0D; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in _SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(without_spaces(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        F.struct(
            (-F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("len"),
            F.col(id_col).isNull().alias("none"),
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("order"),
    )
    rows = materialize(rows, "digests")
    total = rows.count()
    proposed = rows.stat.freqItems(["text_sha256"], support).first()[0] if total else []
    proposed = proposed or []
    stats = (F.count("*").alias("group_size"), F.min("order").alias("best"))
    hot = (
        rows.where(F.col("text_sha256").isin(proposed))
        .groupBy("text_sha256")
        .agg(*stats)
        .where(F.col("group_size") > total * support)
    )
    hot = materialize(hot, "hot-digests")
    frequent = [r[0] for r in hot.select("text_sha256").collect()]  # at most 1/support
    is_hot = F.col("text_sha256").isin(frequent)
    settled = rows.where(is_hot).join(F.broadcast(hot), "text_sha256")
    cold = rows.where(~is_hot)
    rest = cold.join(cold.groupBy("text_sha256").agg(*stats), "text_sha256")  # aggregated before it is shuffled
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("order.row")).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM n
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
