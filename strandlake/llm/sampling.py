"""Training rows: labelled documents outside the held-out fold, bounded and documented."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut, spent


def fold(column: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string"))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, chars: int
) -> pd.DataFrame:
    """At most ``per_class`` (text, label) rows of each class, those first by a hash of the id.

    The ids are chosen on the narrow label table; an id labelled both ways is
    left out. The texts of the chosen ids only are written to the shared folder,
    and the first ``chars`` characters of these in total, by whole documents of
    at most a tenth of that, go to the driver: sizes are summed before any text
    moves. Of several texts of one id the one that sorts first counts. The bound
    is on what is learnt from, never on what is scored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(F.pmod(fold(), F.lit(modulus)) != held_out)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy(order, "doc_id").limit(per_class)
    )
    ids = [(r[0], r[1]) for r in chosen.collect()]
    if not ids:
        return pd.DataFrame({"text": [], "label": []})
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", F.length("text").alias("size"))
    rows = cut(rows.where((F.col("size") > 0) & (F.col("size") <= chars // 10)))
    sizes = rows.groupBy("doc_id").agg(F.max("size").alias("size")).toPandas()
    sizes["order"] = pd.util.hash_array(sizes["doc_id"].to_numpy())
    sizes = sizes.sort_values(["order", "doc_id"])
    fits = sizes[sizes["size"].cumsum() <= chars]["doc_id"]
    rank = {int(i): k for k, i in enumerate(fits)}
    first = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = first.where(F.col("doc_id").isin(list(rank))).toPandas() if rank else pd.DataFrame({"doc_id": [], "text": [], "label": []})
    spent(rows)
    return found.sort_values("doc_id", key=lambda c: c.map(rank))[["text", "label"]].reset_index(drop=True)
