"""Labelled samples for models, bounded by a parameter, and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(labelled: DataFrame, per_class: int, seed: int = 0) -> list[tuple[int, object]]:
    """(doc_id, label) of about ``per_class`` rows of each label, at most that many: those whose seeded hash of
    the id is smallest. ``labelled``: (doc_id, label), nulls in either left out. The counts of the
    labels come to the driver; labels are few."""
    labelled = labelled.where("doc_id is not null and label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, 1.2 * per_class / n))).otherwise(share)
    # at most 1.2 x per_class x labels rows are expected here
    rows = labelled.withColumn("unit", unit).where(F.col("unit") < share).select("label", "unit", "doc_id").distinct().collect()
    out: list[tuple[int, object]] = []
    for label in sorted(counts):
        out += [(r["doc_id"], label) for r in sorted((r for r in rows if r["label"] == label), key=lambda r: (r["unit"], r["doc_id"]))[:per_class]]
    return out


def sample_texts(docs: DataFrame, sample: list[tuple[int, object]], label_type: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of the sampled ids; broadcasts the sample, which is bounded."""
    ids = docs.sparkSession.createDataFrame(sample, f"doc_id long, label {label_type}")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
