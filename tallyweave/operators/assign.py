"""One-to-one assignment and components, as rounds of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def first_come(edges: DataFrame) -> DataFrame:
    """``edges(tx_ord, key_ord, invoice_id, ...)`` to the edges of a serial choice: transactions in order each take
    their first edge whose invoice is still free.

    A round accepts every edge that is the first of its transaction and whose transaction is the first of its invoice,
    then drops all edges that touch an accepted one; the first remaining transaction is always served, so it ends."""
    left = materialize(edges)
    taken: list[DataFrame] = []
    of_tx, of_invoice = Window.partitionBy("tx_ord"), Window.partitionBy("invoice_id")
    while not left.isEmpty():
        first = left.withColumn("_own", F.min("key_ord").over(of_tx)).withColumn("_claim", F.min("tx_ord").over(of_invoice))
        first = first.withColumn("_ok", F.expr("key_ord = _own and tx_ord = _claim"))
        touched = first.withColumn("_gone", F.max("_ok").over(of_invoice)).withColumn("_gone", F.expr("_gone or max(_ok) over (partition by tx_ord)"))
        settled = materialize(touched.drop("_own", "_claim"))
        taken.append(settled.where("_ok").select(*edges.columns))
        left = settled.where("not _gone").select(*edges.columns)
    if not taken:
        return left
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def bipartite_components(edges: DataFrame) -> DataFrame:
    """Add ``component``, the least ``tx_ord`` reachable, to ``edges(tx_ord, invoice_id, ...)``.

    Labels go from transactions to invoices and back, and a label's own label is followed, so long chains shorten by
    doubling."""
    pairs = materialize(edges.select("tx_ord", "invoice_id").distinct())
    labels = pairs.select("tx_ord").distinct().withColumn("component", F.col("tx_ord"))
    while True:
        by_invoice = pairs.join(labels, "tx_ord").groupBy("invoice_id").agg(F.min("component").alias("component"))
        spread = pairs.join(by_invoice, "invoice_id").groupBy("tx_ord").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("tx_ord").alias("component"), F.col("component").alias("further"))
        after = spread.join(jump, "component", "left").select("tx_ord", F.least("component", F.coalesce("further", "component")).alias("component"))
        after = materialize(after.join(labels.select("tx_ord", F.col("component").alias("old")), "tx_ord"))
        labels = after.select("tx_ord", "component")
        if after.where("component <> old").isEmpty():
            return edges.join(labels, "tx_ord")
