"""Which documents contain which passages, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.shared import written
from lexspark.functions.sizes import bounded, text_bytes
from lexspark.functions.text import let

ANCHOR = 4


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def containing(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text") -> DataFrame:
    """(doc, item): documents that have an item's words in a row. Items are looked up by the hash of
    their first ANCHOR words (all, if fewer) among the windows of the documents, then verified."""
    asked = items.select(F.col(item).alias("item"), _words(F.col(text)).alias("iw")).where(F.size("iw") > 0)
    asked = asked.withColumn("n", F.least(F.size("iw"), F.lit(ANCHOR)))
    anchors = [(n, F.xxhash64(*(F.xxhash64(F.get("iw", F.lit(i))) for i in range(n)))) for n in range(1, ANCHOR + 1)]
    asked = asked.withColumn("anchor", F.coalesce(*(F.when(F.col("n") == n, anchor) for n, anchor in anchors)))
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())
    if not sizes:
        return docs.select(F.col(doc).alias("doc")).join(asked.select("item"), F.lit(False))
    rows = docs.select(F.col(doc).alias("doc"), _words(F.col(text)).alias("dw"))

    def hashes(words: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(0), F.size(words) - n)
            each = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n))))
            return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<bigint>"))

        return F.array_distinct(F.flatten(F.array(*map(of_size, sizes))))  # at most ANCHOR sizes

    every = rows.select("doc", F.explode(let(F.transform("dw", lambda w: F.xxhash64(w)), hashes)).alias("anchor"))
    met = every.join(bounded(asked.select("item", "anchor"), 64), "anchor").select("doc", "item")
    met = bounded(written(met.distinct(), "met"))  # mostly little; then the documents are not shuffled
    both = rows.join(met, "doc").join(bounded(asked.select("item", "iw", F.array_join("iw", " ").alias("it")), text_bytes("it")), "item")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return both.where(F.contains(spaced(F.col("dw")), F.concat(F.lit(" "), F.col("it"), F.lit(" ")))).select("doc", "item").distinct()
