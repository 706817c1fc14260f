"""Mixing sources to target weights (operator 6).

Words are summed per source (partial aggregates), the targets are the fixed
point of "share the corpus by weight, stop at ``max_repeat`` times the
source's size, reshare the excess", and every document is taken
``floor(rate)`` times plus one hash-seeded copy whose probability is the fraction of the
source's repetition rate.

The draws of a source are systematic, so that it comes near its target however
unequal its documents are: its documents are ordered by size, and of the first ``k``
``floor(k · fraction + offset)`` get the copy, with an offset hashed from the source.
Among documents of one size those with the smallest hashes of their ids get it.  The
words taken differ from the target by less than the source's longest document.
Hashes depend on id and source alone, so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, the
last in order; a source without words has target and rate 0; rows of one id, size and
source share their draw (and may then take the source further from its target); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.stats import global_index
from shelfwise.llm.components import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: above this many rows (of a few numbers) targets and cut-offs are joined by a shuffle
BROADCAST_ROWS = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                   max_repeat: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``; sources
    in code-point order, null last, take the weights in turn."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "last", F.col("source").isNull())
    w = F.array(*[F.lit(x) for x in weights])
    per = cut(global_index(per, ["last", "source"], "place").select(
        "source", "source_size",
        F.element_at(w, (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("w")))
    most = F.col("source_size") * max_repeat
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("w") * F.lit(level) > most
        n, used, free = per.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, most)), F.lit(0)),
                                F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    return per.select("source", "source_size", F.least(
        most.cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")))),
                              1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cut_offs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, size, most)``: documents of a source and size with a draw of at most
    ``most`` get the copy (none where it is null).  One narrow row a document is ordered by
    a distributed prefix sum, so no source is ordered in one task."""
    places = global_index(rows.select("source", "size", "draw").withColumn("last", F.col("source").isNull()),
                          ["last", "source", "size", "draw"], "place")
    places = cut(places.select("source", "size", "draw", "place"))
    classes = places.groupBy("source", "size").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    first = cut(classes.groupBy("source").agg(F.min("low").alias("first"))
                .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = rate - F.floor(rate)
    k = F.col("low") - F.col("first")
    c = classes.join(first.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "size", "low",
        (F.floor((k + F.col("n")) * fraction + draw(F.col("source"))) - F.floor(k * fraction + draw(F.col("source")))
         ).alias("copied"))
    c = cut(c.filter("copied > 0").withColumnsRenamed({"source": "of", "size": "of_size"}))
    j = places.join(c, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
    return cut(j.filter(F.col("place") - F.col("low") < F.col("copied")).groupBy("source", "size").agg(
        F.max("draw").alias("most")))


def _matched(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Left join on null-safe keys; the right side is broadcast while it is small."""
    found = found.withColumnsRenamed({c: f"of_{c}" for c in on})
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    cond = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in on]
    return rows.join(found, cond, "left").drop(*[f"of_{c}" for c in on])


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every input row as the struct ``row`` with ``size``, its source's
    ``source_size`` and ``target``, and the ``copies`` the mix takes."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                       F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
                       draw(F.col(id_col)).alias("draw"))
    narrow = cut(rows.select("source", "size", "draw"))
    targets = cut(source_targets(narrow, weights, max_repeat))
    out = _matched(_matched(rows, targets, ["source"]), cut_offs(narrow, targets), ["source", "size"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("row", "id", "size", "source_size", "target", (
        F.floor(rate) + (F.coalesce(F.col("draw") <= F.col("most"), F.lit(False))).cast("long")).cast("long").alias(
        "copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as the plan takes it."""
    p = plan(docs, weights, max_repeat, id_col, text_col, source_col)
    return (p.filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("row.*"))
