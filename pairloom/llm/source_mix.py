"""Mix sources to target weights by systematic sampling.

Each source gets a target: a share of the corpus size dealt out by weight, stopped at a multiple of the
source's own size, with the excess dealt out again to the others. Inside a source every document expects
``target / source_size`` copies. Documents stand in order of size, expected copies are summed up along
that order from one random start, and a document is emitted once for each integer boundary that its own
stretch crosses. Close sizes stand side by side, so the words taken come near the target.

Defined results: a null text has size 0, null is a source of its own (the last one), equal sizes go by id,
then by text; an empty table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key, unit
from pairloom.llm.common import numbered, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7


def word_count(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One row for each source: n (documents), source_size, weight, target.

    Sources are levelled from the lowest size per weight upwards: the first one whose part of what is left
    stays within its stop sets the level for all that follow.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "mix-sources", "_rank")
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", picked.cast("long"))
    ranked = ranked.withColumn("_stop", F.col("source_size") * most)
    levelled = running(
        ranked.withColumn("_ratio", F.col("source_size") / F.col("weight")),
        [F.col("_ratio"), F.col("_rank")],
        {"_stops": "_stop", "_weights": "weight"},
        "mix-levels",
    )
    whole = levelled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share)) * F.lit(whole.size or 0) - F.col("_stops")) / (F.lit(whole.weight or 0) - F.col("_weights"))
    reached = levelled.withColumn("_level", level).filter(F.col("_level") * F.col("weight") <= F.col("_stop"))
    found = reached.agg(F.min_by("_level", F.struct("_ratio", "_rank")).alias("level")).first().level
    level = F.lit(float(found)) if found is not None else F.lit(float("inf"))
    target = F.least(F.col("_stop").cast("double"), level * F.col("weight"))
    return levelled.select("source", "n", "source_size", "weight", target.alias("target"))


def _copies(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, keep: list[str]) -> DataFrame:
    """_k0 ... (the columns of ``keep``), _size, _source_size, _target, _copies."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    sizes = docs.select(
        *kept, F.col("doc_id").alias("_id"), "source", word_count("text").alias("size"), F.xxhash64("text").alias("_tie")
    )
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_id").asc_nulls_last(), F.col("_tie")]
    placed = numbered(sizes, order, "mix-order")
    targets = source_targets(placed.select("source", "size"), weights, share, most)
    firsts = placed.groupBy("source").agg(F.min("_index").alias("_first"))
    totals = targets.join(firsts, targets["source"].eqNullSafe(firsts["source"])).select(
        targets["source"].alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_first"
    )
    start = unit(hash_key(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), seed))
    step = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    place = (F.col("_index") - F.col("_first")).cast("double")
    found = placed.join(totals, F.col("source").eqNullSafe(F.col("_source")), "left")
    found = found.withColumns({"_step": step, "_start": start, "_place": place})
    upto = F.floor((F.col("_place") + 1) * F.col("_step") + F.col("_start"))
    before = F.floor(F.col("_place") * F.col("_step") + F.col("_start"))
    copies = F.least(upto - before, F.lit(most)).cast("long").alias("_copies")
    return found.select(*[f"_k{i}" for i in range(len(keep))], F.col("size").alias("_size"), "_source_size", "_target", copies)


def mix_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row for each document: ``keep`` columns, size, source_size, target, copies."""
    found = _copies(docs, weights, share, most, seed, list(keep))
    named = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(*named, *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it was taken, columns unchanged."""
    found = _copies(docs, weights, share, most, seed, docs.columns).filter("_copies > 0")
    named = [F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)]
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*named)
