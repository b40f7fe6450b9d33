"""Product matches of an entity: which of its scored aliases count, and which of the items behind an alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.allocation import cut_lineage

# How close to the best length ratio and score a contained alias must come, and a merely similar one.
LENGTH_SHARE, CONTAINED_SHARE, SIMILAR_SHARE = 0.7, 0.9, 0.85
MANY, FEW = 5, 3


def best_aliases(scored: DataFrame, floor: float, entity: str = "entity", alias: str = "alias", score: str = "score") -> DataFrame:
    """The rows of scored (entity, alias, score) that count, with ``tier``, how they were found.

    Of an entity with an alias equal to it, those aliases alone; else, of aliases that hold the
    entity or lie in it, those of nearly the best length ratio and score; else aliases of
    at least max(floor, 0.85 x best). At most five, by score, then alias. Where a tier
    keeps none, the best three. Comparison ignores case and outer blanks.
    """
    clean = lambda c: F.trim(F.lower(F.col(c)))
    by = Window.partitionBy(entity)
    best = lambda c, c2: F.max(F.when(c2, c)).over(by)
    rows = scored.withColumn("_same", clean(alias) == clean(entity)).withColumn("_inside", F.contains(F.lower(F.col(alias)), clean(entity)) | F.contains(clean(entity), clean(alias)))
    rows = rows.withColumn("_tier", F.when(F.max("_same").over(by), 1).when(F.max("_inside").over(by), 2).otherwise(3))
    ratio = F.length(alias) / F.greatest(F.length(entity), F.lit(1))
    rows = rows.withColumn("_ratio", ratio).withColumn("_long", F.col("_inside") & (F.col("_ratio") >= LENGTH_SHARE * best(F.col("_ratio"), F.col("_inside"))))
    near = F.col(score) >= CONTAINED_SHARE * best(F.col(score), F.col("_long"))
    similar = F.col(score) >= F.greatest(F.lit(floor), SIMILAR_SHARE * F.max(score).over(by))
    rows = rows.withColumn("_ok", F.when(F.col("_tier") == 1, F.col("_same")).when(F.col("_tier") == 2, F.col("_long") & near).otherwise(similar))
    order = [F.desc(score), F.asc(alias)]
    rows = rows.withColumn("_any", F.max("_ok").over(by)).withColumn("_n", F.row_number().over(Window.partitionBy(entity, "_ok").orderBy(*order))).withColumn("_all", F.row_number().over(by.orderBy(*order)))
    kept = rows.filter(F.when(F.col("_any"), F.col("_ok") & (F.col("_n") <= MANY)).otherwise(F.col("_all") <= FEW))
    tier = F.when(~F.col("_any"), "few").when(F.col("_tier") == 1, "same").when(F.col("_tier") == 2, "contained").otherwise("similar")
    return kept.select(*scored.columns, tier.alias("tier"))


def items_of(matches: DataFrame, items: DataFrame, reached: DataFrame, entity: str = "entity", alias: str = "alias") -> DataFrame:
    """Each match with the items behind its alias, an item of an entity once, by its best score.

    items has (alias, item_nm, item_id, item_dmn); reached (entity, name) holds the names that
    the alias rules lead to from an entity. Where several items share an alias and some are
    named so, the others are only related and go.
    """
    each = items.select(alias, "item_nm", "item_id", "item_dmn").distinct()
    joined = matches.join(each, alias)
    direct = reached.select(F.col(entity), F.trim(F.lower("name")).alias("_name"), F.lit(True).alias("_direct")).distinct()
    named = joined.withColumn("_name", F.trim(F.lower("item_nm"))).join(direct, [entity, "_name"], "left").withColumn("_direct", F.coalesce("_direct", F.lit(False)))
    kept = named.withColumn("_some", F.max("_direct").over(Window.partitionBy(entity, alias))).filter("_direct or not _some").drop("_some")
    first = F.row_number().over(Window.partitionBy(entity, "item_nm", "item_id").orderBy(F.desc("score"), alias))
    return kept.withColumn("_n", first).filter("_n = 1").drop("_n", "_name", "_direct")


def one_to_one_pairs(scored: DataFrame, left: str, right: str, score: str = "score", least: float = 0.5, max_rounds: int = 1000) -> DataFrame:
    """Greedy one-to-one pairs by falling score, ties by left, then right; each value is used once.

    A pair that is the best one left for both of its sides is what the serial greedy takes
    before it looks at anything else of theirs. So a round takes all such pairs at once and
    drops their sides' other rows; rounds go on until no row is left.
    """
    live = cut_lineage(scored.filter((F.col(score) >= least) & F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.max(score).alias(score)))
    done = live.limit(0)
    for _ in range(max_rounds):
        key = F.struct((-F.col(score)).alias("s"), F.col(left).alias("a"), F.col(right).alias("b"))
        best = lambda c: live.groupBy(c).agg(F.min(key).alias(f"_{c}"))
        # a pair that both sides name is among the left sides' best and among the right sides' best
        mutual = best(left).select(F.col(f"_{left}").alias("k")).join(best(right).select(F.col(f"_{right}").alias("k")), "k").select(F.col("k.a").alias(left), F.col("k.b").alias(right), (-F.col("k.s")).alias(score))
        taken = cut_lineage(mutual)
        if taken.isEmpty():
            return done
        done = done.unionByName(taken)
        live = cut_lineage(live.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"))
    raise RuntimeError(f"pairs are left after {max_rounds} rounds")
