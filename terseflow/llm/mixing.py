"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the target size in proportion to its weight, but no more than `max_epochs` passes over what
it has. Sources above their cap are clamped, their excess goes to the others in proportion to their weights, and so on
until no source is above its cap. A source's documents are then taken floor(epochs) times, and once more with
probability epochs - floor(epochs), by a coin that depends on the seed and the doc_id alone.

Sizes are UTF-8 bytes. Defined cases: a null source is a source of its own; null and empty texts weigh nothing but are
sampled like the others of their source; a source without any bytes gets `max_epochs`-capped epochs of 0; rows that
share a doc_id share the coin; a null doc_id counts as the string 'null'; an empty table stays empty. Weights of sources
that are not in the table do nothing, sources without a given weight get 0. If the target is beyond all caps, every
weighted source is at its cap. All columns come back under their names, whatever these are; only one called copy_no gives
way to the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseflow.llm.common import materialize, named, neutral

MAX_EPOCHS = 4
SEED = 1


def water_level(sizes: DataFrame, target: float) -> float:
    """The level L at which sum(least(L * weight, cap)) reaches `target`; infinity if it never does. One small aggregate for each round of clamping."""
    level = 0.0
    clamped = F.lit(False)
    while True:
        row = sizes.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if not row["open"]:
            return float("inf")
        new = float(target - row["full"]) / float(row["open"])
        if new <= level:
            return level
        level = new
        clamped = F.col("weight") * F.lit(level) >= F.col("cap")


def source_epochs(docs: DataFrame, weights: dict[str | None, int] | None = None, target: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, size, weight, epochs: how often each source is passed over. `weights` are whole numbers, equal ones by default; `target` is in bytes, by default the size of the table."""
    weight: Column = F.lit(1)
    if weights is not None:
        weight = F.lit(0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(w))).otherwise(weight)
    sizes = (
        docs.groupBy("source")
        .agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long")).alias("size"))
        .select("source", "size", F.when(F.col("size") > 0, weight).otherwise(0).cast("long").alias("weight"), (F.col("size") * max_epochs).alias("cap"))
    )
    sizes = materialize(sizes, "sources")
    if target is None:
        target = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level = water_level(sizes, target)
    share = F.col("weight") * F.lit(level) / F.col("size")
    full = F.col("weight") * F.lit(level) >= F.col("cap")
    epochs = F.when((F.col("weight") == 0) | (F.col("size") == 0), 0.0).when(full, float(max_epochs)).otherwise(share)
    return sizes.select("source", "size", "weight", epochs.cast("double").alias("epochs"))


def coin(seed: int) -> Column:
    """A number in [0, 1) of 52 bits for each doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame, weights: dict[str | None, int] | None = None, target: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, numbered: bool = True
) -> DataFrame:
    """The documents as often as they are sampled, with all their columns and, if `numbered`, the number of the copy from 0 as `copy_no`.

    The texts are never shuffled while the table of sources is small enough for Spark to broadcast; beyond that it is a
    join on source whose hot keys AQE splits.
    """
    plain, names = neutral(docs)
    own = plain.select("*", plain[names.of("source")].alias("source"), plain[names.of("doc_id")].alias("doc_id"))
    plan = source_epochs(named(docs, "source", "text"), weights, target, max_epochs).select(F.col("source").alias("__tf_source"), F.col("epochs").alias("__tf_epochs"))
    whole = F.floor("__tf_epochs")
    times = whole + F.when(coin(seed) < F.col("__tf_epochs") - whole, 1).otherwise(0)
    taken = own.join(plan, own["source"].eqNullSafe(F.col("__tf_source"))).withColumn("__tf_times", times).where(F.col("__tf_times") > 0)
    copies = taken.withColumn("__tf_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tf_times") - 1)))
    return names.restore(copies, new={"copy_no": F.col("__tf_copy")} if numbered else None)


#: The water level in closed form: with sources by the level at which they fill up, the k lowest are clamped.
ORACLE_SQL = f"""
WITH s AS (SELECT source, sum(strlen(text))::BIGINT AS size FROM documents GROUP BY source HAVING sum(strlen(text)) > 0),
c AS (SELECT source, size, size * {MAX_EPOCHS} AS cap,
  coalesce(sum(size * {MAX_EPOCHS}) OVER (ORDER BY size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  count(*) OVER (ORDER BY size, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still,
  sum(size) OVER () AS target FROM s),
l AS (SELECT max(CASE WHEN (target - before)::DOUBLE / still::DOUBLE <= cap THEN (target - before)::DOUBLE / still::DOUBLE END) AS level FROM c),
e AS (SELECT source, CASE WHEN level IS NULL OR level >= cap THEN {float(MAX_EPOCHS)}::DOUBLE ELSE level / size END AS epochs FROM c, l),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, floor(epochs)::BIGINT
  + CASE WHEN ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}::DOUBLE < epochs - floor(epochs) THEN 1 ELSE 0 END AS times
  FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, times)) AS copy_no FROM t WHERE times > 0
"""
