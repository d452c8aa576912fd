"""Next-token distributions: repetition penalty, temperature, top-k, nucleus, draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def penalised(df: DataFrame, history: DataFrame, penalty: float, context: str = "context") -> DataFrame:
    """df (context, id, logit) with the logits of ids in the context's history divided by the penalty, negative ones multiplied."""
    seen = history.select(context, "id").distinct().withColumn("__seen", F.lit(True))
    bent = F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)
    return df.join(seen, [context, "id"], "left").withColumn("logit", F.when(F.col("__seen"), bent).otherwise(F.col("logit"))).drop("__seen")


def distribution(df: DataFrame, top_k: int, top_p: float, temperature: float, context: str = "context") -> DataFrame:
    """(context, rank, id, probability) of each context's logits (context, id, logit).

    The k largest logits (ties: least id first) go through a softmax at the temperature, are cut behind the first id
    at which the sum reaches ``top_p``, and scaled to one. Temperature 0 leaves the largest with probability 1. Null
    and NaN logits are left out.
    """
    rows = df.where(F.col("logit").isNotNull() & ~F.isnan("logit"))
    order = Window.partitionBy(context).orderBy(F.desc("logit"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (top_k if temperature > 0 else 1))
    if temperature <= 0:
        return ranked.select(context, "rank", "id", F.lit(1.0).alias("probability"))
    every = Window.partitionBy(context)
    shifted = ranked.withColumn("__e", F.exp((F.col("logit") - F.max("logit").over(every)) / temperature))
    shared = shifted.withColumn("__p", F.col("__e") / F.sum("__e").over(every))
    before = F.coalesce(F.sum("__p").over(Window.partitionBy(context).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = shared.withColumn("__before", before).where(F.col("__before") < top_p)
    return kept.select(context, "rank", "id", (F.col("__p") / F.sum("__p").over(every)).alias("probability"))


def choose(dist: DataFrame, draws: DataFrame, context: str = "context") -> DataFrame:
    """(context, id): the first id at which the running probability exceeds the context's draw in [0, 1); else the last."""
    run = F.sum("probability").over(Window.partitionBy(context).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = dist.withColumn("__sum", run).join(draws, context)
    first = F.min(F.when(F.col("__sum") > F.col("draw"), F.struct("rank", "id")))
    return over.groupBy(context).agg(F.coalesce(first, F.max(F.struct("rank", "id")))["id"].alias("id"))


def strongest(df: DataFrame, n: int = 10, context: str = "context", end: int | None = None) -> DataFrame:
    """(context, rank, id, probability) of the n likeliest ids of the whole softmax, and with ``end`` that id's row too."""
    every = Window.partitionBy(context)
    e = F.exp(F.col("logit") - F.max("logit").over(every))
    shared = df.withColumn("__e", e).withColumn("probability", F.col("__e") / F.sum("__e").over(every))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy(context).orderBy(F.desc("logit"), "id")))
    return ranked.where((F.col("rank") <= n) | (F.col("id") == F.lit(end)) if end is not None else F.col("rank") <= n).select(context, "rank", "id", "probability")


def target_losses(logits: DataFrame, targets: DataFrame, context: str = "context") -> DataFrame:
    """(context, loss): cross entropy of each context's target (context, id) under its logits (context, id, logit).

    The maximum is taken off before the exponential, so that large logits don't overflow. A context without its target
    among the logits has a null loss.
    """
    most = logits.groupBy(context).agg(F.max("logit").alias("__most"))
    joined = logits.join(most, context).join(targets.select(context, F.col("id").alias("__target")), context)
    sums = joined.groupBy(context).agg(
        F.sum(F.exp(F.col("logit") - F.col("__most"))).alias("__sum"), F.max("__most").alias("__most"), F.max(F.when(F.col("id") == F.col("__target"), F.col("logit"))).alias("__own")
    )
    return sums.select(context, (F.log("__sum") + F.col("__most") - F.col("__own")).alias("loss"))


def clipped(gradients: DataFrame, maximum: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Gradients scaled to a global norm of at most ``maximum``, and (norm, scale). The norm is one row, read as a number."""
    from lexiloom.functions.training import clip_scale

    norm = gradients.agg(F.sqrt(F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0))).alias("norm"))
    norm = norm.withColumn("scale", clip_scale(F.col("norm"), maximum))
    scale = norm.first()["scale"]
    if scale is None:
        raise ValueError("the norm of the gradients is not finite")
    return gradients.withColumn(value, F.col(value) * F.lit(scale)), norm
