"""Mixing sources to target shares of tokens."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import budget
from lexiloom.runtime import cut

#: Buckets of a cell over which its running sum is split.
BUCKETS = 64
#: Rounds of proportional fitting at most, the largest relative change of a marginal at which it ends, and the rounds
#: without a smaller one after which marginals count as contradicting each other under the caps.
ROUNDS, GAP, STUCK = 10_000, 1e-9, 200
#: Cells (source, language, topic) that the fit takes; there are as many as combinations of labels, not of documents.
MOST_CELLS = 1_000_000


def texts(documents: DataFrame, targets: DataFrame, **tokenizer) -> DataFrame:
    """Each distinct text of each source that has a target, once: doc_id (the least), source, language, topic, tokens.

    A text counts per source: its copies under other ids are the same text, of which the cap allows so many uses. Its
    language and topic are those of its least doc_id. Texts without tokens have no row.
    """
    wanted = budget.small_side(documents.where(F.col("text").isNotNull()), targets.select("source", F.lit(True).alias("__wanted")), "source").where("__wanted")
    keyed = wanted.withColumn("digest", budget.fingerprint(F.col("text")))
    first = F.min(F.struct("doc_id", "language", "topic"))
    # combined before the shuffle: a text that is a third of a source travels once per task
    distinct = keyed.groupBy("source", "digest").agg(first.alias("f"))
    counts = budget.distinct_tokens(wanted, "text", **tokenizer)
    joined = distinct.join(counts, "digest").where(F.col("tokens") > 0)
    return joined.select("f.doc_id", "source", "f.language", "f.topic", F.col("tokens").cast("long"))


def fit(cells: dict[tuple, float], marginals: list[Mapping[object, float]], caps: dict[tuple, float]) -> dict[tuple, float]:
    """Iterative proportional fitting with caps.

    ``cells`` are available tokens by key; ``marginals`` gives, for each place of the key, wanted tokens by label (a
    place may want nothing: an empty mapping). Each round scales the cells of each label to what it wants; cells over
    their cap are set to it. Returns wanted tokens by cell. Ends when all marginals that the caps allow are met, or
    when the gap has stopped to shrink because marginals and caps contradict each other: then the last place's marginal,
    the sources in a mix, holds, and the others are as near as they come. Fails if ROUNDS end it while it still shrinks.
    """
    keys = list(cells)
    weight = np.array([cells[k] for k in keys], float)
    most = np.array([caps[k] for k in keys], float)
    groups = []
    for place, wanted in enumerate(marginals):
        labels = sorted({k[place] for k in keys if k[place] in wanted}, key=repr)
        at = {label: i for i, label in enumerate(labels)}
        of = np.array([at.get(k[place], -1) for k in keys])
        if labels:
            groups.append((of, np.array([wanted[x] for x in labels], float)))
    least, since = float("inf"), 0
    for _ in range(ROUNDS):
        gap = 0.0
        for of, wanted in groups:
            # scaling that leaves capped cells at their cap is repeated until no further cell meets it
            free = np.ones(len(keys), bool)
            for _ in range(len(keys)):
                inside = of >= 0
                held = np.bincount(of[inside & ~free], weight[inside & ~free], len(wanted))
                loose = np.bincount(of[inside & free], weight[inside & free], len(wanted))
                scale = np.where(loose > 0, np.maximum(wanted - held, 0) / np.where(loose > 0, loose, 1), 1.0)
                trial = np.where(inside & free, weight * scale[np.maximum(of, 0)], weight)
                over = inside & free & (trial > most)
                if not over.any():
                    gap = max(gap, float(np.max(np.abs(scale[loose > 0] - 1), initial=0)))
                    weight = trial
                    break
                weight = np.where(over, most, weight)
                free &= ~over
        if gap < least * (1 - 1e-3):
            least, since = gap, 0
        else:
            since += 1
        if gap < GAP or since >= STUCK:
            break
    else:
        raise RuntimeError(f"the fit still moves by {gap:.2g} after {ROUNDS} rounds")
    return dict(zip(keys, weight.tolist()))


def _plan(rows: DataFrame, targets: DataFrame, total: int | None, marginals: Mapping[str, Mapping[str, float]] | None) -> tuple[DataFrame, DataFrame]:
    """Cells with their weight (uses of each token), and the targets; the cells are few: combinations of labels."""
    spark = rows.sparkSession
    sums = rows.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("available")).limit(MOST_CELLS + 1).collect()
    if len(sums) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of source, language and topic")
    wanted = {r["source"]: r for r in targets.collect()}
    cells = {(r["source"], r["language"], r["topic"]): float(r["available"]) for r in sums}
    caps = {k: v * wanted[k[0]]["max_repeats"] for k, v in cells.items()}
    size = float(total) if total is not None else sum(cells.values())
    by_source: dict[str, float] = {}
    for k, v in cells.items():
        by_source[k[0]] = by_source.get(k[0], 0.0) + v
    goal = {s: min(r["target_share"] * size, by_source.get(s, 0.0) * r["max_repeats"]) for s, r in wanted.items()}
    sides: list[Mapping] = [goal]
    for place, name in ((1, "language"), (2, "topic")):
        given = (marginals or {}).get(name)
        # none given: what the sources' shares imply at the make-up that each source has
        implied: dict = {}
        for k, v in cells.items():
            if by_source[k[0]]:
                implied[k[place]] = implied.get(k[place], 0.0) + goal[k[0]] * v / by_source[k[0]]
        sides.append({x: share * sum(goal.values()) for x, share in given.items()} if given is not None else implied)
    # the sources come last in a round, so that their shares hold exactly
    order = [1, 2, 0]
    turned = fit({tuple(k[i] for i in order): v for k, v in cells.items()}, [sides[i] for i in order], {tuple(k[i] for i in order): v for k, v in caps.items()})
    fitted = {(s, language, topic): v for (language, topic, s), v in turned.items()}
    plan = [(*k, cells[k], fitted[k] / cells[k]) for k in cells if cells[k]]
    schema = "source string, language string, topic string, cell_tokens double, weight double"
    return spark.createDataFrame(plan, schema), spark.createDataFrame([(s, goal[s]) for s in goal], "source string, goal double")


def mix(
    documents: DataFrame, targets: DataFrame, total: int | None = None, marginals: Mapping[str, Mapping[str, float]] | None = None, seed: int = 42, buckets: int = BUCKETS, **tokenizer
) -> DataFrame:
    """doc_id, source, language, topic, tokens, copies of each text in the mix.

    ``documents`` has doc_id, text, source, language, topic; ``targets`` source, target_share, max_repeats. ``total``
    is the mix's size in tokens, by default what the sources with targets hold. Token weights of the cells (source,
    language, topic) are fitted to the source shares and to ``marginals``, shares by language and topic; without them
    each source keeps its make-up. A source whose share is more than ``max_repeats`` times its tokens gives those.

    A text is used as many whole times as its cell's weight says, and once more with the fraction left as
    probability: the texts of a cell, in the order of a seeded hash, are taken until the fraction of the cell's
    tokens is reached, so that a cell misses it by half a text at most. The running sum goes over hash buckets first
    and then within each, so no task holds a whole source.
    """
    rows = cut(texts(documents, targets, **tokenizer))
    return _mixed(rows, targets, total, marginals, seed, buckets)


def _mixed(rows: DataFrame, targets: DataFrame, total: int | None, marginals: Mapping[str, Mapping[str, float]] | None, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    plan, _ = _plan(rows, targets, total, marginals)
    cell = ["source", "language", "topic"]
    none = "\x00"
    filled = lambda df: df.select(*[F.coalesce(F.col(c), F.lit(none)).alias(f"__{c}") for c in cell], *df.columns)
    keys = [f"__{c}" for c in cell]
    order = F.xxhash64(F.lit(seed), "doc_id", "source")
    joined = filled(rows).join(F.broadcast(filled(plan).select(*keys, "cell_tokens", "weight")), keys)
    joined = joined.withColumn("__h", order).withColumn("__bucket", F.pmod(F.shiftrightunsigned("__h", 8), F.lit(buckets)).cast("int"))
    sums = joined.groupBy(*keys, "__bucket").agg(F.sum("tokens").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("tokens").over(Window.partitionBy(*keys, "__bucket").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = joined.join(sums, [*keys, "__bucket"]).withColumn("__at", F.col("__before") + F.coalesce(within, F.lit(0)))
    whole = F.floor(F.col("weight") + 1e-9)
    quota = (F.col("weight") - whole) * F.col("cell_tokens")
    copies = whole + F.when(F.col("__at") + F.col("tokens") / 2 <= quota, 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0).select("doc_id", *cell, "tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, marginals: Mapping[str, Mapping[str, float]] | None = None, **options) -> DataFrame:
    """One row per target: its tokens available and in the mix, texts and largest repeat, the share it has and should have.

    ``share`` is of the mix's own tokens; ``share_of_goal`` of the size aimed at, which sources that fall short don't
    change for the others; ``reached`` tells whether the cap allowed the target.
    """
    how = {k: options.pop(k) for k in ("seed", "buckets") if k in options}
    rows = cut(texts(documents, targets, **options))
    mixed = cut(_mixed(rows, targets, total, marginals, **how))
    have = rows.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_texts"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("mix_texts"), F.max("copies").alias("largest_repeat"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = targets.join(have, "source", "left").join(got, "source", "left")
    out = out.select("source", "target_share", "max_repeats", *(zero(c) for c in ("available_tokens", "available_texts", "mix_tokens", "mix_texts", "largest_repeat")))
    everything = Window.partitionBy()
    size = F.lit(float(total)) if total is not None else F.sum("available_tokens").over(everything)
    return (
        out.withColumn("goal_tokens", F.col("target_share") * size)
        .withColumn("share", F.try_divide(F.col("mix_tokens").cast("double"), F.sum("mix_tokens").over(everything)))
        .withColumn("share_of_goal", F.try_divide(F.col("mix_tokens").cast("double"), size))
        .withColumn("reached", F.col("goal_tokens") <= F.col("available_tokens") * F.col("max_repeats"))
    )


def marginal_shares(documents: DataFrame, targets: DataFrame, total: int | None = None, marginals: Mapping[str, Mapping[str, float]] | None = None, **options) -> DataFrame:
    """One row per language and per topic: side, label, its tokens available and in the mix, the share it has and,
    where ``marginals`` give one, should have."""
    how = {k: options.pop(k) for k in ("seed", "buckets") if k in options}
    rows = cut(texts(documents, targets, **options))
    mixed = cut(_mixed(rows, targets, total, marginals, **how))
    wanted = [(side, label, float(share)) for side, by in (marginals or {}).items() for label, share in by.items()]
    goal = documents.sparkSession.createDataFrame(wanted, "side string, label string, target_share double")

    def sums(df: DataFrame, value: Column, name: str) -> DataFrame:
        each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("label")) for c in ("language", "topic")])).alias("k"), value.alias("v"))
        return each.groupBy("k.side", "k.label").agg(F.sum("v").alias(name))

    have, got = sums(rows, F.col("tokens"), "available_tokens"), sums(mixed, F.col("tokens") * F.col("copies"), "mix_tokens")
    same = lambda a, b: (a["side"] == b["side"]) & a["label"].eqNullSafe(b["label"])
    out = have.join(got, same(have, got), "left").select(have["side"], have["label"], "available_tokens", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"))
    out = out.join(goal, same(out, goal), "left").select(out["side"], out["label"], "available_tokens", "mix_tokens", "target_share")
    return out.withColumn("share", F.try_divide(F.col("mix_tokens").cast("double"), F.sum("mix_tokens").over(Window.partitionBy("side")).cast("double")))
