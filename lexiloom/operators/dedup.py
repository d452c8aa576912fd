"""Exact and near duplicates, fragments shared across splits, and the greedy choice among conflicting rows."""

from __future__ import annotations

from itertools import combinations, count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexiloom.functions import hashing
from lexiloom.functions import text as tx
from lexiloom.runtime import cut, ranges, rewritten

#: Bits in which the sketches of near duplicates may differ, and the blocks of bits they are sought by: any three of
#: these make a key, of 31 to 33 bits.
DISTANCE, BLOCKS = 3, 6
#: Keys in conflict, and pairs of near sketches, that one task may hold.
ONE_TASK = 500_000
REASONS = ("exact_duplicate", "near_duplicate_simhash", "cross_partition_fragment")


@F.pandas_udf(LongType())
def sketch_udf(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of the word trigrams as the bit pattern of a BIGINT, 0 where there is none.

    Each trigram votes on each bit with that of its hash; a bit is set where more votes are for it than against.
    Votes are counted in NumPy by Arrow batch, without exploding trigrams into rows.
    """
    import hashlib
    import re

    import numpy as np

    space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    out = []
    for t in texts:
        w = [x for x in space.split((t or "").lower()) if x]
        if len(w) < 3:
            out.append(0)
            continue
        raw = b"".join(hashlib.sha256(" ".join(g).encode("utf-8", "replace")).digest()[:8] for g in zip(w, w[1:], w[2:]))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(bits * 2 > len(w) - 2, bitorder="little").tobytes(), "little", signed=True))
    return pd.Series(out, dtype="int64")


def sketches(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, sketch)."""
    return df.select(ident, sketch_udf(F.col(text)).alias("sketch"))


def near_sketches(values: DataFrame, sketch_column: str = "sketch", most: int = DISTANCE) -> DataFrame:
    """(a, b, distance) with a < b: distinct sketches that differ in at most three bits.

    Two 64-bit numbers that differ in up to three bits are equal in three of six blocks of bits at least, so an
    equi-join on the twenty choices of three blocks loses none, and a key of some 32 bits is shared by few sketches
    that aren't near. A pair that meets under several keys is kept under the first. Only distinct sketches meet, so a
    text that is a third of all rows is one of them. They are written to the checkpoint folder, so that each is made
    once, and both sides are shuffled: Spark takes their twenty keys for one and would broadcast far too many.
    """
    if most > DISTANCE:
        raise ValueError(f"the keys find at most {DISTANCE} differing bits")
    bounds = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in zip(bounds, bounds[1:])) - sum((1 << bounds[k + 1]) - (1 << bounds[k]) for k in left) for left in combinations(range(BLOCKS), DISTANCE)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = cut(values.select(F.col(sketch_column).alias("s")).distinct()).where(F.col("s").isNotNull())
    keyed = distinct.select("s", F.posexplode(F.array(*[F.col("s").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "v"))
    a, b = keyed.select(F.col("s").alias("a"), "k", "v"), keyed.select(F.col("s").alias("b"), "k", "v")
    joined = a.join(b.hint("merge"), ["k", "v"]).where(F.col("a") < F.col("b")).where(hashing.distance(F.col("a"), F.col("b")) <= most)
    differs = F.col("a").bitwiseXOR(F.col("b"))
    same = F.array(*[differs.bitwiseAND(F.lit(m)) == 0 for m in masks])
    return joined.where(F.col("k") + 1 == F.array_position(same, True)).select("a", "b", hashing.distance(F.col("a"), F.col("b")).alias("distance"))


def duplicate_classes(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, class_id, copies): the least ident of the rows with the same text, and how many they are; null texts have none."""
    keyed = df.where(F.col(text).isNotNull()).select(ident, hashing.sha(F.col(text)).alias("__sha"))
    groups = keyed.groupBy("__sha").agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups, "__sha").select(ident, "class_id", "copies")


def shared_fragments(df: DataFrame, split: str = "split", text: str = "text", records: bool = False) -> DataFrame:
    """(fragment_sha, splits, rows) of the significant fragments that stand in several splits; a row counts once.

    Rows are counted per split before the shuffle, so a fragment of a third of all rows is a few rows of counts.
    """
    hashes = F.array_distinct(F.transform(tx.fragments(tx.unix_lines(F.col(text)), records), hashing.sha))
    rows = df.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), F.explode(hashes).alias("fragment_sha"))
    per = rows.groupBy("fragment_sha", "s").agg(F.count(F.lit(1)).alias("n"))
    grouped = per.groupBy("fragment_sha").agg(F.count(F.lit(1)).alias("splits"), F.sum("n").alias("rows"))
    return grouped.where(F.col("splits") > 1)


def accept(df: DataFrame, pos: str, text: str = "text", url: str = "url", split: str = "split", most_rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(pos, reason) of each row: null for accepted rows, else why an earlier accepted row excludes it.

    Row by row in the order of ``pos`` (unique), a row is accepted unless an accepted earlier one has its URL or text
    (exact_duplicate), a sketch within three bits (near_duplicate_simhash), or a significant fragment in another split
    (cross_partition_fragment). That choice is the lexicographically first independent set of the conflicts, found in
    rounds: a row falls once an accepted earlier row conflicts with it, and stands once every earlier row that
    conflicts has fallen. Each round decides the first undecided row at least, so they end; what long chains leave
    after ``most_rounds``, one task decides in order as soon as it is at most ``one_task`` keys.

    No pairs of rows are made. Each conflict is a key (URL, text, sketch, or fragment) under which only the least
    accepted and the least undecided position matter, per split for fragments; near sketches are pairs of distinct
    sketches. Rows that share no key with others are decided at once. Rounds are written to the checkpoint folder and read
    again, each in the place of the last one. Up to ``one_task`` keys in conflict, one task goes through them in order
    instead; the result is the same. All joins shuffle both sides: positions are small in files, so Spark would broadcast
    those of all rows, several times a round, and the driver's memory would grow with the table.
    Null URLs, texts and splits conflict with nothing.
    """
    base = df.select(F.col(pos).cast("long").alias("pos"), F.col(text).alias("t"), F.col(url).alias("u"), F.col(split).alias("s"))
    base = base.withColumn("sk", F.when(F.col("t").isNotNull(), sketch_udf("t")))
    fragments = F.array_distinct(F.transform(tx.fragments(F.col("t")), hashing.sha))
    key = lambda rank, c: F.struct(F.lit(rank).alias("rank"), c.alias("key"))
    keys = F.concat(
        F.array(key(1, F.concat(F.lit("u"), F.col("u"))), key(1, F.concat(F.lit("t"), hashing.sha(F.col("t")))), key(2, F.col("sk").cast("string"))),
        F.coalesce(F.transform(fragments, lambda f: key(3, f)), F.array().cast("array<struct<rank:int,key:string>>")),
    )
    # the texts are read once; from here on there are keys only
    base = cut(base.select("pos", F.coalesce("s", F.lit("")).alias("s"), "sk", keys.alias("keys")))
    flat = base.select("pos", "s", F.explode("keys").alias("k")).select("pos", "s", "k.rank", "k.key").where("key is not null")
    near = near_sketches(base.where("sk is not null"), "sk")
    ab, ba = (F.struct(F.col(x).cast("string").alias("key"), F.col(y).cast("string").alias("other")) for x, y in ("ab", "ba"))
    near = cut(near.select(F.explode(F.array(ab, ba)).alias("k")).select("k.*"))
    # keys under which nothing can conflict leave
    busy = flat.groupBy("rank", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("splits"))
    shared = busy.where(((F.col("rank") < 3) & (F.col("n") > 1)) | ((F.col("rank") == 3) & (F.col("splits") > 1))).select("rank", "key")
    shared = shared.unionByName(near.select(F.lit(2).alias("rank"), "key")).distinct()
    # numbers in the place of keys of 64 signs, which each round would shuffle
    shared = cut(shared.withColumn("id", F.monotonically_increasing_id().cast("string")))
    links = cut(flat.join(shared.hint("merge"), ["rank", "key"]).select("rank", F.col("id").alias("key"), "pos", "s"))
    for c in ("key", "other"):
        ids = shared.where("rank = 2").select(F.col("key").alias(c), "id")
        near = near.join(ids.hint("merge"), c).drop(c).withColumnRenamed("id", c)
    near = cut(near)
    if _few(links, one_task) and _few(near, one_task):
        return _named(base, _one_task(links, near, None))
    state, folder = rewritten(links.select("pos").distinct().withColumn("reason", F.lit(-1)))  # -1 undecided, 0 accepted, else a rank
    for done in count(1):
        told = _conflicts(links, near, state, state.where("reason = -1"))
        verdict = F.when(F.col("falls").isNotNull(), F.col("falls")).when(F.coalesce("waits", F.lit(False)), -1).otherwise(0)
        new = state.where("reason = -1").select("pos").join(told.hint("merge"), "pos", "left").select("pos", verdict.cast("int").alias("reason"))
        state, folder = rewritten(state.where("reason <> -1").unionByName(new), folder)
        if state.where("reason = -1").limit(1).count() == 0:
            break
        if done >= most_rounds:
            left = links.join(state.where("reason <= 0").hint("merge"), "pos")  # accepted rows count, fallen ones don't
            if _few(left, one_task) and _few(near, one_task):
                state, folder = rewritten(state.where("reason > 0").unionByName(_one_task(left.drop("reason"), near, state.where("reason = 0"))), folder)
                break
    # a row may have fallen before an earlier one stood that excludes it for a stronger reason
    fallen = state.where("reason > 0")
    final = _conflicts(links, near, state, fallen).select("pos", F.col("falls").alias("reason"))
    return _named(base, state.where("reason = 0").unionByName(final))


def _conflicts(links: DataFrame, near: DataFrame, state: DataFrame, rows: DataFrame) -> DataFrame:
    """(pos, falls, waits) of rows: the strongest rank at which an accepted earlier row conflicts, and whether an
    earlier row that conflicts still may stand. Under a key the least positions tell."""
    known = links.join(state.hint("merge"), "pos").where(F.col("reason") <= 0)
    least = known.groupBy("rank", "key", "s").agg(F.min(F.when(F.col("reason") == 0, F.col("pos"))).alias("accepted"), F.min("pos").alias("standing"))
    both = [F.min("accepted").alias("accepted"), F.min("standing").alias("standing")]
    # what counts under a key: for exact ones all rows, for sketches those of near ones too, for fragments other splits
    exact = least.where("rank < 3").groupBy("rank", "key").agg(*both)
    close = exact.where("rank = 2").join(near.hint("merge"), "key").select("rank", F.col("other").alias("key"), "accepted", "standing")
    exact = exact.unionByName(close).groupBy("rank", "key").agg(*both)
    asked = links.join(rows.select("pos").hint("merge"), "pos")
    one = asked.where("rank < 3").join(exact.hint("merge"), ["rank", "key"]).select("pos", "rank", "accepted", "standing")
    other = least.where("rank = 3").select("key", F.col("s").alias("os"), "accepted", "standing")
    two = asked.where("rank = 3").join(other.hint("merge"), "key").where(F.col("s") != F.col("os")).where("s <> '' and os <> ''").select("pos", "rank", "accepted", "standing")
    return one.unionByName(two).groupBy("pos").agg(
        F.min(F.when(F.col("accepted") < F.col("pos"), F.col("rank"))).alias("falls"), F.max(F.col("standing") < F.col("pos")).alias("waits")
    )


def _named(base: DataFrame, decided: DataFrame) -> DataFrame:
    name = F.lit(None).cast("string")
    for rank, reason in enumerate(REASONS, 1):
        name = F.when(F.col("reason") == rank, reason).otherwise(name)
    return base.select("pos").join(decided.select("pos", name.alias("reason")).hint("merge"), "pos", "left")


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _one_task(links: DataFrame, near: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """(pos, reason) of the rows of few links, in order; rows known to be accepted come out as such."""
    rows = links.select("pos", "rank", "key", "s")
    rows = rows.withColumn("fixed", F.lit(False)) if accepted is None else rows.join(accepted.select("pos", F.lit(True).alias("fixed")).hint("merge"), "pos", "left")
    pairs = near.select(F.lit(None).cast("long").alias("pos"), F.lit(0).alias("rank"), "key", F.col("other").alias("s"), F.lit(False).alias("fixed"))
    return rows.unionByName(pairs).coalesce(1).mapInPandas(_in_order, "pos long, reason int")


def _in_order(batches):
    """The choice row by row, for few conflicts: what each key has accepted, by split for fragments. Rows of rank 0 are
    pairs of near sketches."""
    links = pd.concat([*batches, pd.DataFrame({"pos": [], "rank": [], "key": [], "s": [], "fixed": []})])
    pairs, links = links[links["rank"] == 0], links[links["rank"] > 0]
    close: dict[str, list[str]] = {}
    for key, other in zip(pairs["key"], pairs["s"]):
        close.setdefault(key, []).append(other)
    taken: set = set()
    splits: dict[str, set] = {}
    out = []
    for pos, rows in links.groupby("pos", sort=True):
        keys = list(zip(rows["rank"], rows["key"]))
        own = rows["s"].iloc[0]
        if rows["fixed"].iloc[0] in (True, 1):
            reason = 0
        elif any(k[0] == 1 and k in taken for k in keys):
            reason = 1
        elif any((2, x) in taken for r, k in keys if r == 2 for x in (k, *close.get(k, ()))):
            reason = 2
        elif own and any(splits.get(k, set()) - {own, ""} for r, k in keys if r == 3):
            reason = 3
        else:
            reason = 0
        if not reason:
            taken.update(k for k in keys if k[0] < 3)
            for r, k in keys:
                if r == 3:
                    splits.setdefault(k, set()).add(own)
        out.append((int(pos), reason))
    yield pd.DataFrame(out, columns=["pos", "reason"])


def within_budget(df: DataFrame, pos: str, size: str, accepted: str, budget: int, buckets: int = 256) -> DataFrame:
    """The rows before the first at which the accepted sizes before it and its own exceed the budget.

    The row at the cut and all later ones are gone, accepted or not. Running sums go over ranges of ``pos`` first and
    within each range then, so that no task holds all rows.
    """
    rows = cut(df.select(F.col(pos).alias("p"), F.col(size).alias("n"), F.when(F.col(accepted), F.col(size)).otherwise(0).alias("used")))
    low, high = rows.agg(F.min("p"), F.max("p")).first()
    if low is None:
        return df
    ranged = rows.withColumn("b", ranges(F.col("p"), low, high, buckets))
    before = F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("b").agg(F.sum("used").alias("s")).select("b", before.alias("before"))  # one row a bucket
    within = F.coalesce(F.sum("used").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = ranged.withColumn("within", within).join(F.broadcast(sums), "b").where(F.col("before") + F.col("within") + F.col("n") > budget)
    first = over.agg(F.min("p")).first()[0]
    return df if first is None else df.where(F.col(pos) < first)
