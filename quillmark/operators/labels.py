"""Human-label sets and agreement of a judge with human labels.

Sampling is by md5 of seed and key, so it is the same on any engine and any number of tasks. Equal
(row_id, reply) pairs are drawn once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Half-open margin bands, the score of each choice, and the figures to beat.
BANDS = ((-99.0, -3.0), (-3.0, -0.5), (-0.5, 0.5), (0.5, 3.0), (3.0, 99.0))
CHOICES = {"L2": 2, "L1": 1, "EQ": 0, "R1": -1, "R2": -2}
BASE_DECISIVE, BASE_PEARSON = round(41 / 58, 3), 0.38


def draw(seed: str, *key):
    """The sampling order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in key)).cast("binary"))


def hash_sample(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """A seeded sample of n rows, all if there are fewer. The limit is the feature."""
    return rows.orderBy(draw(seed, F.col(key)), key).limit(n)


def band(margin):
    out = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(BANDS))):
        out = F.when((margin >= lo) & (margin < hi), k).otherwise(out)
    return out


def quota(count: int):
    """Rows wanted of a band, from its number."""
    return F.lit(count // 10) + (F.col("band") < (count % 10) // 2).cast("int")


def pick_bands(rows: DataFrame, count: int, seed: str) -> DataFrame:
    """Equal draws per character from five margin bands. ``rows``: row_id, character, reply, margin."""
    one = rows.filter("margin is not null").dropDuplicates(["row_id", "reply"]).withColumn("band", band(F.col("margin"))).filter("band is not null")
    w = Window.partitionBy("character", "band").orderBy(draw(seed, F.col("row_id")), "row_id")
    # The largest quota first, as a literal: Spark then keeps no more rows of a key in any map task.
    return one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= count // 10 + 1).filter(F.col("n") <= quota(count)).drop("n")


def opener_pairs(rows: DataFrame, count: int, first: str, seed: str) -> DataFrame:
    """Per group one reply with a stock opener and one without; then a quota per character, ``first`` getting the odd one.
    ``rows``: batch, grp, character, row_id, opener (boolean)."""
    order = draw(seed, F.col("row_id"))
    pick = lambda flag: F.min_by("row_id", F.when(F.col("opener") == F.lit(flag), F.struct(order, F.col("row_id"))))
    both = rows.groupBy("batch", "grp", "character").agg(pick(True).alias("with_opener"), pick(False).alias("without_opener"))
    both = both.filter("with_opener is not null and without_opener is not null")
    w = Window.partitionBy("character").orderBy(draw(seed, F.col("batch"), F.col("grp")), "batch", "grp")
    want = F.lit(count // 2) + ((F.col("character") == first) & F.lit(count % 2 == 1)).cast("int")
    return both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= -(-count // 2)).filter(F.col("n") <= want).drop("n")


def label_set(kinds: list[tuple[str, DataFrame, int]], seed: str) -> DataFrame:
    """One label set of several kinds of pairs: (kind, row_id, reply, ...). Of each kind in turn a seeded sample of at
    most its count is taken from the pairs whose (row_id, reply) no kind before has; columns that a kind lacks are null."""
    out = None
    for kind, pairs, count in kinds:
        one = pairs.dropDuplicates(["row_id", "reply"])
        if out is not None:
            one = one.join(out.select("row_id", "reply"), ["row_id", "reply"], "left_anti")
        one = hash_sample(one, f"{seed}|{kind}", "row_id", count).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def kind_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def blind(pairs: DataFrame, seed: str) -> DataFrame:
    """Items in shuffled order under ids q001, q002, ..., sides swapped by a hash bit. ``pairs``: kind, row_id,
    first, second. A label set is a few hundred rows, so numbering them in one task is bounded."""
    h = draw(seed, F.col("kind"), F.col("row_id"))
    swap = F.conv(F.substring(draw(seed + "-side", F.col("kind"), F.col("row_id")), 1, 1), 16, 10).cast("int") % 2 == 1
    n = F.row_number().over(Window.orderBy(h, "kind", "row_id"))
    return pairs.select(
        F.format_string("q%03d", n).alias("id"),
        "kind",
        "row_id",
        F.when(swap, F.col("second")).otherwise(F.col("first")).alias("left"),
        F.when(swap, F.col("first")).otherwise(F.col("second")).alias("right"),
        swap.alias("swapped"),
    )


def human_score(choice, swapped):
    """2 to -2 for the first source; skipped and unknown choices are null."""
    score = F.lit(None).cast("int")
    for k, v in CHOICES.items():
        score = F.when(choice == k, v).otherwise(score)
    return F.when(swapped, -score).otherwise(score)


def sources(kind):
    """(first, second) source of a pair by its kind: the side that a positive human score favours comes first."""
    return F.when(kind == "opener", "opener").otherwise("policy"), F.when(kind == "opener", "no_opener").otherwise("base")


def labelled_items(key: DataFrame, items: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Answer key, page items, labels and suite rows joined; unlabelled items stay with a null score.

    ``key``: id, kind, row_id, left, right; ``items``: id, left, right (texts); ``labels``: id, choice;
    ``rows``: id, character, situation, speaker, line. Texts come out as first and second source.
    """
    first, _ = sources(F.col("kind"))
    k = key.select("id", "kind", "row_id", (F.col("right") == first).alias("swapped"))
    j = k.join(items.select("id", F.col("left").alias("l"), F.col("right").alias("r")), "id").join(labels.select("id", "choice"), "id", "left")
    j = j.join(rows.withColumnRenamed("id", "row_id"), "row_id")
    text = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    return j.withColumn("first", text("l", "r")).withColumn("second", text("r", "l")).withColumn("human", human_score(F.col("choice"), F.col("swapped"))).drop("l", "r")


def uncovered(key: DataFrame, items: DataFrame) -> DataFrame:
    """Ids that only the key or only the page has; agreement is refused unless there are none."""
    a, b = key.select("id").distinct(), items.select("id").distinct()
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def signed_verdict(verdict):
    return verdict - 0.5


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """Of (human, judge) scores: sign agreement over all and over decisive pairs, and Pearson's r, null for a constant side."""
    h, j = F.signum(F.col("human").cast("double")), F.signum(F.col("judge").cast("double"))
    decisive = (h != 0) & (j != 0)
    r = F.try_divide(F.covar_pop("human", "judge"), F.stddev_pop("human") * F.stddev_pop("judge"))
    agree = F.count_if(decisive & (h == j))
    return rows.filter("human is not null and judge is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(h == j).alias("exact_three_way"),
        F.count_if(decisive).alias("decisive"),
        agree.alias("decisive_agree"),
        F.round(F.try_divide(agree, F.count_if(decisive)), 3).alias("decisive_rate"),
        F.round(r, 3).alias("pearson"),
    )


def gate(agreed: DataFrame) -> DataFrame:
    """Strictly better than the figures to beat; undefined figures fail."""
    ok = (F.col("decisive_rate") > BASE_DECISIVE) & (F.col("pearson") > BASE_PEARSON)
    return agreed.withColumn("passed", F.coalesce(ok, F.lit(False)))


def opener_preference(rows: DataFrame) -> DataFrame:
    """How often judge and humans prefer the reply with the opener."""
    return rows.agg(*[F.count_if(F.col(c) > 0).alias(f"{c}_for") for c in ("judge", "human")], *[F.count_if(F.col(c) < 0).alias(f"{c}_against") for c in ("judge", "human")])
