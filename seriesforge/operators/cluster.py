"""Clusters of series by their statistics: k-means with seeding in parallel.

Rows are ``(id, features)`` with an array of numbers. The centres, ``k`` times the number of features, are the only thing that passes through the
driver, and they are part of each round's expression; so a round is one pass with a small aggregate, and no row is joined or moved.
Seeding takes a few passes: each draws rows with a chance that grows with their squared distance to the seeds so far (by a hash of the id,
so that a repeated or recomputed run draws the same), weighs what it drew by the rows nearest to it, and thins it out to ``k``.

Defined cases: rows without id, or with a null or non-finite feature, take no part; equal distances go to the centre with the smaller number;
a centre that no row is nearest to stays where it is; fewer distinct rows than ``k`` give fewer centres; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_NUMBERS = 100_000  # of all centres together: what the driver and each plan may hold


def usable(df: DataFrame, id: str = "id", features: str = "features") -> DataFrame:
    """(id, features) of the rows that take part."""
    values = F.col(features).cast("array<double>")
    fit = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(id).isNotNull() & F.col(features).isNotNull() & fit).select(F.col(id).alias("id"), values.alias("features"))


def scaled(df: DataFrame) -> DataFrame:
    """Features with mean 0 and deviation 1, by one aggregate over all rows; a constant feature becomes 0."""
    rows = usable(df)
    size = rows.agg(F.max(F.size("features"))).first()[0] or 0
    each = [F.get("features", F.lit(i)) for i in range(size)]
    sums = rows.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(each) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if size else None
    out = [(x - F.lit(sums[f"m{i}"])) / F.lit(sums[f"s{i}"]) if sums[f"s{i}"] else F.lit(0.0) for i, x in enumerate(each)]
    return rows.withColumn("features", F.array(*out).cast("array<double>"))


def _literal(centres: Sequence[Sequence[float]]) -> Column:
    if sum(map(len, centres)) > MOST_NUMBERS:
        raise ValueError(f"{len(centres)} centres are too many for one expression")
    return F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*map(F.lit, map(float, c))).alias("at")) for i, c in enumerate(centres)])


def nearest(centres: Sequence[Sequence[float]]) -> Column:
    """(distance, cluster): the squared distance to the nearest centre, and its number."""
    def distance(at: Column) -> Column:
        return F.aggregate(F.zip_with("features", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x)

    return F.array_min(F.transform(_literal(centres), lambda c: F.struct(distance(c["at"]).alias("distance"), c["cluster"].alias("cluster"))))


def assigned(df: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(id, cluster, distance) of every row."""
    return df.withColumn("_n", nearest(centres)).select("id", F.col("_n.cluster").alias("cluster"), F.col("_n.distance").alias("distance"))


def lloyd(df: DataFrame, centres: Sequence[Sequence[float]], rounds: int = 10) -> list[list[float]]:
    """The centres after some rounds, or once a round changes nothing."""
    centres = [list(map(float, c)) for c in centres]
    for _ in range(rounds if centres else 0):
        size = len(centres[0])
        means = df.withColumn("_c", nearest(centres)["cluster"]).groupBy("_c").agg(*[F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(size)])
        moved = [list(c) for c in centres]
        for row in means.collect():  # one row a centre
            moved[row["_c"]] = [row[f"m{i}"] for i in range(size)]
        if moved == centres:
            break
        centres = moved
    return centres


def seeds(df: DataFrame, k: int, passes: int = 4, salt: int = 0) -> list[list[float]]:
    """At most ``k`` starting centres, drawn far apart in a few passes over all rows."""
    chance = lambda n: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
    first = df.agg(F.min_by("features", F.struct(F.xxhash64("id", F.lit(salt)), "id"))).first()[0]
    if first is None:
        return []
    found = [list(first)]
    for n in range(passes):
        with_distance = df.withColumn("_d", nearest(found)["distance"])
        total = with_distance.agg(F.sum("_d")).first()[0]
        if not total:
            break
        # About 2 k rows a pass are expected; the limit only guards the driver, by the order of their chance.
        draw = with_distance.withColumn("_u", chance(n)).filter(F.col("_u") * total < 2 * k * F.col("_d"))
        found += [list(r.features) for r in draw.orderBy(F.col("_u") / F.col("_d"), "id").limit(8 * k).select("features").collect()]
        found = [list(x) for x in dict.fromkeys(map(tuple, found))]
    weights = {r.cluster: r.n for r in assigned(df, found).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    # Thinned out on the driver, farthest first: at most a few hundred rows a centre.
    chosen = [max(range(len(found)), key=lambda i: (weights.get(i, 0), -i))]
    gap = [sum((a - b) ** 2 for a, b in zip(x, found[chosen[0]])) for x in found]
    while len(chosen) < k:
        best = max(range(len(found)), key=lambda i: (gap[i] * weights.get(i, 0), -i))
        if not gap[best] * weights.get(best, 0):
            break
        chosen.append(best)
        gap = [min(g, sum((a - b) ** 2 for a, b in zip(x, found[best]))) for g, x in zip(gap, found)]
    return [found[i] for i in chosen]


def kmeans(df: DataFrame, k: int, rounds: int = 10, salt: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster, distance) of every row, and the centres."""
    rows = usable(df)
    centres = lloyd(rows, seeds(rows, k, salt=salt), rounds)
    return (assigned(rows, centres) if centres else rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))), centres
