"""Stepwise choice of orders for every series at once, over linear models that share their sums of products.

The sums of the largest model are one row per series. A candidate's equations are rows and columns picked from them, so the series
are read once, and all candidates are scored on the same months. The search goes round by round: each series has a frontier of candidates, the
neighbours of its best model that it hasn't visited; it stops for itself when a round brings nothing better. A round is a table in the
shared folder, and the driver learns from it only whether any series goes on.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators import linear
from seriesforge.operators.linear import Model
from seriesforge.sources.tables import scratch_path

KEY = ("p", "ps", "dr")
STARTS = ((2, 1, False), (0, 0, False), (1, 0, False), (0, 1, False))  # where a search begins, as far as the largest orders allow
MOVES = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1))
VISITED = "series_id {id}, p int, ps int, dr boolean, aicc double, round int"


def _term_orders(model: Model) -> list[tuple[int, int, bool]]:
    """Least (p, ps, dr) of a model that has the term; either lag order brings in a lag that both can mean."""
    own = []
    for term in model.terms:
        lag = int(term[3:]) if term.startswith("lag") else 0
        p = lag if 0 < lag <= model.p else 10 ** 6 if lag else 0
        ps = lag // model.season if lag and lag % model.season == 0 else 10 ** 6 if lag else 0
        own.append((p, ps, term == "trend" or term == "constant" and model.d + model.ds > 0))
    return own


def scored(candidates: DataFrame, sums: DataFrame, largest: Model) -> DataFrame:
    """Adds ``aicc`` to rows (series_id, p, ps, dr); null where the model can't be fitted."""
    size = len(largest.terms)
    at = linear._places(size)
    whole = F.array(*[F.array(*[F.get("sums", F.lit(at[i, j])) for j in range(size + 1)]) for i in range(size + 1)])
    wanted = [F.when((~F.lit(dr) | F.col("dr")) & (F.lit(p == 0 and ps == 0) | (F.lit(p) <= F.col("p")) & F.lit(p > 0) | (F.lit(ps) <= F.col("ps")) & F.lit(ps > 0)),
                     F.lit(i)) for i, (p, ps, dr) in enumerate(_term_orders(largest))]
    rows = candidates.join(sums, "series_id").withColumns({"_all": whole, "_pick": F.array_compact(F.array(*wanted)).cast("array<int>")})
    target = F.lit(size)
    matrix = F.transform("_pick", lambda i: F.concat(F.transform("_pick", lambda j: F.get(F.get("_all", i), j)), F.array(F.get(F.get("_all", i), target))))
    rows = rows.withColumn("_c", linear.solved(matrix, F.col("n")))
    rows = rows.withColumn("_c", F.when((F.size("_pick") == 0) & (F.col("n") > 0), F.array().cast("array<double>")).otherwise(F.col("_c")))
    right = F.transform("_pick", lambda i: F.get(F.get("_all", i), target))
    own = F.get(F.get("_all", target), target)
    loss = F.greatest(own - linear._dot(F.col("_c"), right), 1e-12 * own) * F.get("_s", F.lit(0)) ** 2
    value = F.when(F.col("_c").isNotNull(), linear.aicc(loss, F.col("n"), F.size("_pick")))
    return rows.select(*candidates.columns, value.alias("aicc"))


def _best(rows: DataFrame) -> DataFrame:
    """(series_id, best): the least criterion and its model; the simpler one of equals."""
    return rows.groupBy("series_id").agg(F.min(F.when(F.col("aicc").isNotNull(), F.struct("aicc", *KEY))).alias("best"))


def _neighbours(best: DataFrame, largest: Model, trend: bool) -> DataFrame:
    """Candidates one move away from each series' best model, inside the largest orders."""
    def moved(p: int, ps: int) -> Column:
        return F.struct((F.col("best.p") + p).cast("int").alias("p"), (F.col("best.ps") + ps).cast("int").alias("ps"), F.col("best.dr").alias("dr"))

    moves = [moved(*m) for m in MOVES]
    if trend:
        moves.append(F.struct(F.col("best.p").alias("p"), F.col("best.ps").alias("ps"), (~F.col("best.dr")).alias("dr")))
    rows = best.filter("best IS NOT NULL").select("series_id", F.inline(F.array(*moves)))
    return rows.filter(F.col("p").between(0, largest.p) & F.col("ps").between(0, largest.ps))


def search(df: DataFrame, max_p: int = 3, max_ps: int = 2, d: int = 0, ds: int = 0, trend: bool = True, regressors: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, p, ps, dr, aicc, round): every model visited for every series, in the round that visited it."""
    spark = df.sparkSession
    largest = Model(max_p, d, max_ps, ds, trend and d + ds < 2, regressors)
    folder = scratch_path(spark, "stepwise")
    linear.moments(df, largest).write.parquet(f"{folder}/sums")
    sums = spark.read.parquet(f"{folder}/sums")
    schema = VISITED.format(id=df.schema["series_id"].dataType.simpleString())
    starts = sorted({(min(p, max_p), min(ps, max_ps), dr) for p, ps, dr in STARTS})
    candidates = sums.select("series_id", F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(ps).alias("ps"), F.lit(dr).alias("dr")) for p, ps, dr in starts])))
    paths: list[str] = []
    while True:
        path = f"{folder}/round-{len(paths)}"
        scored(candidates, sums, largest).withColumn("round", F.lit(len(paths))).write.parquet(path)
        latest = spark.read.schema(schema).parquet(path)
        before = spark.read.schema(schema).parquet(*paths) if paths else latest.limit(0)
        paths.append(path)
        if latest.isEmpty():
            return before
        visited = spark.read.schema(schema).parquet(*paths)
        # A series goes on from a best model that the last round found.
        gained = _best(visited).join(latest.select("series_id", F.struct("aicc", *KEY).alias("best")), ["series_id", "best"], "left_semi")
        candidates = _neighbours(gained, largest, largest.dr).join(visited, ["series_id", *KEY], "left_anti")


def choice(visited: DataFrame) -> DataFrame:
    """(series_id, p, ps, dr, aicc, n_visited, rounds): the best model of each series; nulls where none could be fitted."""
    best = visited.groupBy("series_id").agg(F.min(F.when(F.col("aicc").isNotNull(), F.struct("aicc", *KEY))).alias("best"),
                                            F.count("*").alias("n_visited"), (F.max("round") + 1).alias("rounds"))
    return best.select("series_id", *[F.col(f"best.{c}").alias(c) for c in (*KEY, "aicc")], "n_visited", "rounds")


def forecast(df: DataFrame, chosen: DataFrame, h: int, d: int = 0, ds: int = 0, regressors: tuple[str, ...] = ()) -> DataFrame:
    """Forecasts of each series by the model chosen for it; the models are few, so each is one job over its own series."""
    models = [r.asDict() for r in chosen.select(*KEY).filter("p IS NOT NULL").distinct().collect()]
    base, parts = Model(d=d, ds=ds, regressors=regressors), []
    for m in sorted(models, key=repr):
        own = chosen.filter((F.col("p") == m["p"]) & (F.col("ps") == m["ps"]) & (F.col("dr") == m["dr"])).select("series_id")
        model = replace(base, **m)
        parts.append(linear.forecast(df.join(own, "series_id", "left_semi"), model, h).withColumn("model", F.lit(model.label)))
    if not parts:
        return linear.forecast(df.limit(0), base, h).withColumn("model", F.lit(base.label))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
