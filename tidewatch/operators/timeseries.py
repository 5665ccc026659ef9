"""Windows over (country, day) panels: latest rows, dense windows, trends, training windows, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import n_if, r6, trend

EPOCH = "1970-01-01"


def day_number(c: str | Column) -> Column:
    return F.datediff(c, F.lit(EPOCH).cast("date"))


def latest_country_risk(risk: DataFrame) -> DataFrame:
    """The newest row with a risk score of each country."""
    cols = [c for c in risk.columns if c != "country"]
    best = risk.filter("risk_score is not null").groupBy("country").agg(F.max_by(F.struct(*cols), "feature_date").alias("r"))
    return best.select("country", "r.*")


def top_neighbors(edges: DataFrame, n: int = 5) -> DataFrame:
    """Each country's ``n`` strongest edges as first endpoint and as second: country, neighbor, weight, rank, side."""
    out = None
    for me, other, side in (("country_a", "country_b", "a"), ("country_b", "country_a", "b")):
        w = Window.partitionBy(me).orderBy(F.desc("weight"), other)
        x = edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(F.col(me).alias("country"), F.col(other).alias("neighbor"), "weight", "rank", F.lit(side).alias("side"))
        out = x if out is None else out.unionByName(x)
    return out


def best_neighbors(edges: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best over both sides of ``top_neighbors``."""
    w = Window.partitionBy("country").orderBy(F.desc("weight"), "neighbor")
    return top_neighbors(edges, n).select("country", "neighbor", "weight").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dense_window(features: DataFrame, columns: list[str], seq_len: int = 90, as_of: str | None = None) -> DataFrame:
    """Every calendar day of the window that ends on ``as_of`` (else on each country's last day), filled forward inside
    the window; a leading gap is 0. ``valid`` marks days that had a row, ``pos`` counts from 1."""
    end = F.lit(as_of).cast("date") if as_of else F.max("feature_date")
    f = features.filter(F.col("feature_date") <= F.lit(as_of).cast("date")) if as_of else features
    spans = f.groupBy("country").agg(end.alias("end"))
    days = spans.select("country", F.explode(F.sequence(F.date_sub("end", seq_len - 1), "end")).alias("feature_date"))
    joined = days.join(f.select("country", "feature_date", *columns, F.lit(True).alias("valid")), ["country", "feature_date"], "left")
    w = Window.partitionBy("country").orderBy("feature_date").rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)).alias(c)
    return joined.select("country", "feature_date", F.row_number().over(Window.partitionBy("country").orderBy("feature_date")).alias("pos"), F.coalesce("valid", F.lit(False)).alias("valid"), *[fill(c) for c in columns])


def tail_means(dense: DataFrame, columns: list[str], last: int) -> DataFrame:
    """Means of the last ``last`` rows of each country's dense window, with the share of valid days with any value."""
    top = dense.withColumn("__n", F.max("pos").over(Window.partitionBy("country")))
    tail = F.col("pos") > F.col("__n") - last
    any_ = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) > 0
    return top.groupBy("country").agg(*[r6(F.avg(F.when(tail, F.col(c)))).alias(c) for c in columns], r6(F.avg(F.when(any_, 1.0).otherwise(0.0))).alias("coverage"))


def trailing_context(daily: DataFrame, key: str, date: str, values: list[str], days: int = 7) -> DataFrame:
    """Sums of the ``days`` days before each row's day."""
    w = Window.partitionBy(key).orderBy(day_number(date)).rangeBetween(-days, -1)
    return daily.select(key, date, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"prior_{v}") for v in values])


def trend_7v7(risk: DataFrame, band: float = 0.03) -> DataFrame:
    """Mean of [d-7, d] against [d-14, d-7] on each country's every day."""
    w = Window.partitionBy("country").orderBy(day_number("feature_date"))
    recent, before = F.avg("risk_score").over(w.rangeBetween(-7, 0)), F.avg("risk_score").over(w.rangeBetween(-14, -7))
    return risk.select("country", "feature_date", r6(recent - before).alias("delta")).withColumn("trend", trend(F.col("delta"), band))


def trend_3v3(risk: DataFrame, band: float = 0.02) -> DataFrame:
    """Mean of the last three rows against the three before; fewer than six rows are stable."""
    w = Window.partitionBy("country").orderBy(F.desc("feature_date"))
    r = risk.withColumn("n", F.row_number().over(w)).filter("n <= 6")
    delta = F.avg(F.when(F.col("n") <= 3, F.col("risk_score"))) - F.avg(F.when(F.col("n") > 3, F.col("risk_score")))
    return r.groupBy("country").agg(r6(delta).alias("delta"), F.count("*").alias("rows")).select(
        "country", F.when(F.col("rows") < 6, "stable").otherwise(trend(F.col("delta"), band)).alias("trend"))


def origin_risk(risk: DataFrame, as_of: str) -> DataFrame:
    """As of a day: the effective date and the newest risk up to it, 0 without any."""
    r = risk.filter(F.col("feature_date") <= F.lit(as_of).cast("date"))
    return r.groupBy("country").agg(F.max("feature_date").alias("effective_date"), F.coalesce(F.max_by("risk_score", F.when(F.col("risk_score").isNotNull(), F.col("feature_date"))), F.lit(0.0)).alias("origin_risk"))


def trend_slope(dense: DataFrame, column: str, last: int = 30) -> DataFrame:
    """Least-squares slope of ``column`` on position over the last ``last`` rows."""
    top = dense.withColumn("__n", F.max("pos").over(Window.partitionBy("country"))).filter(F.col("pos") > F.col("__n") - last)
    return top.groupBy("country").agg(r6(F.coalesce(F.regr_slope(F.col(column), F.col("pos").cast("double")), F.lit(0.0))).alias("slope"))


def chunked(dense: DataFrame, columns: list[str], overlap: int, size: int) -> DataFrame:
    """country, chunk (from 0) and rows: each country's positions cut into arrays of ``size``, with the ``overlap`` rows before
    them. A row is moved once, and twice if it lies in an overlap."""
    own = F.floor((F.col("pos") - 1) / size).cast("int")
    near = F.when(F.col("pos") > (own + 1) * size - overlap, F.array(own, own + 1)).otherwise(F.array(own))
    each = dense.select("country", F.struct("pos", "feature_date", "valid", *columns).alias("r"), F.explode(near).alias("chunk"))
    return each.groupBy("country", "chunk").agg(F.sort_array(F.collect_list("r")).alias("rows")).filter(F.element_at("rows", -1)["pos"] > F.col("chunk") * size)


def sliding_windows(dense: DataFrame, columns: list[str], seq_len: int, stride: int, min_nonzero: int, chunk: int = 512) -> DataFrame:
    """Windows of ``seq_len`` rows that end every ``stride`` rows, as arrays of structs, with enough non-zero days.

    Windows are slices of chunks of the panel that overlap by a window, so what is shuffled is about the panel, also where
    windows overlap almost wholly.
    """
    size = max(chunk, seq_len)
    c = chunked(dense, columns, seq_len - 1, size)
    ends = F.filter("rows", lambda r: (r["pos"] > F.col("chunk") * size) & (r["pos"] >= seq_len) & ((r["pos"] - seq_len) % stride == 0))
    first = F.get("rows", F.lit(0))["pos"]
    cut = F.transform(ends, lambda e: F.struct(e["feature_date"].alias("end_date"), F.slice("rows", e["pos"] - first - (seq_len - 2), F.lit(seq_len)).alias("w")))
    w = c.select("country", F.explode(cut).alias("x")).select("country", "x.end_date", "x.w")
    some = lambda r: sum((r[k] for k in columns[1:]), r[columns[0]]) > 0
    w = w.withColumn("nonzero", F.size(F.filter("w", some)).cast("long")).filter(F.col("nonzero") >= min_nonzero)
    return w.select("country", "end_date", "nonzero", F.transform("w", lambda r: F.struct(*[r[k].alias(k) for k in ("pos", "valid", *columns)])).alias("window"))


def context_target_pairs(snapshots: DataFrame, value: str, context: int = 6, target: int = 4, min_context: int = 2, min_target: int = 1) -> DataFrame:
    """For each (country, snapshot): the values of the last ``context`` snapshots and the next ``target``; absent ones are 0.

    Snapshots are numbered over all countries, and each offset is an equi-join folded into one grouping.
    """
    dates = snapshots.select("snapshot_date").distinct()
    numbered = dates.withColumn("i", F.dense_rank().over(Window.orderBy("snapshot_date")))
    s = snapshots.join(numbered, "snapshot_date").select("country", "i", F.col(value).alias("v"))
    moved = s.select("country", "v", F.explode(F.sequence(F.lit(-target), F.lit(context - 1))).alias("o"), "i").withColumn("step", F.col("i") + F.col("o"))
    at = lambda o: F.coalesce(F.max(F.when(F.col("o") == o, F.col("v"))), F.lit(0.0))
    g = moved.groupBy("country", "step").agg(
        *[at(context - 1 - k).alias(f"c{k + 1}") for k in range(context)], *[at(-k).alias(f"t{k}") for k in range(1, target + 1)],
        n_if((F.col("o") >= 0) & (F.col("v") != 0)).alias("nc"), n_if((F.col("o") < 0) & (F.col("v") != 0)).alias("nt"))
    last = dates.agg(F.count("*")).scalar()
    g = g.filter((F.col("step") >= context) & (F.col("step") <= last - target))
    return g.filter((F.col("nc") >= min_context) & (F.col("nt") >= min_target)).drop("nc", "nt")


def split_by_index(rows: DataFrame, date: str, shares=(0.7, 0.15)) -> DataFrame:
    """train, val or test by the number of the date among all dates."""
    dates = rows.select(date).distinct().withColumn("i", F.row_number().over(Window.orderBy(date)))
    n = rows.agg(F.count_distinct(date)).scalar()
    split = F.when(F.col("i") <= F.floor(n * shares[0] + 1e-9), "train").when(F.col("i") <= F.floor(n * sum(shares) + 1e-9), "val").otherwise("test")
    return rows.join(dates.select(date, split.alias("split")), date)


def split_by_dates(rows: DataFrame, date: str, train_end: str, val_end: str) -> DataFrame:
    d = F.col(date)
    return rows.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def last_share_per_key(rows: DataFrame, key: str, date: str, share: float = 0.2) -> DataFrame:
    """The last ``share`` of each key's rows."""
    w = Window.partitionBy(key)
    return rows.withColumn("__i", F.row_number().over(w.orderBy(date))).withColumn("__n", F.count("*").over(w)).filter(F.col("__i") > F.floor(F.col("__n") * (1 - share) + 1e-9)).drop("__i", "__n")


def restride(windows: DataFrame, every: int = 14) -> DataFrame:
    """Windows that end a multiple of ``every`` days after their country's first."""
    first = windows.groupBy("country").agg(F.min("end_date").alias("__first"))
    return windows.join(first, "country").filter(F.datediff("end_date", "__first") % every == 0).drop("__first")


def walk_forward_folds(risk: DataFrame, burn_in: int = 30) -> DataFrame:
    """(country, pivot_date, origin_risk, fold): dates after the first ``burn_in`` are pivots; a country takes part if it
    has at least max(burn_in, half of all dates) rows and is there on the pivot."""
    dates = risk.select("feature_date").distinct()
    numbered = dates.withColumn("i", F.row_number().over(Window.orderBy("feature_date")))
    n_dates = risk.agg(F.count_distinct("feature_date")).scalar()
    enough = risk.groupBy("country").agg(F.count("*").alias("rows")).filter(F.col("rows") >= F.greatest(F.lit(burn_in), n_dates / 2)).select("country")
    r = risk.join(numbered.filter(F.col("i") > burn_in), "feature_date").join(enough, "country")
    return r.select("country", F.col("feature_date").alias("pivot_date"), F.col("risk_score").alias("origin_risk"), (F.col("i") - burn_in).alias("fold"))


def active_countries(features: DataFrame, as_of: str, days: int = 7, fallback_days: int = 30) -> DataFrame:
    """Countries with rows in the ``days`` before ``as_of``; if none has, in the ``fallback_days`` before the newest date."""
    d = F.lit(as_of).cast("date")
    near = F.col("feature_date").between(F.date_sub(d, days), d)
    found = features.agg(F.max(F.when(near, 1))).scalar()
    newest = features.agg(F.max("feature_date")).scalar()
    return features.filter(F.when(found == 1, near).otherwise(F.col("feature_date") >= F.date_sub(newest, fallback_days))).select("country").distinct()


def sampled_grid(features: DataFrame, columns: list[str], step: int) -> DataFrame:
    """Each country's values on every ``step``-th day from its first to the last of all, 0 where missing."""
    spans = features.groupBy("country").agg(F.min("feature_date").alias("first")).withColumn("last", features.agg(F.max("feature_date")).scalar())
    grid = spans.select("country", F.explode(F.expr(f"sequence(first, last, interval {step} days)")).alias("feature_date"))
    return grid.join(features.select("country", "feature_date", *columns), ["country", "feature_date"], "left").fillna(0.0, columns)


def last_dates(rows: DataFrame, date: str, n: int) -> DataFrame:
    """The last ``n`` distinct dates, ascending."""
    return rows.select(date).distinct().orderBy(F.desc(date)).limit(n).orderBy(date)
