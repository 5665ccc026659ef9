"""Proxy labels from events: daily sufficient statistics, then row formulas and a trailing context of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import n_if, r6, sigmoid

TASKS = ("instability", "war", "terrorism", "financial")


def label_statistics(events: DataFrame) -> DataFrame:
    """Counts and weighted sums per (country, day) from which every label follows by arithmetic."""
    root, base, quad = F.col("event_root_code"), F.col("event_base_code"), F.col("quad_class")
    r, b, q = F.coalesce(root, F.lit(0)), F.coalesce(base, F.lit(0)), F.coalesce(quad, F.lit(0))
    m = F.coalesce(F.nullif(F.col("num_mentions"), F.lit(0)), F.lit(1)).cast("double")
    weight = F.when(q == 4, 1.0).when(q == 3, 0.5).when(r == 14, 0.3).otherwise(0.0)
    fight = r.isin(19, 20)
    cross = (F.coalesce("actor1_country", F.lit("")) != "") & (F.coalesce("actor2_country", F.lit("")) != "") & (F.col("actor1_country") != F.col("actor2_country"))
    terror = b.between(180, 186) | (r.isin(18, 19, 20) & (q == 4))
    money = lambda codes: b.isin(*codes) | r.isin(*codes)
    part = lambda c, w=1.0: F.sum(F.when(c, F.lit(w) if isinstance(w, float) else w).otherwise(0.0))
    return events.filter(F.coalesce("action_geo_country", F.lit("")) != "").groupBy(F.col("action_geo_country").alias("country"), F.col("event_date").alias("label_date")).agg(
        F.count("*").alias("n"),
        F.sum(weight * (1.0 + F.log1p(m) / 10.0)).alias("conflict"),
        (1.5 * n_if(fight) + 2.0 * n_if(r == 20) + 0.5 * n_if(r.between(15, 20)) + 0.3 * n_if(cross)).alias("war"),
        n_if(fight).alias("fights"),
        part(fight, m).alias("fight_mentions"),
        part(terror, F.when(b.isin(183, 185), 2.0).otherwise(1.0) * (1.0 + F.log1p(m) / 8.0)).alias("terror"),
        (1.5 * n_if(money((163, 168))) + 0.8 * n_if(r.isin(15, 16, 163, 168, 172, 173) & q.isin(3, 4)) + 0.2 * n_if(F.coalesce("avg_tone", F.lit(0.0)) < -10)).alias("money"),
    )


def _instability(conflict, n):
    return sigmoid((conflict / n - 0.3) * 8.0)


def _war(raw, n, fights, mentions, context_fights, context_n):
    x = raw / n * (1.0 + 0.5 * F.coalesce(context_fights / F.greatest(context_n, F.lit(1)), F.lit(0.0)))
    x = F.when(mentions > 0, x * (1.0 + F.log1p(mentions / F.greatest(fights, F.lit(1))) / 10.0)).otherwise(x)
    return sigmoid((x - 0.4) * 6.0)


def multitask_labels(events: DataFrame, smoothing_days: int = 7, alpha: float = 0.7) -> DataFrame:
    """Four labels per (country, day); instability and war are blended with the pooled events of the days before.

    The context is a range window over daily statistics, so no event meets another.
    """
    s = label_statistics(events)
    day = F.datediff("label_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("country").orderBy(day).rangeBetween(-smoothing_days, -1)
    context = {f"c_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("n", "conflict", "war", "fights", "fight_mentions")}
    s = s.withColumns(context)
    n = F.col
    inst = _instability(n("conflict"), n("n"))
    war = _war(n("war"), n("n"), n("fights"), n("fight_mentions"), n("c_fights"), n("c_n"))
    c_inst = F.when(n("c_n") > 0, sigmoid((F.try_divide(n("c_conflict"), n("c_n")) - 0.3) * 8.0)).otherwise(0.0)
    raw = F.try_divide(n("c_war"), n("c_n"))
    raw = F.when(n("c_fight_mentions") > 0, raw * (1.0 + F.log1p(n("c_fight_mentions") / F.greatest(n("c_fights"), F.lit(1))) / 10.0)).otherwise(raw)
    c_war = F.when(n("c_n") > 0, sigmoid((raw - 0.4) * 6.0)).otherwise(0.0)
    blend = lambda own, before: r6(F.least(alpha * own + (1 - alpha) * before, F.lit(1.0)))
    return s.select(
        "country", "label_date", n("n").alias("event_count"),
        blend(inst, c_inst).alias("instability_label"), blend(war, c_war).alias("war_label"),
        r6(F.least(sigmoid((n("terror") / n("n") - 0.3) * 7.0), F.lit(1.0))).alias("terrorism_label"),
        r6(F.least(sigmoid((n("money") / n("n") - 0.2) * 8.0), F.lit(1.0))).alias("financial_label"),
    )


def daily_signals(events: DataFrame) -> DataFrame:
    """The four signals of each day by itself, without context."""
    s, n = label_statistics(events), F.col
    return s.select(
        "country", "label_date",
        r6(_instability(n("conflict"), n("n"))).alias("instability"),
        r6(_war(n("war"), n("n"), n("fights"), n("fight_mentions"), F.lit(0), F.lit(0))).alias("war"),
        r6(sigmoid((n("terror") / n("n") - 0.3) * 7.0)).alias("terrorism"),
        r6(sigmoid((n("money") / n("n") - 0.2) * 8.0)).alias("financial"),
    )
