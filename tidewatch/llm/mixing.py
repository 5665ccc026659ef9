"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows from the root by weight. What a child cannot take
(``max_epochs`` times its tokens) goes to its siblings, in proportion to their weights; only when all siblings are full
does the shortage reach the parent's siblings, because a parent's own limit is the sum of its leaves' limits. Each leaf
then takes whole epochs and, of one more epoch, a prefix: its documents in the order of md5(seed:epoch:doc_id), up to
the first that would exceed the budget.

The prefix needs no sort of a leaf: token sums per leaf and leading hash digits (16**DIGITS buckets at most) find the
bucket in which the budget ends, sums of that bucket by further digits the next, and so on until a leaf's last bucket
has at most ``SMALL`` keys, which are ordered. So no window grows with a leaf. The result of planning is one row per
leaf, which is joined to the documents.

Nulls and odd input: a null language, source or domain is a node of its own with the default weight; a node of weight 0
takes nothing, however short its siblings are, and negative weights raise; null text has no
tokens; a null doc_id hashes as an empty string; rows of equal doc_id are taken or left together; documents without
tokens are taken in whole epochs and in a prefix that reaches them, and never if their leaf has no tokens at all; an empty table gives an empty result. Extra columns are kept by
``mixed_documents`` and may have any name. All sums are integers; rounding down leaves at most one token per node unused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, materialize, sized_join

DIGITS = 2
SMALL = 256


@dataclass(frozen=True)
class Mix:
    """Integer target weights by node name; names that are absent have ``default``."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 3})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 3, "src5": 2})
    default: int = 1
    budget_tenths: int = 8
    max_epochs: int = 2
    seed: int = 17

    def __post_init__(self) -> None:
        if min([self.default, *self.domains.values(), *self.langs.values(), *self.sources.values()]) < 0:
            raise ValueError("weights must not be negative")

    def named(self, level: str) -> dict[str, int]:
        return {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]

    def weight(self, level: str) -> Column:
        known = self.named(level)
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col(level)) if known else F.lit(None)
        return F.coalesce(found, F.lit(self.default)).cast("long")

    def weight_sql(self, level: str) -> str:
        cases = "".join(" when n.{} = '{}' then {}".format(level, k.replace("'", "''"), v) for k, v in self.named(level).items())
        return f"(case{cases} else {self.default} end)::bigint" if cases else f"{self.default}::bigint"


#: Four domains, by the last character of the source's name.
DOMAIN = "concat('d', cast(ascii(right(source, 1)) % 4 as string))"
LEVELS = (("domain", ()), ("lang", ("domain",)), ("source", ("domain", "lang")))


def token_counts(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens (words of the whole text)."""
    return docs.select(
        "doc_id", F.expr(domain).alias("domain"), "lang", "source",
        F.expr(f"cast(coalesce(regexp_count(text, r'{WORD}'), 0) as bigint)").alias("n_tokens"),
    )


def _shared_out(nodes: DataFrame, parents: tuple[str, ...], name: str) -> DataFrame:
    """``nodes`` (w, cap, budget of the parent) with ``take``: the parent's budget by weight, each at most cap.

    Nodes without weight come last and take nothing.
    """
    w = Window.partitionBy(*[F.col(p) for p in parents] or [F.lit(0)])
    before = w.orderBy(F.try_divide("cap", "w").asc_nulls_last(), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    n = n.withColumn("sum_w", F.sum("w").over(w)).withColumn("full", F.expr("w > 0 AND cap * (sum_w - w_before) <= w * (budget - cap_before)"))
    n = n.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w)).withColumn("w_full", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(w))
    return n.withColumn("take", F.expr("CASE WHEN w = 0 THEN 0 WHEN full THEN cap ELSE w * (budget - cap_full) div (sum_w - w_full) END"))


def leaf_budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, avail (tokens of one epoch), take."""
    leaves = materialize(tokens.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("avail")))
    budget = leaves.agg(F.expr(f"coalesce(sum(avail), 0) * {mix.budget_tenths} div 10")).first()[0]
    taken = None
    for level, parents in LEVELS:
        keys = [*parents, level]
        nodes = leaves.groupBy(*keys).agg(F.expr(f"sum(avail) * {mix.max_epochs}").alias("cap")).withColumn("w", mix.weight(level))
        if taken is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            up = taken.select(*[F.col(p).alias(f"up_{p}") for p in parents], F.col("take").alias("budget"))
            on = F.lit(True)
            for p in parents:
                on = on & F.col(p).eqNullSafe(F.col(f"up_{p}"))
            nodes = nodes.join(up, on).drop(*[f"up_{p}" for p in parents])
        taken = materialize(_shared_out(nodes, parents, level).select(*keys, "cap", "take"))
    return taken.select("domain", "lang", "source", F.expr(f"cap div {mix.max_epochs}").alias("avail"), "take")


def _key(epoch: str, mix: Mix) -> Column:
    return F.expr(f"md5(concat('{mix.seed}:', {epoch}, ':', coalesce(cast(doc_id as string), '')))")


def plan(tokens: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: whole epochs, and the key prefix and key up to which the next epoch's documents are taken.

    ``tokens`` is read several times: give a materialised frame.
    """
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(tokens, mix).select(
        *leaf, F.expr("CASE WHEN avail > 0 THEN take div avail ELSE 0 END").alias("whole"),
        F.expr("CASE WHEN avail > 0 THEN take % avail ELSE 0 END").alias("rest"),
    )
    budgets = materialize(budgets)
    rows = sized_join(tokens, budgets.filter("rest > 0"), leaf, "inner").select(*leaf, "rest", F.lit(0).cast("long").alias("before"), _key("whole", mix).alias("key"), F.col("n_tokens").alias("n"))
    digits = 0
    while True:
        digits += DIGITS
        sums = rows.groupBy(*leaf, "rest", "before", F.substring("key", 1, digits).alias("prefix")).agg(F.sum("n").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("prefix"))
        over = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        ends = materialize(over.groupBy(*leaf).agg(F.min(F.struct("prefix", (F.col("upto") - F.col("n")).alias("at"))).alias("e")).select(*leaf, "e.prefix", "e.at"))
        inside = sized_join(rows, ends, leaf, "inner").filter(F.startswith("key", "prefix"))
        rows = materialize(inside.groupBy(*leaf, "rest", F.col("at").alias("before"), "key").agg(F.sum("n").alias("n")))
        if digits >= 32 or not rows.groupBy(*leaf).count().filter(F.col("count") > SMALL).limit(1).count():
            break
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("key"))
    cut = rows.withColumn("upto", upto).filter("upto <= rest").groupBy(*leaf).agg(F.max("key").alias("cut"))
    out = sized_join(sized_join(budgets, ends, leaf), materialize(cut), leaf)
    return materialize(out.select(*leaf, "whole", "rest", "prefix", "cut"))


def chosen(rows: DataFrame, plans: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with doc_id, domain, lang, source) once for each epoch that takes them, with ``epoch``."""
    r = sized_join(rows, plans, ["domain", "lang", "source"], "inner").withColumn("__k", _key("whole", mix))
    n = F.col("whole") + F.when(F.expr("rest > 0 AND (__k < prefix OR __k <= cut)"), 1).otherwise(0)
    r = r.withColumn("epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))))
    return r.drop("__k", "whole", "rest", "prefix", "cut")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time that a document is taken."""
    tokens = materialize(token_counts(docs, domain))
    return chosen(tokens, plan(tokens, mix), mix).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), domain: str = DOMAIN) -> DataFrame:
    """The rows of ``docs`` that are taken, repeated for each epoch, with the columns of ``docs``."""
    plans = plan(materialize(token_counts(docs, domain)), mix)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", F.expr(domain).alias("domain"), "lang", "source")
    return chosen(rows, plans, mix).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def oracle_sql(mix: Mix = Mix()) -> str:
    def level(name: str, keys: list[str], parents: list[str], up: str, level_name: str) -> str:
        on = " and ".join(f"n.{p} is not distinct from u.{p}" for p in parents) or "true"
        part = ", ".join(parents) or "1"
        cols = ", ".join(keys)
        return f"""
{name}_n as (select {cols}, sum(avail)::bigint * {mix.max_epochs} as cap from leaves group by {cols}),
{name}_b as (select n.*, {mix.weight_sql(level_name)} as w, u.take as budget from {name}_n n join {up} u on {on}),
{name}_w as (select *, sum(w) over (partition by {part}) as sum_w,
  coalesce(sum(cap) over (partition by {part} order by case when w > 0 then cap / w end nulls last, {level_name} nulls first rows between unbounded preceding and 1 preceding), 0) as cap_before,
  coalesce(sum(w) over (partition by {part} order by case when w > 0 then cap / w end nulls last, {level_name} nulls first rows between unbounded preceding and 1 preceding), 0) as w_before from {name}_b),
{name}_f as (select *, w > 0 and cap * (sum_w - w_before) <= w * (budget - cap_before) as fl from {name}_w),
{name}_s as (select *, sum(case when fl then cap else 0 end) over (partition by {part}) as cap_full,
  sum(case when fl then w else 0 end) over (partition by {part}) as w_full from {name}_f),
{name} as (select {cols}, cap, case when w = 0 then 0 when fl then cap else w * (budget - cap_full) // (sum_w - w_full) end as take from {name}_s),"""

    return f"""with tokens as (select doc_id, 'd' || (ascii(right(source, 1)) % 4) as domain, lang, source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as avail from tokens group by 1, 2, 3),
root as (select sum(avail)::bigint * {mix.budget_tenths} // 10 as take from leaves),{level("l1", ["domain"], [], "root", "domain")}{level("l2", ["domain", "lang"], ["domain"], "l1", "lang")}{level("l3", ["domain", "lang", "source"], ["domain", "lang"], "l2", "source")}
plans as (select domain, lang, source, case when cap > 0 then take // (cap // {mix.max_epochs}) else 0 end as whole,
  case when cap > 0 then take % (cap // {mix.max_epochs}) else 0 end as rest from l3),
keyed as (select t.*, whole, rest, md5('{mix.seed}:' || whole::bigint || ':' || coalesce(doc_id::varchar, '')) as key from tokens t join plans p
  on t.domain is not distinct from p.domain and t.lang is not distinct from p.lang and t.source is not distinct from p.source),
sums as (select *, sum(n_tokens) over (partition by domain, lang, source order by key) as upto from keyed)
select doc_id, domain, lang, source, n_tokens, unnest(range(0, (whole + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint)) as epoch from sums"""


ORACLE_SQL = oracle_sql()
