"""Quality rules with thresholds that adapt to each language and source.

Every document gets integer metrics. Each metric's distribution per (language, source) is kept as a log-linear
histogram: 128 bins for each power of two, so a quantile is right to 1/128 of its value. Histograms merge by adding
counts, which is all that Spark shuffles: a row per bin, group and task, and bins are bounded by the values' digits. Groups with fewer than
``min_docs`` documents use their language's merged sketch, and languages with fewer use that of all documents.

Thresholds are fences beyond a tail quantile: q85 + max(SPREADS * (q85 - q50), EVENTS * grain) above, and likewise below q15,
so that less than 15 of 100 bad documents on a side do not move them. No threshold is a constant: the grain is what one
symbol, one repeated line or one repeated window makes in a document of the group's median size, and keeps a fence off
the quantiles where nearly all documents have the same value. Rates count what goes beyond the first event, as one
event in a short text says nothing of a rate. The thresholds are then joined to the documents.

Nulls and odd input: a null text counts as an empty one (no words, so it fails the base rule); a null language or source
is a group of its own; repeated rows each count and each get a row; an empty table gives an empty result. Extra columns
are ignored by ``quality_verdicts`` and kept by ``quality_filter``; their names may clash with the metrics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, let, materialize, sized_join, text_or_empty

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: metric: (fence below?, fence above?, an event of it, what it is a rate of). Rates are per hundred thousand, word_length is in
#: hundredths of a character, distinct_rate per thousand. The grain is RATE * event / median size, or 1 where there is no size,
#: and no finer than the histogram's bin at the median.
FENCES = {
    "symbol_rate": (False, True, 1, "word_chars"),
    "dup_line_rate": (False, True, 1, "n_lines"),
    "repeat_rate": (False, True, 2 * WINDOW, "n_words"),
    "word_length": (True, True, 1, None),
    "distinct_rate": (True, False, 1, None),
}
RATE = 100_000
METRICS = tuple(FENCES)
SIZES = ("word_chars", "n_lines", "n_words")
#: The share of distinct words is taken in blocks of so many words, so that long texts are judged as short ones are.
BLOCK = 100
TAIL = 15
SPREADS = 6
EVENTS = 3
#: Bits of a value that its histogram bin keeps.
BITS = 8
MIN_DOCS = 100
MIN_WORDS = 20
MAX_REPEAT_PCT = 30


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``hashes`` (one hash per window, in order)."""

    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(positions, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda x, k: F.struct(x.alias("h"), k.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, twice), covered))


def distinct_rate(words: Column, block: int = BLOCK) -> Column:
    """Mean distinct words per thousand over the text's blocks; the last block overlaps the one before so as to be full."""
    n = F.size(words)
    distinct = lambda first, length: F.size(F.array_distinct(F.slice(words, first, length)))
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.least(b * block, n - block) + 1)
    sums = F.aggregate(starts, F.lit(0).cast("long"), lambda a, first: a + distinct(first, F.lit(block)))
    whole = F.floor(1000 * F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)))
    return F.when(n <= block, whole).otherwise(F.floor(1000 * sums / (block * F.ceil(n / block)))).cast("long")


def with_metrics(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of ``docs`` as one struct), the contract's counts and the metrics, one row per row of ``docs``."""
    text = text_or_empty("doc.text")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    d = d.select("doc", F.expr(f"regexp_extract_all(coalesce(doc.text, ''), r'{WORD}', 0)").alias("words"))
    d = d.select("doc", "words", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    windows = F.transform(
        F.slice("wh", F.lit(1), F.greatest(F.size("wh") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(F.col("wh"), i + k) for k in range(1, WINDOW)]),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        "doc",
        "n_words",
        windows.alias("windows"),
        lines.alias("lines"),
        distinct_rate(F.col("wh")).alias("distinct_rate"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "doc", "n_words", "distinct_rate", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
    )
    beyond = lambda n, of, m: F.expr(f"{RATE} * greatest({n} - {FENCES[m][2]}, 0) div greatest({of}, 1)").alias(m)
    return d.select(
        "doc", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).alias("base_failed"),
        beyond("n_symbols", "word_chars", "symbol_rate"),
        beyond("n_dup_lines", "n_lines", "dup_line_rate"),
        beyond("n_repeat_words", "n_words", "repeat_rate"),
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_length"),
        "distinct_rate",
    )


def sketch(metrics: DataFrame, keys: list[str], names: Iterable[str] = (*METRICS, *SIZES)) -> DataFrame:
    """Mergeable quantile sketches: keys, metric, bin, n. Values below 2**BITS have a bin each."""
    bits = "length(bin(value))"
    stacked = ", ".join(f"'{m}', {m}" for m in names)
    long = metrics.select(*keys, F.expr(f"stack({len(list(names))}, {stacked}) AS (metric, value)"))
    bin_ = F.expr(f"CASE WHEN value < {1 << BITS} THEN value ELSE ({bits} - {BITS}) * {1 << BITS} + shiftright(value, {bits} - {BITS}) END").cast("long")
    return long.groupBy(*keys, "metric", bin_.alias("bin")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], percents=(TAIL, 50, 100 - TAIL)) -> DataFrame:
    """keys, metric, total, q15, q50, ...: the value of the smallest bin that holds the quantile's rank.

    A group's bins are bounded by the value range (128 for each power of two), so its window is small.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "metric")
    cum = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    s = sketches.withColumn("total", F.sum("n").over(w)).withColumn("cum", cum)
    value = F.expr("CASE WHEN bin < {0} THEN bin ELSE shiftleft(bin - (bin div {0}) * {0}, CAST(bin div {0} AS INT)) END".format(1 << BITS))
    return s.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(100 * F.col("cum") >= p * F.col("total"), value)).alias(f"q{p}") for p in percents],
    )


def thresholds(metrics: DataFrame, min_docs: int = MIN_DOCS, spreads: int = SPREADS) -> DataFrame:
    """lang, source and, for each metric, its lower and upper fence (null: none)."""
    by_source = materialize(sketch(metrics, ["lang", "source"]))
    by_lang = merge(by_source, ["lang"])
    names = ("total", f"q{TAIL}", "q50", f"q{100 - TAIL}")
    q = [quantiles(by_source, ["lang", "source"]), quantiles(by_lang, ["lang"]), quantiles(merge(by_lang, []), [])]
    q = [x.select(*[c for c in x.columns if c not in names], F.struct("total", F.col(names[1]).alias("low"), F.col("q50").alias("mid"), F.col(names[3]).alias("high")).alias(f"s{i}")) for i, x in enumerate(q)]
    s = q[0].join(q[1].withColumnsRenamed({"lang": "l", "metric": "m"}), F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).drop("l", "m")
    s = s.join(q[2], "metric")
    s = s.withColumn("s", F.when(F.col("s0.total") >= min_docs, F.col("s0")).when(F.col("s1.total") >= min_docs, F.col("s1")).otherwise(F.col("s2")))
    of = lambda name, part: F.max(F.when(F.col("metric") == name, F.col(f"s.{part}"))).alias(f"{name}_{part}")
    wide = s.groupBy("lang", "source").agg(*[of(m, p) for m in METRICS for p in ("low", "mid", "high")], *[of(z, "mid") for z in SIZES])
    out = []
    for m, (low, high, unit, size) in FENCES.items():
        grains = f"{EVENTS * RATE * unit} div greatest({size}_mid, 1)" if size else str(EVENTS * unit)
        least = F.expr(f"greatest({grains}, {EVENTS} * ({m}_mid div {1 << BITS - 1}))")
        if low:
            out.append((F.col(f"{m}_low") - F.greatest(spreads * (F.col(f"{m}_mid") - F.col(f"{m}_low")), least)).alias(f"{m}_least"))
        if high:
            out.append((F.col(f"{m}_high") + F.greatest(spreads * (F.col(f"{m}_high") - F.col(f"{m}_mid")), least)).alias(f"{m}_most"))
    return wide.select("lang", "source", *out)


def judged(metrics: DataFrame, min_docs: int = MIN_DOCS, spreads: int = SPREADS) -> DataFrame:
    """``metrics`` (read twice: give a materialised frame with lang and source) with ``kept``."""
    limits = materialize(thresholds(metrics, min_docs, spreads))
    good = ~F.col("base_failed")
    for m, (low, high, _, _) in FENCES.items():
        good = good & (F.col(m) >= F.col(f"{m}_least")) if low else good
        good = good & (F.col(m) <= F.col(f"{m}_most")) if high else good
    joined = sized_join(metrics, limits, ["lang", "source"])
    return joined.withColumn("kept", good).drop(*[c for c in limits.columns if c not in ("lang", "source")])


def quality_verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, spreads: int = SPREADS) -> DataFrame:
    """doc_id, the counts, the metrics, base_failed and kept; one row per document."""
    d = docs.select("doc_id", "text", "lang", "source")
    m = with_metrics(d).select("doc.doc_id", "doc.lang", "doc.source", *_OUT, "n_lines", *METRICS)
    return judged(materialize(m), min_docs, spreads).select("doc_id", *_OUT, "kept", *METRICS)


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_filter(docs: DataFrame, min_docs: int = MIN_DOCS, spreads: int = SPREADS) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    m = with_metrics(docs).select("doc", F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), "base_failed", *SIZES, *METRICS)
    kept = judged(materialize(m), min_docs, spreads).filter("kept")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def _fence_sql() -> tuple[str, str]:
    cols, tests = [], []
    of = lambda name, part: f"max(case when metric = '{name}' then {part} end)"
    for m, (low, high, unit, size) in FENCES.items():
        grains = f"{EVENTS * RATE * unit} // greatest({of(size, 'q50')}, 1)" if size else str(EVENTS * unit)
        least = f"greatest({grains}, {EVENTS} * ({of(m, 'q50')} // {1 << BITS - 1}))"
        if low:
            cols.append(f"{of(m, f'q{TAIL}')} - greatest({SPREADS} * ({of(m, 'q50')} - {of(m, f'q{TAIL}')}), {least}) as {m}_least")
            tests.append(f"{m} >= {m}_least")
        if high:
            cols.append(f"{of(m, f'q{100 - TAIL}')} + greatest({SPREADS} * ({of(m, f'q{100 - TAIL}')} - {of(m, 'q50')}), {least}) as {m}_most")
            tests.append(f"{m} <= {m}_most")
    return ", ".join(cols), " and ".join(tests)


def ctes_sql(source: str = "documents") -> str:
    """DuckDB CTEs that end in ``quality_judged``: the metrics of each row of ``source`` with base_failed and kept."""
    cols, tests = _fence_sql()
    long = " union all ".join(f"select lang, source, '{m}' as metric, {m} as value from q_rates" for m in (*METRICS, *SIZES))
    percents = (TAIL, 50, 100 - TAIL)
    level = lambda name, keys: f"""
{name}_c as (select {keys} metric, bin, sum(n) as n from q_sketch group by {keys} metric, bin),
{name}_w as (select *, sum(n) over (partition by {keys} metric) as total,
  sum(n) over (partition by {keys} metric order by bin rows unbounded preceding) as cum,
  case when bin < {1 << BITS} then bin else (bin % {1 << BITS}) << (bin // {1 << BITS})::int end as v from {name}_c),
{name} as (select {keys} metric, max(total) as total, {", ".join(f"min(case when 100 * cum >= {p} * total then v end) as q{p}" for p in percents)}
  from {name}_w group by {keys} metric)"""
    pick = lambda c: f"case when a.total >= {MIN_DOCS} then a.{c} when b.total >= {MIN_DOCS} then b.{c} else c.{c} end as {c}"
    return f"""
q_rows as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from {source}),
q_words as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from q_rows),
q_windows as (select rid, i, list_slice(words, i, i + {WINDOW - 1}) as w
  from (select rid, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from q_words)),
q_twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as n from q_windows) where n > 1),
q_repeat as (select rid, count(distinct i + k) as n_repeat_words from q_twice, range(0, {WINDOW}) as r(k) group by rid),
q_counts as (select rid, doc_id, lang, source, len(words)::bigint as n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (case when len(words) <= {BLOCK} then 1000 * len(list_distinct(words)) // greatest(len(words), 1)
    else 1000 * list_sum(list_transform(range(0, (len(words) - 1) // {BLOCK} + 1), lambda b: len(list_distinct(list_slice(words, least(b * {BLOCK}, len(words) - {BLOCK}) + 1, least(b * {BLOCK}, len(words) - {BLOCK}) + {BLOCK})))))
      // ({BLOCK} * ((len(words) - 1) // {BLOCK} + 1)) end)::bigint as distinct_rate
  from q_words left join q_repeat using (rid)),
q_rates as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words as base_failed,
  {RATE} * greatest(n_symbols - {FENCES["symbol_rate"][2]}, 0) // greatest(word_chars, 1) as symbol_rate,
  {RATE} * greatest(n_dup_lines - {FENCES["dup_line_rate"][2]}, 0) // greatest(n_lines, 1) as dup_line_rate,
  {RATE} * greatest(n_repeat_words - {FENCES["repeat_rate"][2]}, 0) // greatest(n_words, 1) as repeat_rate, 100 * word_chars // greatest(n_words, 1) as word_length from q_counts),
q_long as ({long}),
q_sketch as (select lang, source, metric, case when value < {1 << BITS} then value
  else (length(bin(value)) - {BITS}) * {1 << BITS} + (value >> (length(bin(value)) - {BITS})::int) end as bin, count(*) as n from q_long group by 1, 2, 3, 4),
{level("q_source", "lang, source,")},{level("q_lang", "lang,")},{level("q_all", "")},
q_picked as (select a.lang, a.source, a.metric, {", ".join(pick(f"q{p}") for p in percents)}
  from q_source a join q_lang b on a.metric = b.metric and a.lang is not distinct from b.lang join q_all c on a.metric = c.metric),
q_limits as (select lang as l, source as s, {cols} from q_picked group by 1, 2),
quality_judged as (select r.*, not base_failed and {tests} as kept from q_rates r
  join q_limits on r.lang is not distinct from l and r.source is not distinct from s)"""


ORACLE_SQL = f"""with {ctes_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
  {", ".join(METRICS)} from quality_judged"""
