"""Personal data: base patterns, and contexts that are bootstrapped from what they find.

Base entities (email, ip, card, phone) seed the search. Candidates are words with a digit or an at sign, and numbers
written with spaces. Lexical patterns are a candidate's shape with the word before it, with the word after it, and with
both; and, whatever the shape, the word before, the word after, both, the two before and the two after. Patterns and candidate
values form a graph that Spark scores in rounds, until none finds a new value: a pattern's confidence in a kind is the share of its distinct values
that are known to be of the kind, and a value's confidence is the noisy-or over its accepted patterns. Values above the
bar join the known ones; in the end every occurrence in an accepted pattern with a known value is reported unless it
touches a base span. Edges are distinct (pattern, value) pairs, so neither a common word nor a much-copied document
collects rows anywhere: all steps are partial counts and equi-joins. A value has ``MIN_LENGTH`` characters at least, those of
the shortest email; there is no upper bound, as long values and patterns are known by their hashes.

Spans are in code points, end exclusive. Nulls and odd input: a null text is empty and has no spans; repeated rows each
get their row; a null doc_id stays null; an empty table gives an empty result. Extra columns are kept by
``redacted_documents`` under any name. Texts with very many spans take time in proportion to their length: no pattern here
backtracks over more than one run, nor recurses; running sums and maxima go by blocks, and spans meet in sorted order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import let, materialize, sized_join, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Possessive and anchored forms of the base patterns; they match the same texts without retries inside a run.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_W = r"[^\x20\x09-\x0D]"
CANDIDATE = rf"(?<!{_W})(?={_W}*[0-9@]){_W}++"
#: Numbers written with spaces: number-like words with single spaces between, whole words but for closing punctuation.
_NUMBER = r"[0-9][0-9().-]*+"
_END = rf"(?=\p{{Punct}}*+(?!{_W}))"
RUN = rf"(?<!{_W})[+(]*+{_NUMBER}(?:\x20\(?+{_NUMBER}{_END})++"

#: Of the SQL, which is written out for so many rounds; rounds after the last that finds anything change nothing.
ROUNDS = 4
MIN_LENGTH = 5
#: Values and patterns longer than this are known by their hashes.
LONG = 64
#: Code points in a block of text, of which redacted texts are put together.
BLOCK = 256
MIN_SUPPORT = 5
PATTERN_CONFIDENCE = 0.8
VALUE_CONFIDENCE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return lambda v: F.length(_digits(v)).between(9, 15)
    return lambda v: F.lit(True)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 32, levels: int = 4) -> Column:
    """``op`` of each value of an array with all before it, by blocks, in time linear in the array's length."""

    def direct(vs: Column) -> Column:
        return F.transform(vs, lambda _, i: F.aggregate(F.slice(vs, F.lit(1), i + 1), zero, op))

    def blocks(vs: Column) -> Column:
        number = lambda i: F.floor(i / block).cast("int")
        totals = F.transform(F.sequence(F.lit(0), number(F.size(vs) - 1)), lambda b: F.aggregate(F.slice(vs, b * block + 1, F.lit(block)), zero, op))

        def inner(before: Column) -> Column:
            return F.transform(vs, lambda _, i: F.aggregate(F.slice(vs, number(i) * block + 1, i % block + 1), F.coalesce(F.get(before, number(i) - 1), zero), op))

        return let(running(totals, zero, op, block, levels - 1), inner)

    return let(values, lambda vs: F.when(F.size(vs) <= block, direct(vs)).otherwise(blocks(vs)) if levels else direct(vs))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, v, gap): offsets in code points, text, text before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def join(m: Column) -> Column:
        def spans(gaps: Column) -> Column:
            ends = running(F.transform(m, lambda v, i: F.length(v) + F.length(F.get(gaps, i))), F.lit(0), lambda a, x: a + x)
            return let(ends, lambda es: F.transform(m, lambda v, i: F.struct(
                (F.get(es, i) - F.length(v)).alias("s"), F.get(es, i).alias("e"), v.alias("v"),
                F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))))
        return let(between, spans)

    return let(found, join)


def _base(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    k = F.lit(KINDS.index(kind))
    valid = _valid(kind)
    spans = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda x: valid(x["v"])), lambda x: F.struct(k.alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    gate = F.contains(text, F.lit("@")) if kind == "email" else F.lit(True)
    return F.when(gate & text.rlike(PATTERNS[kind]), spans).otherwise(none)


def _short(c: Column) -> Column:
    return F.when(F.length(c) > LONG, F.sha2(c, 256)).otherwise(c)


def _candidates(text: Column) -> Column:
    """Candidates as structs: s, e (edge punctuation off), value, left, right (neighbour words, lower case), shape, left2, right2 and whole.

    They are words and, whole, numbers written with spaces. left2 and right2 are the two words on either side; they are
    null for words that are part of such a number.
    """
    space = lambda c: F.translate(c, "\x09\x0a\x0b\x0c\x0d", "     ")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))

    def two(c: Column, n: int) -> Column:
        return F.regexp_replace(F.substring_index(c, " ", n), r"^[\p{Punct}]+|[\p{Punct}]+$", "")

    def one(x: Column, part: Column, whole: bool) -> Column:
        lead = F.length(F.regexp_extract(x["v"], r"^[^\p{L}0-9@+]*", 0))
        value = F.regexp_replace(x["v"], r"^[^\p{L}0-9@+]+|[^\p{L}0-9]+$", "")
        before, after = F.rtrim(space(x["before"])), F.ltrim(space(x["after"]))
        return let(value, lambda v: F.struct(
            (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(v)).alias("e"), _short(F.lower(v)).alias("value"),
            bare(F.substring_index(before, " ", -1)).alias("left"),
            bare(F.substring_index(after, " ", 1)).alias("right"),
            F.regexp_replace(F.regexp_replace(F.lower(v), r"\p{L}+", "a"), "[0-9]+", "0").alias("shape"),
            F.when(~part, F.lower(two(before, -2))).alias("left2"), F.when(~part, F.lower(two(after, 2))).alias("right2"), F.lit(whole).alias("whole")))

    def words(m: Column) -> Column:
        number = lambda x: x["v"].rlike(rf"^\(?+{_NUMBER}\p{{Punct}}*$")
        open_ = lambda x: x["v"].rlike(rf"^[+(]*+{_NUMBER}$")
        joined = lambda i: F.coalesce((F.get(m, i)["before"] == " ") & number(F.get(m, i)) & open_(F.get(m, i - 1)), F.lit(False))
        return F.transform(m, lambda x, i: one(x, joined(i) | joined(i + 1), False))

    none = F.array().cast("array<struct<s:int,e:int,value:string,left:string,right:string,shape:string,left2:string,right2:string,whole:boolean>>")
    runs = F.when(text.rlike(RUN), F.transform(matches(text, RUN), lambda x: one(x, F.lit(False), True))).otherwise(none)
    found = F.filter(F.concat(let(matches(text, CANDIDATE), words), runs), lambda c: c["e"] - c["s"] >= MIN_LENGTH)
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``doc`` (the ``keep`` columns), ``base`` (spans by kind, then start) and ``found`` (candidates with their base kind or null)."""
    text = text_or_empty("text")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), text.alias("text"))
    d = d.select("doc", "text", F.concat(*[_base(F.col("text"), k) for k in KINDS]).alias("base"), _candidates(F.col("text")).alias("found"))

    # base spans by start and candidates by end, in one order: what a candidate overlaps starts before its end, and of each
    # kind it can only be the last, as spans of a kind do not overlap. A last span is a long: its end, then its start.
    names = ("s", "e", "value", "left", "right", "shape", "left2", "right2", "whole")
    span = "struct<s:int,e:int,value:string,left:string,right:string,shape:string,left2:string,right2:string,whole:boolean>"
    code = lambda b, k: F.when(b["k"] == k, F.shiftleft(b["e"].cast("long"), 32) + b["s"]).otherwise(-1).alias(f"k{k}")
    kinds = range(len(KINDS))
    starts = F.transform("base", lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("what"), F.lit(None).cast(span).alias("c"), *[code(b, k) for k in kinds]))
    stops = F.transform("found", lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("what"), c.alias("c"), *[F.lit(-1).cast("long").alias(f"k{k}") for k in kinds]))
    none = F.struct(*[F.lit(-1).cast("long").alias(f"k{k}") for k in kinds])

    def marked(order: Column) -> Column:
        last = running(F.transform(order, lambda x: F.struct(*[x[f"k{k}"].alias(f"k{k}") for k in kinds])), none, lambda a, x: F.struct(*[F.greatest(a[f"k{k}"], x[f"k{k}"]).alias(f"k{k}") for k in kinds]))

        def known(x: Column, seen: Column) -> Column:
            c = x["c"]
            over = lambda k: (seen[f"k{k}"] >= 0) & (F.shiftright(seen[f"k{k}"], 32) > c["s"])
            first = lambda of: F.coalesce(*[F.when(over(k), of(k)) for k in kinds])
            part = first(lambda k: seen[f"k{k}"])
            mixed = c["whole"] & ((part.bitwiseAND(F.lit(2**32 - 1)) > c["s"]) | (F.shiftright(part, 32) < c["e"]))
            return F.struct(*[c[n].alias(n) for n in names], first(F.lit).alias("k"), F.coalesce(mixed, F.lit(False)).alias("mixed"))

        return let(last, lambda seen: F.transform(F.filter(F.transform(order, lambda x, i: F.struct(x["what"].alias("what"), known(x, F.get(seen, i)).alias("c"))), lambda x: x["what"] == 0), lambda x: x["c"]))

    alone = F.transform("found", lambda c: F.struct(*[c[n].alias(n) for n in names], F.lit(None).cast("int").alias("k"), F.lit(False).alias("mixed")))
    both = let(F.array_sort(F.concat(starts, stops)), marked)
    # numbers with spaces that are a base span and more are no candidates
    return d.select("doc", "base", F.filter(F.when(F.size("base") == 0, alone).otherwise(both), lambda c: ~c["mixed"]).alias("found"))


def discover(scanned: DataFrame, rounds: int | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """rid, k, s, e: occurrences that confident patterns add to the base spans of ``scanned`` (with rid; materialised).

    Rounds go on until none finds a new value, or for ``rounds`` of them.
    """
    occ = scanned.select("rid", F.explode("found").alias("o")).select("rid", "o.*")
    left, right = F.col("left") != "", F.col("right") != ""
    shaped = lambda test, *parts: F.when(~F.col("whole") & test, F.concat_ws(" ", *parts))
    free = lambda test, *parts: F.when(F.col("left2").isNotNull() & test, F.concat_ws(" ", *parts))
    patterns = F.array(
        shaped(left, F.lit("L"), "left", "shape"),
        shaped(right, F.lit("R"), "right", "shape"),
        shaped(left & right, F.lit("B"), "left", "shape", "right"),
        free(left, F.lit("l"), "left"),
        free(right, F.lit("r"), "right"),
        free(left & right, F.lit("b"), "left", "right"),
        free(F.col("left2").contains(" "), F.lit("ll"), "left2"),
        free(F.col("right2").contains(" "), F.lit("rr"), "right2"),
    )
    occ = occ.withColumn("pattern", F.explode(F.transform(F.array_compact(patterns), _short)))
    edges = materialize(occ.groupBy("pattern", "value").agg(F.min("k").alias("k")))
    known = materialize(edges.filter("k is not null").groupBy("value").agg(F.min("k").alias("kind")))
    totals = materialize(edges.groupBy("pattern").agg(F.count("*").alias("total")).filter(F.col("total") >= min_support))
    edges, done = edges.select("pattern", "value"), 0
    while True:
        # what is known grows by each round, so that patterns short of seeds can be accepted later; values keep their kind
        support = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
        accepted = support.join(totals, "pattern").withColumn("confidence", F.col("n") / (F.col("total") + 1)).filter(F.col("confidence") >= PATTERN_CONFIDENCE)
        accepted = materialize(accepted.select("pattern", "kind", "confidence"))
        if done == rounds:
            break
        votes = edges.join(accepted, "pattern").join(known.select("value"), "value", "left_anti").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("confidence"))
        votes = votes.filter(F.col("confidence") >= VALUE_CONFIDENCE).groupBy("value").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        new = materialize(votes)
        if not new.limit(1).count():
            break
        known, done = materialize(known.unionByName(new)), done + 1
    fresh = occ.filter("k is null").join(accepted.select("pattern", "kind"), "pattern").join(known.withColumnRenamed("kind", "of"), "value").filter("kind = of")
    return fresh.select("rid", F.col("kind").alias("k"), "s", "e").distinct()


def find(docs: DataFrame, keep: list[str], rounds: int | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``doc``, ``base`` and ``spans`` (base and discovered, by kind, then start); one row per row of ``docs``."""
    s = materialize(scan(docs, keep).withColumn("rid", F.monotonically_increasing_id()))
    extra = discover(s.select("rid", "found"), rounds, min_support).groupBy("rid").agg(F.collect_list(F.struct("k", "s", "e")).alias("extra"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")

    def outer(sp: Column) -> Column:  # in order of start, the longest first, a span that ends no later than one before lies inside it
        reach = running(F.transform(sp, lambda x: -x["ne"]), F.lit(-1), lambda a, x: F.greatest(a, x))
        return let(reach, lambda r: F.filter(sp, lambda x, i: (i == 0) | (F.get(r, i - 1) < -x["ne"])))

    ordered = F.array_sort(F.transform("extra", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["k"].alias("k"))))
    extra = extra.withColumn("extra", F.transform(let(ordered, outer), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["ne"]).alias("e"))))
    return sized_join(s, materialize(extra), ["rid"]).select("doc", "base", F.sort_array(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def _said(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def personal_data(docs: DataFrame, rounds: int | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id, n_<kind> (base counts), base_sha256, spans; one row per document."""
    f = find(docs, ["doc_id"], rounds, min_support)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return f.select("doc.doc_id", *[count(k) for k in KINDS], F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redacted_documents(docs: DataFrame, rounds: int | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets and n_chars set anew; the columns of ``docs``.

    Where spans of several kinds overlap, the one that starts first (then the longest) is replaced and the rest of the
    others with it.
    """
    f = find(docs, docs.columns, rounds, min_support)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # merged spans in order: each takes over what overlaps it
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["k"].alias("k"))))

    def covered(sp: Column) -> Column:
        # a span is inside or overlapped if an earlier one ends after its start
        reach = running(F.transform(sp, lambda x: -x["ne"]), F.lit(-1), lambda a, x: F.greatest(a, x))
        return let(reach, lambda r: F.transform(sp, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.coalesce(F.get(r, i - 1), F.lit(0)).alias("reach"), F.get(r, i).alias("upto"))))

    text = F.col("doc.text")

    def rebuilt(sp: Column) -> Column:
        number = lambda i: F.floor(i / BLOCK).cast("int")

        def put(blocks: Column) -> Column:
            def part(a: Column, z: Column) -> Column:  # code points a to z, from the blocks that hold them
                held = F.array_join(F.slice(blocks, number(a) + 1, number(z - 1) - number(a) + 1), "")
                return F.when(z > a, F.substring(held, a % BLOCK + 1, z - a)).otherwise("")

            # every span drops its own text beyond what earlier spans reach; only spans that start a group leave a mark
            marks = F.transform(sp, lambda x: F.when(x["s"] >= x["reach"], F.concat(part(x["reach"], x["s"]), F.get(names, x["k"]))).otherwise(""))
            return F.concat(F.array_join(marks, ""), part(F.get(sp, F.size(sp) - 1)["upto"], F.length(text)))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), put)

    clean = F.when(F.size("spans") == 0, text).otherwise(let(let(ordered, covered), rebuilt))
    d = f.select("doc", clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return d.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def oracle_sql(rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> str:
    """DuckDB SQL of ``personal_data`` over ``documents``; its patterns are the plain forms."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda i: case when i % 2 = 0 then d_at(i) else 2 * d_at(i) - case when d_at(i) > 4 then 9 else 0 end end)) % 10 = 0"
    luhn = luhn.replace("d_at(i)", f"substr({digits}, len({digits}) - i, 1)::int")
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda x: x::hugeint > 255)) = 0",
        "card": f"len({digits}) between 13 and 19 and {luhn}", "phone": f"len({digits}) between 9 and 15",
    }
    spans = " union all ".join(
        f"select rid, {k} as k, s, e from (select rid, m as v, sum(len(m) + len(g)) over (partition by rid order by i) as e, sum(len(m) + len(g)) over (partition by rid order by i) - len(m) as s "
        f"from (select rid, unnest(regexp_extract_all(text, '{p}')) as m, unnest(string_split_regex(text, '{p}')[:-2]) as g, unnest(range(1, 1 + len(regexp_extract_all(text, '{p}')))) as i from t where regexp_matches(text, '{p}'))) where {valid[kind]}"
        for k, (kind, p) in enumerate(plain.items()))
    c = r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"
    steps, known = "", "seeds"
    for r in range(rounds + 1):
        steps += f""",
acc{r} as (select pattern, kind, n / (total + 1) as confidence from (select pattern, kind, count(*) as n from edges join {known} using (value) group by 1, 2 having count(*) >= {min_support})
  join totals using (pattern) where n / (total + 1) >= {PATTERN_CONFIDENCE})"""
        if r < rounds:
            steps += f""",
vote{r} as (select value, arg_max(kind, (c, -kind)) as kind from (select value, kind, 1 - exp(sum(ln(1 - confidence))) as c from edges join acc{r} using (pattern) group by 1, 2)
  where c >= {VALUE_CONFIDENCE} and value not in (select value from {known}) group by 1),
known{r} as (select * from {known} union all select * from vote{r})"""
            known = f"known{r}"
    bare = lambda x: f"lower(regexp_replace({x}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))"
    some = lambda x, n: f"array_to_string(list_slice(string_split({x}, ' '), {n}), ' ')"
    space = lambda x: f"translate({x}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    short = lambda x: f"case when len({x}) > {LONG} then sha256({x}) else {x} end"
    number = "[0-9][0-9().-]*"
    context = lambda part: f"""{bare(some("b", "-1, 99999999"))} as l, {bare(some("a", "1, 1"))} as r,
  case when not ({part}) then {bare(some("b", "greatest(-2, -len(string_split(b, ' '))), 99999999"))} end as l2, case when not ({part}) then {bare(some("a", "1, 2"))} end as r2"""
    strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^[^\p{{L}}0-9@+]+', ''), '[^\p{{L}}0-9]+$', '')"
    lead = lambda x: rf"len(regexp_extract({x}, '^[^\p{{L}}0-9@+]*'))"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    said = lambda frm: f"select rid, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by k, s, e) as said, count(*) as n from {frm} group by 1"
    kinds = [
        ("not whole and l <> ''", "'L ' || l || ' ' || shape"), ("not whole and r <> ''", "'R ' || r || ' ' || shape"),
        ("not whole and l <> '' and r <> ''", "'B ' || l || ' ' || shape || ' ' || r"), ("l2 is not null and l <> ''", "'l ' || l"), ("l2 is not null and r <> ''", "'r ' || r"),
        ("l2 is not null and l <> '' and r <> ''", "'b ' || l || ' ' || r"), ("contains(l2, ' ')", "'ll ' || l2"), ("contains(r2, ' ')", "'rr ' || r2"),
    ]
    occurrences = " union all ".join(f"select *, {p} as p from marked where {test}" for test, p in kinds)
    return f"""with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as ({spans}),
split as (select rid, text, regexp_extract_all(text, '{c}') as m, string_split_regex(text, '{c}') as g from t where regexp_matches(text, '[0-9@]')),
parts as (select rid, text, unnest(range(1, len(m) + 1)) as i, unnest(m) as v, unnest(g[:-2]) as before, unnest(g[2:]) as after from split),
words as (select *, (sum(len(v) + len(before)) over (partition by rid order by i))::bigint as e, (sum(len(v) + len(before)) over (partition by rid order by i))::bigint - len(v) as s,
  before = ' ' and regexp_matches(v, '^\\(?{number}[[:punct:]]*$') and coalesce(regexp_matches(lag(v) over (partition by rid order by i), '^[+(]*{number}$'), false) as joined from parts),
linked as (select *, coalesce(lead(joined) over (partition by rid order by i), false) as joins, sum(case when joined then 0 else 1 end) over (partition by rid order by i) as island from words),
runs as (select rid, any_value(text) as text, min(s) as s, max(s) + arg_max(len(regexp_extract(v, '^[+(]*{number}')), s) as e from linked group by rid, island having count(*) > 1),
around as (select rid, s, substr(text, s + 1, e - s) as v, substr(text, coalesce(lag(e) over o, 0) + 1, s - coalesce(lag(e) over o, 0)) as before,
  substr(text, e + 1, coalesce(lead(s) over o, len(text)) - e) as after from runs window o as (partition by rid order by s)),
near as (select rid, s, v, false as whole, joined or joins as part, rtrim({space("before")}, ' ') as b, ltrim({space("after")}, ' ') as a from linked
  union all select rid, s, v, true, false, rtrim({space("before")}, ' '), ltrim({space("after")}, ' ') from around),
cand as (select rid, s + {lead("v")} as s, s + {lead("v")} + len({strip("v")}) as e, lower({strip("v")}) as whole_value, whole, {context("part")} from near where len({strip("v")}) >= {MIN_LENGTH}),
over as (select *, (select min(k) from base b where b.rid = c.rid and b.s < c.e and b.e > c.s) as k from cand c),
marked as (select *, {short("whole_value")} as value, regexp_replace(regexp_replace(whole_value, '\\p{{L}}+', 'a', 'g'), '[0-9]+', '0', 'g') as shape from over o
  where not (whole and exists (select 1 from base b where b.rid = o.rid and b.k = o.k and b.s < o.e and b.e > o.s and (b.s > o.s or b.e < o.e)))),
occ as (select *, {short("p")} as pattern from ({occurrences})),
alledges as (select pattern, value, min(k) as k from occ group by 1, 2),
seeds as (select value, min(k) as kind from alledges where k is not null group by 1),
totals as (select pattern, count(*) as total from alledges group by 1 having count(*) >= {min_support}),
edges as (select pattern, value from alledges join totals using (pattern)){steps},
extra as (select distinct rid, kind as k, s, e from occ join acc{rounds} using (pattern) join {known} using (value, kind) where k is null),
spans as (select rid, k, s, e from base union all select rid, k, s, e from extra x where not exists (select 1 from extra y where y.rid = x.rid and y.s <= x.s and y.e >= x.e and (y.s < x.s or y.e > x.e))),
b as ({said('base')}), a as ({said('spans')})
select doc_id, {", ".join(f"(select count(*) from base x where x.rid = t.rid and k = {i}) as n_{k}" for i, k in enumerate(KINDS))}, sha256(coalesce(b.said, '')) as base_sha256,
  coalesce(a.said, '') as spans, coalesce(a.n, 0) - coalesce(b.n, 0) as n_added from t left join b using (rid) left join a using (rid)"""


ORACLE_SQL = oracle_sql()
