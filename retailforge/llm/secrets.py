"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: the
stretches that must stand in every match, each a choice of literal strings,
each string the conjunction of its trigrams.  The index lists, for the
trigrams that any rule asks for, the documents that hold them (ASCII letters
lower-cased).  Postings are intersected per string, united per stretch and
intersected over the stretches; candidates are verified with the expression
itself.  A rule without a mandatory trigram scans every document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as K
from re import _parser as P

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.llm.common import small_enough
from retailforge.session import stage


@dataclass(frozen=True)
class Rule:
    """``least``: fewest characters of group ``group`` of a match that counts."""

    name: str
    regex: str
    group: int = 0
    least: int = 0


# The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more are the runs of any length that pass the length test
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: alternatives that one stretch may have before it is split
CHOICES = 64
#: candidates up to this number are broadcast; more are joined by shuffle
BROADCAST_ROWS = 500_000


def _choices(op, arg) -> set[str] | None:
    """All strings that a node matches, or None if they are too many to list."""
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is K.LITERAL:
                out.add(chr(a).lower())
            elif o is K.RANGE and a[1] - a[0] < CHOICES:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, body = arg
        inner = _sequence(body)
        if inner is None or high is K.MAXREPEAT or high > 3:
            return None
        return {"".join(c) for n in range(low, high + 1) for c in itertools.product(sorted(inner), repeat=n)}
    return {""} if op is K.AT else None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = _choices(op, arg)
        if more is None or len(out) * len(more) > CHOICES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """AND over stretches of OR over strings of AND over trigrams; no stretch means that nothing is mandatory."""
    stretches: list[set[str]] = []

    def walk(nodes):
        run = {""}
        for op, arg in nodes:
            more = _choices(op, arg)
            if more is not None and len(run) * len(more) <= CHOICES:
                run = {a + b for a in run for b in more}
                continue
            stretches.append(run)
            run = more if more is not None else {""}
            if more is None and op is K.SUBPATTERN:
                walk(arg[-1])
            elif more is None and op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        stretches.append(run)

    walk(P.parse(regex))
    out = []
    for s in stretches:
        if all(len(x) >= 3 for x in s):
            strings = {frozenset(x[i:i + 3] for i in range(len(x) - 2)) for x in s}
            out.append({c for c in strings if not any(d < c for d in strings)})  # a string that asks for more adds nothing
    return out


def trigram_index(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings ``(trigram, k_id, k_text)``."""
    low = docs.select(F.col(f"`{id_col}`").alias("k_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("k_text"),
                      F.lower(F.col(f"`{text_col}`")).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select(F.explode(F.array_compact(held)).alias("trigram"), "k_id", "k_text")


def _terms(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The queries as a table: one row per rule, stretch, string and trigram."""
    rows = []
    for r in rules:
        query = trigram_query(r.regex)
        for s, stretch in enumerate(query):
            for c, grams in enumerate(sorted(sorted(g) for g in stretch)):
                rows += [(r.name, len(query), s, c, len(grams), g) for g in grams]
    return spark.createDataFrame(rows, "rule string, stretches int, stretch int, choice int, need int, trigram string")


def candidates(docs: DataFrame, id_col: str, text_col: str, rules: list[Rule]) -> DataFrame:
    """``k_id, k_text, rules``: documents whose trigrams satisfy some rule's query."""
    terms = _terms(docs.sparkSession, rules)
    grams = sorted({g for r in rules for s in trigram_query(r.regex) for c in s for g in c})
    postings = trigram_index(docs, id_col, text_col, grams).dropDuplicates(["trigram", "k_id", "k_text"])
    # the terms are a fixed small table of the rules
    strings = (postings.join(F.broadcast(terms), "trigram")
               .groupBy("k_id", "k_text", "rule", "stretches", "stretch", "choice", "need").agg(F.count("*").alias("held"))
               .where("held = need"))
    return (strings.groupBy("k_id", "k_text", "rule", "stretches").agg(F.countDistinct("stretch").alias("met"))
            .where("met = stretches").groupBy("k_id", "k_text").agg(F.collect_set("rule").alias("rules")))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Matches of a rule as (start, order, kind, end): the text between matches gives their places."""
    pattern = F.lit(rule.regex)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.arrays_zip(F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"), matches.alias("m"))
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,stop:long>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        good = F.length(F.regexp_extract(x["m"], rule.regex, rule.group)) >= rule.least
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.name).alias("kind"), stop.alias("stop"))
        return F.struct(F.coalesce(stop, acc["at"]).alias("at"),
                        F.when(x["m"].isNotNull() & good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add)["out"]
    return F.when(text.rlike(rule.regex), folded).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE,
         extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """``row, base_spans, all_spans``: per document the matches as (start, ord, kind, stop), sorted.

    Positions are code points, ends exclusive; matches of one rule do not
    overlap.  NULL and empty texts have no spans; repeated rows get equal
    results; an empty table gives no rows.  ``row`` holds all columns.
    """
    rules = [*base, *extra]
    indexed = [r for r in rules if trigram_query(r.regex)]
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    if indexed:
        found = stage(candidates(docs, id_col, text_col, indexed), "secret-candidates")
        right = F.broadcast(found) if small_enough(found, BROADCAST_ROWS) else found
        rows = rows.join(right, rows["id"].eqNullSafe(right["k_id"]) & (rows["hash"] == right["k_text"]), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,stop:long>>")
    names = {r.name for r in indexed}
    text = F.col("text")
    parts = []
    for i, r in enumerate(rules):
        wanted = F.array_contains("rules", r.name) if r.name in names else F.lit(True)
        parts.append(F.when(text.isNotNull() & F.coalesce(wanted, F.lit(False)), _spans(r, i, text)).otherwise(none).alias(f"s{i}"))
    rows = rows.select("row", *parts)
    some = [f"s{i}" for i in range(len(rules))]
    return rows.select("row", F.array_sort(F.concat(*some[:len(base)])).alias("base_spans"), F.array_sort(F.concat(*some)).alias("all_spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
