"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's expression a Boolean query over trigrams is derived: any text that the rule matches holds, in
lower case, all trigrams of one of the query's clauses. The index keeps postings (trigram -> document) for the
trigrams that rules ask for. Intersecting a clause's postings gives candidate documents, and only there is the
rule's expression run. A rule without mandatory trigrams is run on every text. A posting names its document by
doc_id and a 64-bit hash of the text, so repeated rows and null ids are no trouble: equal rows get equal spans.

Spans are code points, end exclusive; per rule leftmost and not overlapping, and matches that fail a rule's
length are dropped after matching. Null counts as empty. Base kinds come first, in the order of RULES, then
the kinds that this module adds.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import aside, discard, stored, table

#: Candidate documents that may be broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group


#: The base rules, then the added ones.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
)
BASE = ("assign", "access", "hex")

# ------------------------------------------------------------ trigram queries
#: A query is a set of clauses, a clause a set of trigrams: any clause, all of its trigrams. {frozenset()} is "any text".
Query = frozenset
ANY: Query = frozenset([frozenset()])
MANY = 64


def _least(q) -> Query:
    """Without clauses that another clause implies."""
    q = frozenset(q)
    return frozenset(c for c in q if not any(o < c for o in q))


def _both(a: Query, b: Query) -> Query:
    q = _least(x | y for x in a for y in b)
    return q if len(q) <= MANY else min(a, b, key=len)  # weaker, still sound


def _grams(strings: set[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(node) -> tuple[set[str] | None, Query]:
    """(all strings that the node matches, if they are few; the query of any of its matches)."""
    known: set[str] = {""}
    query, whole = ANY, True
    for op, arg in node:
        exact, sub = _item(op, arg)
        if exact is not None and len(known) * len(exact) <= MANY:
            known = {a + b for a in known for b in exact}
            continue
        query, whole = _both(query, _grams(known)), False
        if exact is not None:
            known = set(exact)
        else:
            query, known = _both(query, sub), {""}
    query = _both(query, _grams(known))
    return (known, query) if whole else (None, query)


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, ANY
        return None, ANY
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = set().union(*(e for e, _ in parts if e is not None)) if all(e is not None for e, _ in parts) else None
        return (exact if exact is not None and len(exact) <= MANY else None), _least(frozenset().union(*(q for _, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ANY
        if exact is not None and low == high == 1:
            return exact, query
        return None, query if low else ANY
    if op is sre.AT:
        return {""}, ANY
    return None, ANY  # classes, dots, look-around: nothing mandatory is claimed


def trigram_query(pattern: str) -> Query:
    return _walk(sre_parse.parse(pattern))[1]


# ------------------------------------------------------------ index


def _terms(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, str, int, int]], list[str]]:
    """Rows (kind, clause, trigram, bit, all bits) and the kinds without mandatory trigrams."""
    rows, free = [], []
    for r in rules:
        query = trigram_query(r.pattern)
        if frozenset() in query:
            free.append(r.kind)
            continue
        for k, clause in enumerate(sorted(map(sorted, query))):
            rows += [(r.kind, k, g, 1 << i, (1 << len(clause)) - 1) for i, g in enumerate(clause)]
    return rows, free


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_hash", F.xxhash64("_text"))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, _hash), one row for each of ``grams`` that a document holds in lower case."""
    low = keyed(docs).select("doc_id", "_hash", F.lower("_text").alias("_low"))
    held = low.select("doc_id", "_hash", F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams))).alias("_held"))
    return held.select(F.explode("_held").alias("gram"), "doc_id", "_hash").sortWithinPartitions("gram")


def candidates(index: DataFrame, terms: list[tuple[str, int, str, int, int]]) -> DataFrame:
    """(doc_id, _hash, _kinds): the rules whose query a document meets, by intersecting postings."""
    values = ", ".join(f"({_lit(k)}, {c}, {_lit(g)}, {b}L, {m}L)" for k, c, g, b, m in terms)
    query = index.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(kind, clause, gram, bit, bits)")  # as large as the rules
    met = index.join(F.broadcast(query), "gram").groupBy("doc_id", "_hash", "kind", "clause").agg(F.bit_or("bit").alias("got"), F.max("bits").alias("bits"))
    return met.where("got = bits").groupBy("doc_id", "_hash").agg(F.collect_set("kind").alias("_kinds"))


def rule_spans(rule: Rule, no: int) -> Column:
    """The rule's matches in _text as (start, kind number, end), by the lengths of what lies between them."""
    text, pattern = F.col("_text"), F.lit(rule.pattern)
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), measured.alias("part"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        one = F.array(F.struct(start.alias("start"), F.lit(no).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), spans).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row and column of ``docs``, and _spans: array of (start, kind number, end), sorted."""
    terms, free = _terms(rules)
    index = stored(postings(docs.select("doc_id", "text"), sorted({t[2] for t in terms})), "postings")
    met = stored(candidates(index, terms), "candidates").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_kinds")
    side = F.broadcast(met) if met.count() <= broadcast_rows else met
    discard(index)
    rows = keyed(docs).join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    each = [
        rule_spans(r, i) if r.kind in free else F.when(F.array_contains("_kinds", r.kind), rule_spans(r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return rows.select(*docs.columns, F.sort_array(F.concat(*each)).alias("_spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by ``mark``; n_chars follows the text."""
    docs, back = aside(docs, ("_text", "_hash", "_id", "_h", "_kinds", "_spans", "_clean"))
    found = scan(docs)

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    clean = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    hit = F.size("_spans") > 0
    out = found.withColumn("_clean", F.when(hit, clean).otherwise(F.col("text")))
    kept = [
        F.col("_clean").alias("text") if c == "text" else F.when(hit, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ]
    return back(out.select(*kept))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"] < len(BASE))
    of = lambda i: F.filter("_spans", lambda s: s["kind"] == i)
    count = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query's rows in DuckDB, by the same expressions on every text."""
    parts = []
    for no, r in enumerate(rules):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
        pattern = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT rid, {no} AS k, '{r.kind}' AS kind, g, m, p FROM (SELECT rid, regexp_split_to_array(t, {pattern}) AS g,
            regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS p FROM d WHERE regexp_matches(t, {pattern}))"""
        )
    least = "CASE k " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
u AS (SELECT rid, k, kind, g, m, p, unnest(generate_series(1, len(m))) AS i FROM r),
s AS (SELECT rid, k, kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a,
  length(m[i]) AS n, length(p[i]) AS c FROM u),
f AS (SELECT rid, k, kind, a, kind || ':' || a || ':' || (a + n) AS x FROM s WHERE c >= {least}),
j AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(x, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.rid = j.rid
"""
