"""Secret scan by a trigram inverted index, with DataFrame functions only.

Each rule's regex is read once on the driver and turned into a Boolean query over trigrams: an OR
of ANDs of the trigrams that every match must contain (letters of either case are folded). The
documents' postings for the trigrams that occur in any query are read off each text in one pass and
intersected by one aggregation, which leaves the candidates of each rule; only those are verified
with the regex. A rule from which no mandatory trigram follows is run over every text.

Verification gives spans in code points, end exclusive. ``split`` returns what lies between the
matches and ``regexp_extract_all`` the matches, so that running sums of their lengths are the
positions. Both run once a text, and the sums take time in proportion to the number of matches.

Defined cases: a null text counts as empty and has no spans; rows with the same id share their
candidate rules, which can only add work; a null id is a value like any other; extra columns pass
through. Kinds ``github`` and ``pem`` are added to the three base kinds and change none of them.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, unused

NAME = "op7_secrets"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than
    ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Any longer run of the class starts where the whole run starts, so {24,} finds what + and the length test find.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, base=False),
)

#: A part of a regex that stands for more strings than this counts as "anything".
MOST_STRINGS = 64

#: Elements summed one by one within a running sum; it changes the time, never the result.
CHUNK = 32


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that each match contains; None: no such query."""
    options: list[set[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        found = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings}
        if strings and all(found):
            options.append({f for f in found if not any(g < f for g in found)})  # A or (A and B) is A

    def strings(node) -> set[str] | None:
        """All strings of a node if they are few."""
        kind, arg = str(node[0]), node[1]
        if kind == "LITERAL":
            return {chr(arg).lower()}
        if kind == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            own = {chr(c).lower() for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
            return own if len(own) <= 8 else None
        if kind == "SUBPATTERN":
            return joined(arg[3])
        if kind == "BRANCH":
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind == "MAX_REPEAT" and arg[1] <= 1:
            inner = joined(arg[2])
            return inner and (inner | {""} if arg[0] == 0 else inner)
        return None

    def joined(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            s = strings(n)
            if s is None or len(out) * len(s) > MOST_STRINGS:
                return None
            out = {a + b for a, b in itertools.product(out, s)}
        return out

    def walk(nodes) -> None:
        run = {""}
        for n in nodes:
            s = strings(n)
            if s is not None and len(run) * len(s) <= MOST_STRINGS:
                run = {a + b for a, b in itertools.product(run, s)}
                continue
            close(run)
            run = {""}
            if s is not None:
                run = s
            elif str(n[0]) == "SUBPATTERN":
                walk(n[1][3])
            elif str(n[0]) == "MAX_REPEAT" and n[1][0] >= 1:
                walk(n[1][2])
        close(run)

    walk(regex_parser.parse(pattern))
    return max(options, key=lambda o: min(map(len, o)), default=None)


def candidates(df: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """(id, kinds): the rules whose trigram query a document's postings satisfy."""
    clauses = [(r.kind, i, tuple(sorted(c))) for r in rules for i, c in enumerate(sorted(trigram_query(r.pattern) or (), key=sorted))]
    grams = sorted({t for _, _, c in clauses for t in c})
    # A lookahead takes no characters, so trigrams that overlap are all found.
    tails = {h: "|".join(re.escape(t[1:]) for t in grams if t[0] == h) for h in sorted({t[0] for t in grams})}
    any_gram = "(?=(" + "|".join(f"{re.escape(h)}(?:{rest})" for h, rest in tails.items()) + "))"
    postings = df.select(
        F.col(id_col).alias("id"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(any_gram), F.lit(1)))).alias("gram"),
    )
    wanted = df.sparkSession.createDataFrame([(k, i, t, len(c)) for k, i, c in clauses for t in c], "kind string, clause int, gram string, size int")
    met = postings.join(F.broadcast(wanted), "gram").groupBy("id", "kind", "clause", "size").agg(F.count_distinct("gram").alias("n"))
    return met.where("n = size").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` reads it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column, levels: int = 4) -> Column:
    """The sums of the first 1, 2, ... elements, by chunks of chunks of ``CHUNK`` elements."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    first = lambda a, i: total(F.slice(a, 1, i + 1))
    if levels == 0:
        return F.transform(steps, lambda _, i: first(steps, i))
    last = F.floor(F.greatest(F.size(steps) - 1, F.lit(0)) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))

    def within(chunks: Column, totals: Column, sums: Column) -> Column:
        before = lambda c: F.get(sums, c) - F.get(totals, c)
        return F.flatten(F.transform(chunks, lambda chunk, c: F.transform(chunk, lambda _, i: before(c) + first(chunk, i))))

    return _let(chunks, lambda cs: _let(F.transform(cs, total), lambda ts: _let(_running(ts, levels - 1), lambda sums: within(cs, ts, sums))))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind, size>> of one rule."""
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)
    between = F.transform(F.split(text, rule.pattern), F.length)

    def placed(sizes: Column, own: Column, gaps: Column) -> Column:
        steps = F.transform(sizes, lambda _, i: F.get(gaps, i) + F.coalesce(F.get(sizes, i - 1), F.lit(0)))
        span = lambda start, i: F.struct(
            start.alias("start"),
            F.lit(order).alias("ord"),
            (start + F.get(sizes, i)).alias("end"),
            F.lit(rule.kind).alias("kind"),
            F.get(own, i).alias("size"),
        )
        return F.transform(_let(steps, lambda s: _running(s)), span)

    found = _let(lengths(0), lambda sizes: _let(between, lambda gaps: placed(sizes, sizes, gaps) if rule.group == 0 else _let(lengths(rule.group), lambda own: placed(sizes, own, gaps))))
    return F.filter(found, lambda s: s["size"] >= rule.least)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``df`` with ``secrets``: array<struct<start, ord, end, kind, size>> by start, then rule."""
    kinds, key = unused(df, "kinds"), unused(df, "key")
    found = candidates(df, id_col, text_col, rules).select(F.col("id").alias(key), F.col("kinds").alias(kinds))
    joined = df.join(found, F.col(id_col).eqNullSafe(F.col(key)), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,size:int>>")
    parts = []
    for order, rule in enumerate(rules):
        asked = F.rlike(text, F.lit(rule.pattern))
        if trigram_query(rule.pattern):
            asked = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) & asked
        parts.append(F.when(asked, _spans(text, rule, order)).otherwise(none))
    return joined.select(*(c for c in df.columns if c != "secrets"), F.array_sort(F.concat(*parts)).alias("secrets"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["ord"] < sum(r.base for r in RULES))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))


def _sql_spans(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, i, len(own[i]) AS size, len(whole[i]) AS length,
         list_sum(list_transform(between[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: len(x))), 0) AS start
  FROM (SELECT doc_id, whole, own, between, unnest(range(1, len(whole) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS whole, regexp_extract_all(text, '{p}', {rule.group}) AS own,
                     string_split_regex(text, '{p}') AS between
              FROM documents WHERE regexp_matches(text, '{p}')))
  WHERE len(own[i]) >= {rule.least}"""


ORACLE_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
written AS (
  SELECT doc_id, ord, kind, start, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start AS BIGINT) + length AS VARCHAR) AS span
  FROM spans),
grouped AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM written GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped g ON d.doc_id = g.doc_id
"""
