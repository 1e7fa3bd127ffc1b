"""Secrets by pattern, with a trigram inverted index that says where to look; SQL only."""

import re._constants as rx
import re._parser as regex_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import fresh, saved


def _either_case(word: str) -> str:
    """Not ``(?i)``: what else counts as an equal letter differs between regex engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either_case, ["password", "passwd", "secret", "token"]), f"{_either_case('api')}_?{_either_case('key')}"])


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose ``group`` is too short are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The order is that of spans with one start. The first three are the fixed base rules.
RULES = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
    Rule("hosting", "(?:gho|ghp|ghs|ghu)_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abp]-[A-Za-z0-9-]+", 0, 20),
    Rule("private", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----"),
    # The header has a bound, else a run of beginnings without a dot is read to its end from each.
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{1,200}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = 3
#: Documents of one block of the index.
BLOCK = 4096
#: Candidates (8 bytes each, with the numbers of their rules) that are sent to every executor;
#: more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
_MOST_ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Trigrams (lower case) that every match contains: one of the sets, all of its members.

    None if some match may have no known trigram. Each alternative of the pattern becomes a
    list of literal runs with gaps (None) between them.
    """

    def one(op, value) -> list[list]:
        if op is rx.LITERAL:
            return [[chr(value).lower()]]
        if op is rx.IN:
            literal = {chr(v).lower() if o is rx.LITERAL else None for o, v in value}
            return [[literal.pop()]] if len(literal) == 1 else [[None]]
        if op is rx.BRANCH:
            return [alternative for branch in value[1] for alternative in several(branch)]
        if op is rx.SUBPATTERN:
            return several(value[3])
        if op is rx.MAX_REPEAT:
            low, high, body = value
            inside = several(body)
            if (low, high) == (0, 1) and len(inside) == 1 and None not in inside[0]:
                return [[], *inside]
            start = several([item for _ in range(min(low, 8)) for item in body])
            return start if low == high <= 8 else [[*a, None] for a in start]
        return [[None]]

    def several(items) -> list[list]:
        found: list[list] = [[]]
        for op, value in items:
            found = [[*a, *b] for a in found for b in one(op, value)]
            if len(found) > _MOST_ALTERNATIVES:
                found = [[None]]
        return found

    sets = set()
    for alternative in several(regex_parser.parse(pattern)):
        runs = "".join("\n" if part is None else part for part in alternative).split("\n")
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return None
        sets.add(grams)
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _queries(rules) -> dict[int, list[frozenset[str]]]:
    return {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}


def build_index(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(block, gram, posting)``: hashed ids of the rows whose lower-cased text has the trigram.

    Only the trigrams that some rule asks for are indexed. Ids are hashed, so that any type
    of id, null included, can be looked up; two ids with one hash share their candidates.
    """
    blocks = max(1, docs.count() // BLOCK)
    listed = ", ".join(map(_text, grams))
    key = F.xxhash64(id_col)
    found = docs.select(key.alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).selectExpr(
        "key", f"explode(filter(array({listed}), g -> contains(t, g))) AS gram"
    )
    return found.groupBy(F.expr(f"pmod(key, {blocks})").alias("block"), "gram").agg(
        F.collect_set("key").alias("posting")
    )


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, rules)``: hashed ids and the numbers of the rules that may match there."""
    queries = _queries(rules)
    grams = sorted({g for query in queries.values() for s in query for g in s})
    index = build_index(docs, grams, id_col, text_col)
    blocks = index.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("gram", "posting"))).alias("postings")
    )

    def posting(gram: str) -> str:
        return f"coalesce(postings[{_text(gram)}], array())"

    def matches(query: list[frozenset[str]]) -> str:
        every = [reduce(lambda a, b: f"array_intersect({a}, {b})", map(posting, sorted(s))) for s in query]
        return reduce(lambda a, b: f"array_union({a}, {b})", every)

    lists = ", ".join(f"named_struct('rule', {n}, 'keys', {matches(q)})" for n, q in queries.items())
    found = blocks.selectExpr(f"inline(array({lists}))").selectExpr("rule", "explode(keys) AS key")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, number: int) -> str:
    """SQL: the spans of one rule in ``t``, from the lengths of the matches and of what is between."""
    pattern = _text(rule.pattern)
    pieces = (
        f"zip_with(split(t, {pattern}, -1), arrays_zip(regexp_extract_all(t, {pattern}, 0), regexp_extract_all(t, {pattern}, {rule.group})),"
        " (p, z) -> named_struct('p', length(p), 'm', coalesce(length(z.`0`), 0), 'g', length(z.`1`)))"
    )
    empty = "cast(array() AS array<struct<s:int,k:int,e:int>>)"
    span = f"named_struct('s', a.at + z.p, 'k', {number}, 'e', a.at + z.p + z.m)"
    return (
        f"aggregate({pieces}, named_struct('at', 0, 'out', {empty}),"
        f" (a, z) -> named_struct('at', a.at + z.p + z.m, 'out',"
        f" if(z.g >= {rule.least}, concat(a.out, array({span})), a.out)), a -> a.out)"
    )


def with_spans(
    docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with an array of spans ``(s, k, e)``: start, number of the rule, end.

    Positions are code points, the end exclusive; spans are sorted. Rules with mandatory
    trigrams are tried only in the rows the index names, the others in all. Returns the frame
    and the name of the new column.

    Null texts are empty. Null and repeated ids share their candidates and are verified row by
    row. An empty table gives an empty result; other columns pass through.
    """
    queries = _queries(rules)
    spans, t, key, wanted = fresh(docs, "spans", "t", "key", "rules")
    hits = saved(candidates(docs, rules, id_col, text_col).withColumnsRenamed({"key": key, "rules": wanted}), "candidates")
    if hits.count() <= MAX_BROADCAST:
        hits = F.broadcast(hits)
    keyed = docs.withColumns({key: F.xxhash64(id_col), t: F.coalesce(F.col(text_col), F.lit(""))})
    joined = keyed.join(hits, key, "left")
    none = "cast(array() AS array<struct<s:int,k:int,e:int>>)"
    parts = []
    for n, rule in enumerate(rules):
        when = f"array_contains(`{wanted}`, {n})" if n in queries else f"`{t}` rlike {_text(rule.pattern)}"
        body = f"transform(array(`{t}`), t -> {_spans(rule, n)})[0]"
        parts.append(f"if(coalesce({when}, false), {body}, {none})")
    found = joined.withColumn(spans, F.expr(f"sort_array(concat({', '.join(parts)}))"))
    return found.select(*docs.columns, spans), spans


def secret_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    ``spans`` lists kind:start:end of all rules, ``base_sha256`` is the hash of such a list of
    the first three. See :func:`with_spans` for nulls, repeated rows and empty tables.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, spans = with_spans(plain, rules)
    names = ", ".join(_text(r.kind) for r in rules)

    def listed(source: str) -> str:
        return f"array_join(transform({source}, x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')"

    counts = [f"cast(size(filter({spans}, x -> x.k = {n})) AS long) AS n_{rules[n].kind}" for n in range(BASE)]
    return found.selectExpr(
        "doc_id", *counts,
        f"sha2({listed(f'filter({spans}, x -> x.k < {BASE})')}, 256) AS base_sha256",
        f"{listed(spans)} AS spans",
    )


def redact_secrets(
    docs: DataFrame, mark: str = "[SECRET]", rules=RULES, id_col: str = "doc_id", text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; spans that overlap become one mark.

    Every row stays. ``length_col`` is set to the new length in code points where the text
    changed. Texts without secrets, null ones included, stay as they are.
    """
    found, spans = with_spans(docs, rules, id_col, text_col)
    text = f"`{text_col}`"
    # Spans ascend by start: text before the span if it begins after all earlier ones end.
    step = (
        "(a, x) -> named_struct('at', greatest(a.at, x.e), 'out', concat(a.out, if(x.s >= a.at,"
        f" concat(substring({text}, a.at + 1, x.s - a.at), {_text(mark)}), '')))"
    )
    cut = f"aggregate({spans}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    changed = f"size({spans}) > 0"
    columns = {text_col: f"if({changed}, {cut}, {text})"}
    if length_col is not None:
        columns[length_col] = f"if({changed}, length({cut}), `{length_col}`)"
    kinds = dict(docs.dtypes)
    return found.selectExpr(
        *[f"cast({columns[c]} AS {kinds[c]}) AS `{c}`" if c in columns else f"`{c}`" for c in docs.columns]
    )


def oracle_sql(rules=RULES) -> str:
    """The query :func:`secret_spans` as DuckDB SQL."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    scans = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS k, {quoted(r.kind)} AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS p,"
        f" regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d"
        for n, r in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
scans AS ({scans}),
hits AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM scans WHERE len(m) > 0),
placed AS (
  SELECT doc_id, k, kind, length(m[i]) AS size,
    list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM hits WHERE length(g[i]) >= least),
spans AS (SELECT doc_id, k, kind, cast(s AS bigint) AS s, cast(s + size AS bigint) AS e FROM placed)
SELECT d.doc_id,
  count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {BASE}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""
