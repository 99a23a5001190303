"""License detection by ordered signature rules, with DataFrame expressions only.

A rule runs on a text only when its keyword occurs there. All matches of all rules become
intervals; sorted by start, longest first, then by priority and rule order, an interval
inside one met earlier is suppressed unless its own priority is stronger. The labels of
what stays, together with those of the base phrases, describe the document.

Every signature is an expression with a constant pattern, so it is compiled once. Running sums and
maxima over the matches of a text go by blocks of ``BLOCK`` matches, as an array that grows by one
element is copied each time.

Edge cases: a null text counts as empty: no words, no labels, score 0. Repeated rows are
scanned alike; ties between equal intervals go to the stronger, then the earlier rule.
An empty table gives an empty result. Extra columns pass through under any name but those of the
outputs, which raise ValueError. Offsets count code points of the lower-cased text. A very long
text is scanned by one task, which holds its words and matches at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules
from .store import column, fence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.5
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

#: Matches to a block of the running sums.
BLOCK = 256
#: A keyword that many other words hold is looked for with what must surround it.
GATES = {"cc": r"\bcc[- \t\r\n]"}


def _matches(text: str, table: tuple[Rule, ...]) -> Column:
    """array<struct<n: rule, m: its matches>> of the rules that match."""
    by: dict[str, list[Column]] = {}
    for n, r in enumerate(table):
        by.setdefault(r.keyword, []).append(F.struct(F.lit(n).alias("n"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("m")))
    gate = lambda k: F.col(text).rlike(GATES[k]) if k in GATES else F.contains(F.col(text), F.lit(k))
    none = F.array().cast("array<struct<n: int, m: array<string>>>")
    groups = F.flatten(F.array(*(F.when(gate(k), F.array(*found)).otherwise(none) for k, found in by.items())))
    return F.filter(groups, lambda x: F.size(x["m"]) > 0)


def _running(array: str, start: str, state: str, step: str, out: str, emit: str) -> str:
    """SQL of an array with ``emit`` for each element y of ``array``, given the state s before it; ``step``
    is the state after it. Linear but for the copying inside blocks."""
    chunks = f"transform(sequence(0, (size(z.v) - 1) div {BLOCK}), c -> slice(z.v, c * {BLOCK} + 1, {BLOCK}))"
    before = f"aggregate(z.ch, struct({start} AS s, cast(array() AS array<{state}>) AS out), (a, c) -> struct(aggregate(c, a.s, (s, y) -> {step}) AS s, concat(a.out, array(a.s)) AS out), a -> a.out)"
    inner = f"aggregate(c, struct(z.be[i] AS s, cast(array() AS array<{out}>) AS out), (a, y) -> struct(transform(array(a.s), s -> {step})[0] AS s, concat(a.out, array(transform(array(a.s), s -> {emit})[0])) AS out), a -> a.out)"
    one = f"transform(array(struct({array} AS v)), z -> struct({chunks} AS ch))[0]"
    two = f"transform(array({one}), z -> struct(z.ch AS ch, {before} AS be))[0]"
    return f"transform(array({two}), z -> flatten(transform(z.ch, (c, i) -> {inner})))[0]"


# Of one rule's matches: the pieces between them give the offsets. A transform over an array of one
# struct binds what is used several times.
_STARTS = _running("transform(x.m, (w, k) -> length(x.p[k]) + CASE WHEN k > 0 THEN length(x.m[k - 1]) ELSE 0 END)", "0", "int", "s + y", "int", "s + y")
_SPANS = f"""transform(array(struct(h.n AS n, h.m AS m, split(t, patterns[h.n]) AS p)), x ->
  transform({_STARTS}, (b, k) -> struct(b AS start, -(b + length(x.m[k])) AS neg_end, priorities[x.n] AS priority, x.n AS n)))[0]"""
_FOUND = f"sort_array(flatten(transform(hits, h -> {_SPANS})))"

# e0, e1, e2: the farthest end met so far among intervals of priority 0, 1 and 2
_STATE = "struct<e0: int, e1: int, e2: int>"
_STEP = "struct(" + ", ".join(f"CASE WHEN y.priority = {k} THEN greatest(s.e{k}, -y.neg_end) ELSE s.e{k} END AS e{k}" for k in range(3)) + ")"
_STAYS = "-y.neg_end > CASE y.priority WHEN 0 THEN s.e0 WHEN 1 THEN greatest(s.e0, s.e1) ELSE greatest(s.e0, s.e1, s.e2) END"
_KEEP = _running("found", "struct(-1 AS e0, -1 AS e1, -1 AS e2)", _STATE, _STEP, "boolean", _STAYS)


def _places(phrase: str) -> str:
    """Starts of a phrase in words; the array is searched only where the first word occurs."""
    words = phrase.split()
    same = " AND ".join(f"coalesce(get(words, i + {k}) = '{w}', false)" for k, w in enumerate(words))
    return f"CASE WHEN size(words) >= {len(words)} AND contains(t, '{words[0]}') AND contains(t, '{words[-1]}') THEN filter(sequence(0, size(words) - {len(words)}), i -> {same}) ELSE cast(array() AS array<int>) END"


def scan(df: DataFrame, text: str = "text", table: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` with the base counts, the labels, a score and the detections' spans."""
    taken = {c.lower() for c in df.columns} & set(OUTPUTS)
    if taken:
        raise ValueError(f"output columns already exist: {sorted(taken)}")
    table = table or rules()
    # beside the row as a whole there are only names of this function, so none can clash
    step = df.select(F.struct(*(column(c) for c in df.columns)).alias("row"), F.translate(F.coalesce(column(text), F.lit("")), UPPER, LOWER).alias("t"))
    step = fence(step).select("row", "t", F.array_remove(F.split("t", NOT_WORD), "").alias("words"), _matches("t", table).alias("hits"))
    listed = lambda name, values: F.array(*(F.lit(v) for v in values)).alias(name)
    step = fence(step).select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        *(F.expr(_places(p)).alias(f"at{k}") for k, (p, _) in enumerate(PHRASES)),
        F.expr(_FOUND.replace("patterns[", _sql(r.pattern for r in table) + "[").replace("priorities[", _sql(r.priority for r in table) + "[")).alias("found"),
    )
    step = fence(step).withColumn("keep", F.expr(_KEEP))
    labels, scores = listed("labels", [r.label for r in table]), listed("scores", [r.score for r in table])
    kept = F.filter("found", lambda x, i: F.get("keep", i))
    detections = F.transform(kept, lambda x: F.struct(F.get(labels, x["n"]).alias("label"), x["start"].alias("start"), (-x["neg_end"]).alias("end"), F.get(scores, x["n"]).alias("score")))
    step = fence(step).select(
        "row",
        "n_words",
        F.concat(*(f"at{k}" for k in range(len(PHRASES)))).alias("at"),
        F.array_compact(F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)))).alias("base"),
        detections.alias("detections"),
    )
    step = fence(step)
    named = F.sort_array(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    best = F.array_max(F.concat(F.array(F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))), F.transform("detections", lambda d: d["score"])))
    return step.select(
        "row.*",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(named, ",").alias("labels"),
        best.alias("score"),
        "detections",
    )


def _sql(values) -> str:
    """SQL of a constant array."""
    quoted = ("r'" + v + "'" if isinstance(v, str) and "'" not in v else 'r"' + v + '"' if isinstance(v, str) else str(v) for v in values)
    return f"array({', '.join(quoted)})"


def oracle() -> str:
    """The registered query's result as DuckDB SQL."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    listed = ", ".join(f"({n}, {q(r.pattern)}, {r.priority}, {q(r.label)}, {r.score}::DOUBLE)" for n, r in enumerate(rules()))
    places = " UNION ALL ".join(
        f"SELECT r, i, {q(label)} AS label FROM (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM w WHERE list_contains(ws, {q(phrase.split()[0])})) WHERE "
        + " AND ".join(f"ws[i + {k + 1}] = {q(x)}" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    return f"""
WITH rules(n, pat, prio, label, score) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d),
p AS ({places}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM p GROUP BY r),
c AS (SELECT d.r, t, rules.* FROM d JOIN rules ON regexp_matches(t, pat)),
e AS (SELECT r, n, prio, label, score, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS s FROM c),
f AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM e),
g AS (SELECT r, n, prio, label, score, list_sum([length(x) for x in s[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS a, length(m[k]) AS len FROM f),
h AS (SELECT r, n, prio, label, score, a, a + len AS z FROM g),
kept AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.a <= h.a AND o.z >= h.z AND o.prio <= h.prio
  AND (o.a < h.a OR o.z > h.z OR o.prio < h.prio OR o.n < h.n))),
l AS (SELECT r, list(DISTINCT label) AS ls, max(score) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(l.ls, [])))), ',') AS labels,
  greatest(coalesce(l.score, 0), CASE WHEN b.r IS NULL THEN 0 ELSE {BASE_SCORE} END)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN l USING (r)"""
