"""The registered queries of the session engine and the SQL that states their results.

Each query runs one operator over all sessions of an adapter (see ``sources.adapters``);
``oracle`` holds the adapters' rows as DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import advice, compaction as K, lost as L, reports as R, tokens as T, waste as W
from ..operators import classify as C
from ..sources.adapters import conversation_messages, event_messages, table
from ..sources.shared import cut, shared_dir, spread
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EV = O.events()

# --- what fills a window ----------------------------------------------------------

_BUCKETS = """full_ AS (SELECT g.s, c.category, coalesce(t, 0) AS t, coalesce(n, 0) AS n, coalesce(est, false) AS est, c.ord FROM (SELECT DISTINCT s FROM part) g CROSS JOIN cats c
  LEFT JOIN (SELECT s, cat, sum(tok) AS t, sum(n) AS n, bool_or(est) AS est FROM part GROUP BY s, cat) p ON p.s = g.s AND p.cat = c.category)
SELECT s AS session_id, category, CAST(t AS BIGINT) AS tokens, CAST(n AS BIGINT) AS n_messages, CASE WHEN est THEN 'estimated' ELSE 'exact' END AS accuracy,
  CASE WHEN sum(t) OVER (PARTITION BY s) > 0 THEN CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY s) AS DOUBLE) * 100 ELSE 0.0 END AS percentage FROM full_"""


@query(f"WITH {O.CONV}, {O.CATS}, part AS (SELECT s, cat, tok, 1 AS n, true AS est FROM msg), {_BUCKETS}")
def context_breakdown(spark, d):
    return C.buckets(C.classify(conversation_messages(spark, d)))


@query(f"""WITH {EV}, {O.CATS}, part AS (SELECT s, cat, tok, 1 AS n, type <> 'assistant' AS est FROM msg UNION ALL SELECT DISTINCT s, 'tools', 9055, 0, true FROM msg
  UNION ALL SELECT DISTINCT s, 'system', 1200, 0, true FROM msg UNION ALL SELECT DISTINCT s, 'state', 300, 0, true FROM msg), {_BUCKETS}""")
def lifetime_breakdown(spark, d):
    m = event_messages(spark, d)
    return C.buckets(C.classify(m), C.config_overhead(m, prompt=1200, memory=300))


@query(f"""WITH {EV}, {O.EVENTS}, {O.CATS}, part AS (SELECT m.s, cat, tok, 1 AS n, type <> 'assistant' AS est FROM msg m JOIN st ON st.s = m.s AND idx >= start_idx), {_BUCKETS}""")
def current_context_breakdown(spark, d):
    m = event_messages(spark, d)
    return C.buckets(K.current_context(C.classify(m), K.compaction_events(m)))


@query(f"""WITH {EV}, r AS (SELECT *, CASE WHEN lag(cat) OVER w IS NOT DISTINCT FROM cat THEN 0 ELSE 1 END AS starts FROM msg WINDOW w AS (PARTITION BY s ORDER BY idx))
SELECT s AS session_id, idx, CAST(sum(tok) OVER w AS BIGINT) AS cumulative_tokens, last_value(tname IGNORE NULLS) OVER w AS last_tool, CAST(sum(starts) OVER w AS BIGINT) AS run,
  CAST(sum(tok) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM r WINDOW w AS (PARTITION BY s ORDER BY idx)""")
def timeline_in_blocks(spark, d):
    """Running sum, last tool, runs of one category and a look back over five rows, in blocks of eight rows of a session."""
    from ..operators import scan

    c = C.classify(event_messages(spark, d)).select("session_id", "idx", "tokens", "category", "tool_name")
    c = scan.running_sum(c, "tokens", "cumulative_tokens", 8)
    c = scan.islands(scan.last_value(c, "tool_name", "last_tool", 8), "category", "run", 8)
    return scan.moving_sum(c, "tokens", 5, "before", 8).select("session_id", "idx", "cumulative_tokens", "last_tool", F.col("run").cast("bigint").alias("run"), "before")


@query(f"""WITH {O.CONV} SELECT s AS session_id, idx, type, cat AS category, tok AS tokens, CAST(sum(tok) OVER (PARTITION BY s ORDER BY idx) AS BIGINT) AS cumulative_tokens,
  replace(substr(txt, 1, 60), chr(10), ' ') AS preview FROM msg""")
def message_timeline(spark, d):
    return C.classify(conversation_messages(spark, d)).select("session_id", "idx", "type", "category", "tokens", "cumulative_tokens", T.preview().alias("preview"))


@query(f"""WITH {EV} SELECT s AS session_id, idx, cat AS category, tname AS tool_name, tok AS tokens, CASE WHEN type = 'assistant' THEN 'exact' ELSE 'estimated' END AS accuracy,
  CAST(sum(tok) OVER (PARTITION BY s ORDER BY idx) AS BIGINT) AS cumulative_tokens FROM msg""")
def classified_events(spark, d):
    return C.classify(event_messages(spark, d)).select("session_id", "idx", "category", "tool_name", "tokens", "accuracy", "cumulative_tokens")


@query(f"""WITH {EV}, {O.EVENTS}, t AS (SELECT s, idx, tok, count(*) OVER (PARTITION BY s) AS n FROM msg), u AS (SELECT *, greatest(1, (n - 20) // 20) AS step FROM t)
SELECT s AS session_id, idx, tok AS tokens FROM u WHERE n <= 30 OR idx < 10 OR idx >= n - 10 OR (idx >= 10 AND idx < n - 10 AND (idx - 10) % step = 0 AND (idx - 10) // step < 20)
  OR EXISTS (SELECT 1 FROM ev WHERE ev.s = u.s AND ev.before_idx = u.idx)""")
def timeline_sampled(spark, d):
    m = event_messages(spark, d)
    return K.timeline_sample(C.classify(m), K.compaction_events(m), show_all=30, middle=20).select("session_id", "idx", "tokens")


@query(f"""SELECT doc_id, CAST(ceil(length(text) / CASE WHEN regexp_matches(text, '{O.CODE}') THEN 3.3::DOUBLE ELSE 4.0::DOUBLE END) AS BIGINT) AS tokens, regexp_matches(text, '{O.CODE}') AS is_code FROM documents""")
def token_estimate_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tokens_of(F.col("text")).alias("tokens"), X.looks_like_code(F.col("text")).alias("is_code"))


@query(f"WITH {O.CONV} SELECT s AS session_id, CAST(max(CASE WHEN type = 'user' THEN idx END) AS BIGINT) AS last_human FROM msg GROUP BY s")
def last_human_text(spark, d):
    return C.last_human_text(conversation_messages(spark, d))


@query(f"""WITH {O.CONV} SELECT s AS session_id, idx, contains(txt, ' the ') OR contains(txt, 'tion') AS has_state, contains(txt, ' de ') OR contains(txt, 'der') AS has_system FROM msg""")
def state_system_markers(spark, d):
    m = conversation_messages(spark, d)
    return m.select("session_id", "idx", C.has_markers((" the ", "tion"), thinking=True).alias("has_state"), C.has_markers((" de ", "der"), thinking=False).alias("has_system"))


# --- usage ------------------------------------------------------------------------

_EFF = "ef AS (SELECT m.s, arg_max(eff, idx) FILTER (type = 'assistant' AND model <> '<synthetic>' AND eff > 0 AND idx >= coalesce(start_idx, 0)) AS effective FROM msg m LEFT JOIN st ON st.s = m.s GROUP BY m.s)"
_SEG = """sg0 AS (SELECT *, CASE WHEN lag(model) OVER (PARTITION BY s ORDER BY idx) IS NOT DISTINCT FROM model THEN 0 ELSE 1 END AS b0 FROM msg WHERE type = 'assistant' AND model <> '<synthetic>'),
sg1 AS (SELECT *, sum(b0) OVER (PARTITION BY s ORDER BY idx) AS segment FROM sg0),
sg AS (SELECT s, segment, min(model) AS model, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n, sum(u_in) AS ui, sum(u_out) AS uo, sum(u_cc) AS uc, sum(u_cr) AS ur FROM sg1 GROUP BY s, segment)"""
_LIM = f"""{_SEG}, cm AS (SELECT s, arg_max(model, segment) AS model, count(*) - 1 AS n_switches FROM sg GROUP BY s),
lm AS (SELECT m.s, CASE WHEN regexp_matches(coalesce(max(cm.model), ''), '(?i)\\[1m\\]|-1m$') THEN 'model-id' WHEN max(eff) > 200000 THEN 'usage' ELSE 'default' END AS signal FROM msg m LEFT JOIN cm ON cm.s = m.s GROUP BY m.s),
li AS (SELECT s, signal, CASE WHEN signal = 'default' THEN 200000 ELSE 1000000 END AS lim FROM lm)"""
_STATE = f"""{_EFF}, {_LIM}, sn AS (SELECT m.s, count(*) FILTER (idx >= coalesce(start_idx, 0)) AS n, sum(tok) FILTER (idx >= coalesce(start_idx, 0)) AS content FROM msg m LEFT JOIN st ON st.s = m.s GROUP BY m.s),
sx AS (SELECT sn.s, CAST(coalesce(effective, content) AS BIGINT) AS total, lim, sn.n FROM sn JOIN ef USING (s) JOIN li USING (s)),
sp AS (SELECT *, total::DOUBLE / lim::DOUBLE * 100 AS pct FROM sx)"""


@query(f"WITH {EV}, {O.EVENTS}, {_EFF} SELECT s AS session_id, CAST(effective AS BIGINT) AS effective FROM ef")
def effective_window(spark, d):
    m = event_messages(spark, d)
    return C.effective_window(m, K.last_compaction(K.compaction_events(m)))


@query(f"WITH {EV}, {_LIM} SELECT s AS session_id, CAST(lim AS BIGINT) AS context_limit, signal FROM li")
def context_limit_signal(spark, d):
    m = event_messages(spark, d)
    return C.context_limits(m, K.model_history(K.model_segments(m)).select("session_id", "current_model"))


@query(f"""WITH {EV}, {_SEG} SELECT s AS session_id, CAST(segment AS BIGINT) AS segment, model, first_idx, last_idx, n AS n_messages, CAST(ui AS BIGINT) AS input_tokens, CAST(uo AS BIGINT) AS output_tokens,
  CAST(uc AS BIGINT) AS cache_creation_input_tokens, CAST(ur AS BIGINT) AS cache_read_input_tokens FROM sg""")
def model_segments(spark, d):
    return K.model_segments(event_messages(spark, d))


@query(f"""WITH {EV}, {_SEG}, f AS (SELECT s, model, min(segment) AS fs FROM sg GROUP BY s, model), g AS (SELECT s, count(*) AS n_models, string_agg(model, ',' ORDER BY fs) AS models FROM f GROUP BY s),
h AS (SELECT s, arg_max(model, segment) AS current_model, count(*) - 1 AS n_switches FROM sg GROUP BY s) SELECT s AS session_id, current_model, n_switches, n_models, models FROM h JOIN g USING (s)""")
def model_history(spark, d):
    return K.model_history(K.model_segments(event_messages(spark, d)))


_EVCOLS = "s AS session_id, before_idx, after_idx, tokens_before, tokens_after, tokens_before - tokens_after AS tokens_dropped"


@query(f"WITH {EV}, {O.HEURISTIC} SELECT {_EVCOLS} FROM hv")
def compaction_heuristic(spark, d):
    return K.heuristic_events(event_messages(spark, d)).drop("summary_idx", "summary_tokens", "detection")


@query(f"""WITH {O.events(summaries=True)}, {O.MARKERS}, sm AS (SELECT a.s, a.idx, min(c.idx) AS summary_idx, arg_min(CAST(ceil(length(c.txt) / 3.5::DOUBLE) AS BIGINT), c.idx) AS summary_tokens
  FROM msg a JOIN msg c ON c.s = a.s AND c.cs AND c.idx > a.idx AND c.idx < a.idx + 5 WHERE a.type = 'system' GROUP BY a.s, a.idx)
SELECT mk.s AS session_id, before_idx, after_idx, tokens_before, tokens_after, tokens_before - tokens_after AS tokens_dropped, summary_idx, summary_tokens FROM mk LEFT JOIN sm ON sm.s = mk.s AND sm.idx = mk.before_idx""")
def compaction_markers(spark, d):
    return K.marker_events(event_messages(spark, d, summaries=True)).drop("detection")


@query(f"WITH {EV}, {O.EVENTS} SELECT {_EVCOLS}, detection FROM ev")
def compaction_events(spark, d):
    return K.compaction_events(event_messages(spark, d)).drop("summary_idx", "summary_tokens")


@query(f"""WITH {O.events(cumulative=True, markers=False)}, c AS (SELECT s, idx, type, eff, sum(tok) OVER (PARTITION BY s ORDER BY idx) - tok AS before FROM msg),
p AS (SELECT *, lead(idx) OVER w AS ni, lead(eff) OVER w AS ne, lead(before) OVER w AS nb, row_number() OVER (PARTITION BY s ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY s) AS n FROM c WHERE type = 'assistant' AND eff > 0 WINDOW w AS (PARTITION BY s ORDER BY idx)),
q AS (SELECT s, CAST(ne - eff - (nb - before) AS DOUBLE) / CAST(ni - idx AS DOUBLE) AS x FROM p WHERE n >= 3 AND ni IS NOT NULL AND back <= 21 AND ne > eff),
r AS (SELECT s, list_sort(list(x)) AS xs FROM q WHERE x BETWEEN 0 AND 50 GROUP BY s HAVING count(*) >= 3),
u AS (SELECT r.s, CAST(floor(xs[len(xs) // 2 + 1] + 0.5) AS BIGINT) AS t, len(xs) AS ns, n FROM r JOIN (SELECT s, count(*) AS n FROM msg GROUP BY s) USING (s))
SELECT s AS session_id, t AS tokens_per_message, t * n AS total_tokens, CAST(ns AS BIGINT) AS n_samples FROM u""")
def message_framing(spark, d):
    return K.framing(C.classify(event_messages(spark, d, cumulative=True, markers=False)))


@query(f"""WITH {EV}, f AS (SELECT s, arg_min(eff, idx) FILTER (type = 'assistant' AND u_in > 0) AS first_input, arg_min(tok, idx) FILTER (type = 'user') AS fu FROM msg GROUP BY s)
SELECT s AS session_id, first_input, CASE WHEN first_input - 9531 - coalesce(fu, 0) BETWEEN 1000 AND 15000 THEN first_input - 9531 - coalesce(fu, 0) END AS tokens FROM f""")
def system_prompt_derivation(spark, d):
    return K.internal_prompt(event_messages(spark, d))


# --- tools ------------------------------------------------------------------------


@query(f"WITH {EV} SELECT s AS session_id, idx, res AS tool_use_id, rtool AS tool_name FROM msg WHERE is_res")
def tool_use_names(spark, d):
    c = C.classify(event_messages(spark, d)).filter((F.col("type") == "user") & C.has_block("tool_result"))
    return c.select("session_id", "idx", F.get("blocks", F.lit(0))["tool_use_id"].alias("tool_use_id"), "tool_name")


_SERVERS = tuple(f"s{k}" for k in range(6))
MCP = O.events(mcp=True)
_MU = "mu AS (SELECT g.s, g.server, coalesce(sum(CASE WHEN type = 'assistant' THEN 1 ELSE 0 END) FILTER (m.s IS NOT NULL), 0) AS inv, coalesce(sum(tok), 0) AS tok FROM (SELECT DISTINCT s, 's' || x AS server FROM msg, range(6) t(x)) g LEFT JOIN msg m ON m.s = g.s AND split_part(m.tname, '__', 2) = g.server AND m.tname LIKE 'mcp\\_\\_%' ESCAPE '\\' GROUP BY g.s, g.server)"


@query(f"WITH {MCP}, {_MU} SELECT s AS session_id, server, CAST(inv AS BIGINT) AS invocations, CAST(tok AS BIGINT) AS tokens, row_number() OVER (PARTITION BY s ORDER BY tok DESC, server) AS position FROM mu")
def mcp_servers(spark, d):
    return advice.mcp_usage(C.classify(event_messages(spark, d, mcp=True)), _SERVERS)


@query(f"WITH {MCP}, {_MU} SELECT s AS session_id, server FROM mu WHERE inv = 0")
def unused_servers(spark, d):
    return advice.mcp_usage(C.classify(event_messages(spark, d, mcp=True)), _SERVERS).filter("invocations = 0").select("session_id", "server")


@query(f"""WITH {EV}, u AS (SELECT DISTINCT s, tname FROM msg WHERE tname IS NOT NULL), n AS (SELECT s, count(*) AS n FROM u GROUP BY s),
x AS (SELECT g.s, string_agg(t, ',' ORDER BY t) AS unused FROM (SELECT DISTINCT s, t FROM msg, unnest(['Bash', 'Edit', 'Grep', 'Read']) v(t)) g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.s = g.s AND u.tname = g.t) GROUP BY g.s),
y AS (SELECT s, coalesce(sum(tok) FILTER (cat IN ('tools', 'retrieved') AND type = 'assistant'), 0) AS a, coalesce(sum(tok) FILTER (cat IN ('tools', 'retrieved') AND type <> 'assistant'), 0) AS b FROM msg GROUP BY s)
SELECT y.s AS session_id, CAST(a AS BIGINT) AS call_tokens, CAST(b AS BIGINT) AS result_tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_used, coalesce(unused, '') AS unused FROM y LEFT JOIN n USING (s) LEFT JOIN x USING (s)""")
def tools_loaded_unused(spark, d):
    return advice.tool_breakdown(C.classify(event_messages(spark, d)), ("Bash", "Edit", "Grep", "Read"))


# --- waste ------------------------------------------------------------------------

_LIVE = "lv AS (SELECT m.*, coalesce(start_idx, 0) AS st0 FROM msg m LEFT JOIN st ON st.s = m.s WHERE idx >= coalesce(start_idx, 0))"
_RD = """rd AS (SELECT s, idx, path, use, st0, CASE WHEN lead(tname) OVER w = 'Read' THEN lead(tok) OVER w ELSE 0 END AS tk, coalesce(lead(tok) OVER w, 0) AS nt, tool, count(*) OVER (PARTITION BY s) AS n FROM lv WINDOW w AS (PARTITION BY s ORDER BY idx)),
rr AS (SELECT *, split_part(path, '/', -1) AS fn FROM rd WHERE tool = 'Read')"""
_STALE = """sr AS (SELECT s, tk, idx, fn, n - (idx - st0) AS age FROM rr WHERE n - (idx - st0) > 15 AND coalesce(tk, 0) <> 0 AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.s = rr.s AND lv.idx >= rr.idx + 2 AND lv.txt <> '' AND contains(lv.txt, rr.fn)))"""
_DUP = """dp0 AS (SELECT *, lead(idx) OVER (PARTITION BY s, lower(path) ORDER BY idx) AS ni, count(*) OVER (PARTITION BY s, lower(path)) AS nr FROM rr),
dp1 AS (SELECT * FROM dp0 WHERE ni IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lv e WHERE e.s = dp0.s AND e.tool = 'Edit' AND e.path = dp0.path AND e.idx > dp0.idx AND e.idx < dp0.ni)),
dp AS (SELECT s, fn, sum(coalesce(tk, 0)) AS tk, min(idx) AS fi, max(idx) + 1 AS la, max(nr) AS nr, string_agg(CAST(idx + 1 AS VARCHAR), ',' ORDER BY idx) AS detail FROM dp1 GROUP BY s, fn HAVING sum(coalesce(tk, 0)) > 0)"""
_CACHE = "co AS (SELECT s, sum(u_cr) AS cr, sum(eff) AS ti FROM msg GROUP BY s)"
_UNUSED = """ur AS (SELECT a.s, a.idx, a.tok, c.tool AS rtool FROM lv a LEFT JOIN lv c ON c.s = a.s AND c.use = a.res
  WHERE a.is_res AND length(a.txt) >= 200 AND coalesce(c.tool, '') NOT IN ('Read', 'Grep', 'Glob') AND a.tok > 100
  AND NOT EXISTS (SELECT 1 FROM lv e WHERE e.s = a.s AND e.event_type = 'signup' AND e.idx > a.idx AND e.idx <= a.idx + 4 AND (length(e.txt) > 50 OR contains(e.txt, trim(substr(a.txt, 1, 50))))))"""
_WASTE = f"""{_LIVE}, {_RD}, {_STALE}, {_DUP}, {_CACHE}, {_UNUSED},
wa AS (SELECT s, 'stale_read' AS type, 'high' AS severity, tk AS tokens, idx AS first_idx, idx + 1 AS last_idx, fn AS filename, 1 AS n_reads, CAST(age AS VARCHAR) AS detail, 1 AS so, 1 AS d FROM sr
 UNION ALL SELECT s, 'duplicate_read', 'medium', tk, fi, la, fn, nr, detail, 2, 2 FROM dp UNION ALL SELECT s, 'cache_overhead', 'info', 0, NULL, NULL, NULL, NULL, NULL, 4, 5 FROM co WHERE ti > 0 AND cr::DOUBLE / ti::DOUBLE > 0.6
 UNION ALL SELECT s, 'unused_result', 'low', tok, idx, idx, NULL, NULL, coalesce(rtool, 'Tool'), 3, 6 FROM ur),
wr AS (SELECT wa.*, row_number() OVER (PARTITION BY wa.s ORDER BY so, tokens DESC, d, first_idx, filename) AS rank, first_idx - coalesce(start_idx, 0) AS rel_first FROM wa LEFT JOIN st ON st.s = wa.s)"""
_WCOLS = "s AS session_id, type, severity, CAST(tokens AS BIGINT) AS tokens, first_idx, last_idx, filename, CAST(n_reads AS BIGINT) AS n_reads, detail"


def _live(spark, d, **kw):
    """Messages, classified rows, events and live starts. Classified rows hold the messages; they and the
    starts are written once, as every detector reads them."""
    c = cut(C.classify(event_messages(spark, d, **kw)))
    e = K.compaction_events(c)
    return c, c, e, cut(K.last_compaction(e))


@query(f"""WITH {EV}, {O.EVENTS}, {_LIVE}, {_RD}, {_STALE} SELECT s AS session_id, 'stale_read' AS type, 'high' AS severity, CAST(tk AS BIGINT) AS tokens, idx AS first_idx, idx + 1 AS last_idx, fn AS filename, CAST(1 AS BIGINT) AS n_reads, CAST(age AS VARCHAR) AS detail FROM sr""")
def stale_reads(spark, d):
    m, c, e, since = _live(spark, d)
    return W.stale_reads(K.slice_from(c, since))


@query(f"""WITH {EV}, {O.EVENTS}, {_LIVE}, {_RD}, {_DUP} SELECT s AS session_id, 'duplicate_read' AS type, 'medium' AS severity, CAST(tk AS BIGINT) AS tokens, fi AS first_idx, la AS last_idx, fn AS filename, nr AS n_reads, detail FROM dp""")
def duplicate_reads(spark, d):
    m, c, e, since = _live(spark, d)
    return W.duplicate_reads(K.slice_from(c, since))


_PHRASES = ("tion", "der", "que")


@query(f"""WITH {O.CONV}, t AS (SELECT s, idx, type, lower(trim(txt)) AS low, coalesce(sum(CASE WHEN cat IN ('conversation', 'tools', 'retrieved') THEN tok END) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS tk FROM msg)
SELECT s AS session_id, 'resolved_exchange' AS type, 'high' AS severity, CAST(tk AS BIGINT) AS tokens, greatest(0, idx - 10) AS first_idx, idx AS last_idx, CAST(NULL AS VARCHAR) AS filename, CAST(NULL AS BIGINT) AS n_reads, substr(low, 1, 40) AS detail
FROM t WHERE type = 'user' AND length(low) BETWEEN 1 AND 200 AND (contains(low, 'tion') OR contains(low, 'der') OR contains(low, 'que')) AND tk > 100""")
def resolved_exchanges(spark, d):
    return W.resolved_exchanges(C.classify(conversation_messages(spark, d)), _PHRASES, min_tokens=100, max_chars=200)


@query(f"""WITH {EV}, {O.EVENTS}, {_LIVE}, {_UNUSED} SELECT s AS session_id, 'unused_result' AS type, 'low' AS severity, tok AS tokens, idx AS first_idx, idx AS last_idx, CAST(NULL AS VARCHAR) AS filename, CAST(NULL AS BIGINT) AS n_reads, coalesce(rtool, 'Tool') AS detail FROM ur""")
def unused_results(spark, d):
    m, c, e, since = _live(spark, d)
    return W.unused_results(K.slice_from(c, since))


@query(f"WITH {EV}, {_CACHE} SELECT s AS session_id, CAST(coalesce(cr, 0) AS BIGINT) AS cache_read, CAST(coalesce(ti, 0) AS BIGINT) AS total_input FROM co")
def cache_ratio(spark, d):
    return W.cache_ratio(event_messages(spark, d))


@query(f"WITH {EV}, {_CACHE} SELECT s AS session_id, 'cache_overhead' AS type, 'info' AS severity FROM co WHERE ti > 0 AND cr::DOUBLE / ti::DOUBLE > 0.6")
def cache_overhead(spark, d):
    return W.cache_overhead(event_messages(spark, d)).select("session_id", "type", "severity")


@query(f"WITH {EV} SELECT DISTINCT s AS session_id, 'oversized_system' AS type, 'medium' AS severity, CAST(2700 AS BIGINT) AS tokens, '4200' AS detail FROM msg")
def oversized_system(spark, d):
    return W.oversized_system(event_messages(spark, d), 4200).select("session_id", "type", "severity", "tokens", "detail")


@query(f"WITH {EV}, {O.EVENTS}, {_WASTE} SELECT {_WCOLS}, rank, rel_first FROM wr")
def waste_ranked(spark, d):
    m, c, e, since = _live(spark, d)
    return W.detect_waste(c, m, since)


@query(f"WITH {EV}, {O.EVENTS}, {_WASTE} SELECT s AS session_id, severity, count(*) AS n_items, CAST(sum(tokens) AS BIGINT) AS tokens FROM wr GROUP BY ROLLUP (s, severity)")
def waste_by_severity(spark, d):
    m, c, e, since = _live(spark, d)
    return W.waste_totals(W.detect_waste(c, m, since))


_DIRS = "element_at(array('node_modules/', 'dist/', 'src/', 'build/', 'a/.next/', 'target/', 'lib/', 'x/.git/', 'src/', 'Dist/'), k % 10 + 1)"
_DDIRS = "['node_modules/', 'dist/', 'src/', 'build/', 'a/.next/', 'target/', 'lib/', 'x/.git/', 'src/', 'Dist/'][k % 10 + 1]"
NOISE = O.events(path=f"{_DDIRS} || 'f' || k || '.ts'")
_NOISE = r"""nr AS (SELECT s, idx, use, path, CASE WHEN regexp_matches(path, '(?i)(^|[\\/])node_modules[\\/]') THEN 'node_modules/' WHEN regexp_matches(path, '(?i)(^|[\\/])dist[\\/]') THEN 'dist/' WHEN regexp_matches(path, '(?i)(^|[\\/])build[\\/]') THEN 'build/'
  WHEN regexp_matches(path, '(?i)(^|[\\/])\.next[\\/]') THEN '.next/' WHEN regexp_matches(path, '(?i)(^|[\\/])target[\\/]') THEN 'target/' WHEN regexp_matches(path, '(?i)(^|[\\/])\.git[\\/]') THEN '.git/' END AS rule FROM msg WHERE tool = 'Read'),
no AS (SELECT r.s, rule, count(DISTINCT r.path) AS n_paths, sum(CAST(ceil(length(m.txt) / 3.3::DOUBLE) AS BIGINT)) AS tokens FROM nr r JOIN msg m ON m.s = r.s AND m.res = r.use AND m.idx > r.idx WHERE rule IS NOT NULL GROUP BY r.s, rule)"""


@query(f"WITH {NOISE}, {_NOISE} SELECT s AS session_id, rule, n_paths, CAST(tokens AS BIGINT) AS tokens FROM no")
def noise_patterns(spark, d):
    return W.noise_reads(event_messages(spark, d, paths=f"concat({_DIRS}, 'f', k, '.ts')"))


# --- advice -----------------------------------------------------------------------

_FOCUS = """ft AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rank) AS r FROM wr WHERE severity IN ('high', 'medium')),
fo AS (SELECT s, '/compact focus "' || string_agg(CASE WHEN type = 'duplicate_read' THEN 'keep only latest read of ' || filename ELSE 'drop stale read of ' || filename END, '; ' ORDER BY r) || '"' AS focus, CAST(sum(tokens) AS BIGINT) AS savings FROM ft WHERE r <= 3 GROUP BY s)"""


@query(f"WITH {EV}, {O.EVENTS}, {_WASTE}, {_FOCUS} SELECT s AS session_id, focus, savings FROM fo")
def compact_focus(spark, d):
    m, c, e, since = _live(spark, d)
    return advice.compact_focus(W.detect_waste(c, m, since))


def _limits(m):
    return C.context_limits(m, K.model_history(K.model_segments(m)).select("session_id", "current_model"))


def _state(m, c, since):
    return advice.session_state(c, C.effective_window(m, since), _limits(m), since)


_LEFT = "CASE WHEN total >= lim * 0.8::DOUBLE THEN 0 WHEN total > 0 THEN floor((lim * 0.8::DOUBLE - total) / (total::DOUBLE / n::DOUBLE)) END"


@query(f"""WITH {EV}, {O.EVENTS}, {_STATE} SELECT s AS session_id, total, CAST(lim AS BIGINT) AS context_limit, n AS n_messages, pct AS percentage, CAST(greatest(0, lim - total) AS BIGINT) AS free_tokens,
  CASE WHEN pct < 50 THEN 'healthy' WHEN pct < 70 THEN 'warming' WHEN pct < 85 THEN 'hot' ELSE 'critical' END AS health, CAST({_LEFT} AS BIGINT) AS messages_left FROM sp""")
def context_health(spark, d):
    m, c, e, since = _live(spark, d)
    return _state(m, c, since)


@query(f"""WITH {NOISE}, {O.EVENTS}, {_WASTE}, {_FOCUS}, {_LIM}, {_NOISE}, nt AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS sv, string_agg(rule, ',' ORDER BY rule) AS detail FROM no GROUP BY s HAVING sum(tokens) >= 100),
us AS (SELECT s, string_agg(server, ',' ORDER BY server) AS detail FROM (SELECT DISTINCT s, unnest(['s8', 's9']) AS server FROM msg) GROUP BY s),
fx AS (SELECT s, 'compact-focus' AS kind, savings, focus AS detail, 1 AS o FROM fo WHERE savings >= 100 UNION ALL SELECT s, 'ignore-file', sv, detail, 2 FROM nt UNION ALL SELECT s, 'prompt-rule', CAST(floor(sv / 2.0 + 0.5) AS BIGINT), detail, 3 FROM nt
  UNION ALL SELECT s, 'mcp-disable', 0, detail, 4 FROM us UNION ALL SELECT DISTINCT s, 'prompt-oversized', 500, '2000', 5 FROM msg)
SELECT fx.s AS session_id, row_number() OVER (PARTITION BY fx.s ORDER BY savings DESC, o) AS position, kind, savings, detail, CAST(sum(savings) OVER (PARTITION BY fx.s) AS BIGINT) AS total_saveable,
  CAST(sum(savings) OVER (PARTITION BY fx.s) AS DOUBLE) / lim * 100 AS percent_of_context FROM fx JOIN li USING (s)""")
def optimize_report(spark, d):
    m, c, e, since = _live(spark, d, paths=f"concat({_DIRS}, 'f', k, '.ts')")
    unused = advice.mcp_usage(c, ("s8", "s9")).filter("invocations = 0").select("session_id", "server")
    return advice.optimize_report(advice.compact_focus(W.detect_waste(c, m, since)), W.noise_reads(m), unused, _limits(m), prompt=2000)


@query(f"""WITH {EV}, {O.EVENTS}, {_WASTE}, {_FOCUS}, {_STATE}, {O.CATS},
tp AS (SELECT m.s, CAST(coalesce(sum(tok) FILTER (cat = 'tools'), 0) AS DOUBLE) / CAST(sum(tok) AS DOUBLE) * 100 AS tpct FROM msg m GROUP BY m.s),
pr AS (SELECT s, CAST(floor((lim * 0.8::DOUBLE - total) / (total::DOUBLE / n::DOUBLE)) AS BIGINT) AS lf FROM sp WHERE total > 0),
dd AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tokens DESC, rank) AS r FROM wr WHERE type = 'duplicate_read'),
dc AS (SELECT s, count(*) AS dups FROM dd GROUP BY s),
hb AS (SELECT sp.s, CASE WHEN n_compactions >= 3 THEN 'clear-between-tasks' WHEN dups >= 5 THEN 'reuse-reads' WHEN tpct > 50 THEN 'fresh-sessions' END AS h FROM sp LEFT JOIN st ON st.s = sp.s LEFT JOIN dc ON dc.s = sp.s LEFT JOIN tp ON tp.s = sp.s),
al AS (SELECT sp.s, 1 AS priority, 'compact' AS kind, coalesce(savings, CAST(floor(total * 0.25::DOUBLE) AS BIGINT)) AS impact, coalesce(focus, '/compact') AS subject, 0.0::DOUBLE AS o FROM sp LEFT JOIN fo ON fo.s = sp.s WHERE total >= lim * 0.5::DOUBLE
  UNION ALL SELECT s, CASE WHEN lf <= 0 THEN 1 WHEN lf < 20 THEN 2 ELSE 5 END, 'prediction', 0, CAST(lf AS VARCHAR), 1 FROM pr WHERE lf <= 100
  UNION ALL SELECT s, 2, 'duplicate-file', tokens, filename || '|' || n_reads || '|' || detail, 2 + r / 10 FROM dd WHERE r <= 5
  UNION ALL SELECT s, 4, 'prompt-split', 500, '2000', 5 FROM sp UNION ALL SELECT s, 5, 'habit', 0, h, 6 FROM hb WHERE h IS NOT NULL)
SELECT s AS session_id, CAST(priority AS BIGINT) AS priority, kind, CAST(impact AS BIGINT) AS impact, subject, row_number() OVER (PARTITION BY s ORDER BY priority, o) AS position FROM al""")
def recommendations(spark, d):
    m, c, e, since = _live(spark, d)
    w = cut(W.detect_waste(c, m, since))
    share = C.buckets(c).filter("category = 'tools'").select("session_id", F.col("percentage").alias("tool_percentage"))
    return advice.recommendations(_state(m, c, since), w, advice.compact_focus(w), since, share, m, prompt=2000)


_TOP_CTE = """lw AS (SELECT s, idx, tool, path, coalesce(lead(tok) OVER (PARTITION BY s ORDER BY idx), 0) AS nt FROM lv), fc AS (SELECT s, split_part(path, '/', -1) AS name, sum(nt) AS tokens, count(*) AS n_reads FROM lw WHERE tool = 'Read' GROUP BY 1, 2),
ip AS (SELECT s, arg_min(eff, idx) FILTER (type = 'assistant' AND u_in > 0) - 9531 - coalesce(arg_min(tok, idx) FILTER (type = 'user'), 0) AS t FROM msg GROUP BY s),
ta AS (SELECT fc.s, name, fc.tokens, fc.n_reads, coalesce(w.tokens, 0) AS duplicate_tokens, 0 AS o FROM fc LEFT JOIN wr w ON w.s = fc.s AND w.type = 'duplicate_read' AND w.filename = fc.name
  UNION ALL SELECT DISTINCT s, 'Tool schemas', 9055, 0, 0, 1 FROM lv UNION ALL SELECT s, 'System prompt', CASE WHEN t BETWEEN 1000 AND 15000 THEN t ELSE 0 END, 0, 0, 2 FROM ip WHERE s IN (SELECT s FROM lv)),
tr AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tokens DESC, o, name) AS position FROM ta)"""


@query(f"""WITH {EV}, {O.EVENTS}, {_WASTE}, {_TOP_CTE}
SELECT s AS session_id, name, CAST(tokens AS BIGINT) AS tokens, n_reads, CAST(duplicate_tokens AS BIGINT) AS duplicate_tokens, position FROM tr WHERE position <= 5""")
def top_consumers(spark, d):
    m, c, e, since = _live(spark, d)
    derived = K.internal_prompt(m).filter("tokens IS NOT NULL").select("session_id", "tokens")
    return advice.top_consumers(K.slice_from(c, since), W.detect_waste(c, m, since), e, derived)


@query(f"""WITH {EV}, {O.EVENTS}, {_WASTE}, {_FOCUS}, {_STATE}, {O.CATS},
tp AS (SELECT m.s, CAST(coalesce(sum(tok) FILTER (cat = 'tools'), 0) AS DOUBLE) / CAST(sum(tok) AS DOUBLE) * 100 AS tpct FROM msg m GROUP BY m.s),
pr AS (SELECT s, CAST(floor((lim * 0.8::DOUBLE - total) / (total::DOUBLE / n::DOUBLE)) AS BIGINT) AS lf FROM sp WHERE total > 0),
dd AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tokens DESC, rank) AS r FROM wr WHERE type = 'duplicate_read'),
dc AS (SELECT s, count(*) AS dups FROM dd GROUP BY s),
hb AS (SELECT sp.s, CASE WHEN n_compactions >= 3 THEN 'clear-between-tasks' WHEN dups >= 5 THEN 'reuse-reads' WHEN tpct > 50 THEN 'fresh-sessions' END AS h FROM sp LEFT JOIN st ON st.s = sp.s LEFT JOIN dc ON dc.s = sp.s LEFT JOIN tp ON tp.s = sp.s),
{_TOP_CTE},
tl AS (SELECT s, string_agg(name || ' ' || CAST(tokens AS BIGINT), '; ' ORDER BY position) AS list_ FROM tr WHERE position <= 5 GROUP BY s), mi AS (SELECT s, string_agg(DISTINCT tool, ',' ORDER BY tool) AS used FROM msg WHERE tool IN ('Edit', 'db') GROUP BY s),
al AS (SELECT sp.s, 1 AS priority, 'compact' AS kind, coalesce(savings, CAST(floor(total * 0.25::DOUBLE) AS BIGINT)) AS impact, coalesce(focus, '/compact') AS subject, 0.0::DOUBLE AS o FROM sp LEFT JOIN fo ON fo.s = sp.s WHERE total >= lim * 0.5::DOUBLE
  UNION ALL SELECT s, CASE WHEN lf <= 0 THEN 1 WHEN lf < 20 THEN 2 ELSE 5 END, 'prediction', 0, CAST(lf AS VARCHAR), 1 FROM pr WHERE lf <= 100
  UNION ALL SELECT s, 2, 'duplicate-file', tokens, filename || '|' || n_reads || '|' || detail, 2 + r / 10 FROM dd WHERE r <= 5
  UNION ALL SELECT s, 3, 'top-consumers', 0, list_, 3 FROM tl UNION ALL SELECT s, 5, 'mcp-info', 0, coalesce(used, 'none'), 4 FROM sp LEFT JOIN mi USING (s) UNION ALL SELECT s, 4, 'prompt-split', 500, '2000', 5 FROM sp UNION ALL SELECT s, 5, 'habit', 0, h, 6 FROM hb WHERE h IS NOT NULL)
SELECT s AS session_id, CAST(priority AS BIGINT) AS priority, kind, CAST(impact AS BIGINT) AS impact, subject, row_number() OVER (PARTITION BY s ORDER BY priority, o) AS position FROM al""")
def recommendations_all(spark, d):
    """All seven kinds of advice; prompt, session consumers and servers included."""
    m, c, e, since = _live(spark, d)
    w = cut(W.detect_waste(c, m, since))
    share = C.buckets(c).filter("category = 'tools'").select("session_id", F.col("percentage").alias("tool_percentage"))
    derived = K.internal_prompt(m).filter("tokens IS NOT NULL").select("session_id", "tokens")
    consumers = advice.top_consumers(K.slice_from(c, since), w, e, derived)
    return advice.recommendations(_state(m, c, since), w, advice.compact_focus(w), since, share, m, ("Edit", "db"), 2000, consumers)


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT s, epoch_ns(ts) // 1000000 AS t FROM msg WHERE eff IS NOT NULL AND CAST(eff AS DOUBLE) / 200000 * 100 >= 50),
r AS (SELECT s, min(t) AS t FROM h GROUP BY s UNION ALL SELECT r.s, min(h.t) AS t FROM r JOIN h ON h.s = r.s AND h.t >= r.t + 86400000 GROUP BY r.s, r.t) SELECT s AS session_id, t AS ts_ms FROM r""")
def inject_decision(spark, d):
    m = event_messages(spark, d)
    turns = m.filter("usage IS NOT NULL").select("session_id", F.unix_millis(F.to_timestamp("ts")).alias("ts_ms"), (T.effective_input() / F.lit(200_000) * 100).alias("percentage"))
    return advice.injection_decisions(turns, threshold=50, min_gap_ms=24 * 3600 * 1000)


@query(f"""WITH {EV}, r AS (SELECT s, idx, type, (is_call AND use IS NOT NULL AND k % 3 = 0) OR (is_res AND k % 2 = 0) AS own, type = 'assistant' AND NOT is_call AS prose, type = 'user' AND NOT is_res AS asks FROM msg),
a AS (SELECT s, max(idx) + 1 AS n, coalesce(max(CASE WHEN NOT own THEN idx END) + 1, 0) AS e1 FROM r GROUP BY s),
b AS (SELECT r.s, coalesce(max(CASE WHEN NOT prose THEN idx END) + 1, 0) AS e2 FROM r JOIN a ON a.s = r.s AND idx < e1 GROUP BY r.s),
c AS (SELECT a.s, n, e1, CASE WHEN e1 = n THEN n ELSE coalesce(e2, 0) END AS e2 FROM a LEFT JOIN b ON b.s = a.s)
SELECT c.s AS session_id, n, e2 - CASE WHEN e1 < n AND EXISTS (SELECT 1 FROM r WHERE r.s = c.s AND r.idx = e2 - 1 AND asks) THEN 1 ELSE 0 END AS cutoff FROM c""")
def cutoff_trim(spark, d):
    m = event_messages(spark, d)
    b = F.get("blocks", F.lit(0))
    k = F.col("usage.output_tokens") - 20
    return C.cutoff(m, F.coalesce((b["type"] == "tool_use") & (k % 3 == 0), F.lit(False)), F.coalesce((b["type"] == "tool_result") & (F.length(b["content_str"]) / 10 % 2 == 0), F.lit(False)))


# --- losses -----------------------------------------------------------------------

LOST = O.events(summaries=True)
_LOST = f"""{O.EVENTS}, en AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY before_idx) AS event, lag(after_idx, 1, 0) OVER (PARTITION BY s ORDER BY before_idx) AS ws FROM ev),
sm AS (SELECT en.s, event, coalesce(arg_min(lower(m.txt), m.idx), '') AS summary FROM en LEFT JOIN msg m ON m.s = en.s AND m.cs AND en.detection = 'marker' AND m.idx > before_idx AND m.idx < before_idx + 5 GROUP BY en.s, event),
wi AS (SELECT m.*, event, ws, before_idx FROM msg m JOIN en ON en.s = m.s AND idx >= ws AND idx < before_idx),
nx AS (SELECT wi.*, lead(tok) OVER w AS ntok, lead(cat) OVER w AS ncat, lead(type) OVER w AS ntype, lead(idx) OVER w AS nidx, lead(txt) OVER w AS ntxt FROM wi WINDOW w AS (PARTITION BY s, event ORDER BY idx)),
lf AS (SELECT s, event, idx, split_part(path, '/', -1) AS fn, coalesce(ntok, 0) AS tokens FROM nx WHERE tool = 'Read' QUALIFY row_number() OVER (PARTITION BY s, event, lower(path) ORDER BY idx) = 1),
lc AS (SELECT s, event, idx, txt, CASE WHEN ncat = 'conversation' AND ntype = 'assistant' THEN nidx ELSE idx END AS li, tok + CASE WHEN ncat = 'conversation' AND ntype = 'assistant' THEN ntok ELSE 0 END AS tokens FROM nx
  WHERE cat = 'conversation' AND type = 'user' AND NOT is_res AND length(txt) >= 9),
lost AS (SELECT s, event, 'file_read' AS type, idx AS first_idx, idx + 1 AS last_idx, tokens, fn AS subject, 1 AS o FROM lf JOIN sm USING (s, event) WHERE NOT contains(summary, lower(fn))
  UNION ALL SELECT s, event, 'conversation', idx, li, tokens, txt, 2 FROM lc JOIN sm USING (s, event) WHERE tokens >= 50 AND NOT contains(summary, regexp_extract(txt, 'f[0-9]+.ts'))
  UNION ALL SELECT s, event, 'tool_result', idx, idx, tok, coalesce(rtool, 'Tool'), 3 FROM wi JOIN sm USING (s, event) WHERE cat = 'tools' AND is_res AND tok >= 50 AND NOT coalesce(contains(summary, lower(rtool)), false)
  UNION ALL SELECT s, event, 'instruction', idx, idx, tok, txt, 4 FROM wi JOIN sm USING (s, event) WHERE cs AND length(txt) >= 9 AND NOT contains(summary, regexp_extract(txt, 'f[0-9]+.ts')))"""


def _lost(spark, d):
    m = event_messages(spark, d, summaries=True)
    c = C.classify(m)
    e = L.event_windows(K.compaction_events(m))
    return L.window_rows(c, e), L.summaries(m, e)


def _lost_sql(kind: str) -> str:
    return f"WITH {LOST}, {_LOST} SELECT s AS session_id, event, type, first_idx, last_idx, tokens, subject FROM lost WHERE type = '{kind}'"


@query(_lost_sql("file_read"))
def lost_file_reads(spark, d):
    return L.lost_file_reads(*_lost(spark, d))


@query(_lost_sql("conversation"))
def lost_conversations(spark, d):
    return L.lost_conversations(*_lost(spark, d), min_chars=9)


@query(_lost_sql("tool_result"))
def lost_tool_results(spark, d):
    return L.lost_tool_results(*_lost(spark, d))


@query(_lost_sql("instruction"))
def lost_instructions(spark, d):
    return L.lost_instructions(*_lost(spark, d), min_tokens=1, min_chars=9)


@query(f"WITH {LOST}, {_LOST} SELECT s AS session_id, event, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_items FROM lost WHERE type IN ('file_read', 'tool_result') GROUP BY ROLLUP (s, event)")
def lost_totals(spark, d):
    rows, said = _lost(spark, d)
    both = L.lost_file_reads(rows, said).unionByName(L.lost_tool_results(rows, said))
    return L.lost_totals(both)


@query(f"""WITH {LOST}, {_LOST} SELECT s AS session_id, event, type, first_idx, last_idx, tokens, subject, row_number() OVER (PARTITION BY s, event ORDER BY tokens DESC, o, first_idx) AS position
FROM lost WHERE type IN ('file_read', 'tool_result') OR (type = 'conversation' AND length(subject) >= 10)""")
def lost_content(spark, d):
    """All that each compaction lost, largest first, with the usual limits (no instruction here is long enough)."""
    m = event_messages(spark, d, summaries=True)
    return L.lost_content(C.classify(m), m, K.compaction_events(m))


_AGENTS = ("CASE WHEN k % 2 = 0 THEN concat('x/toolu_0', k, CASE WHEN k % 4 = 0 THEN '.json' ELSE '' END) ELSE concat('x/toolu-', k % 10, '.ts') END", "CASE WHEN k % 2 = 0 THEN 'x/toolu_0' || k || CASE WHEN k % 4 = 0 THEN '.json' ELSE '' END ELSE 'x/toolu-' || (k % 10) || '.ts' END")


@query(f"""WITH {O.events(path=_AGENTS[1], summaries=True)}, {_LOST}, fx AS (SELECT *, CASE WHEN regexp_matches(split_part(path, '/', -1), '^toolu_') THEN 'Agent sub-task result' ELSE path END AS p2 FROM nx WHERE tool = 'Read'),
f1 AS (SELECT s, event, idx, coalesce(ntok, 0) AS tokens, split_part(p2, '/', -1) AS fn FROM fx QUALIFY row_number() OVER (PARTITION BY s, event, lower(p2) ORDER BY idx) = 1)
SELECT s AS session_id, event, idx AS first_idx, tokens, fn AS subject FROM f1 JOIN sm USING (s, event) WHERE NOT contains(summary, lower(fn))""")
def lost_agent_results(spark, d):
    """Lost reads of files that are named after a call: one item for all of them."""
    m = event_messages(spark, d, summaries=True, paths=_AGENTS[0])
    e = L.event_windows(K.compaction_events(m))
    return L.lost_file_reads(L.window_rows(C.classify(m), e), L.summaries(m, e)).select("session_id", "event", "first_idx", "tokens", "subject")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def content_survival(spark, d):
    return L.surviving_items(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("SELECT item_id, doc_id FROM (SELECT item_id, substr(text, 2 + item_id % 5, 4 + item_id % 9) AS t FROM benchmark) b JOIN documents d ON contains(d.text, t)")
def short_survival(spark, d):
    """Passages of a few characters, which begin and end inside words."""
    items = table(spark, d, "benchmark").select("item_id", F.expr("substr(text, 2 + CAST(item_id % 5 AS INT), 4 + CAST(item_id % 9 AS INT))").alias("text"))
    return L.surviving_items(items, table(spark, d, "documents"))


# --- comparison, trends, calibration, benchmark runs --------------------------------

_CMP = f"""WITH {O.CONV}, {O.CATS}, bk AS (SELECT g.s, c.category, coalesce(sum(tok), 0) AS t FROM (SELECT DISTINCT s FROM msg) g CROSS JOIN cats c LEFT JOIN msg m ON m.s = g.s AND m.cat = c.category GROUP BY g.s, c.category),
cp AS (SELECT a.s AS sa, b.s AS sb, a.category, CAST(a.t AS BIGINT) AS ta, CAST(b.t AS BIGINT) AS tb, CAST(b.t - a.t AS BIGINT) AS delta, CASE WHEN a.t > 0 THEN CAST(b.t - a.t AS DOUBLE) / CAST(a.t AS DOUBLE) * 100 WHEN b.t > 0 THEN 100.0 ELSE 0.0 END AS dp
  FROM bk a JOIN bk b ON b.s = a.s + 1 AND b.category = a.category)"""


def _pairs(buckets):
    s = buckets.select("session_id").distinct()
    return s.select(F.col("session_id").alias("session_a"), (F.col("session_id") + 1).alias("session_b"))


@query(f"{_CMP} SELECT sa AS session_a, sb AS session_b, category, ta AS tokens_a, tb AS tokens_b, delta, dp AS delta_percent FROM cp")
def compare_sessions(spark, d):
    b = C.buckets(C.classify(conversation_messages(spark, d)))
    return R.compare(_pairs(b), b)


@query(f"""WITH {EV}, {O.EVENTS}, {O.CATS}, {_WASTE}, bk AS (SELECT g.s, c.category, coalesce(sum(tok), 0) AS t FROM (SELECT DISTINCT s FROM msg) g CROSS JOIN cats c LEFT JOIN msg m ON m.s = g.s AND m.cat = c.category GROUP BY g.s, c.category),
x0 AS (SELECT a.s AS sa, b.s AS sb, a.category, b.t - a.t AS d, CASE WHEN a.t > 0 THEN CAST(b.t - a.t AS DOUBLE) / a.t * 100 WHEN b.t > 0 THEN 100.0 ELSE 0.0 END AS p FROM bk a JOIN bk b ON b.s = a.s + 1 AND b.category = a.category),
x AS (SELECT sa, sb, max(d) FILTER (category = 'tools') AS td, max(p) FILTER (category = 'tools') AS tp, max(d) FILTER (category = 'conversation') AS cd, max(p) FILTER (category = 'conversation') AS cpp FROM x0 GROUP BY sa, sb),
wc AS (SELECT s, count(*) AS n FROM wr GROUP BY s), nn AS (SELECT m.s, coalesce(any_value(wc.n), 0) AS w, coalesce(any_value(n_compactions), 0) AS c,
  CAST(coalesce(arg_max(eff, idx) FILTER (type = 'assistant' AND model <> '<synthetic>' AND eff > 0), sum(tok)) AS BIGINT) AS t FROM msg m LEFT JOIN wc ON wc.s = m.s LEFT JOIN st ON st.s = m.s GROUP BY m.s),
y AS (SELECT x.*, a.w AS wa, b.w AS wb, a.c AS ca, b.c AS cb, a.t AS ta, b.t AS tb FROM x JOIN nn a ON a.s = sa JOIN nn b ON b.s = sb)
SELECT sa AS session_a, sb AS session_b, concat_ws(chr(10), CASE WHEN abs(tp) > 15 THEN 'more tool tokens in ' || CASE WHEN td > 0 THEN 'b' ELSE 'a' END || ': ' || format('{{:,}}', CAST(abs(td) AS BIGINT)) END,
 CASE WHEN abs(cpp) > 10 THEN 'more conversation tokens in ' || CASE WHEN cd > 0 THEN 'b' ELSE 'a' END || ': ' || format('{{:,}}', CAST(abs(cd) AS BIGINT)) END,
 CASE WHEN (wa > 0 AND wb >= 2 * wa) OR (wb > 0 AND wa >= 2 * wb) OR (wa = 0 AND wb > 0) OR (wb = 0 AND wa > 0) THEN 'more waste in ' || CASE WHEN wb > wa THEN 'b' ELSE 'a' END || ': a ' || wa || ', b ' || wb END,
 CASE WHEN (ca > 0 OR cb > 0) AND ca <> cb THEN CASE WHEN ca > 0 AND cb > 0 THEN 'both compacted' ELSE 'only compacted in ' || CASE WHEN cb > ca THEN 'b' ELSE 'a' END END || ': a ' || ca || ', b ' || cb END,
 CASE WHEN ta > 0 AND CAST(abs(tb - ta) AS DOUBLE) / ta * 100 > 20 THEN 'more tokens in all in ' || CASE WHEN tb > ta THEN 'b' ELSE 'a' END || ': ' || format('{{:,}}', abs(tb - ta)) || ', ' || CAST(floor(CAST(abs(tb - ta) AS DOUBLE) / ta * 100 + 0.5) AS BIGINT) || ' percent' END) AS insights FROM y""")
def compare_insights(spark, d):
    m, c, e, since = _live(spark, d)
    b = C.buckets(c)
    waste = W.detect_waste(c, m, since).groupBy("session_id").agg(F.count(F.lit(1)).alias("w"))
    counts = _totals(c).join(waste, "session_id", "left").join(since, "session_id", "left")
    counts = counts.select("session_id", F.coalesce("w", F.lit(0)).alias("n_waste"), F.coalesce("n_compactions", F.lit(0)).alias("n_compactions"), F.col("tokens_total").alias("total"))
    return R.insights(R.compare(_pairs(b), b), counts)


def _totals(c):
    """Rows (session_id, tokens_total, message_count) of whole sessions."""
    totals = c.groupBy("session_id").agg(F.sum("tokens").alias("content"), F.count(F.lit(1)).alias("message_count")).join(C.effective_window(c), "session_id", "left")
    return totals.select("session_id", F.coalesce("effective", "content").alias("tokens_total"), "message_count")


def _cut_sql(n: int) -> str:
    return f"""c{n} AS (SELECT s, idx, type, tok, CASE WHEN type = 'system' THEN 'system' WHEN type = 'user' AND idx = max(CASE WHEN type = 'user' THEN idx END) OVER (PARTITION BY s) THEN 'user' ELSE 'conversation' END AS cat FROM msg WHERE idx < {n}),
b{n} AS (SELECT g.s, c.category, coalesce(sum(tok), 0) AS t FROM (SELECT DISTINCT s FROM c{n}) g CROSS JOIN cats c LEFT JOIN c{n} m ON m.s = g.s AND m.cat = c.category GROUP BY g.s, c.category)"""


@query(f"WITH {O.CONV}, {O.CATS}, {_cut_sql(2)}, {_cut_sql(5)} SELECT s AS session_id, category, CAST(b2.t AS BIGINT) AS tokens_from, CAST(b5.t AS BIGINT) AS tokens_to, CAST(b5.t - b2.t AS BIGINT) AS delta FROM b2 JOIN b5 USING (s, category)")
def session_diff(spark, d):
    return R.session_diff(R.cut_buckets(conversation_messages(spark, d), (2, 5)), 2, 5)


_CUTS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


@query(f"""WITH {EV}, {O.CATS}, cu AS (SELECT msg.*, cut FROM msg, unnest({list(_CUTS)}) c(cut) WHERE idx < cut),
ct AS (SELECT s, cut, tok, type, CASE WHEN type = 'system' THEN 'system' WHEN event_type = 'click' AND idx = max(CASE WHEN event_type = 'click' THEN idx END) OVER (PARTITION BY s, cut) THEN 'user'
  WHEN is_call OR is_res THEN CASE WHEN coalesce(tname, '') = 'Read' THEN 'retrieved' ELSE 'tools' END ELSE 'conversation' END AS cat FROM cu),
p AS (SELECT s, cut, cat, sum(tok) AS t, count(*) AS n, bool_or(type <> 'assistant') AS est FROM ct GROUP BY s, cut, cat)
SELECT g.s AS session_id, CAST(g.cut AS BIGINT) AS cut, category, CAST(coalesce(t, 0) AS BIGINT) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_messages, CASE WHEN est THEN 'estimated' ELSE 'exact' END AS accuracy
FROM (SELECT DISTINCT s, cut FROM cu) g CROSS JOIN cats LEFT JOIN p ON p.s = g.s AND p.cut = g.cut AND p.cat = category""")
def session_cuts(spark, d):
    """Buckets of every session at ten cuts."""
    return R.cut_buckets(event_messages(spark, d), _CUTS)


def _records(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("project"), (F.col("o_totalprice") / 5000).alias("percent_used"), F.col("o_orderpriority").alias("top_category"))


_HIST = "h AS (SELECT o_custkey AS s, o_orderdate AS ts, o_orderkey AS line, o_orderstatus AS project, o_totalprice / 5000 AS pu, o_orderpriority AS cat FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)"


@query(f"WITH {_HIST} SELECT s AS session_id, strftime(ts, '%Y-%m-%d') AS day, line, project, cat AS top_category FROM h")
def trend_history(spark, d):
    return R.trend_history(_records(spark, d)).select("session_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "line", "project", "top_category")


@query("""WITH h AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 3, o_orderkey) = 1)
SELECT CAST(o_custkey AS VARCHAR) AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderstatus AS project, o_totalprice / 5000 AS percent_used, o_orderpriority AS top_category, o_orderkey AS total_tokens FROM h""")
def trend_log(spark, d):
    """The newest record of each session from a log written in three runs, one of them twice, and folded on the way."""
    from ..sources.appends import AppendLog
    from ..sources.state import trend_records as records

    o = table(spark, d, "orders").selectExpr("o_orderkey % 3 AS run", "CAST(o_custkey AS STRING) AS sessionId", "o_orderstatus AS projectName", "date_format(o_orderdate, 'yyyy-MM-dd') AS timestamp", "o_totalprice / 5000 AS percentUsed", "o_orderpriority AS topCategory", "o_orderkey AS totalTokens")
    log = AppendLog(shared_dir(spark))
    for run in (0, 1, 1, 2):
        log.append(o.filter(F.col("run") == run).drop("run"), run, "totalTokens")
        if run == 1:
            log.fold(spark, 1, "sessionId", "timestamp")
    log.append(o.filter("run = 0").drop("run"), 0)
    return R.trend_history(records(log.lines(spark))).select("session_id", "ts", "project", "percent_used", "top_category", "total_tokens")


@query(f"""WITH {_HIST}, p AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY ts, s) AS pos FROM h), q AS (SELECT *, greatest(1, n // 3) AS third FROM p),
a AS (SELECT project, count(*) AS n, avg(pu) AS ap, avg(pu) FILTER (pos <= third) AS fa, avg(pu) FILTER (pos > n - third) AS la FROM q GROUP BY project),
m AS (SELECT project, cat, count(*) AS c, min(pos) AS p FROM q GROUP BY project, cat), b AS (SELECT project, cat FROM m QUALIFY row_number() OVER (PARTITION BY project ORDER BY c DESC, p) = 1)
SELECT project, n, round(ap, 6) AS avg_percent, cat AS dominant_category, round(CASE WHEN n >= 3 THEN la - fa ELSE 0 END, 6) AS percent_delta, CASE WHEN n >= 3 AND la - fa > 5 THEN 'worsening' WHEN n >= 3 AND la - fa < -5 THEN 'improving' ELSE 'flat' END AS direction FROM a JOIN b USING (project)""")
def trend_summary(spark, d):
    s = R.trend_summary(R.trend_history(_records(spark, d)), "project")
    return s.withColumns({"avg_percent": F.round("avg_percent", 6), "percent_delta": F.round("percent_delta", 6)})


@query(f"""WITH {_HIST} SELECT strftime(ts, '%Y-%m-%d') AS day, concat_ws(',', CAST(s AS VARCHAR), project, cat) AS line FROM h""")
def trend_csv(spark, d):
    h = R.trend_history(_records(spark, d))
    return R.trend_csv(h, ("session_id", "project", "top_category")).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "line")


@query("""SELECT o_orderkey AS record, concat_ws(',', o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || ', ""a""' || chr(10) || 'b"' ELSE o_orderpriority END,
  o_orderkey, printf('%d.%02d', r // 100, r % 100), o_orderkey % 90, o_orderkey % 4, CASE WHEN o_orderkey % 2 = 0 THEN 'hot' ELSE '' END, 'tools', o_orderkey * 2, 200000) AS line
FROM (SELECT *, CAST(floor(12.5 * (o_orderkey % 800) + 0.5) AS INT) AS r FROM orders)""")
def trend_csv_full(spark, d):
    """The eleven exported columns; texts with commas, quotes and line breaks, fractions in eighths."""
    o = table(spark, d, "orders")
    odd = F.concat("o_orderpriority", F.lit(', "a"\nb'))
    made = (
        F.col("o_custkey"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, odd).otherwise(F.col("o_orderpriority")), F.col("o_orderkey"), F.col("o_orderkey") % 800 / 8,
        F.col("o_orderkey") % 90, F.col("o_orderkey") % 4, F.when(F.col("o_orderkey") % 2 == 0, "hot"), F.lit("tools"), F.col("o_orderkey") * 2, F.lit(200_000),
    )
    return R.trend_csv(o.select("o_orderkey", F.col("o_orderkey").alias("ts"), *(c.alias(n) for c, n in zip(made, R.TREND_COLUMNS, strict=True)))).select(F.col("ts").alias("record"), "line")


def _pasted(spark, d):
    """Pasted usage listings, one for each customer: repeated labels, odd lines, and a total in some."""
    return spread(table(spark, d, "customer"), "c_custkey").selectExpr("c_custkey AS id", f"{_PASTE} AS text")


#: Read alike by Spark and DuckDB.
_PASTE = r"""concat('  System prompt:  1,2', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ' tokens', chr(10), 'System tools: ', CAST(c_custkey * 10 AS STRING), chr(10), 'Tools: 11k', chr(10),
  'Custom agents: ', CAST(c_custkey % 3 * 40 AS STRING), ' tokens', chr(10), 'Memory files: 0', chr(10), 'MCP tools: ', CAST(c_custkey % 5 * 100 AS STRING), chr(10), 'Messages: 7,000 tokens', chr(10), 'memdir: 55', chr(10),
  'messages: ', CAST(c_custkey % 4 * 2500 AS STRING), ' TOKENS', chr(10), 'Free space: 2,000', chr(10), 'noise', chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Total: 200,000 tokens' ELSE 'Total: n/a' END)"""
_FIND = {b: words for b, words in R.CALIBRATION_LABELS}
_CAL = (
    f"""ln AS (SELECT c_custkey AS id, l, p FROM (SELECT c_custkey, string_split({_PASTE.replace('STRING', 'VARCHAR')}, chr(10)) AS ls FROM customer), LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS p)),
lb AS (SELECT id, p, lower(trim(regexp_extract(l, '^\\s*([^:]+):', 1))) AS label, CAST(replace(regexp_extract(l, '(?i):\\s*([0-9,]+)\\s*(?:tokens?)?\\s*$', 1), ',', '') AS BIGINT) AS v FROM ln WHERE regexp_matches(l, '(?i)^\\s*[^:]+:\\s*[0-9,]+\\s*(?:tokens?)?\\s*$')),
la AS (SELECT id, label, arg_max(v, p) AS v, min(p) AS p FROM lb GROUP BY id, label),
cb AS (SELECT id, """.replace("\\\\", "\\")
    + ", ".join(f"coalesce({', '.join(f'nullif(arg_min(v, p) FILTER (contains(label, {chr(39)}{w}{chr(39)})), 0)' for w in words)}, 0) AS {b}" for b, words in _FIND.items())
    + """ FROM la GROUP BY id),
ca AS (SELECT * EXCLUDE (total), system_prompt + system_tools + custom_agents + memory_files + mcp_tools + messages AS total_used, total FROM cb),
cc AS (SELECT * EXCLUDE (total), CASE WHEN total > 0 THEN total ELSE total_used + free_space END AS total_capacity FROM ca WHERE total_used > 0 OR free_space > 0)"""
)


@query(f"WITH {_CAL} SELECT * FROM cc")
def calibration_parse(spark, d):
    return R.parse_context_output(_pasted(spark, d))


def _estimates(spark, d):
    """Estimated buckets of the sessions that have a customer's number, with the fixed costs."""
    c = C.classify(event_messages(spark, d))
    return C.buckets(c, C.config_overhead(c, prompt=1200, memory=300)).select(F.col("session_id").alias("id"), "category", "tokens")


_CALC = f"""{_CAL}, es AS (SELECT s AS id, sum(tok) FILTER (cat = 'system') AS a, sum(tok) FILTER (cat = 'tools') AS b, sum(tok) FILTER (cat IN ('conversation', 'retrieved', 'user')) AS c, sum(tok) FILTER (cat = 'state') AS e FROM
  (SELECT s, cat, tok FROM msg UNION ALL SELECT DISTINCT s, 'tools', 9055 FROM msg UNION ALL SELECT DISTINCT s, 'system', 1200 FROM msg UNION ALL SELECT DISTINCT s, 'state', 300 FROM msg) GROUP BY s),
cm AS (SELECT id, unnest([{{'bucket': 'System prompt', 'estimated': coalesce(a, 0), 'actual': system_prompt}}, {{'bucket': 'Tools', 'estimated': coalesce(b, 0), 'actual': system_tools + mcp_tools}}, {{'bucket': 'Messages', 'estimated': coalesce(c, 0), 'actual': messages}},
  {{'bucket': 'Memory', 'estimated': coalesce(e, 0), 'actual': memory_files}}, {{'bucket': 'Custom agents', 'estimated': 0, 'actual': custom_agents}}], recursive := true) FROM es JOIN cc USING (id)),
cp AS (SELECT * FROM cm WHERE estimated > 0 OR actual > 0)"""


@query(f"WITH {EV}, {_CALC} SELECT id, bucket, CAST(estimated AS BIGINT) AS estimated, CAST(actual AS BIGINT) AS actual, CASE WHEN actual > 0 THEN CAST(estimated - actual AS DOUBLE) / CAST(actual AS DOUBLE) * 100 ELSE 0.0 END AS delta_percent FROM cp")
def calibration_compare(spark, d):
    return R.calibrate(_estimates(spark, d), R.parse_context_output(_pasted(spark, d)))


@query(f"""WITH {EV}, {_CALC}, g AS (SELECT id, sum(estimated) AS e, sum(actual) AS a FROM cp GROUP BY id)
SELECT id, CASE WHEN a > 0 THEN 100 - CAST(abs(e - a) AS DOUBLE) / CAST(a AS DOUBLE) * 100 END AS accuracy, system_tools + mcp_tools > 0 AND CAST(abs(system_tools + mcp_tools - 9055) AS DOUBLE) / CAST(system_tools + mcp_tools AS DOUBLE) * 100 > 5 AS stale FROM g JOIN cc USING (id)""")
def calibration_accuracy(spark, d):
    actual = R.parse_context_output(_pasted(spark, d))
    return R.calibration_accuracy(R.calibrate(_estimates(spark, d), actual))


_SNAP = f"""{O.EVENTS}, {_WASTE}, {_STATE}, an AS (SELECT s, count(*) AS na FROM msg GROUP BY s), tt AS (SELECT s, CAST(coalesce(arg_max(eff, idx) FILTER (type = 'assistant' AND model <> '<synthetic>' AND eff > 0), sum(tok)) AS BIGINT) AS t FROM msg GROUP BY s), wc AS (SELECT s, count(*) AS n FROM wr GROUP BY s),
sh AS (SELECT sp.s, tt.t AS tokens_total, total AS tokens_current, pct AS usage_percentage, na AS message_count, coalesce(wc.n, 0) AS waste_count, coalesce(n_compactions, 0) AS compaction_count, CAST(lim AS BIGINT) AS context_limit
  FROM sp JOIN an ON an.s = sp.s JOIN tt ON tt.s = sp.s LEFT JOIN wc ON wc.s = sp.s LEFT JOIN st ON st.s = sp.s)"""


@query(f"WITH {EV}, {_SNAP} SELECT a.s AS session_id, " + ", ".join(f"b.{c} - a.{c} AS {c}" for c in R.SNAPSHOT) + " FROM sh a JOIN sh b ON b.s = a.s + 1")
def bench_snapshot_compare(spark, d):
    s = cut(bench_snapshots(spark, d))
    return R.snapshot_delta(s, s.withColumn("session_id", F.col("session_id") - 1), "session_id")


def _paths(a: str, b: str) -> str:
    return f"concat('see src/', source, '/', doc_id {a}, '.ts and lib/', lang, '.py, version 1.2.', doc_id, ' e.g. x.unknown, ./notes', doc_id {b}, '.md')"


@query("SELECT doc_id, './notes' || (doc_id % 3) || '.md,' || 'lib/' || lang || '.py,' || 'src/' || source || '/' || (doc_id % 5) || '.ts' AS refs FROM documents")
def file_refs(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_paths("% 5", "% 3")).alias("t"))
    return t.select("doc_id", F.array_join(X.file_refs(F.col("t")), ",").alias("refs"))


@query("""WITH r AS (SELECT doc_id, ['./notes' || (doc_id % 3) || '.md', 'lib/' || lang || '.py', 'src/' || source || '/' || (doc_id % 5) || '.ts'] AS a, ['./notes' || (doc_id % 2) || '.md', 'lib/' || lang || '.py', 'src/' || source || '/' || (doc_id % 4) || '.ts'] AS b FROM documents)
SELECT doc_id, array_to_string([x for x in a if NOT list_contains(b, x)], ',') AS only_a, array_to_string([x for x in b if NOT list_contains(a, x)], ',') AS only_b, array_to_string([x for x in a if list_contains(b, x)], ',') AS in_both, CAST(len(b) - len(a) AS BIGINT) AS coverage_delta FROM r""")
def file_ref_setdiff(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_paths("% 5", "% 3")).alias("a"), F.expr(_paths("% 4", "% 2")).alias("b"))
    return R.survivor_diff(t, "doc_id", "a", "b")


def _reclaimed(spark, d):
    """What the last compactions of two neighbouring sessions dropped."""
    e = K.compaction_events(event_messages(spark, d)).groupBy("session_id").agg(F.max_by("tokens_dropped", "before_idx").alias("a"))
    return e.join(e.select((F.col("session_id") - 1).alias("session_id"), F.col("a").alias("b")), "session_id")


_RECL = f"""{O.EVENTS}, rc AS (SELECT s, arg_max(tokens_before - tokens_after, before_idx) AS a FROM ev GROUP BY s), rp AS (SELECT x.s, x.a, y.a AS b FROM rc x JOIN rc y ON y.s = x.s + 1)"""
_RATIO = "CASE WHEN a > 0 AND b > 0 AND abs(1 - b::DOUBLE / a::DOUBLE) >= 0.1 THEN CAST(floor((CASE WHEN b > a THEN b::DOUBLE / a::DOUBLE - 1 ELSE 1 / (b::DOUBLE / a::DOUBLE) - 1 END) * 100 + 0.5) AS BIGINT) END"


@query(f"""WITH {EV}, {_RECL} SELECT s AS session_id, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN abs(1 - b::DOUBLE / a::DOUBLE) < 0.1 THEN 'similar' WHEN b > a THEN 'b' ELSE 'a' END END AS more, {_RATIO} AS percent FROM rp""")
def bench_reclaim(spark, d):
    return R.reclaim_ratio(_reclaimed(spark, d), "session_id", "a", "b")


@query(f"""WITH {EV}, {_RECL}, fl AS (SELECT s, list_distinct(list(split_part(path, '/', -1)) FILTER (tool = 'Read')) AS r FROM msg GROUP BY s),
q AS (SELECT rp.s, a, b, coalesce(x.r, []) AS ra, coalesce(y.r, []) AS rb, {_RATIO} AS pc FROM rp JOIN fl x ON x.s = rp.s JOIN fl y ON y.s = rp.s + 1),
o AS (SELECT *, list_sort([v for v in rb if NOT list_contains(ra, v)]) AS ob, list_sort([v for v in ra if NOT list_contains(rb, v)]) AS oa FROM q)
SELECT s AS key, concat_ws(chr(10), CASE WHEN len(ra) > 0 OR len(rb) > 0 THEN CASE WHEN len(rb) > len(ra) THEN 'b names more files by ' || (len(rb) - len(ra)) WHEN len(rb) < len(ra) THEN 'a names more files by ' || (len(ra) - len(rb)) ELSE 'both name as many files: ' || len(ra) END END,
  CASE WHEN len(ob) > 0 THEN 'only in b: ' || array_to_string(ob[1:5], ', ') || CASE WHEN len(ob) > 5 THEN ', and ' || (len(ob) - 5) || ' more' ELSE '' END END,
  CASE WHEN len(oa) > 0 THEN 'only in a: ' || array_to_string(oa[1:5], ', ') || CASE WHEN len(oa) > 5 THEN ', and ' || (len(oa) - 5) || ' more' ELSE '' END END,
  CASE WHEN a > 0 AND b > 0 THEN CASE WHEN abs(1 - b::DOUBLE / a::DOUBLE) < 0.1 THEN 'both reclaimed about as much' ELSE CASE WHEN b > a THEN 'b' ELSE 'a' END || ' reclaimed more by ' || pc || ' percent' END END) AS insights FROM o""")
def bench_insights(spark, d):
    m = event_messages(spark, d)
    files = C.tool_uses(m).filter("name = 'Read'").groupBy("session_id").agg(F.collect_set(X.filename(F.col("path"))).alias("r"))
    files = m.select("session_id").distinct().join(files, "session_id", "left").select("session_id", F.coalesce("r", F.array().cast("array<string>")).alias("refs_a"))
    both = files.join(files.select((F.col("session_id") - 1).alias("session_id"), F.col("refs_a").alias("refs_b")), "session_id")
    runs = _reclaimed(spark, d).join(both, "session_id")
    return R.run_insights(runs.select(F.col("session_id").alias("key"), "refs_a", "refs_b", F.col("a").alias("reclaimed_a"), F.col("b").alias("reclaimed_b")))


@query(f"""WITH {EV}, {O.EVENTS}, {_WASTE}, {_FOCUS}, {_STATE}, {O.CATS}, bk AS (SELECT g.s, c.category, c.ord, coalesce(sum(tok), 0) AS t FROM (SELECT DISTINCT s FROM msg) g CROSS JOIN cats c LEFT JOIN msg m ON m.s = g.s AND m.cat = c.category GROUP BY g.s, c.category, c.ord),
bp AS (SELECT *, CASE WHEN sum(t) OVER (PARTITION BY s) > 0 THEN CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY s) AS DOUBLE) * 100 ELSE 0.0 END AS p FROM bk),
tq AS (SELECT s, string_agg(category || ' ' || CAST(floor(p + 0.5) AS BIGINT) || '%', ', ' ORDER BY ord) AS top FROM bp WHERE ord <= 3 GROUP BY s)
SELECT sp.s AS session_id, 'Context window at ' || CAST(floor(pct + 0.5) AS BIGINT) || '%.' || CASE WHEN coalesce(savings, 0) > 0 THEN ' About ' || format('{{:,}}', savings) || ' tokens can be reclaimed.' ELSE ' Largest parts: ' || top || '.' END || chr(10) ||
  'Ask the user to run this before the next answer:' || chr(10) || coalesce(focus, '/compact') || chr(10) || 'At 80% the window is compacted unasked, and more is dropped. Files stay on disk and can be read again.' AS text
FROM sp JOIN tq ON tq.s = sp.s LEFT JOIN fo ON fo.s = sp.s""")
def injection_text(spark, d):
    m, c, e, since = _live(spark, d)
    return advice.injection(_state(m, c, since), advice.compact_focus(W.detect_waste(c, m, since)), C.buckets(c))


@query(r"""SELECT doc_id, array_to_string((regexp_extract_all(text, '[A-Za-z0-9_-]+\.[A-Za-z0-9_]{1,6}') || regexp_extract_all(text, '([a-zA-Z_][A-Za-z0-9_]{3,})\s*\(', 1) ||
  [x for x in [regexp_replace(w, '[^a-zA-Z]', '', 'g') for w in string_split_regex(text, '\s+')] if length(x) > 6])[1:20], '|') AS terms FROM documents""")
def key_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.key_terms(F.col("text")), "|").alias("terms"))


def _listing(spark, d):
    """Sessions as a listing: conversations with their number of turns as the time."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("n") * 1000 + F.col("conv_id")).alias("modified_at"), F.concat(F.lit("p-"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.concat(F.lit("/"), F.col("conv_id").cast("string")).alias("path"))


_LIST = "l AS (SELECT 'c' || conv_id AS session_id, count(*) * 1000 + conv_id AS modified_at, 'p-' || (conv_id % 3) AS project, '/' || conv_id AS path FROM conversations GROUP BY conv_id)"


@query(f"WITH {_LIST} SELECT * FROM l WHERE starts_with(session_id, 'c1') AND contains(lower(project), 'p-1') ORDER BY modified_at DESC, path LIMIT 1")
def session_prefix_lookup(spark, d):
    from ..sources.logs import resolve_session

    return resolve_session(_listing(spark, d), "c1", "P-1")


@query(f"WITH {_LIST} SELECT * FROM l ORDER BY modified_at DESC, path LIMIT 1")
def latest_session(spark, d):
    from ..sources.logs import latest_session as latest

    return latest(_listing(spark, d))


@query("SELECT c_nationkey, CASE max(CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 1000 THEN 2 ELSE 1 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'ok' END AS status, count(*) AS n_checks FROM customer GROUP BY c_nationkey")
def doctor_status(spark, d):
    c = table(spark, d, "customer")
    status = F.when(F.col("c_acctbal") < 0, "fail").when(F.col("c_acctbal") < 1000, "warn").otherwise("ok")
    return R.worst_status(c.select("c_nationkey", status.alias("status")), "c_nationkey")


_THIRDS = "t3 AS (SELECT *, CAST(floor(3 * idx / count(*) OVER (PARTITION BY s)) AS BIGINT) AS third FROM msg)"


def _in_thirds(spark, rows, step):
    """Append every session's rows to a table in three steps, in order, and call ``step`` with a stream of it after each."""
    at = shared_dir(spark)
    third = F.floor(3 * F.col("idx") / F.count(F.lit(1)).over(C.by_session()))
    parts = cut(rows.withColumn("third", third))
    for k in range(3):
        parts.filter(F.col("third") == k).drop("third").write.mode("append").parquet(f"{at}/rows")
        step(spark.readStream.schema(rows.schema).parquet(f"{at}/rows"))


@query(f"""WITH {EV}, {_THIRDS}, g AS (SELECT s, third, count(*) FILTER (type = 'system') AS n FROM t3 GROUP BY s, third),
c AS (SELECT s, n, sum(n) OVER (PARTITION BY s ORDER BY third) AS now FROM g)
SELECT CAST(s AS VARCHAR) AS session_id, CAST(now - n AS BIGINT) AS known, CAST(now AS BIGINT) AS now FROM c WHERE n > 0""")
def watch_feed(spark, d):
    """Compactions as a stream finds them in three batches: a stateful count for each session, as JSON lines."""
    from ..streaming.live import new_compactions, run_once

    to = shared_dir(spark)
    found = []
    _in_thirds(spark, event_messages(spark, d).select("session_id", "idx", "type", "subtype"), lambda stream: found.append(run_once(new_compactions(stream), to)))
    return found[-1]


@query(f"""WITH {EV}, {O.EVENTS}, {O.CATS}, vw AS (SELECT 'lifetime' AS v, s, cat, tok, type <> 'assistant' AS est FROM msg
  UNION ALL SELECT 'current', m.s, cat, tok, type <> 'assistant' FROM msg m JOIN st ON st.s = m.s AND idx >= start_idx),
p AS (SELECT v, s, cat, sum(tok) AS t, count(*) AS n, bool_or(est) AS est FROM vw GROUP BY v, s, cat)
SELECT g.v AS view, CAST(g.s AS VARCHAR) AS session_id, category, CAST(coalesce(t, 0) AS BIGINT) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_messages, CASE WHEN coalesce(est, false) THEN 'estimated' ELSE 'exact' END AS accuracy
FROM (SELECT DISTINCT v, s FROM vw) g CROSS JOIN cats LEFT JOIN p ON p.v = g.v AND p.s = g.s AND p.cat = category""")
def incremental_analysis(spark, d):
    """Buckets of the whole sessions and of their live windows from a state that grew in three batches."""
    from ..streaming.incremental import Incremental

    kept, at = Incremental(shared_dir(spark), fold_every=2), shared_dir(spark)
    rows = event_messages(spark, d).withColumn("line_no", F.col("idx"))
    _in_thirds(spark, rows, lambda stream: kept.follow(stream.drop("idx"), at).awaitTermination())
    state = kept.state(spark)
    views = (v.select(F.lit(n).alias("view"), "session_id", "category", "tokens", "n_messages", "accuracy") for n, v in (("lifetime", state.buckets), ("current", state.current)))
    return next(views).unionByName(next(views))


@query(f"""WITH {EV}, {O.EVENTS}, {_EFF}, {_LIM} SELECT CAST(m.s AS VARCHAR) AS session_id, count(*) AS n, CAST(coalesce(any_value(n_compactions), 0) AS BIGINT) AS n_compactions,
  CAST(any_value(effective) AS BIGINT) AS effective, CAST(any_value(lim) AS BIGINT) AS context_limit, any_value(signal) AS signal
FROM msg m LEFT JOIN st ON st.s = m.s JOIN ef ON ef.s = m.s JOIN li ON li.s = m.s GROUP BY m.s""")
def incremental_sessions(spark, d):
    """Window, limit and compactions of every session from a state that grew in three batches."""
    from ..streaming.incremental import Incremental

    kept, at = Incremental(shared_dir(spark)), shared_dir(spark)
    rows = event_messages(spark, d).withColumn("line_no", F.col("idx"))
    _in_thirds(spark, rows, lambda stream: kept.follow(stream.drop("idx"), at).awaitTermination())
    return kept.state(spark).sessions


#: Milliseconds after which a wait for a compaction ends, and which it goes on after one.
_PATIENCE, _SETTLE = 10 * 86_400_000, 6 * 3_600_000


@query(f"""WITH {EV}, r AS (SELECT s, idx, type, eff, epoch_us(ts) // 1000 AS ms FROM msg), rq AS (SELECT s, ms AS began FROM r WHERE idx = 4),
f AS (SELECT rq.s, began, min(ms) FILTER (type = 'system' AND ms > began AND ms < began + {_PATIENCE}) AS found FROM rq JOIN r USING (s) GROUP BY rq.s, began),
e AS (SELECT *, coalesce(found + {_SETTLE}, began + {_PATIENCE}) AS ended FROM f)
SELECT CAST(e.s AS VARCHAR) AS session_id, CASE WHEN found IS NULL THEN 'timeout' ELSE 'compacted' END AS status, CASE WHEN found IS NULL THEN 'no boundary was written' END AS message, began AS began_ms, ended AS ended_ms,
  count(*) FILTER (ms <= began) AS before_messages, count(*) FILTER (ms < ended) AS after_messages, count(*) FILTER (type = 'system' AND ms <= began) AS before_compactions, count(*) FILTER (type = 'system' AND ms < ended) AS after_compactions,
  CAST(coalesce(arg_max(eff, idx) FILTER (type = 'assistant' AND eff > 0 AND ms <= began), 0) AS BIGINT) AS before_tokens, CAST(coalesce(arg_max(eff, idx) FILTER (type = 'assistant' AND eff > 0 AND ms < ended), 0) AS BIGINT) AS after_tokens
FROM e JOIN r USING (s) WHERE ended <= (SELECT max(ms) FROM r) GROUP BY e.s, found, began, ended""")
def await_compactions(spark, d):
    """Every session asks at its fifth message for its next compaction; what became of it, in the time of the
    records. Waits that the last record leaves open have no row."""
    from ..streaming import waiting
    from ..streaming.live import run_once

    m = cut(event_messages(spark, d).select("session_id", "idx", "type", "subtype", "usage", F.to_timestamp("ts").alias("at")))
    rows = waiting.records(m, "at").unionByName(waiting.requests(m.filter("idx = 4")))
    at, to = shared_dir(spark), shared_dir(spark)
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    for k in range(3):  # time only grows from batch to batch
        edges = [low + (high - low) * x / 3 for x in (k, k + 1)]
        part = rows.filter((F.col("at") >= edges[0]) & (F.col("at") < edges[1] if k < 2 else F.lit(True)))
        part.write.mode("append").parquet(f"{at}/rows")
        out = run_once(waiting.await_compactions(spark.readStream.schema(rows.schema).parquet(f"{at}/rows"), _PATIENCE, _SETTLE, by_event=True), to)
    return out


_FIX = f"""{_WASTE}, {_FOCUS}, {_STATE}, ps AS (SELECT *, CAST({_LEFT} AS BIGINT) AS ml FROM sp),
dd AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tokens DESC, rank) AS r FROM wr WHERE type = 'duplicate_read'),
da AS (SELECT s, count(*) AS n, string_agg(filename || ' (' || detail || ')', '; ' ORDER BY r) FILTER (r <= 10) AS a, string_agg(filename, ', ' ORDER BY r) FILTER (r <= 8) AS b FROM dd GROUP BY s)"""


@query(f"""WITH {EV}, {O.EVENTS}, {_FIX}
SELECT ps.s AS session_id, nullif(concat_ws(chr(10), 'In context already: ' || a, CASE WHEN ml > 0 AND ml < 20 THEN 'Messages until compaction: ' || ml END), '') AS session_prompt,
  nullif(concat_ws(chr(10), CASE WHEN da.n >= 2 THEN 'Key files: ' || b END, CASE WHEN n_compactions >= 2 THEN 'Clear the context between tasks.' END, 'Prompt tokens: 2000'), '') AS prompt_snippet,
  CASE WHEN pct >= 50 THEN coalesce(focus, CASE WHEN pct >= 70 THEN '/compact' END) END AS compact_command FROM ps LEFT JOIN da ON da.s = ps.s LEFT JOIN fo ON fo.s = ps.s LEFT JOIN st ON st.s = ps.s""")
def fix_prompts(spark, d):
    m, c, e, since = _live(spark, d)
    w = cut(W.detect_waste(c, m, since))
    return advice.fix_prompts(_state(m, c, since), w, advice.compact_focus(w), since, prompt=2000)


def _sizes(c):
    return c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


_HEALTH = "CASE WHEN pct < 50 THEN 'healthy' WHEN pct < 70 THEN 'warming' WHEN pct < 85 THEN 'hot' ELSE 'critical' END"
_ALL = "al AS (SELECT s, count(*) AS na FROM msg GROUP BY s)"


@query(f"""WITH {EV}, {O.EVENTS}, {_STATE}, {_ALL} SELECT sp.s AS session_id, CAST(floor(pct + 0.5) AS BIGINT) AS percent,
  concat_ws(' | ', {_HEALTH}, na || ' messages', coalesce(n_compactions, 0) || CASE WHEN coalesce(n_compactions, 0) = 1 THEN ' compaction' ELSE ' compactions' END) AS line FROM sp JOIN al ON al.s = sp.s LEFT JOIN st ON st.s = sp.s""")
def status_line(spark, d):
    m, c, e, since = _live(spark, d)
    return advice.status_line(_state(m, c, since), since, _sizes(c))


@query(f"""WITH {EV}, {O.EVENTS}, {_WASTE}, {_STATE}, {_ALL}, tt AS (SELECT s, CAST(coalesce(arg_max(eff, idx) FILTER (type = 'assistant' AND model <> '<synthetic>' AND eff > 0), sum(tok)) AS BIGINT) AS t FROM msg GROUP BY s), wc AS (SELECT s, count(*) AS n FROM wr GROUP BY s)
SELECT sp.s AS session_id, tt.t AS tokens_total, total AS tokens_current, pct AS usage_percentage, na AS message_count, coalesce(wc.n, 0) AS waste_count, coalesce(n_compactions, 0) AS compaction_count, CAST(lim AS BIGINT) AS context_limit
FROM sp JOIN al ON al.s = sp.s JOIN tt ON tt.s = sp.s LEFT JOIN wc ON wc.s = sp.s LEFT JOIN st ON st.s = sp.s""")
def bench_snapshots(spark, d):
    m, c, e, since = _live(spark, d)
    return R.snapshots(_state(m, c, since), _totals(c), W.detect_waste(c, m, since), since)


@query(f"""WITH {LOST}, b AS (SELECT s, max(idx) AS at_ FROM msg WHERE type = 'system' AND NOT cs GROUP BY s), c AS (SELECT m.s, arg_min(txt, idx) AS t FROM msg m JOIN b ON b.s = m.s AND m.cs AND idx > at_ GROUP BY m.s)
SELECT s AS session_id, regexp_extract(t, 'f[0-9]+.ts') AS refs FROM c""")
def summary_file_refs(spark, d):
    return R.summary_refs(event_messages(spark, d, summaries=True))


@query(f"""WITH {EV}, {O.EVENTS}, {_STATE}, {_ALL}, {O.CATS}, part AS (SELECT m.s, cat, tok FROM msg m LEFT JOIN st ON st.s = m.s WHERE idx >= coalesce(start_idx, 0)),
bk AS (SELECT g.s, c.category, c.ord, coalesce(sum(tok), 0) AS t FROM (SELECT DISTINCT s FROM part) g CROSS JOIN cats c LEFT JOIN part p ON p.s = g.s AND p.cat = c.category GROUP BY g.s, c.category, c.ord),
tc AS (SELECT s, category, t FROM bk QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC, ord) = 1)
SELECT sp.s AS session_id, total AS total_tokens, pct AS percent_used, na AS message_count, coalesce(n_compactions, 0) AS compaction_count, {_HEALTH} AS health, category AS top_category, CAST(tc.t AS BIGINT) AS top_category_tokens, CAST(lim AS BIGINT) AS context_limit
FROM sp JOIN al ON al.s = sp.s JOIN tc ON tc.s = sp.s LEFT JOIN st ON st.s = sp.s""")
def trend_records(spark, d):
    m, c, e, since = _live(spark, d)
    return R.trend_records(_state(m, c, since), C.buckets(K.slice_from(c, since)), since, _sizes(c))


@query("SELECT count(*) AS n_tools, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT unnest([250, 280, 280, 250, 200, 250, 250, 230, 280, 200, 230, 250, 200, 230, 230, 230, 200, 200, 200, 200, 200, 200, 230, 200, 250, 200, 200, 230, 230]) AS t UNION ALL SELECT 225 FROM range(11))")
def builtin_tools(spark, d):
    from ..sources.state import builtin_tools as tools

    return tools(spark).agg(F.count(F.lit(1)).alias("n_tools"), F.sum("tokens").alias("tokens"))


# --- logs as files ------------------------------------------------------------------


@query(f"WITH {O.CONV} SELECT 'p-' || (s % 3) || '/c' || (s // 3) AS session_id, idx, type, cat AS category, tok AS tokens FROM msg")
def jsonl_sessions(spark, d):
    """Conversations written as logs of three projects with equal file names, and read back; a progress
    row, a broken and an empty line stand in each."""
    from ..sources.logs import read_sessions
    from ..sources.sinks import write_sessions

    t = table(spark, d, "conversations")
    place = [F.concat(F.lit("p-"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.concat(F.lit("c"), F.floor(F.col("conv_id") / 3).cast("string")).alias("name")]
    said = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    turns = t.select(*place, (F.col("turn") * 2).cast("bigint").alias("pos"), said.alias("line"))
    noise = F.explode(F.array(F.lit('{"type":"progress"}'), F.lit('{"type":'), F.lit("")))
    other = t.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(*place, (F.col("turn") * 2 + 1).cast("bigint").alias("pos"), noise.alias("line"))
    base = shared_dir(spark)
    write_sessions(turns.unionByName(other), base).count()
    return C.classify(read_sessions(spark, f"{base}/*/*.jsonl")).select("session_id", "idx", "type", "category", "tokens")


@query(f"WITH {O.CONV} SELECT 'p-' || (s % 3) || '/c' || (s // 3) AS session_id, idx, type, cat AS category, tok AS tokens FROM msg")
def tail_sessions(spark, d):
    """Conversations as logs that grow in two steps, followed by a stream; the second step ends what the first left half written."""
    from ..sources.sinks import write_sessions
    from ..sources.tail import tail_messages
    from ..streaming.live import run_once

    t = table(spark, d, "conversations")
    said = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = cut(t.select(F.concat(F.lit("p-"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.concat(F.lit("c"), F.floor(F.col("conv_id") / 3).cast("string")).alias("name"), F.col("turn").cast("bigint").alias("pos"), said.alias("line")))
    middle = F.floor(F.count(F.lit(1)).over(Window.partitionBy("project", "name")) / 2)
    place = F.row_number().over(Window.partitionBy("project", "name").orderBy("pos")) - 1
    half = rows.withColumns({"middle": middle, "place": place}).filter("place <= middle")
    cut_off = half.withColumn("line", F.when(F.col("place") == F.col("middle"), F.expr("left(line, length(line) div 2)")).otherwise(F.col("line"))).drop("middle", "place")
    base, to = shared_dir(spark), shared_dir(spark)
    for step in (cut_off, rows):
        write_sessions(step, base, end_last=step is rows).count()
        found = run_once(tail_messages(spark, base), to)
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")) - 1).cast("bigint")
    return C.classify(found.withColumn("idx", place)).select("session_id", "idx", "type", "category", "tokens")


@query(f"""WITH {O.events(cumulative=True)}, {O.EVENTS}, {O.CATS}, c AS (SELECT m.s, idx, type, eff, sum(tok) OVER (PARTITION BY m.s ORDER BY idx) - tok AS before, coalesce(start_idx, 0) AS st0 FROM msg m LEFT JOIN st ON st.s = m.s),
p AS (SELECT *, lead(idx) OVER w AS ni, lead(eff) OVER w AS ne, lead(before) OVER w AS nb, row_number() OVER (PARTITION BY s ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY s) AS n FROM c WHERE type = 'assistant' AND eff > 0 AND idx >= st0 WINDOW w AS (PARTITION BY s ORDER BY idx)),
q AS (SELECT s, CAST(ne - eff - (nb - before) AS DOUBLE) / CAST(ni - idx AS DOUBLE) AS x FROM p WHERE n >= 3 AND ni IS NOT NULL AND back <= 21 AND ne > eff),
r AS (SELECT s, list_sort(list(x)) AS xs FROM q WHERE x BETWEEN 0 AND 50 GROUP BY s HAVING count(*) >= 3), fr AS (SELECT s, CAST(floor(xs[len(xs) // 2 + 1] + 0.5) AS BIGINT) AS f FROM r),
ip AS (SELECT s, arg_min(eff, idx) FILTER (type = 'assistant' AND u_in > 0) - 9831 - coalesce(arg_min(tok, idx) FILTER (type = 'user'), 0) AS t FROM msg GROUP BY s),
part AS (SELECT m.s, cat, tok + coalesce(f, 0) AS tok, 1 AS n, type <> 'assistant' OR coalesce(f, 0) > 0 AS est FROM msg m JOIN st ON st.s = m.s AND idx >= start_idx LEFT JOIN fr ON fr.s = m.s
  UNION ALL SELECT s, 'tools', 9055, 0, true FROM st UNION ALL SELECT s, 'state', 300, 0, true FROM st UNION ALL SELECT s, 'system', t, 0, true FROM ip WHERE t BETWEEN 1000 AND 15000 AND s IN (SELECT s FROM st)), {_BUCKETS}""")
def analyze_current_context(spark, d):
    """The whole analysis' view from the last compaction on: fixed costs, derived prompt and framing included."""
    from ..operators.analyze import analyze

    return analyze(event_messages(spark, d, cumulative=True), memory=300, cache=True).current


_OVER = """ip AS (SELECT s, arg_min(eff, idx) FILTER (type = 'assistant' AND u_in > 0) - 9831 - coalesce(arg_min(tok, idx) FILTER (type = 'user'), 0) AS t FROM msg GROUP BY s),
part AS (SELECT s, cat, tok, 1 AS n, type <> 'assistant' AS est FROM msg UNION ALL SELECT DISTINCT s, 'tools', 9055, 0, true FROM msg UNION ALL SELECT DISTINCT s, 'state', 300, 0, true FROM msg
  UNION ALL SELECT s, 'system', t, 0, true FROM ip WHERE t BETWEEN 1000 AND 15000)"""


@query(f"WITH {O.events(cumulative=True)}, {O.CATS}, {_OVER}, {_BUCKETS}")
def analyze_lifetime(spark, d):
    """The analysis' view of whole sessions: fixed costs and derived prompt, but nothing for each message."""
    from ..operators.analyze import analyze

    return analyze(event_messages(spark, d, cumulative=True), memory=300, cache=True).buckets


@query(f"WITH {EV}, {O.CATS}, {_OVER}, {_BUCKETS}")
def analyze_own_turn(spark, d):
    """Sessions that end with a run of the analyser: what asked for it, the call and its output do not count."""
    from ..functions import schema as S
    from ..operators.analyze import analyze

    m = event_messages(spark, d)
    n = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    call = F.to_json(F.struct(F.lit(f"{S.OWN_COMMANDS[0]} --json").alias("command")))

    def row(k: int, **fields):
        has = {"session_id": F.col("session_id"), "idx": F.col("n") + k} | fields
        return n.select(*(has.get(c, F.lit(None)).cast(t).alias(c) for c, t in [("session_id", "bigint"), *((f.name, f.dataType) for f in m.schema if f.name != "session_id")]))

    def block(**fields):
        kind = m.schema["blocks"].dataType.elementType
        return F.array(F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind)))

    user, tool = {"type": F.lit("user"), "role": F.lit("user")}, {"content_kind": F.lit("array")}
    ask = row(0, **user, content_kind=F.lit("string"), content_str=F.lit("what fills the window?"))
    run = row(1, type=F.lit("assistant"), role=F.lit("assistant"), **tool, blocks=block(type=F.lit("tool_use"), name=F.lit("Bash"), id=F.lit("own"), input_json=call))
    out = row(2, **user, **tool, blocks=block(type=F.lit("tool_result"), tool_use_id=F.lit("own"), content_kind=F.lit("string"), content_str=F.lit(f"{S.OWN_MARKS[0]}: 3 items")))
    return analyze(m.unionByName(ask).unionByName(run).unionByName(out), memory=300, cache=True).buckets


@query(f"""WITH {EV}, {O.EVENTS}, {_EFF}, {_LIM}, {_OVER}, sl AS (SELECT s, sum(tok) AS whole FROM part GROUP BY s), fx AS (SELECT s, sum(tok) AS fixed FROM part WHERE n = 0 GROUP BY s),
lv AS (SELECT m.s, count(*) AS n, sum(tok) AS own FROM msg m LEFT JOIN st ON st.s = m.s WHERE idx >= coalesce(start_idx, 0) GROUP BY m.s),
fm AS (SELECT m.s, idx, eff, sum(tok) OVER (PARTITION BY m.s ORDER BY idx) - tok AS before, type, coalesce(start_idx, 0) AS st0 FROM msg m LEFT JOIN st ON st.s = m.s),
fp AS (SELECT *, lead(idx) OVER w AS ni, lead(eff) OVER w AS ne, lead(before) OVER w AS nb, row_number() OVER (PARTITION BY s ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY s) AS n FROM fm WHERE type = 'assistant' AND eff > 0 AND idx >= st0 WINDOW w AS (PARTITION BY s ORDER BY idx)),
fq AS (SELECT s, CAST(ne - eff - (nb - before) AS DOUBLE) / CAST(ni - idx AS DOUBLE) AS x FROM fp WHERE n >= 3 AND ni IS NOT NULL AND back <= 21 AND ne > eff),
fr AS (SELECT s, list_sort(list(x)) AS xs FROM fq WHERE x BETWEEN 0 AND 50 GROUP BY s HAVING count(*) >= 3), ff AS (SELECT s, CAST(floor(xs[len(xs) // 2 + 1] + 0.5) AS BIGINT) AS f FROM fr),
du AS (SELECT s, CAST(floor((epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0 + 0.5) AS BIGINT) AS secs FROM msg GROUP BY s),
tt AS (SELECT s, coalesce(sum(tok) FILTER (cat IN ('tools', 'retrieved') AND type = 'assistant'), 0) AS a, coalesce(sum(tok) FILTER (cat IN ('tools', 'retrieved') AND type <> 'assistant'), 0) AS b, count(DISTINCT tname) AS u FROM msg GROUP BY s)
SELECT lv.s AS session_id, CAST(coalesce(effective, CASE WHEN st.s IS NULL THEN whole ELSE own + fixed + coalesce(f, 0) * lv.n END) AS BIGINT) AS total, CAST(lim AS BIGINT) AS context_limit, lv.n AS n_messages, CASE WHEN secs > 0 THEN secs END AS duration_seconds, CAST(a AS BIGINT) AS call_tokens, CAST(b AS BIGINT) AS result_tokens, u AS n_used
FROM lv JOIN sl ON sl.s = lv.s JOIN fx ON fx.s = lv.s JOIN ef ON ef.s = lv.s JOIN li ON li.s = lv.s JOIN du ON du.s = lv.s JOIN tt ON tt.s = lv.s LEFT JOIN st ON st.s = lv.s LEFT JOIN ff ON ff.s = lv.s""")
def analyze_totals(spark, d):
    """Window, size, duration and tools of every session with live messages; without usage the window is what is known of its content."""
    from ..operators.analyze import analyze

    a = analyze(event_messages(spark, d), memory=300, cache=True)
    return a.state.filter("n_messages > 0").select("session_id", "total", "context_limit", "n_messages").join(a.durations, "session_id").join(a.tools.select("session_id", "call_tokens", "result_tokens", "n_used"), "session_id")


@query(f"""WITH {EV}, {O.EVENTS}, {_EFF}, {_LIM}, sn AS (SELECT m.s, count(*) FILTER (idx >= coalesce(start_idx, 0)) AS n, sum(tok) FILTER (idx >= coalesce(start_idx, 0)) AS content FROM msg m LEFT JOIN st ON st.s = m.s GROUP BY m.s),
sp AS (SELECT sn.s, coalesce(effective, content) AS total, sn.n FROM sn JOIN ef USING (s))
SELECT CAST(s AS VARCHAR) AS session_id, CAST(total AS BIGINT) AS total, n AS n_messages, (SELECT count(*) FROM ev WHERE ev.s = sp.s) AS n_events, (SELECT count(*) FROM (SELECT DISTINCT cat FROM msg WHERE msg.s = sp.s)) AS n_filled FROM sp""")
def report_pages(spark, d):
    """A page for each session, written by tasks and read back: its window, its compactions and its filled categories."""
    from ..sources.sinks import page_lines, write_sessions

    m, c, e, since = _live(spark, d)
    filled = C.buckets(c).filter("n_messages > 0").select("session_id", "category", "percentage")
    sections = {"Window": (_state(m, c, since).select("session_id", "total", "n_messages"), []), "Compactions": (e.select("session_id", "before_idx", "tokens_dropped"), ["before_idx"]), "Categories": (filled, ["category"])}
    base = shared_dir(spark)
    write_sessions(page_lines(sections), base, suffix=".html").count()
    page = spark.read.text(f"{base}/pages/*.html", wholetext=True)
    rows = lambda h: F.regexp_count(F.regexp_extract("value", rf"(?s)<h2>{h}</h2>(.*?)</table>", 1), F.lit("<tr><td>"))
    # an unknown total is an empty cell
    window = lambda k: F.nullif(F.regexp_extract("value", r"<h2>Window</h2><table><tr>(?:<th>[^<]*</th>)*</tr>\s*<tr><td>(\d*)</td><td>(\d*)</td>", k), F.lit("")).cast("bigint")
    return page.select(F.regexp_extract("value", r"<h1>Session (\S+)</h1>", 1).alias("session_id"), window(1).alias("total"), window(2).alias("n_messages"), rows("Compactions").cast("bigint").alias("n_events"), rows("Categories").cast("bigint").alias("n_filled"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown FROM pages""")
def escaped_pages(spark, d):
    """Raw pages as they are shown within a report."""
    return table(spark, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("shown"))


@query(f"WITH {O.CONV} SELECT s AS session_id, idx, type, cat AS category, tok AS tokens FROM msg")
def json_round_trip(spark, d):
    """Classified rows written as JSON lines, the second time in place of the first, and read back."""
    from ..sources.sinks import to_json_lines

    c = C.classify(conversation_messages(spark, d)).select("session_id", "idx", "type", "category", "tokens")
    at = shared_dir(spark)
    to_json_lines(c.limit(0), at)
    to_json_lines(c, at)
    return spark.read.schema(c.schema).json(at)


_DOC_TOKENS = "CAST(ceil((length(text) + 1) / 4.0::DOUBLE) AS BIGINT)"


@query(f"""WITH dc AS (SELECT DISTINCT ON (doc_id) * FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL), pr AS (SELECT source, arg_min({_DOC_TOKENS}, doc_id) AS prompt, min(lang) AS l FROM dc GROUP BY source),
ln AS (SELECT source, doc_id, '[x](' || (doc_id % 2) || '/n' || (doc_id // 2) || '.md)' AS link, {_DOC_TOKENS} AS t FROM dc WHERE doc_id % 5 = 0),
mi AS (SELECT source, CAST(ceil(sum(length(link) + 1) / 4.0::DOUBLE) AS BIGINT) + sum(t) AS memory FROM ln GROUP BY source)
SELECT source AS project, prompt, CAST(coalesce(memory, 0) AS BIGINT) AS memory, CAST(180 AS BIGINT) AS skill_tokens, 'all,' || source AS servers, 'k1,k2,' || source AS skills FROM pr LEFT JOIN mi USING (source)""")
def project_configuration(spark, d):
    """Prompt, memory, server and skill files of a project for each source, written from the documents and read at once.
    Linked files lie in two folders under equal names."""
    from ..sources.configs import config_files, project_configs
    from ..sources.sinks import write_sessions

    t = table(spark, d, "documents").filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "source", "text")
    base, zero = shared_dir(spark), F.lit(0).cast("bigint")
    first = t.groupBy("source").agg(F.min_by("text", "doc_id").alias("line"))
    noted = t.filter("doc_id % 5 = 0")
    name = F.concat((F.col("doc_id") % 2).cast("string"), F.lit("/n"), F.floor(F.col("doc_id") / 2).cast("string"))
    folder = F.concat(F.col("source"), F.lit("/mem"))
    files = first.select(F.col("source").alias("project"), F.lit("PROMPT").alias("name"), zero.alias("pos"), "line")
    files = files.unionByName(noted.select(folder.alias("project"), F.lit("MEMORY").alias("name"), F.col("doc_id").alias("pos"), F.concat(F.lit("[x]("), name, F.lit(".md)")).alias("line")))
    files = files.unionByName(noted.select(F.concat(folder, F.lit("/"), (F.col("doc_id") % 2).cast("string")).alias("project"), F.concat(F.lit("n"), F.floor(F.col("doc_id") / 2).cast("string")).alias("name"), zero.alias("pos"), F.col("text").alias("line")))
    write_sessions(files, base, suffix=".md").count()
    own = first.select(F.col("source").alias("project"), F.lit("own").alias("name"), zero.alias("pos"), F.format_string('{"mcpServers": {"all": {}, "%s": {}}, "skills": {"k1": 1, "%s": 2}}', F.col("source"), F.col("source")).alias("line"))
    shared = spark.range(1).select(F.lit("all").alias("project"), F.lit("all").alias("name"), zero.alias("pos"), F.lit('{"mcpServers": {"all": {}}, "skills": ["k1", {"name": "k2"}]}').alias("line"))
    write_sessions(own.unionByName(shared), base, suffix=".json").count()
    at = lambda *x: F.concat(F.lit(f"{base}/"), *x)
    projects = first.select(F.col("source").alias("project"), F.array(at("source", F.lit("/PROMPT.md")), at("source", F.lit("/none.md"))).alias("prompt_paths"), at("source", F.lit("/mem")).alias("memory_dir"), at(F.lit("all/all.json")).alias("global_json"), at("source", F.lit("/own.json")).alias("project_json"))
    found = project_configs(projects, config_files(spark, base))
    return found.select("project", "prompt", "memory", "skill_tokens", F.array_join("servers", ",").alias("servers"), F.array_join("skills", ",").alias("skills"))


@query("""WITH r AS (SELECT source AS s, lang, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS docs FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang)
SELECT s AS source, '# Source ' || s || chr(10) || chr(10) || '## Languages' || chr(10) || chr(10) || '| lang | chars | docs |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || chars || ' | ' || docs || ' |', chr(10) ORDER BY lang) || chr(10) AS page FROM r GROUP BY s""")
def markdown_pages(spark, d):
    """A Markdown page for each source, written by tasks and read back."""
    from ..sources.sinks import MARKDOWN, page_lines, write_sessions

    t = table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("docs"))
    base = shared_dir(spark)
    write_sessions(page_lines({"Languages": (t, ["lang"])}, key="source", title="Source", style=MARKDOWN), base, suffix=".md").count()
    page = spark.read.text(f"{base}/pages/*.md", wholetext=True)
    return page.select(F.regexp_extract("value", "^# Source ([^\n]+)", 1).alias("source"), F.col("value").alias("page"))


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT s, epoch_ns(ts) // 1000000 AS t FROM msg WHERE eff IS NOT NULL AND CAST(eff AS DOUBLE) / 200000 * 100 >= 50),
r AS (SELECT s, min(t) AS t FROM h GROUP BY s UNION ALL SELECT r.s, min(h.t) AS t FROM r JOIN h ON h.s = r.s AND h.t >= r.t + 86400000 GROUP BY r.s, r.t) SELECT CAST(s AS VARCHAR) AS session_id, t AS ts_ms FROM r""")
def throttled_notes(spark, d):
    """Notes as a stream gives them in three batches: the gap to the last one is kept for each session."""
    from ..operators.tokens import effective_input
    from ..streaming.live import run_once, throttled

    m = event_messages(spark, d)
    turns = m.select("session_id", "idx", (F.unix_micros(F.to_timestamp("ts")) / 1000).cast("bigint").alias("ts_ms"), (effective_input() / 200_000 * 100).alias("percentage"))
    to, found = shared_dir(spark), []
    _in_thirds(spark, turns, lambda stream: found.append(run_once(throttled(stream, 50, 86_400_000), to)))
    return found[-1]


@query("SELECT conv_id, count(*) AS n_boundaries FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id")
def boundary_lines(spark, d):
    """Raw log lines that are boundary records; others only speak of them."""
    from ..streaming.live import boundary_lines as marks

    t = table(spark, d, "conversations")
    mark = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype")))
    said = F.to_json(F.struct(F.lit("user").alias("type"), F.lit("a compact_boundary").alias("text")))
    return marks(t.select("conv_id", F.when(F.col("turn") % 3 == 1, mark).otherwise(said).alias("value"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_boundaries"))


@query("SELECT 'c' || o_custkey AS file, o_orderdate::VARCHAR || '-' || o_orderkey AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::VARCHAR || '-' || o_orderkey DESC) > 3")
def surplus_backups(spark, d):
    """Backups beyond the three newest of each file."""
    from ..sources.state import surplus_backups as surplus

    o = table(spark, d, "orders")
    return surplus(o.select(F.concat(F.lit("c"), "o_custkey").alias("file"), F.concat(F.col("o_orderdate").cast("string"), F.lit("-"), "o_orderkey").alias("name")), keep=3)


@query("SELECT page_id, coalesce(html, '') AS html, url FROM pages")
def csv_round_trip(spark, d):
    """Pages with quotes, commas and line breaks written as CSV and read back."""
    from ..sources.sinks import to_csv

    at = shared_dir(spark)
    to_csv(table(spark, d, "pages").select("page_id", "html", "url"), at)
    back = spark.read.csv(at, header=True, quote='"', escape='"', multiLine=True, schema="page_id bigint, html string, url string", emptyValue="", nullValue="\0")
    return back.select("page_id", F.coalesce("html", F.lit("")).alias("html"), "url")


@query("SELECT 'c' || (conv_id // 3) AS session_id, 'p-' || (conv_id % 3) AS project, 'p-' || (conv_id % 3) || '/c' || (conv_id // 3) AS session_key, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def discovered_sessions(spark, d):
    """Logs below three project folders as a listing finds them, with the messages that a read by key gives each."""
    from ..sources.logs import discover_sessions, read_sessions
    from ..sources.sinks import write_sessions

    t = table(spark, d, "conversations")
    said = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    base = shared_dir(spark)
    write_sessions(t.select(F.concat(F.lit("p-"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.concat(F.lit("c"), F.floor(F.col("conv_id") / 3).cast("string")).alias("name"), F.col("turn").alias("pos"), said.alias("line")), base).count()
    n = read_sessions(spark, f"{base}/*/*.jsonl").groupBy(F.col("session_id").alias("session_key")).agg(F.count(F.lit(1)).alias("n_messages"))
    return discover_sessions(spark, base).select("session_id", "project", "session_key").join(n, "session_key")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS at, o_totalprice / 5000 AS percent, o_orderkey AS note, o_orderkey % 2 AS run
FROM orders WHERE o_orderkey % 7 <> 0""")
def injection_log(spark, d):
    """Notes logged in two runs, one of them twice; what lacks a field or is no record is skipped."""
    from ..sources.appends import AppendLog
    from ..sources.sinks import injection_records

    whole = F.col("o_orderkey") % 7 != 0
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("sessionId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), (F.col("o_totalprice") / 5000).alias("percentUsed"),
        F.when(whole, F.lit(50.0)).alias("threshold"), F.col("o_orderkey").cast("string").alias("text"),
    )
    log = AppendLog(shared_dir(spark))
    for run in (0, 1, 0):
        log.append(o.filter(F.col("o_orderkey") % 2 == run).orderBy("o_orderkey").drop("o_orderkey"), run, F.col("text").cast("bigint"))
    rows = injection_records(log.lines(spark))
    return rows.select(F.col("sessionId").alias("session_id"), F.col("timestamp").alias("at"), F.col("percentUsed").alias("percent"), F.col("text").cast("bigint").alias("note"), F.col("line.run").alias("run"))


@query("SELECT n_nationkey AS id, n_regionkey * 100 AS system_tools, n_nationkey * 7 AS messages, n_name AS label FROM nation")
def calibration_files(spark, d):
    """One settings document of several lines for each nation, written by tasks and read at once."""
    from ..sources.sinks import write_sessions
    from ..sources.state import read_json_file

    n = table(spark, d, "nation")
    body = F.format_string('{\n  "id": %s,\n  "buckets": {"system_tools": %s,\n    "messages": %s},\n  "label": "%s"\n}', F.col("n_nationkey").cast("string"), (F.col("n_regionkey") * 100).cast("string"), (F.col("n_nationkey") * 7).cast("string"), F.col("n_name"))
    base = shared_dir(spark)
    write_sessions(n.select(F.lit("calibration").alias("project"), F.col("n_name").alias("name"), F.lit(0).alias("pos"), body.alias("line")), base, suffix=".json").count()
    return read_json_file(spark, f"{base}/calibration", ("id", "buckets")).select("id", "buckets.system_tools", "buckets.messages", "label")
