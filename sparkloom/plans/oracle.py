"""DuckDB SQL shared by the oracles: the adapters' rows in flat form.

Each adapter row has at most one content block, so the flat columns say all:
s session, idx, type, tool (of a call), path, use (call id), res (answered call id), txt,
tok tokens, cat category, tname tool name, eff and usage parts, model, pre.
"""

from __future__ import annotations

CODE = r"import |export |function |const |let |var |=>|[{}\[\]();]"

#: conversations as messages
CONV = f"""
conv AS (SELECT conv_id AS s, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx, role AS type, text AS txt,
  CAST(ceil(length(text) / CASE WHEN regexp_matches(text, '{CODE}') THEN 3.3::DOUBLE ELSE 4.0::DOUBLE END) AS BIGINT) AS tok FROM conversations),
msg AS (SELECT conv.*, CASE WHEN type = 'system' THEN 'system'
  WHEN idx = 0 AND type = 'user' AND regexp_matches(txt, 'CLAUDE.md|system-reminder|system prompt|You are Claude Code') THEN 'system'
  WHEN type = 'user' AND idx = max(CASE WHEN type = 'user' THEN idx END) OVER (PARTITION BY s) THEN 'user'
  WHEN contains(txt, 'memdir/') OR contains(txt, 'memdir' || chr(92)) OR regexp_matches(txt, 'extracted_memories|memory_extraction|plan_mode|skill_metadata|subagent_summary|custom_agent') THEN 'state'
  ELSE 'conversation' END AS cat FROM conv)"""

CATS = "cats(category, ord) AS (VALUES ('conversation', 1), ('retrieved', 2), ('user', 3), ('system', 4), ('tools', 5), ('state', 6))"


def events(mcp: bool = False, markers: bool = True, path: str = "'src/f' || (k % 10) || '.ts'", cumulative: bool = False, summaries: bool = False) -> str:
    """The events adapter as the CTE ``msg``."""
    read, edit = ("'mcp__s' || (k % 4) || '__t'",) * 2 if mcp else ("'Read'", "'Edit'")
    boundary = "event_type = 'error' AND k < 5" if markers else "false"
    usage = "12000 + coalesce(sum(20 + k + k % 40) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if cumulative else "eff0 - (eff0 * k) // 100 - (eff0 - (eff0 * k) // 100) // 4"
    zero = cumulative
    return f"""
e0 AS (SELECT user_id AS s, event_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(round(value * 100) AS BIGINT) * 10 AS eff0,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events),
e1 AS (SELECT *, {boundary} AS b, event_type IN ('view', 'purchase') AS is_call,
  last_value(CASE WHEN event_type IN ('view', 'purchase') THEN 'u' || event_id END IGNORE NULLS) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS res0,
  last_value(CASE WHEN event_type = 'view' THEN {read} WHEN event_type = 'purchase' THEN {edit} END IGNORE NULLS) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rtool,
  {usage} AS u_in, {'0' if zero else '(eff0 - (eff0 * k) // 100) // 4'} AS u_cc, {'0' if zero else '(eff0 * k) // 100'} AS u_cr FROM e0),
e2 AS (SELECT s, idx, k, b, ts, event_type, eff0, is_call,
  CASE WHEN b THEN 'system' WHEN event_type IN ('view', 'purchase', 'signup') THEN 'assistant' ELSE 'user' END AS type,
  CASE WHEN event_type = 'view' THEN {read} WHEN event_type = 'purchase' THEN {edit} END AS tool,
  CASE WHEN is_call THEN {path} END AS path, CASE WHEN is_call THEN 'u' || event_id END AS use,
  CASE WHEN event_type = 'error' AND NOT b THEN res0 END AS res, CASE WHEN event_type = 'error' AND NOT b THEN rtool END AS rtool,
  event_type = 'error' AND NOT b AS is_res, event_type = 'click' AND k % 4 = 0 AND {str(summaries).lower()} AS cs,
  CASE WHEN event_type = 'click' THEN 'see f' || (k % 20) || '.ts' || CASE WHEN k % 8 = 0 THEN ' after edit' ELSE '' END WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN repeat('signed up and done, ', 3) ELSE 'signup' END WHEN event_type = 'error' AND NOT b THEN repeat('x', 10 * k) END AS txt,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(u_in AS BIGINT) END AS u_in, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(u_cc AS BIGINT) END AS u_cc,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(u_cr AS BIGINT) END AS u_cr, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 20 + k END AS u_out,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CASE WHEN k % 10 = 9 THEN '<synthetic>' ELSE ['model-a', 'model-b', 'model-c[1m]'][k % 3 + 1] END END AS model,
  CASE WHEN b THEN eff0 END AS pre FROM e1),
msg AS (SELECT *, u_in + u_cc + u_cr AS eff,
  CAST(CASE WHEN type = 'assistant' THEN 20 + k WHEN type = 'system' THEN 0 WHEN is_res THEN ceil((coalesce(length(res), 0) + length(txt)) / 4.0::DOUBLE) ELSE ceil(length(txt) / 4.0::DOUBLE) END AS BIGINT) AS tok,
  CASE WHEN is_call THEN tool WHEN is_res THEN rtool END AS tname,
  CASE WHEN type = 'system' OR cs THEN 'system' WHEN event_type = 'click' AND idx = max(CASE WHEN event_type = 'click' THEN idx END) OVER (PARTITION BY s) THEN 'user'
    WHEN is_call OR is_res THEN CASE WHEN coalesce(CASE WHEN is_call THEN tool ELSE rtool END, '') = 'Read' THEN 'retrieved' ELSE 'tools' END
    ELSE 'conversation' END AS cat FROM e2)"""


#: marker events, the heuristic, both, and the start of the live window
MARKERS = """
mk AS (SELECT a.s, a.idx AS before_idx, coalesce(min(c.idx), a.idx + 1) AS after_idx, a.pre AS tokens_before, coalesce(arg_min(c.eff, c.idx), 0) AS tokens_after
  FROM msg a LEFT JOIN msg c ON c.s = a.s AND c.type = 'assistant' AND c.idx > a.idx AND c.idx < a.idx + 10 WHERE a.type = 'system' GROUP BY a.s, a.idx, a.pre)"""
HEURISTIC = """
hc AS (SELECT s, idx, eff, lag(idx) OVER (PARTITION BY s ORDER BY idx) AS pi, lag(eff) OVER (PARTITION BY s ORDER BY idx) AS pe FROM msg WHERE type = 'assistant'),
hv AS (SELECT s, pi AS before_idx, idx AS after_idx, pe AS tokens_before, eff AS tokens_after FROM hc WHERE pe - eff > 30000)"""
EVENTS = f"""{MARKERS}, {HEURISTIC},
ev AS (SELECT *, 'marker' AS detection FROM mk UNION ALL SELECT *, 'heuristic' FROM hv WHERE s NOT IN (SELECT s FROM mk)),
st AS (SELECT s, arg_max(after_idx, before_idx) AS start_idx, count(*) AS n_compactions FROM ev GROUP BY s)"""
