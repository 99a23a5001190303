"""The canonical message row and the fixed dimensions of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORIES = ("conversation", "retrieved", "user", "system", "tools", "state")

SEVERITIES = ("high", "medium", "low", "info")

# Tools whose results count as retrieved.
RETRIEVAL_TOOLS = (
    "Read", "Grep", "Glob", "WebFetch", "WebSearch", "NotebookEdit",
    "FileReadTool", "GrepTool", "GlobTool", "WebFetchTool", "WebSearchTool", "NotebookEditTool",
)
READ_TOOLS = ("Read", "FileReadTool")
EDIT_TOOLS = ("Write", "Edit", "FileWriteTool", "FileEditTool", "NotebookEdit")
UNTRACKED_RESULTS = ("Read", "Grep", "Glob")

# Markers of state and of system content.
STATE_MARKERS = (
    "memdir/", "memdir\\", "extracted_memories", "memory_extraction", "plan_mode", "skill_metadata",
    "subagent_summary", "custom_agent",
)
SYSTEM_MARKERS = ("CLAUDE.md", "system-reminder", "system prompt", "You are Claude Code")

# Row types that are dropped when a log is read.
DROPPED_TYPES = ("file-history-snapshot", "progress", "last-prompt")
KEPT_TYPES = ("user", "assistant", "system")
SYNTHETIC = "<synthetic>"

# Phrases that close an exchange.
RESOLUTION_PHRASES = (
    "thanks", "thank you", "that works", "perfect", "great", "fixed", "solved", "got it", "looks good", "nice",
    "awesome", "exactly", "that did it", "working now",
)

#: What marks the analyser's own turn at the end of a session.
OWN_COMMANDS = ("sparkloom analyze", "sparkloom waste", "sparkloom timeline", "sparkloom list", "sparkloom calibrate", "sparkloom fix")
OWN_MARKS = ("sparkloom report",)

# Total of the built-in tools' schemas, skills' default, thresholds.
BUILTIN_SCHEMA_TOKENS = 9_055
DEFAULT_SKILL_TOKENS = 476
COMPACTION_DROP = 30_000
COMPACTION_SHARE = 0.8

# Paths that are noise when read, in order, with the rule each stands for.
NOISE_PATTERNS = (
    (r"(?i)(^|[\\/])node_modules[\\/]", "node_modules/"),
    (r"(?i)(^|[\\/])dist[\\/]", "dist/"),
    (r"(?i)(^|[\\/])build[\\/]", "build/"),
    (r"(?i)(^|[\\/])\.next[\\/]", ".next/"),
    (r"(?i)(^|[\\/])target[\\/]", "target/"),
    (r"(?i)(^|[\\/])\.git[\\/]", ".git/"),
    (r"(?i)(^|[\\/])(package-lock|bun|yarn|pnpm|cargo|poetry|pipfile)\.lock$", "*.lock"),
)

_FLAT = [
    ("type", "string"), ("text", "string"), ("thinking", "string"), ("signature", "string"), ("name", "string"),
    ("input_json", "string"), ("id", "string"), ("tool_use_id", "string"), ("is_error", "boolean"),
    ("content_kind", "string"), ("content_str", "string"),
]
SUB_BLOCK = "struct<" + ",".join(f"{n}:{t}" for n, t in _FLAT) + ",sub_json:string>"
BLOCK = "struct<" + ",".join(f"{n}:{t}" for n, t in _FLAT) + f",sub:array<{SUB_BLOCK}>>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"

#: session_id may have any orderable type; the other columns are fixed.
MESSAGE_COLUMNS = {
    "idx": "bigint", "type": "string", "subtype": "string", "role": "string", "model": "string", "top_model": "string",
    "content_kind": "string", "content_str": "string", "blocks": f"array<{BLOCK}>", "usage": USAGE, "ts": "string",
    "is_compact_summary": "boolean", "is_meta": "boolean", "pre_tokens": "bigint",
}


def message_schema(session_type: str = "string") -> T.StructType:
    return T.StructType.fromDDL(f"session_id {session_type}, " + ", ".join(f"{k} {v}" for k, v in MESSAGE_COLUMNS.items()))
