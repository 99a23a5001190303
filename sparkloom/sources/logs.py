"""Session logs: JSON lines, one file for each session, below one folder for each project.

Files are split like any text, so a long log takes many tasks: a line's place is its block's
start in the file and its row in the block. Rows that no parser accepts are dropped and
counted. The position of a message is assigned after the row filter. A session is known by its
project and file name, as files of different projects may have one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import DROPPED_TYPES, KEPT_TYPES, SYNTHETIC
from ..functions.text import js_len, strip_bom

_CONTENT = "struct<role:string,content:string,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
_LINE = f"struct<type:string,subtype:string,message:{_CONTENT},model:string,isCompactSummary:boolean,isMeta:boolean,timestamp:string,compactMetadata:struct<trigger:string,preTokens:bigint>>"
_RAW_BLOCK = "struct<type:string,text:string,thinking:string,signature:string,name:string,input:string,id:string,tool_use_id:string,is_error:boolean,content:string>"


def _key(path: Column) -> Column:
    """project/name of a log file."""
    return F.regexp_extract(path, r"([^/]+/[^/]+)\.jsonl$", 1)


def discover_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Rows (session_id, project, session_key, path, modified_at, size_bytes), newest first; direct
    children of a project only. ``read_sessions`` names sessions by the key."""
    found = spark.read.format("binaryFile").load(f"{base}/*/*.jsonl").select("path", "modificationTime", "length")
    return found.select(
        F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project"),
        _key(F.col("path")).alias("session_key"),
        "path",
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size_bytes"),
    ).orderBy(F.desc("modified_at"), "path")


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("modified_at"), "path").limit(1)


def resolve_session(sessions: DataFrame, prefix: str | None = None, project: str | None = None) -> DataFrame:
    """The newest session whose id starts with the prefix, in projects whose name holds ``project``."""
    if project:
        sessions = sessions.filter(F.lower("project").contains(project.lower()))
    if prefix:
        sessions = sessions.filter(F.col("session_id").startswith(prefix))
    return latest_session(sessions)


def project_path(slug: str) -> str:
    """A folder name turned back into a path: X-- is a drive, -- and - are separators."""
    import re

    return re.sub(r"^([A-Za-z])--", r"\1:/", slug).replace("--", "/").replace("-", "/")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths).select(_key(F.col("_metadata.file_path")).alias("session_id"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("line_no"), F.col("value").alias("line"))
    return raw.filter(F.length(F.trim("line")) > 0)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Message rows from (session_id, line_no, line)."""
    rows = parse_records(lines)
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")) - 1).cast("bigint")
    return rows.select("session_id", place.alias("idx"), *(c for c in rows.columns if c not in ("session_id", "line_no")))


def parse_records(lines: DataFrame) -> DataFrame:
    """Message rows from (session_id, line_no, line), with line_no in place of idx: one line makes one row or none."""
    parsed = lines.select("session_id", "line_no", F.from_json("line", _LINE).alias("j"), F.expr("try_parse_json(line)").alias("v"))
    good = parsed.filter(F.col("v").isNotNull() & F.col("j.type").isNotNull())
    kept = good.filter(
        ~F.col("j.type").isin(*DROPPED_TYPES)
        & F.col("j.type").isin(*KEPT_TYPES)
        & ~((F.col("j.type") == "assistant") & F.coalesce(F.col("j.model") == SYNTHETIC, F.lit(False)))
    )
    is_string = F.expr("schema_of_variant(try_variant_get(v, '$.message.content', 'variant')) = 'STRING'")
    raw = F.col("j.message.content")
    kind = F.when(raw.isNull(), "none").when(F.coalesce(is_string, F.lit(False)), "string").otherwise("array")
    blocks = F.from_json(raw, f"array<{_RAW_BLOCK}>")

    def flat(b, with_sub: bool):
        kind_of = F.when(b["content"].isNull(), F.lit(None)).when(b["content"].rlike(r"^\s*\[\s*\{"), "array").otherwise("string")
        fields = [b[n].alias(n) for n in ("type", "text", "thinking", "signature", "name")]
        fields += [b["input"].alias("input_json"), b["id"].alias("id"), b["tool_use_id"].alias("tool_use_id"), b["is_error"].alias("is_error"), kind_of.alias("content_kind"), F.when(kind_of == "string", b["content"]).alias("content_str")]
        if with_sub:
            inner = F.from_json(b["content"], f"array<{_RAW_BLOCK}>")
            fields.append(F.when(kind_of == "array", F.transform(inner, lambda x: flat(x, False))).alias("sub"))
        else:
            fields.append(F.when(kind_of == "array", b["content"]).alias("sub_json"))
        return F.struct(*fields)

    return kept.select(
        "session_id",
        "line_no",
        F.col("j.type").alias("type"),
        F.col("j.subtype").alias("subtype"),
        F.col("j.message.role").alias("role"),
        F.col("j.message.model").alias("model"),
        F.col("j.model").alias("top_model"),
        kind.alias("content_kind"),
        F.when(kind == "string", raw).alias("content_str"),
        F.when(kind == "array", F.transform(blocks, lambda b: flat(b, True))).alias("blocks"),
        F.col("j.message.usage").alias("usage"),
        F.col("j.timestamp").alias("ts"),
        F.coalesce("j.isCompactSummary", F.lit(False)).alias("is_compact_summary"),
        F.coalesce("j.isMeta", F.lit(False)).alias("is_meta"),
        F.col("j.compactMetadata.preTokens").alias("pre_tokens"),
    )


def read_sessions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Message rows of the given log files."""
    return parse_lines(_lines(spark, paths))


def malformed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (session_id, n_malformed) of files with lines that are not JSON."""
    return _lines(spark, paths).filter(F.expr("try_parse_json(line)").isNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_malformed"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in any store that Spark reads."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


_FILE_TOKENS = "path string, tokens bigint"


def read_prompt_files(spark: SparkSession, paths: list[str], most: int = 3) -> DataFrame:
    """Rows (path, tokens) of the first ``most`` prompt files that exist; four characters make a token."""
    found = existing(spark, paths[:most])
    if not found:
        return spark.createDataFrame([], _FILE_TOKENS)
    text = spark.read.text(found, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.ceil(js_len(F.col("value")) / F.lit(4.0)).cast("bigint").alias("tokens"))


def read_memory(spark: SparkSession, folder: str, index: str = "MEMORY.md") -> DataFrame:
    """Rows (path, tokens) of a folder's index and of the linked files that exist; a repeated link counts again."""
    at = f"{folder}/{index}"
    if not existing(spark, [at]):
        return spark.createDataFrame([], _FILE_TOKENS)
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    read = lambda paths: spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.ceil(js_len(F.col("value")) / F.lit(4.0)).cast("bigint").alias("tokens"))
    main = read([at])
    links = memory_links(main.select("value"), "value").select(F.concat(F.lit(f"{folder}/"), "target").alias("linked"))
    found = existing(spark, sorted({r.linked for r in links.distinct().collect()}))  # one index file's links
    out = main.select("path", "tokens")
    # by the whole path, as files in two folders may have one name
    return out if not found else out.union(links.join(read(found), bare(F.col("linked")) == bare(F.col("path"))).select("path", "tokens"))


def gather_config(spark: SparkSession, prompt_paths: list[str], memory_dir: str, global_json: str, project_json: str) -> dict:
    """What a session is loaded with beside its messages: tokens of prompt files, memory, skills and
    built-in tools, and the names of servers and skills. Files that do not exist count as empty."""
    from .state import BUILTIN_TOOLS

    def whole(path: str) -> DataFrame:
        return spark.read.text(path, wholetext=True) if existing(spark, [path]) else spark.createDataFrame([], "value string")

    total = lambda df: df.agg(F.sum("tokens")).first()[0] or 0
    both = whole(global_json), whole(project_json)
    servers = [r["name"] for r in mcp_servers(*both).collect()]
    skilled = skills(*both).collect()
    return {
        "prompt": total(read_prompt_files(spark, prompt_paths)),
        "memory": total(read_memory(spark, memory_dir)),
        "builtin": sum(t for _, t in BUILTIN_TOOLS),
        "mcp": 0,  # schemas of servers are loaded when they are asked for
        "skill_tokens": sum(r["tokens"] for r in skilled),
        "servers": servers,
        "skills": [r["name"] for r in skilled],
    }


def memory_links(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one row for each markdown link target in the text, repeats included."""
    return df.withColumn("target", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[.*?\]\(([^)]+)\)"), F.lit(1))))


def mcp_servers(global_json: DataFrame, project_json: DataFrame) -> DataFrame:
    """Rows (name, source) of configured servers; a global one hides the project's."""

    def names(df: DataFrame, source: str) -> DataFrame:
        servers = F.from_json(F.get_json_object(strip_bom(F.col("value")), "$.mcpServers"), "map<string,string>")
        return df.select(F.explode(F.map_keys(servers)).alias("name"), F.lit(source).alias("source"))

    g = names(global_json, "global")
    p = names(project_json, "project")
    return g.unionByName(p.join(g.select("name"), "name", "left_anti").select("name", "source"))


def skills(global_json: DataFrame, project_json: DataFrame, tokens_each: int = 60) -> DataFrame:
    """Rows (name, source, tokens) of skills given as strings, named objects or object keys."""

    def names(df: DataFrame, source: str) -> DataFrame:
        raw = F.get_json_object(strip_bom(F.col("value")), "$.skills")
        listed = F.from_json(raw, "array<string>")
        named = F.transform(listed, lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
        keys = F.map_keys(F.from_json(raw, "map<string,string>"))
        return df.select(F.explode(F.when(raw.rlike(r"^\s*\["), named).otherwise(keys)).alias("name"), F.lit(source).alias("source"))

    g = names(global_json, "global")
    p = names(project_json, "project")
    both = g.unionByName(p.join(g.select("name").distinct(), "name", "left_anti").select("name", "source"))
    return both.withColumn("tokens", F.lit(tokens_each).cast("bigint"))
