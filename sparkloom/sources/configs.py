"""What the sessions of every project are loaded with: prompt, memory, server and skill files.

The files of all projects are listed and read once; each project says which paths it means, and a
path meets its file by equality of the whole path. One row comes out for each project, so a project
may have any number of linked files, and there may be any number of projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_len, strip_bom

#: Prompt files that count for a project, and tokens of a skill's description.
PROMPTS, SKILL_TOKENS = 3, 60


def bare_path(c: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def config_files(spark: SparkSession, *bases: str) -> DataFrame:
    """Rows (path, value) of the Markdown and JSON files below the folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,json}").load(list(bases))
    return found.select(bare_path(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("value"))


def _tokens(value: Column) -> Column:
    return F.ceil(js_len(value) / F.lit(4.0)).cast("bigint")


def _names(value: Column) -> tuple[Column, Column]:
    """Servers and skills of a settings file, as arrays; none where it is absent or broken."""
    none = F.array().cast("array<string>")
    text = strip_bom(value)
    servers = F.map_keys(F.from_json(F.get_json_object(text, "$.mcpServers"), "map<string,string>"))
    raw = F.get_json_object(text, "$.skills")
    listed = F.transform(F.from_json(raw, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    skills = F.when(raw.rlike(r"^\s*\["), listed).otherwise(F.map_keys(F.from_json(raw, "map<string,string>")))
    return F.coalesce(servers, none), F.coalesce(skills, none)


def project_configs(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (project, prompt, memory, skill_tokens, servers, skills).

    projects: (project, prompt_paths array, memory_dir, global_json, project_json); files: rows of ``config_files``.
    A file that is not there counts as empty; a link that is repeated counts again; a project's server or
    skill is hidden by a global one of its name."""
    sizes = files.select("path", _tokens(F.col("value")).alias("tokens"))
    prompts = projects.select("project", F.explode(F.slice("prompt_paths", 1, PROMPTS)).alias("p")).select("project", bare_path(F.col("p")).alias("path"))
    prompt = prompts.join(sizes, "path").groupBy("project").agg(F.sum("tokens").alias("prompt"))
    folder = projects.select("project", bare_path(F.col("memory_dir")).alias("folder"), F.concat(bare_path(F.col("memory_dir")), F.lit("/MEMORY.md")).alias("path"))
    index = folder.join(files, "path")
    links = index.select("project", "folder", F.explode(F.regexp_extract_all("value", F.lit(r"\[.*?\]\(([^)]+)\)"), F.lit(1))).alias("target"))
    linked = links.select("project", F.concat("folder", F.lit("/"), "target").alias("path")).join(sizes, "path").select("project", "tokens")
    memory = index.select("project", _tokens(F.col("value")).alias("tokens")).unionByName(linked).groupBy("project").agg(F.sum("tokens").alias("memory"))
    out = projects.select("project", bare_path(F.col("global_json")).alias("g_path"), bare_path(F.col("project_json")).alias("p_path"))
    for side in "gp":
        out = out.join(files.select(F.col("path").alias(f"{side}_path"), F.col("value").alias(side)), f"{side}_path", "left")
    (gs, gk), (ps, pk) = _names(F.col("g")), _names(F.col("p"))
    out = out.select("project", F.concat(gs, F.array_except(ps, gs)).alias("servers"), gk.alias("gk"), pk.alias("pk"))
    out = out.withColumn("skills", F.concat("gk", F.filter("pk", lambda x: ~F.array_contains("gk", x))))
    zero = F.lit(0).cast("bigint")
    out = out.join(prompt, "project", "left").join(memory, "project", "left")
    return out.select("project", F.coalesce("prompt", zero).alias("prompt"), F.coalesce("memory", zero).alias("memory"), (F.size("skills") * SKILL_TOKENS).cast("bigint").alias("skill_tokens"), "servers", "skills")
