"""Scalar text functions with the semantics of the message logs' producers.

Lengths count UTF-16 code units, white space is Unicode white space, empty strings count
as absent where a truthiness test is meant. All are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token.
CHARS_PER_TOKEN_TEXT = 4.0
CHARS_PER_TOKEN_CODE = 3.3
CHARS_PER_TOKEN_SUMMARY = 3.5

# Fixed value: what marks a text as code.
CODE_PATTERN = r"import |export |function |const |let |var |=>|[{}\[\]();]"

# Context windows.
DEFAULT_LIMIT = 200_000
LONG_LIMIT = 1_000_000

# Fixed value: file extensions that count as file references.
FILE_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "md", "mdx", "txt", "rst", "adoc", "json", "jsonl", "json5", "yaml",
    "yml", "toml", "ini", "env", "properties", "xml", "csv", "tsv", "lock", "html", "htm", "css", "scss", "sass",
    "less", "vue", "svelte", "astro", "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "py", "rb", "go", "rs",
    "java", "kt", "kts", "swift", "m", "mm", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "cs", "vb", "fs", "php",
    "scala", "clj", "lua", "r", "jl", "pl", "pm", "dockerfile", "tf", "tfvars", "hcl", "sql", "graphql", "gql",
    "proto", "svg", "png", "jpg", "jpeg", "gif", "webp", "ico", "pdf",
)

# Fixed value: the shape of a file reference.
FILE_REF = r"(?:[a-zA-Z]:[\\/]|\.{1,2}[\\/]|[\\/])?(?:[\w\-]+[\\/])*[\w\-][\w\-.]*\.[a-zA-Z][a-zA-Z0-9]{0,7}\b"

# Unicode white space and the byte order mark, as Java regex escapes.
WHITE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def js_len(c: Column) -> Column:
    """Length in UTF-16 code units; null counts as 0."""
    return F.coalesce(F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1), F.lit(0)).cast("bigint")


def js_round(c: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def absent_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def looks_like_code(c: Column) -> Column:
    return F.coalesce(c.rlike(CODE_PATTERN), F.lit(False))


def divisor(sample: Column) -> Column:
    """Characters per token of a text of this kind."""
    return F.when(looks_like_code(sample), F.lit(CHARS_PER_TOKEN_CODE)).otherwise(F.lit(CHARS_PER_TOKEN_TEXT))


def tokens_of(text: Column) -> Column:
    return F.ceil(js_len(text) / divisor(text)).cast("bigint")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def filename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def normal_path(path: Column) -> Column:
    return F.lower(slashed(path))


def one_line(text: Column, n: int) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def context_limit(model: Column) -> Column:
    """Window of a model id; ids that end in -1m or hold [1m] have the long one."""
    return F.when(F.coalesce(model.rlike(r"(?i)\[1m\]|-1m$"), F.lit(False)), F.lit(LONG_LIMIT)).otherwise(F.lit(DEFAULT_LIMIT)).cast("bigint")


def context_health(percent: Column) -> Column:
    return F.when(percent < 50, "healthy").when(percent < 70, "warming").when(percent < 85, "hot").otherwise("critical")


def is_tool_use_id(name: Column) -> Column:
    return name.rlike(r"^toolu_[a-zA-Z0-9]+(\.\w+)?$")


def key_terms(text: Column) -> Column:
    """The first twenty of: file-like names, called names, words of more than six letters."""
    files = F.regexp_extract_all(text, F.lit(r"[\w-]+\.\w{1,6}"), F.lit(0))
    called = F.regexp_extract_all(text, F.lit(rf"([a-zA-Z_]\w{{3,}})[{WHITE}]*\("), F.lit(1))
    words = F.transform(F.split(text, rf"[{WHITE}]+"), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    return F.slice(F.concat(files, called, F.filter(words, lambda w: F.length(w) > 6)), 1, 20)


def file_refs(text: Column) -> Column:
    """Distinct sorted file references with a known extension; versions are left out."""
    found = F.regexp_extract_all(text, F.lit(FILE_REF), F.lit(0))
    known = F.array(*(F.lit(x) for x in FILE_EXTENSIONS))

    def good(x: Column) -> Column:
        ext = F.lower(F.element_at(F.split(x, r"\."), -1))
        return (F.length(x) >= 3) & ~x.rlike(r"^\d+(?:\.\d+)+[\w\-]*$") & F.array_contains(known, ext)

    return F.array_sort(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), good)))


def csv_field(c: Column) -> Column:
    """A CSV field: quoted when it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n\r]'), quoted).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^\uFEFF", "")


def duration_seconds(first: Column, last: Column) -> Column:
    """Whole seconds between two ISO timestamps, null unless positive."""
    secs = js_round((F.unix_millis(F.to_timestamp(last)) - F.unix_millis(F.to_timestamp(first))) / F.lit(1000.0)).cast("bigint")
    return F.when(secs > 0, secs)
