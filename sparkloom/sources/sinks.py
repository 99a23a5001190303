"""Sinks: JSON lines, CSV, Markdown and HTML, and append-only logs."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .appends import ordered_lines
from .shared import cut


def to_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header each; fields are quoted only where they must be."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_sessions(lines: DataFrame, base: str, end_last: bool = True, suffix: str = ".jsonl") -> DataFrame:
    """Write rows (project, name, pos, line) as ``base``/project/name + ``suffix``; rows (path, n_lines).
    Without ``end_last`` a file's last line has no line break, as when it is still being written.

    A file is streamed by one task, in order, under a name of its attempt and renamed at the end."""
    src = lines.select("project", "name", "pos", "line").repartition("project", "name").sortWithinPartitions("project", "name", "pos")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(base)
        held, at, n, done = None, None, 0, []

        def close():
            if end_last:
                held.write(b"\n")
            held.close()
            store.move(f"{root}/{at[0]}/_try-{TaskContext.get().taskAttemptId()}-{at[1]}", f"{root}/{at[0]}/{at[1]}{suffix}")
            done.append((f"{base}/{at[0]}/{at[1]}{suffix}", n))

        for b in batches:
            for project, name, line in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if at != (project, name):
                    if held:
                        close()
                    at, n = (project, name), 0
                    store.create_dir(f"{root}/{project}", recursive=True)
                    held = store.open_output_stream(f"{root}/{project}/_try-{TaskContext.get().taskAttemptId()}-{name}", compression=None)
                held.write((f"\n{line}" if n else line).encode())
                n += 1
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "n_lines"])

    return src.mapInArrow(run, "path string, n_lines bigint")


def read_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows of an injection log (JSON lines), newest first; rows without all five fields are skipped."""
    return injection_records(ordered_lines(spark, path), limit)


def injection_records(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The same of (line, value), as of an ``AppendLog``."""
    j = F.from_json("value", "struct<sessionId:string,timestamp:string,percentUsed:double,threshold:double,text:string>")
    rows = lines.select("line", j.alias("j")).select("line", "j.*").dropna().orderBy(F.desc("line"))
    return rows.limit(limit) if limit is not None else rows


def fixed(x: float, digits: int) -> str:
    """A number with so many digits, halves of the exact binary value away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _cell(x) -> str:
    if x is None:
        return ""
    return fixed(x, 1) if isinstance(x, float) else str(x)


def _rows(df: DataFrame, rows: int | None):
    """The rows of a report as lists of cells, one partition at a time, and how many are left out."""
    shown = df if rows is None else df.limit(rows)
    left = 0 if rows is None else max(0, df.count() - rows)
    return ([_cell(x) for x in r] for r in shown.toLocalIterator()), left


def markdown_table(df: DataFrame, title: str, rows: int | None = None) -> str:
    """A report of all rows, or of the first ``rows`` with a note on the others."""
    got, left = _rows(df, rows)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in got]
    return "\n".join([*lines, *(["", f"{left} more rows"] if left else [])]) + "\n"


def text_table(df: DataFrame, rows: int | None = None) -> str:
    """Columns aligned for a terminal; numbers to the right."""
    got, left = _rows(df, rows)
    cells = [[x.replace("\n", " ") for x in r] for r in got]
    numeric = [t in ("int", "bigint", "double", "float") for _, t in df.dtypes]
    wide = [max(len(x) for x in col) for col in zip(df.columns, *cells)]
    line = lambda r: "  ".join(x.rjust(w) if n else x.ljust(w) for x, w, n in zip(r, wide, numeric)).rstrip()
    return "\n".join([line(df.columns), "  ".join("-" * w for w in wide), *map(line, cells), *([f"{left} more rows"] if left else [])]) + "\n"


def html_report(sections: dict[str, DataFrame], title: str, rows: int | None = None, notes: tuple[str, ...] = ()) -> str:
    """One page with a table for each section; a column named percentage is drawn as bars as well."""
    from html import escape

    style = "body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}.bar{background:#69c;height:8px}"
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>"]
    out += [f"<p>{escape(n)}</p>" for n in notes]
    for name, df in sections.items():
        got, left = _rows(df, rows)
        out.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        for r in got:
            bar = lambda c, x: f"<div class='bar' style='width:{min(100.0, float(x)):.1f}px'></div>" if c == "percentage" and x else ""
            out.append("<tr>" + "".join(f"<td>{escape(x)}{bar(c, x)}</td>" for c, x in zip(df.columns, r)) + "</tr>")
        out.append("</table>" + (f"<p>{left} more rows</p>" if left else ""))
    return "".join(out) + "</body></html>"


_STYLE = "body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}.bar{background:#69c;height:8px}"


@dataclass(frozen=True)
class Style:
    """How a page is written; {title}, {key}, {section} and {columns} are filled in, cells are joined by ``between``."""

    head: str
    section: str
    row: tuple[str, str, str]
    column: tuple[str, str]
    after: str
    foot: str | None


HTML = Style(f"<!doctype html><html><head><meta charset='utf-8'><title>{{title}} {{key}}</title><style>{_STYLE.replace(chr(123), chr(123) * 2).replace(chr(125), chr(125) * 2)}</style></head><body><h1>{{title}} {{key}}</h1>", "<h2>{section}</h2><table><tr>{columns}</tr>", ("<tr><td>", "</td><td>", "</td></tr>"), ("<th>", "</th>"), "</table>", "</body></html>")
MARKDOWN = Style("# {title} {key}", "\n## {section}\n\n|{columns}\n|{rules}", ("| ", " | ", " |"), (" ", " |"), "", None)


def page_lines(sections: dict[str, tuple[DataFrame, list[str]]], key: str = "session_id", project: Column | None = None, title: str = "Session", style: Style = HTML) -> DataFrame:
    """Rows (project, name, pos, line) of one page for each value of ``key``, for ``write_sessions``.

    Each section is a table with ``key`` and the columns its rows are sorted by; a key that a section lacks
    gets none of it. The first section has every key."""
    name = F.url_encode(F.col(key).cast("string"))
    folder = project if project is not None else F.lit("pages")
    none = F.array().cast("array<string>")
    escaped = html_escape if style is HTML else lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    def cell(c: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
        text = F.coalesce(F.call_function("format_number", F.col(c), F.lit("0.0")), F.lit(""))
        wide = F.call_function("format_number", F.least(F.col(c), F.lit(100.0)), F.lit("0.0"))
        bar = F.when(F.col(c) > 0, F.concat(F.lit("<div class='bar' style='width:"), wide, F.lit("px'></div>")))
        return F.concat(text, F.coalesce(bar, F.lit(""))) if c == "percentage" and style is HTML else text

    def sort_key(c: str, kind: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.lpad(text, 20, " ") if kind in ("int", "bigint") else text  # numbers sort by their padded text

    parts = []
    for k, (section, (df, order)) in enumerate(sections.items()):
        kinds = dict(df.dtypes)
        own = [(c, t) for c, t in df.dtypes if c != key]
        before, between, after = style.row
        row = F.concat(F.lit(before), *(x for i, (c, t) in enumerate(own) for x in ((F.lit(between),) if i else ()) + (cell(c, t),)), F.lit(after))
        head = style.section.format(section=section, columns="".join(f"{style.column[0]}{c}{style.column[1]}" for c, _ in own), rules="---|" * len(own))
        place = lambda step, sort: F.struct(F.lit(k).alias("section"), F.lit(step).alias("step"), sort.alias("sort")).alias("pos")
        ids = df.select(key).distinct()
        sort = F.array(*(sort_key(c, kinds[c]) for c in order)).cast("array<string>")
        edges = [(0, head)] + ([(2, style.after)] if style.after else [])
        parts += [ids.select(key, place(step, none), F.lit(text).alias("line")) for step, text in edges]
        parts.append(df.select(key, place(1, sort), row.alias("line")))
        if k == 0:
            outer = lambda at: F.struct(F.lit(at).alias("section"), F.lit(0).alias("step"), none.alias("sort")).alias("pos")
            said = F.replace(F.lit(style.head.format(title=title, key="{key}")), F.lit("{key}"), escaped(F.col(key).cast("string")))
            parts.append(ids.select(key, outer(-1), said.alias("line")))
            if style.foot:
                parts.append(ids.select(key, outer(len(sections)), F.lit(style.foot).alias("line")))
    lines = reduce(lambda x, y: x.unionByName(y), parts)
    return lines.select(folder.alias("project"), name.alias("name"), "pos", "line")


def session_pages(analysis, style: Style = HTML) -> DataFrame:
    """The lines of a page for each session: window, categories, live slice, waste, compactions, models and advice."""
    sections = {
        "Window": (analysis.state, []), "Categories": (analysis.buckets, ["category"]), "Since the last compaction": (analysis.current, ["category"]), "Waste": (analysis.waste, ["rank"]),
        "Compactions": (analysis.events, ["before_idx"]), "Models": (analysis.segments, ["segment"]), "Advice": (analysis.recommendations, ["position"]),
    }
    # written first, as each is read for its keys and for its rows
    return page_lines({k: (cut(df), order) for k, (df, order) in sections.items()}, style=style)


def comparison_pages(compared: DataFrame, insights: DataFrame, style: Style = HTML) -> DataFrame:
    """The lines of a page for each compared pair: what stands out, and the categories side by side."""
    pair = F.concat(F.col("session_a").cast("string"), F.lit(" and "), F.col("session_b").cast("string")).alias("pair")
    said = insights.select(pair, F.posexplode(F.split("insights", "\n")).alias("no", "insight"))
    rows = compared.select(pair, "category", "tokens_a", "tokens_b", "delta", "delta_percent")
    return page_lines({"Categories": (rows, ["category"]), "What stands out": (said, ["no"])}, key="pair", title="Comparison of", style=style)


def sparkline(values: list[float]) -> str:
    """Eight-level bars scaled to the values' own range."""
    bars = "▁▂▃▄▅▆▇█"
    lo, hi = min(values, default=0), max(values, default=0)
    return "".join(bars[int((v - lo) / (hi - lo) * 7 + 0.5) if hi > lo else 0] for v in values)
