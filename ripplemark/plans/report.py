"""Text, markdown, HTML and SVG reports of results that a caller has already bounded.

The renderers take plain rows (dicts).  :func:`bounded` takes them from a DataFrame, at
most LIST_CAP a list with the count of the rest: reading more than a page is no report.
"""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_CAP = 15
#: How editors are asked to open a file at a line.
EDITORS = {
    "vscode": "vscode://file/{file}:{line}", "phpstorm": "phpstorm://open?file={file}&line={line}", "sublime": "subl://open?url=file://{file}&line={line}",
    "cursor": "cursor://file/{file}:{line}", "idea": "idea://open?file={file}&line={line}",
}


def bounded(df: DataFrame, order: list, cap: int = LIST_CAP) -> tuple[list[dict], int]:
    """The first ``cap`` rows by ``order``, and how many there are in all."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).limit(cap).collect()], df.count()


def editor_link(editor: str | None, root: str, file: str, line: int | None) -> str | None:
    """The link that opens ``file``, or None for an unknown editor."""
    pattern = EDITORS.get(editor or "", editor if editor and "{file}" in editor else None)
    return pattern.format(file=f"{root.rstrip('/')}/{file}", line=line or 1) if pattern else None


def editor_links(editor: str | None, root: str, file: Column, line: Column) -> Column:
    """As :func:`editor_link`, for a column of files and one of lines (null: 1)."""
    pattern = EDITORS.get(editor or "", editor if editor and "{file}" in editor else None)
    if not pattern:
        return F.lit(None).cast("string")
    out = F.replace(F.lit(pattern), F.lit("{file}"), F.concat(F.lit(root.rstrip("/") + "/"), file))
    return F.replace(out, F.lit("{line}"), F.coalesce(line, F.lit(1)).cast("string"))


def exit_codes(failed: Column, determinable: Column) -> Column:
    """As :func:`exit_code`, for columns."""
    return F.when(failed, 1).when(determinable, 0).otherwise(2)


def label(node: str) -> str:
    """A command without its arguments; other nodes as they are."""
    return node.split(None, 1)[0] if node.startswith("command::") else node


def _more(total: int, shown: int) -> str | None:
    return f"… and {total - shown} more" if total > shown else None


def text(level: str, cause: str, sections: dict[str, tuple[list[str], int]]) -> str:
    """A plain report: the level with its cause, then each list, capped."""
    lines = [f"Risk: {level} — {cause}"]
    for title, (items, total) in sections.items():
        lines += ["", f"{title} ({total})"] + [f"  {i}" for i in items[:LIST_CAP]]
        if more := _more(total, min(len(items), LIST_CAP)):
            lines.append(f"  {more}")
    return "\n".join(lines) + "\n"


def markdown(level: str, cause: str, sections: dict[str, tuple[list[str], int]]) -> str:
    """The same with collapsed lists."""
    safe = lambda s: html.escape(s, quote=False).replace("|", "\\|").replace("`", "\\`")
    lines = [f"## Risk: **{level}**", "", safe(cause)]
    for title, (items, total) in sections.items():
        lines += ["", f"<details><summary>{safe(title)} ({total})</summary>", ""] + [f"- {safe(i)}" for i in items[:LIST_CAP]]
        if more := _more(total, min(len(items), LIST_CAP)):
            lines.append(f"- {more}")
        lines += ["", "</details>"]
    return "\n".join(lines) + "\n"


def svg(nodes: list[dict], size: int = 900) -> str:
    """A picture of laid-out nodes (node, depth, kind, x, y), with a ring for each depth."""
    rings = {n["depth"]: math.hypot(n["x"], n["y"]) for n in nodes}
    half = size / 2
    scale = (half - 40) / max([*rings.values(), 1])
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{-half:g} {-half:g} {size} {size}">'] + [f'<circle r="{r * scale:.1f}" class="ring"/>' for r in sorted(rings.values()) if r]
    for n in nodes:
        parts.append(f'<circle cx="{n["x"] * scale:.1f}" cy="{n["y"] * scale:.1f}" r="5" class="{html.escape(n["kind"])}"><title>{html.escape(label(n["node"]))}</title></circle>')
    return "\n".join([*parts, "</svg>"])


def page(title: str, level: str, cause: str, sections: dict[str, tuple[list[str], int]], picture: str = "") -> str:
    """One HTML page with a tab for each list; no script, no outside files."""
    tabs = []
    for k, (name, (items, total)) in enumerate([*sections.items(), *([("Diagram", ([], 0))] if picture else [])]):
        body = picture if name == "Diagram" and picture else "<ul>" + "".join(f"<li>{html.escape(i)}</li>" for i in items) + "</ul>"
        count = "" if name == "Diagram" and picture else f" ({total})"
        tabs.append(f'<input type="radio" name="tab" id="t{k}"{" checked" if not k else ""}><label for="t{k}">{html.escape(name)}{count}</label><section>{body}</section>')
    style = "section{display:none}input:checked+label+section{display:block}.ring{fill:none;stroke:#ccc}.entry{fill:#c33}.member{fill:#36c}.class{fill:#393}"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(level)}</h1><p>{html.escape(cause)}</p>{''.join(tabs)}"


def document(fields: dict, keep: tuple[str, ...]) -> str:
    """One JSON document with the kept fields, in their order; fields that are None are left out."""
    return json.dumps({k: fields[k] for k in keep if fields.get(k) is not None}, ensure_ascii=False)


def lines_of(rows: list[dict], *columns: str) -> list[str]:
    return ["  ".join(str(r[c]) for c in columns if r.get(c) is not None) for r in rows]


def exit_code(failed: bool, determinable: bool = True) -> int:
    """0: done; 1: the gate failed; 2: a selection can't be vouched for."""
    return 1 if failed else 0 if determinable else 2


def summary(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("diffs"))
