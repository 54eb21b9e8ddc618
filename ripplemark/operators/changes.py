"""Diff lines, member spans, and what a change to a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File kinds by path, first match first.
KINDS = (
    ("test", r"^tests/.*\.php$"), ("migration", r"^database/migrations/.*\.php$"), ("route", r"^routes/.*\.php$"), ("blade", r"^resources/views/.*\.blade\.php$"),
    ("php", r"^app/.*\.php$"), ("types", r"\.d\.ts$"), ("frontend", r"^resources/js/.*\.(ts|tsx|js|jsx|vue)$"),
)
#: Fixed value: how a comment line begins; an attribute isn't one.
COMMENT = r"^\s*(//|/\*|\*|#(?!\[))"


def file_kind(path: Column) -> Column:
    out = None
    for name, pattern in KINDS:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise("other")


def unescaped(path: Column) -> Column:
    """A path that git put in quotes, as it is: octal escapes are bytes of UTF-8, others characters; paths without quotes stay."""
    parts = F.regexp_extract_all(F.substr(path, F.lit(2), F.length(path) - 2), F.lit(r"\\(?:[0-7]{1,3}|.)|[^\\]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in (("n", "\n"), ("t", "\t"), ("r", "\r")) for x in pair])

    def as_hex(part: Column) -> Column:
        rest = F.substr(part, F.lit(2))
        octal = F.right(F.lpad(F.conv(rest, 8, 16), 2, "0"), F.lit(2))
        plain = lambda text: F.hex(F.encode(text, "UTF-8"))
        return F.when(~part.startswith("\\"), plain(part)).when(rest.rlike("^[0-7]"), octal).otherwise(plain(F.coalesce(F.element_at(known, rest), rest)))

    quoted = (F.length(path) >= 2) & path.startswith('"') & path.endswith('"')
    return F.when(quoted, F.unhex(F.array_join(F.transform(parts, as_hex), "")).cast("string")).otherwise(path)


def unquoted(path: Column) -> Column:
    """A diff header's path without its a/ or b/; /dev/null is null."""
    bare = unescaped(F.trim(F.regexp_replace(path, r"^\s+|\s+$", "")))
    return F.when(bare != "/dev/null", F.regexp_replace(bare, "^[ab]/", ""))


def _sections(diffs: DataFrame) -> DataFrame:
    """The lines of diffs (id, diff): n, raw, the number of the file's and of the hunk's first line, and what the file's header says.

    A hunk goes on until the next hunk or file begins, so in it a line that looks like a
    header is a changed line, and one that says that no newline follows is none.
    """
    lines = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("n", "raw"))
    order = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    begins = lambda prefix: F.col("raw").startswith(prefix)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    rows = lines.withColumn("file", F.coalesce(last(F.when(begins("diff --git "), F.col("n"))), F.lit(-1))).withColumn("at", last(F.when(begins("@@"), F.col("n"))))
    rows = rows.withColumn("inside", F.coalesce(F.col("at") > F.col("file"), F.lit(False)))
    whole = Window.partitionBy("id", "file")
    said = lambda prefix: F.max(F.when(~F.col("inside") & begins(prefix), F.substr("raw", F.lit(len(prefix) + 1)))).over(whole)
    rows = rows.withColumns({"minus": said("--- "), "plus": said("+++ "), "from_name": unescaped(said("rename from ")), "to_name": unescaped(said("rename to "))})
    headed = F.col("plus").isNotNull()
    path = F.when(headed, F.coalesce(unquoted(F.col("plus")), unquoted(F.col("minus")))).when(F.col("from_name").isNotNull(), F.col("to_name"))
    return rows.withColumns({
        "path": path, "old_path": F.coalesce(F.when(headed, unquoted(F.col("minus"))).otherwise(F.col("from_name")), path),
        "is_new": headed & F.coalesce(unquoted(F.col("minus")).isNull(), F.lit(False)),
    }).where("path is not null")


def diff_files(diffs: DataFrame) -> DataFrame:
    """id, path, old_path, is_new, hunks: the files of diffs, renames without a hunk too; a deleted file keeps its old path."""
    hunk = F.col("raw").startswith("@@").cast("long")
    files = _sections(diffs).groupBy("id", "path").agg(F.min_by("old_path", "n").alias("old_path"), F.min_by("is_new", "n").alias("is_new"), F.sum(hunk).alias("hunks"))
    return files.select("id", "path", "old_path", "is_new", "hunks")


def parse_diff(diffs: DataFrame) -> DataFrame:
    """id, path, old_path, is_new, side, line, text from (id, diff), unified with no context.

    Lines are numbered once; files and hunks are runs between header lines, carried down
    by windows over one diff.  A deleted file keeps its old path, and a new one has its own.
    """
    rows = _sections(diffs).where("inside")
    pattern = r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    side = F.when(F.col("raw").startswith("-"), "removed").when(F.col("raw").startswith("+"), "added")
    hunk = Window.partitionBy("id", "at")
    first = lambda k: F.max(F.when(F.col("n") == F.col("at"), F.coalesce(F.regexp_extract("raw", pattern, k).try_cast("int"), F.lit(0)))).over(hunk)
    rows = rows.withColumn("first_old", first(1)).withColumn("first_new", first(2)).withColumn("side", side).where("side is not null")
    nth = F.row_number().over(Window.partitionBy("id", "at", "side").orderBy("n")) - 1
    line = F.when(F.col("side") == "removed", F.col("first_old")).otherwise(F.col("first_new")) + nth
    return rows.select("id", "path", "old_path", "is_new", "side", line.alias("line"), F.substr("raw", F.lit(2)).alias("text"))


def readable_sides(files: DataFrame) -> DataFrame:
    """path, reading, seed: how each changed class file (path, old_path, is_new, added, removed, head, base) is read.

    ``renamed``: no line changed, only the name; the class of the old path is a seed.  ``coarse``: a
    side that must be there couldn't be read (head where lines were added, base where the file
    isn't new), so the whole class counts as changed.  Else ``members``.
    """
    renamed = (F.col("added") == 0) & (F.col("removed") == 0) & (F.col("old_path") != F.col("path"))
    unread = (F.col("head").isNull() & (F.col("added") > 0)) | (F.col("base").isNull() & ~F.col("is_new"))
    reading = F.when(renamed, "renamed").when(unread, "coarse").otherwise("members")
    return files.select("path", reading.alias("reading"), F.when(renamed, class_of_path(F.col("old_path"))).alias("seed"))


def class_of_path(path: Column, root: str = "App") -> Column:
    """The class, dotted, that a path below app/ names."""
    inner = F.replace(F.regexp_replace(F.regexp_replace(path, "^app/", ""), r"\.php$", ""), F.lit("/"), F.lit("."))
    return F.concat(F.lit(root + "."), inner)


def lines_in_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (path, side, line, text) with the member (path, side, kind, name, start, end) whose span holds them; a range join within a path."""
    at = spans.select("path", "side", "kind", "name", "start", "end")
    return lines.join(at, ["path", "side"]).where(F.col("line").between(F.col("start"), F.col("end")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def classify_members(lines: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """path, kind, name, change (added, modified, removed), cosmetic of the members that a diff touches.

    A member on both sides is modified if a line of its span changed; cosmetic if removed
    and added lines agree in order once white space is gone.
    """
    spans = base.withColumn("side", F.lit("removed")).unionByName(head.withColumn("side", F.lit("added")))
    hit = lines_in_spans(lines, spans).where(F.length(stripped(F.col("text"))) > 0)
    text = lambda side: F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("line", "text")))), lambda x: stripped(x["text"])))
    touched = hit.groupBy("path", "kind", "name").agg(text("removed").alias("before"), text("added").alias("after"))
    both = base.select("path", "kind", "name", F.lit(True).alias("was")).distinct().join(head.select("path", "kind", "name", F.lit(True).alias("is")).distinct(), ["path", "kind", "name"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("modified")
    out = both.join(touched, ["path", "kind", "name"], "left").where("was is null or is is null or before is not null")
    return out.select("path", "kind", "name", change.alias("change"), F.coalesce((change == "modified") & (F.col("before") == F.col("after")), F.lit(False)).alias("cosmetic"))


def class_level_changes(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """path of the files with a real change outside all members: white space and comment lines aside, and whatever the order."""
    inside = lines_in_spans(lines, spans).select("path", "side", "line").distinct()
    outer = lines.join(inside, ["path", "side", "line"], "left_anti").where(~F.col("text").rlike(COMMENT)).withColumn("text", stripped(F.col("text"))).where("text <> ''")
    kept = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("text"))))
    return outer.groupBy("path").agg(kept("removed").alias("a"), kept("added").alias("b")).where("a <> b").select("path")


def additive_settings(base: DataFrame, head: DataFrame) -> DataFrame:
    """model, kind, additive: whether every base entry (key, value) is unchanged in head."""
    old = base.groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"))
    same = base.join(head.select("model", "kind", "key", F.col("value").alias("now")), ["model", "kind", "key"], "left").where(F.col("value").eqNullSafe(F.col("now"))).groupBy("model", "kind").agg(F.count(F.lit(1)).alias("same"))
    return old.join(same, ["model", "kind"], "left").select("model", "kind", (F.col("n") == F.coalesce("same", F.lit(0))).alias("additive"))


def seeds_of_changes(changes: DataFrame, graph_nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """file, node, how: the nodes that each changed class file seeds walks from.

    ``changes``: file, fqcn, is_new, members (array of structs name, additive, resolvable).
    Precise seeds are resolvable members that aren't merely additive; a member that can't be
    resolved brings the class and all its members (``coarse``; ``coarse-dependencies`` leaves
    out the class).  With neither, the nodes defined in the file: entry points ``declared``.
    """
    m = changes.select("file", "fqcn", "is_new", F.explode_outer("members").alias("m")).select("file", "fqcn", "is_new", "m.name", "m.additive", "m.resolvable")
    real = m.where((~F.col("additive") | F.col("is_new")))
    node = graph_nodes.select("node", F.substring_index("node", "::", 1).alias("fqcn"))
    precise = real.where("resolvable").select("file", F.concat_ws("::", "fqcn", "name").alias("node")).join(graph_nodes, "node", "left_semi").select("file", "node")
    new = changes.where("is_new").join(node, "fqcn").select("file", "node")
    coarse = real.where("not resolvable").select("file", "fqcn").distinct().join(node, "fqcn").select("file", "fqcn", "node")
    members = coarse.where(F.col("node").contains("::"))
    bare = coarse.join(members.select("file", "fqcn").distinct(), ["file", "fqcn"], "left_anti")
    tag = lambda df, how: df.select("file", "node", F.lit(how).alias("how"))
    found = tag(precise.unionByName(new), "precise").unionByName(tag(coarse, "coarse")).unionByName(tag(members, "coarse-dependencies")).unionByName(tag(bare, "coarse-dependencies"))
    rest = changes.where(F.exists("members", lambda x: ~x["additive"]) | F.col("is_new")).select("file").join(found.select("file").distinct(), "file", "left_anti").join(meta.select("file", "node"), "file").join(graph_nodes, "node", "left_semi")
    entry = F.col("node").rlike("^(route|command|schedule)::")
    return found.unionByName(rest.select("file", "node", F.when(entry, "declared").otherwise("precise").alias("how"))).distinct()
