"""How a project is wired, read from PHP source: settings, container bindings, middleware aliases and groups.

One pass a file; what the rows mean together is relational.  A row is
(path, lane, owner, a, b, c, tokens), as in :mod:`ripplemark.sources.lanes`:

=========  ================================================================================
wired      a file that could be scanned, once
setting    owner = file of settings, a = path (null: the file; else ``.key.key``), b = open if it may hold
           other keys, or is no array, tokens = the classes that its value names
binding    owner = key in the container, a = abstract class, b = concrete class; each null if it can't be read
alias      owner = alias of a middleware, a = class, b = precedence, the least first
group      owner = group, a = a middleware's name as written, b = running or removed, c = place in the file
literal    a = a string of a file that declares groups
=========  ================================================================================
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import hazards
from ripplemark.plans.shared import write_table
from ripplemark.sources import lanes
from ripplemark.sources.lanes import Reader, Span
from ripplemark.sources.php import _CLOSE, _OPEN, Unparseable

# Calls that bind, properties that do, and where aliases and groups stand.
BINDS = ("bind", "singleton", "scoped", "bindIf", "singletonIf", "scopedIf")
BOUND = ("bindings", "singletons")
KERNEL, BOOTSTRAP = "app/Http/Kernel.php", "bootstrap/app.php"
OWN_GROUPS = ("web", "api")
NAMED_GROUPS = ("appendToGroup", "prependToGroup", "removeFromGroup", "replaceInGroup")
_SETTINGS = re.compile(r"^config/([^/]+)\.php$")
_CLASS_TEXT = re.compile(r"^\\?[\w\\]+$")


class Wiring(Reader):
    """The rows of one file."""

    def read(self) -> list[tuple]:
        self.scan()
        self.rows = []
        self.put("wired")
        if found := _SETTINGS.match(self.path):
            self.entries(found[1])
        if self.path.startswith("app/Providers/"):
            self.bindings()
        if self.path == KERNEL:
            self.kernel()
        if self.path == BOOTSTRAP:
            self.bootstrap()
        return self.rows

    # Spans.

    def until(self, k: int) -> Span:
        """From k to the semicolon that ends its statement."""
        end = k
        while end < len(self.t) and self.text(end) != ";":
            end = self.match(end) + 1 if self.text(end) in _OPEN else end + 1
        return k, end

    def opener(self, k: int) -> int:
        """The place of the bracket that the one at k closes; -1 if there is none."""
        depth = 0
        while k >= 0:
            depth += (self.text(k) in _CLOSE) - (self.text(k) in _OPEN)
            if depth == 0:
                return k
            k -= 1
        return -1

    def bare(self, span: Span) -> Span:
        """An argument without its name."""
        return (span[0] + 2, span[1]) if self.named(span) else span

    def class_constant(self, span: Span | None) -> str | None:
        found = self.constant(span)
        return found[0] if found is not None and found[1] == "class" else None

    def class_name(self, span: Span | None) -> str | None:
        """A class constant's class, or a string that can only name a class."""
        text = self.literal(span)
        if text is not None:
            return text.lstrip("\\") if "\\" in text and _CLASS_TEXT.match(text) else None
        return self.class_constant(span)

    def calls(self, a: int, b: int, names: tuple[str, ...]) -> Iterator[int]:
        """The places of methods' names where one of ``names`` is called."""
        for k in range(a, b):
            if self.text(k) in names and self.text(k - 1) == "->" and self.text(k + 1) == "(":
                yield k

    def declared_value(self, k: int) -> Span | None:
        return self.until(k + 2) if self.text(k + 1) == "=" else None

    # Settings.

    def returned_array(self) -> Span | None:
        """The first array that the file itself returns."""
        k = 0
        while k < len(self.t):
            word = self.text(k).lower()
            if word == "namespace":
                while self.text(k) not in ("{", ";", ""):
                    k += 1
            elif word == "return" and self.t[k][0] == "name":
                span = self.until(k + 1)
                if self.items(span) is not None:
                    return span
                k = span[1]
            elif word in _OPEN:
                k = self.match(k)
            k += 1
        return None

    def named_classes(self, a: int, b: int) -> list[str]:
        spans = ((k, k + 3) for k in range(a, b - 2) if self.text(k + 1) == "::")
        return sorted({c for s in spans if (c := self.class_constant(s)) is not None})

    def entries(self, file: str) -> None:
        """Each path that is sure to hold its value; what stands before a spread or a computed key isn't."""
        whole, span = self.named_classes(0, len(self.t)), self.returned_array()
        waiting: list[tuple[str | None, Span | None]] = [(None, span)]
        while waiting:
            path, span = waiting.pop()
            items, values = self.items(span), {}
            free = items is None
            for key, value, spread in items or []:
                text = None if spread else self.literal(key)
                if text is None:
                    free = True
                    values.clear()
                else:
                    values[text] = value
            self.put("setting", file, path, "open" if free else "closed", None, whole if path is None else self.named_classes(*span))
            waiting += [((path or "") + "." + text, value) for text, value in values.items() if "." not in text]

    # Bindings.

    def on_container(self, k: int) -> bool:
        """Whether the arrow at k follows ``$this->app``, ``$app`` or ``app()``."""
        if self.text(k - 1) == "$app":
            return True
        if self.text(k - 1) == "app":
            return self.text(k - 2) == "->" and self.text(k - 3) == "$this"
        if self.text(k - 1) != ")":
            return False
        called = self.opener(k - 1) - 1
        return self.text(called).lstrip("\\") == "app" and self.text(called - 1) not in ("->", "?->", "::", "new", "function")

    def bound(self, abstract: Span | None, concrete: Span) -> None:
        node, text = self.class_name(abstract), self.literal(abstract)
        key, to = node if text is None else text, self.class_name(concrete)
        if key is not None:
            self.put("binding", key, node, to)

    def bindings(self) -> None:
        for k in self.calls(0, len(self.t), BINDS):
            args = [self.bare(s) for s in self.arguments(k + 1)]
            if len(args) > 1 and self.on_container(k - 1):
                self.bound(args[0], args[1])
        for _, name, k in self.properties:
            before = k - 1
            while before >= 0 and self.text(before) not in (";", "{", "}") and self.text(before).lower() != "static":
                before -= 1
            if name in BOUND and self.text(before).lower() != "static":
                for key, value, _ in self.items(self.declared_value(k)) or []:
                    self.bound(key, value)

    # Middleware.

    def aliases(self, spans: list[Span], precedence: int) -> None:
        """Of an alias that is given again, the last is meant."""
        found = {}
        for span in spans:
            for key, value, _ in self.items(span) or []:
                alias, constant, text = self.literal(key), self.constant(value), self.literal(value)
                if alias is not None and (constant is not None or text is not None):
                    found[alias] = constant[0] if constant is not None else text.lstrip("\\")
        for alias, cls in found.items():
            self.put("alias", alias, cls, str(precedence))

    def member_of(self, group: str, span: Span | None, state: str) -> None:
        for name in self.middleware(span):
            self.put("group", group, name, state, str(len(self.rows)))

    def literals(self) -> None:
        for k in range(len(self.t)):
            if (text := self.literal((k, k + 1))) is not None:
                self.put("literal", None, text)

    def kernel(self) -> None:
        values = [(name, v) for _, name, k in self.properties if (v := self.declared_value(k)) is not None]
        self.aliases([v for name, v in values if name == "middlewareAliases"], 1)
        for name, value in values:
            for key, listed, _ in (self.items(value) or []) if name == "middlewareGroups" else []:
                if (group := self.literal(key)) is not None:
                    self.member_of(group, listed, "running")
        self.literals()

    def bootstrap(self) -> None:
        first = [s[0] for k in self.calls(0, len(self.t), ("alias",)) if (s := self.arguments(k + 1))]
        self.aliases([self.bare(s) for s in first], 0)
        for k in self.calls(0, len(self.t), ("withMiddleware",)):
            for a, b in (self.bare(s) for s in self.arguments(k + 1)):
                a += self.text(a).lower() == "static"
                if self.text(a).lower() == "function":
                    for call in self.calls(a, b, (*OWN_GROUPS, *NAMED_GROUPS)):
                        self.configured(self.text(call), self.arguments(call + 1))
        self.literals()

    def configured(self, call: str, args: list[Span]) -> None:
        """Events in the order in which they stand: the last that names a middleware decides."""
        if call in OWN_GROUPS:
            for span in args:
                word, value = (self.text(span[0]) if self.named(span) else "append"), self.bare(span)
                items = self.items(value) if word == "replace" else None
                if items is None:
                    self.member_of(call, value, "removed" if word == "remove" else "running")
                for key, new, _ in items or []:
                    self.member_of(call, key, "removed")
                    self.member_of(call, new, "running")
            return
        values = [self.bare(s) for s in args]
        group = self.literal(values[0]) if values else None
        if group is None:
            return
        leaves = call in ("removeFromGroup", "replaceInGroup")
        self.member_of(group, values[1] if len(values) > 1 else None, "removed" if leaves else "running")
        if call == "replaceInGroup" and len(values) > 2:
            self.member_of(group, values[2], "running")


def rows_of(path: str, source: str | None) -> list[tuple]:
    """The rows of one file; none where it can't be scanned."""
    try:
        return Wiring(path, source or "").read()
    except (Unparseable, IndexError):
        return []


def read(files: DataFrame) -> DataFrame:
    """The rows of files (path, source); other files than those that wire aren't scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, s in zip(b.column("path").to_pylist(), b.column("source").to_pylist(), strict=True) for r in rows_of(p, s)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 6 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "lane", "owner", "a", "b", "c", "tokens"])

    wires = F.col("path").rlike(_SETTINGS.pattern) | F.col("path").startswith("app/Providers/") | F.col("path").isin(KERNEL, BOOTSTRAP)
    return files.where(wires).select("path", "source").mapInArrow(run, lanes.SCHEMA)


def aliases(rows: DataFrame) -> DataFrame:
    """alias, cls, precedence."""
    return rows.where("lane = 'alias'").select(F.col("owner").alias("alias"), F.col("a").alias("cls"), F.col("b").cast("int").alias("precedence"))


def bindings(rows: DataFrame) -> DataFrame:
    """key, concrete of the registrations whose class can be read."""
    return rows.where("lane = 'binding' and b is not null").select(F.col("owner").alias("key"), F.col("b").alias("concrete"))


def binding_edges(rows: DataFrame) -> DataFrame:
    """From each abstract class to what it is bound to."""
    return rows.where("lane = 'binding' and a is not null and b is not null").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("binding").alias("type")).distinct()


def registry_edges(reads: DataFrame, rows: DataFrame, root: str = "App") -> DataFrame:
    """Edges of reads (reader, file, key_path; null: not enumerable) to classes of the project.

    A path that is sure to hold a value gives the classes that this value names.  Else the
    nearest of its parents that is known decides: a closed array hasn't got it, which gives nothing; an open
    one, or a value that is no array, gives every class of the file, as a fan-out.
    """
    own = F.filter("tokens", lambda c: c.startswith(root + "\\"))
    known = rows.where("lane = 'setting'").select(F.col("owner").alias("file"), F.coalesce("a", F.lit("")).alias("at"), (F.col("b") == "open").alias("free"), own.alias("classes"))
    parts = F.split("key_path", r"\.")
    # The path itself and all its parents; a read of the whole file has the file alone.
    starts = F.when(F.coalesce("key_path", F.lit("")) == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("."), F.array_join(F.slice(parts, 1, n), "."))))
    )
    asked = reads.select("reader", "file", "key_path").distinct().withColumn("steps", F.size(starts)).select("*", F.posexplode(starts).alias("step", "at"))
    nearest = asked.join(known, ["file", "at"]).groupBy("reader", "file", "key_path", "steps").agg(F.max_by(F.struct("step", "free", "classes"), "step").alias("n"))
    whole = F.coalesce("key_path", F.lit("")) == ""
    exact = ~whole & (F.col("n.step") == F.col("steps") - 1)
    hits = nearest.select("reader", "file", exact.alias("exact"), (whole | F.col("n.free")).alias("fan"), "n.classes")
    literal = hits.where("exact").select("reader", F.explode("classes").alias("target"), F.lit("config-registry").alias("type"))
    every = known.where("at = ''").select("file", F.explode("classes").alias("target"))
    fanout = hits.where("fan and not exact").select("reader", "file").join(every, "file").select("reader", "target", F.lit("config-registry-fanout").alias("type"))
    return literal.unionByName(fanout).select(F.col("reader").alias("source"), "target", "type").distinct()


def _guard(name: Column) -> Column:
    return F.when(hazards.guard_alias(name).isin(*hazards.GUARDS), F.concat(F.lit(hazards.MIDDLEWARE), hazards.guard_identity(name)))


def groups(rows: DataFrame) -> DataFrame:
    """path, grp, token, state of guards; a group without one has a null token."""
    events = rows.where("lane = 'group'").select("path", F.col("owner").alias("grp"), _guard(F.col("a")).alias("token"), F.col("b").alias("state"), F.col("c").cast("int").alias("at"))
    return events.groupBy("path", "grp", "token").agg(F.max_by("state", "at").alias("state"))


def _shared_files(base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the files that could be read on both sides."""
    a, b = (rows.where("lane = 'wired'").select("path") for rows in (base, head))
    return base.join(b, "path", "left_semi"), head.join(a, "path", "left_semi")


def _written(rows: DataFrame) -> DataFrame:
    return rows.where("lane = 'literal'").select("path", _guard(F.col("a")).alias("token")).where("token is not null").distinct()


def group_hazards(base: DataFrame, head: DataFrame) -> DataFrame:
    """Guards that groups lost between the rows of two snapshots, and limits that rose.

    A guard that head still writes, but in no group that can be read, hasn't been seen to leave
    (:func:`unread_groups`).
    """
    a, b = _shared_files(base, head)
    kept = _written(b).join(groups(b).select("path", "token"), ["path", "token"], "left_anti")
    return hazards.group_guard_lost(groups(a), groups(b), kept, ("path", "grp"))


def unread_groups(base: DataFrame, head: DataFrame) -> DataFrame:
    """path of the files whose groups couldn't be compared.

    Those without a group on either side that no longer write a guard, and those that write one, lost by a
    group, where no group can be read.
    """
    a, b = _shared_files(base, head)
    ga, gb = groups(a), groups(b)
    gone = _written(a).join(_written(b), ["path", "token"], "left_anti")
    shapeless = gone.join(ga.unionByName(gb), "path", "left_anti").select("path")
    lost = ga.where("state = 'running' and token is not null").join(gb.where("state = 'running'"), ["path", "grp", "token"], "left_anti")
    hidden = lost.join(_written(b), ["path", "token"], "left_semi").join(gb.select("path", "token"), ["path", "token"], "left_anti").select("path")
    return shapeless.unionByName(hidden).distinct()


def source_hazards(base: DataFrame, head: DataFrame) -> DataFrame:
    """All hazards between two snapshots of files (path, source), those of middleware groups included."""
    a, b = (write_table(read(side), "wiring") for side in (base, head))
    return lanes.source_hazards(base, head).unionByName(group_hazards(a, b).select(*hazards.HAZARD))
