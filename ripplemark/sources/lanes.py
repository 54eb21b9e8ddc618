"""What the hazard lanes compare, read from PHP source: one pass a file.

The scan is Python; how guards are named, which of them a route runs, and every comparison is
relational (:mod:`ripplemark.operators.hazards`).  What can't be read in full gives no row: a
partial list would make removals up.  A row is (path, lane, owner, a, b, c, tokens):

=========  ================================================================================
read       a file that could be scanned; a = its first class
class      owner = class, a = its parent
member     owner = class, a = name (``$`` before a property), b = visibility,
           c = parameters of a method, tokens = what it is: method, property, constant, policy, queued, constructor
guard      owner = member, a = an ability that its body checks (null: the member is there), b = a middleware's name as written
body       owner = member, a = its tokens, of policies' methods and form requests' ``authorize``
rule       owner = member, a = field, b = rule (null: the field has none)
setting    owner = class, a = kind, b = key (null: an empty list), c = value
route      owner = member that the action names, a = verb, b = uri, tokens = middleware in order, ``+`` added or ``-`` taken away
op         owner = table, a = drop, dropColumn or renameColumn, b = column (null: not readable), c = its new name
=========  ================================================================================
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import hazards
from ripplemark.plans.shared import write_table
from ripplemark.sources.php import _CLOSE, _OPEN, Scanner, Unparseable

SCHEMA = "path string, lane string, owner string, a string, b string, c string, tokens array<string>"
# Calls that check an ability, by their receiver.
GATE_CHECKS = ("authorize", "allows", "denies", "check", "any", "none")
OWN_CHECKS = ("authorize", "authorizeForUser", "can", "cannot", "canAny")
USER_CHECKS = ("can", "cannot", "canAny")
# How routes are registered.
ACTION_VERBS = ("get", "post", "put", "patch", "delete", "options", "any")
NODE_VERBS = ("get", "post", "put", "patch", "delete", "options")
CONTROLLER_VERBS = ("resource", "apiResource", "singleton", "apiSingleton")
ACTIONLESS_VERBS = ("view", "redirect", "permanentRedirect")
REGISTRATIONS = (*ACTION_VERBS, *CONTROLLER_VERBS, *ACTIONLESS_VERBS, "match", "fallback")
# Settings of a model, the facade and the calls of a migration.
SETTINGS = ("fillable", "guarded", "hidden", "casts")
SCHEMA_FACADE = "Illuminate\\Support\\Facades\\Schema"
TABLE_DROPS = ("drop", "dropIfExists")
BLUEPRINTS = ("table", "create")

Span = tuple[int, int]


class Reader(Scanner):
    """The rows of one file."""

    def __init__(self, path: str, source: str):
        super().__init__(source)
        self.path, self.rows = path, []
        self.methods: list[tuple[str, str | None, str, int, int]] = []
        self.properties: list[tuple[str, str, int]] = []

    def put(self, lane: str, owner: str | None = None, a=None, b=None, c=None, tokens=None) -> None:
        self.rows.append((self.path, lane, owner, a, b, c, tokens))

    def read(self) -> list[tuple]:
        self.scan()
        classes = [f for f in self.facts if f[0] == "class"]
        self.put("read", a=classes[0][1] if classes else None)
        if self.path.startswith("app/"):
            self.declared(classes)
            for cls, parent, name, k, end in self.methods:
                self.guards(cls, name, k, end)
                self.rules(cls, name, k, end)
                if self.path.startswith("app/Policies/") or name == "authorize" and (parent or "").endswith("\\FormRequest"):
                    self.put("body", f"{cls}::{name}", " ".join(t[1] for t in self.t[k:end]))
        if self.path.startswith("app/Models/") and classes:
            self.settings(classes[0][1])
        if self.path.startswith("routes/"):
            self.statements(0, len(self.t), [])
        if self.path.startswith("database/migrations/"):
            self.operations()
        return self.rows

    # What the scanner meets on its way.

    def body(self, k: int, end: int, cls: str, parent: str | None, method: str) -> None:
        self.methods.append((cls, parent, method, k, end))

    def grouped(self, k: int, cls: str, fact: str) -> int:
        if fact == "property":
            self.properties.append((cls, self.text(k)[1:], k))
        before, after = len(self.facts), super().grouped(k, cls, fact)
        words, i = set(), k - 1
        while i >= 0 and self.text(i) not in (";", "{", "}"):
            words.add(self.text(i).lower())
            i -= 1
        if fact != "case":
            for f in self.facts[before:]:
                self.put("member", cls, ("$" if fact == "property" else "") + f[3], _visibility(words), None, [fact])
        return after

    # Spans of tokens.

    def parts(self, a: int, b: int) -> list[Span]:
        """What stands between the commas of a span."""
        out, depth, first = [], 0, a
        for i in range(a, b):
            depth += (self.text(i) in _OPEN) - (self.text(i) in _CLOSE)
            if depth == 0 and self.text(i) == ",":
                out.append((first, i))
                first = i + 1
        return [s for s in [*out, (first, b)] if s[1] > s[0]]

    def arguments(self, k: int) -> list[Span]:
        """The arguments in the bracket at k."""
        return self.parts(k + 1, self.match(k))

    def literal(self, span: Span | None) -> str | None:
        """The text of a span that is one string without variables."""
        if span is None or span[1] - span[0] != 1 or self.t[span[0]][0] != "string":
            return None
        text = self.text(span[0])
        if text[0] == "'":
            return text[1:-1].replace("\\'", "'").replace("\\\\", "\\")
        return None if text[0] != '"' or "$" in text else text[1:-1].replace('\\"', '"').replace("\\\\", "\\")

    def constant(self, span: Span | None, cls: str | None = None) -> tuple[str, str] | None:
        """Class and name of a span that is one class constant."""
        if span is None or span[1] - span[0] != 3 or self.text(span[0] + 1) != "::" or self.t[span[0]][0] != "name" or self.t[span[0] + 2][0] != "name":
            return None
        return self.resolve(self.text(span[0]), cls), self.text(span[0] + 2)

    def items(self, span: Span | None) -> list[tuple[Span | None, Span, bool]] | None:
        """(key, value, whether it is a spread) of a span that is one array; else null."""
        if span is None:
            return None
        a, b = span
        if self.text(a).lower() == "array" and self.text(a + 1) == "(":
            a += 1
        elif self.text(a) != "[":
            return None
        if self.match(a) != b - 1:
            return None
        out = []
        for first, last in self.parts(a + 1, b - 1):
            depth, arrow = 0, None
            if self.text(first).lower() not in ("fn", "static", "function"):
                for i in range(first, last):
                    depth += (self.text(i) in _OPEN) - (self.text(i) in _CLOSE)
                    if depth == 0 and self.text(i) == "=>":
                        arrow = i
                        break
            out.append(((first, arrow), (arrow + 1, last), False) if arrow is not None else (None, (first, last), self.text(first) == "."))
        return out

    def named(self, span: Span) -> bool:
        return self.t[span[0]][0] == "name" and self.text(span[0] + 1) == ":"

    def positional(self, args: list[Span], at: int) -> Span | None:
        """The argument at a place, if no argument is named: a name shifts every place."""
        return None if any(self.named(s) for s in args) or at >= len(args) else args[at]

    def called_on(self, k: int) -> str | None:
        """For the arrow at k: ``$this``, ``user()``, or null for another receiver."""
        if self.text(k - 1) == "$this":
            return "$this"
        if self.text(k - 1) != ")":
            return None
        depth, i = 0, k - 1
        while i >= 0:
            depth += (self.text(i) in _CLOSE) - (self.text(i) in _OPEN)
            if depth == 0:
                break
            i -= 1
        return "user()" if self.text(i - 1) == "user" and self.text(i - 2) in ("->", "?->", "::") else None

    # Members, guards, rules, settings.

    def declared(self, classes: list[tuple]) -> None:
        queued = {f[1] for f in self.facts if f[0] == "implements" and (f[3].endswith("\\ShouldQueue") or f[3] == "ShouldQueue")}
        for f in classes:
            self.put("class", f[1], f[4])
        for fact, cls, _, name, modifiers, params, *_ in self.facts:
            if fact == "method":
                visibility = _visibility(set(modifiers.split()))
                what = ["method"] + ["constructor"] * (name == "__construct") + ["queued"] * ("\\Jobs\\" in cls or cls in queued)
                what += ["policy"] * (self.path.startswith("app/Policies/") and visibility == "public" and name != "__construct")
                self.put("member", cls, name, visibility, params, what)
                self.put("guard", f"{cls}::{name}")

    def ability(self, call: str, args: list[Span], cls: str) -> str:
        first = args[0] if args else None
        if (text := self.literal(first)) is not None:
            return f"ability:{text}"
        found = self.constant(first, cls)
        return f"ability:{found[0]}::{found[1]}" if found else f"call:{call}"

    def guards(self, cls: str, method: str, k: int, end: int) -> None:
        member = f"{cls}::{method}"
        for i in range(k, end - 2):
            if self.text(i) not in ("::", "->", "?->") or self.text(i + 2) != "(":
                continue
            name, args = self.text(i + 1), self.arguments(i + 2)
            if len(args) == 1 and self.text(args[0][0]) == "." and args[0][1] - args[0][0] == 3:
                continue  # f(...) is no call
            if self.text(i) == "::":
                if name in GATE_CHECKS and self.t[i - 1][0] == "name" and self.resolve(self.text(i - 1), cls).endswith("\\Gate"):
                    self.put("guard", member, self.ability(name, args, cls))
                continue
            on = self.called_on(i)
            if name == "middleware" and on == "$this" and method == "__construct":
                first = args[0] if args else None
                values = [v for _, v, _ in self.items(first) or []] or ([first] if first else [])
                for text in map(self.literal, values):
                    if text is not None:
                        self.put("guard", member, None, text)
            elif on == "$this" and name in OWN_CHECKS or on == "user()" and name in USER_CHECKS:
                self.put("guard", member, self.ability(name, args, cls))

    def rules(self, cls: str, method: str, k: int, end: int) -> None:
        arrays = []
        if method == "rules" and self.text(k).lower() == "return" and self.text(end - 1) == ";":
            arrays.append(self.items((k + 1, end - 1)))
        for i in range(k, end - 2):
            if self.text(i + 2) != "(":
                continue
            if self.text(i) == "->" and self.text(i + 1) == "validate":
                arrays.append(self.items(self.positional(self.arguments(i + 2), int(self.text(i - 1) == "$this"))))
            elif self.text(i) == "::" and self.text(i + 1) == "make" and self.t[i - 1][0] == "name" and self.resolve(self.text(i - 1), cls).endswith("\\Validator"):
                arrays.append(self.items(self.positional(self.arguments(i + 2), 1)))
        fields: dict[str, list[str] | None] = {}
        for key, value, _ in [x for array in arrays for x in array or []]:
            if key is not None and (field := self.literal(key)) is not None:
                fields[field] = self.rule_names(value)
        for field, names in fields.items():
            for name in names or ([None] if names is not None else []):
                self.put("rule", f"{cls}::{method}", field, name)

    def rule_names(self, value: Span) -> list[str] | None:
        text, items = self.literal(value), self.items(value)
        if text is not None:
            texts = text.split("|")
        elif items is None or any(self.literal(v) is None for _, v, _ in items):
            return None
        else:
            texts = [self.literal(v) for _, v, _ in items]
        return list(dict.fromkeys(t.split(":", 1)[0].strip().lower() for t in texts))

    def plain(self, span: Span) -> str | None:
        """A key or a value that is a string, a number, a constant or a class constant."""
        if (text := self.literal(span)) is not None:
            return text
        if (found := self.constant(span)) is not None:
            return "::".join(found)
        return self.text(span[0]) if span[1] - span[0] == 1 and self.t[span[0]][0] in ("number", "name") else None

    def settings(self, first: str) -> None:
        found: dict[str, list[Span]] = {}
        for _, name, k in self.properties:
            if name in SETTINGS and self.text(k + 1) == "=":
                end, depth = k + 2, 0
                while depth or self.text(end) not in (",", ";"):
                    depth += (self.text(end) in _OPEN) - (self.text(end) in _CLOSE)
                    end += 1
                if self.items((k + 2, end)) is not None:
                    found.setdefault(name, []).append((k + 2, end))
        for _, _, name, k, end in self.methods:
            if name == "casts" and self.text(k).lower() == "return" and self.text(end - 1) == ";" and self.items((k + 1, end - 1)) is not None:
                found.setdefault("casts()", []).append((k + 1, end - 1))
        for kind, spans in found.items():
            if len(spans) != 1:
                continue  # several classes declare it
            entries = self.items(spans[0])
            pairs = [(self.plain(key or value), self.plain(value)) for key, value, _ in entries]
            if any(spread for _, _, spread in entries) or any(None in pair for pair in pairs):
                continue
            for key, value in dict(pairs).items() or [(None, None)]:
                self.put("setting", first, kind, key, value)

    # Routes.

    def statements(self, k: int, end: int, outer: list[str]) -> None:
        """Routes of the statements in a span, those below a condition or a loop too."""
        while k < end:
            word = self.text(k).lower()
            if word in ("if", "elseif", "foreach", "while", "for", "catch") and self.text(k + 1) == "(":
                k = self.match(k + 1) + 1
            elif word in ("else", "try", "finally", "do", "{", "}", ";", ":") or word.startswith("end"):
                k += 1
            elif word in ("switch", "function", "class", "interface", "trait", "enum", "abstract", "final") and self.text(k + 1) != "::":
                while k < end and self.text(k) not in ("{", ";"):
                    k = self.match(k) + 1 if self.text(k) in _OPEN else k + 1
                k = self.match(k) + 1 if self.text(k) == "{" else k + 1
            else:
                last = k
                while last < end and self.text(last) != ";":
                    last = self.match(last) + 1 if self.text(last) in _OPEN else last + 1
                self.chain(k, last, outer)
                k = last + 1

    def chain(self, k: int, end: int, outer: list[str]) -> None:
        """One chain of calls that begins at the Route facade, its middleware in the order of the calls."""
        if self.t[k][0] != "name" or self.text(k + 1) != "::" or not self.resolve(self.text(k)).endswith("\\Route"):
            return
        calls, i = [], k + 1
        while i < end and self.text(i) in ("::", "->") and self.text(i + 2) == "(":
            calls.append((self.text(i + 1), self.arguments(i + 2)))
            i = self.match(i + 2) + 1
        if i != end:
            return
        events, group, registered = list(outer), None, None
        for name, args in calls:
            if name in ("middleware", "withoutMiddleware"):
                sign = "+" if name == "middleware" else "-"
                events += [sign + m for m in self.middleware(args[0] if args else None)]
            elif name in REGISTRATIONS:
                registered = registered or (name, args)
            elif name == "group":
                group = args
                for key, value, _ in self.items(args[0]) or [] if args else []:
                    if key is not None and self.literal(key) == "middleware":
                        events += ["+" + m for m in self.middleware(value)]
                        break
        if group is not None:
            self.group(group, events)
        elif registered is not None:
            self.registered(*registered, events)

    def middleware(self, span: Span | None) -> list[str]:
        """Names of middleware as written; a framework guard built by a static call with its parameters, if all of them are plain."""
        if span is None:
            return []
        items, out = self.items(span), []
        for value in [span] if items is None else [v for _, v, _ in items]:
            built = value[1] - value[0] > 3 and self.text(value[0] + 1) == "::" and self.text(value[0] + 3) == "(" and self.match(value[0] + 3) == value[1] - 1
            if (text := self.literal(value)) is not None:
                out.append(text)
            elif (found := self.constant(value)) is not None:
                out.append(found[0])
            elif built and (alias := hazards.GUARD_CLASSES.get(self.resolve(self.text(value[0])))):
                args = self.arguments(value[0] + 3)
                texts = [None if self.named(s) else self.parameter(s) for s in args]
                out.append(alias if not texts or None in texts else f"{alias}:{','.join(texts)}")
        return out

    def parameter(self, span: Span) -> str | None:
        found = self.constant(span)
        if found is not None:
            return found[0] if found[1].lower() == "class" else None
        return self.text(span[0]) if span[1] - span[0] == 1 and self.t[span[0]][0] == "number" else self.literal(span)

    def group(self, args: list[Span], events: list[str]) -> None:
        """The routes in a group's closure; a group that loads another file stands for that file's routes."""
        for a, b in args:
            at = a + (self.text(a).lower() == "static")
            word = self.text(at).lower()
            if word == "function":
                while self.text(at) != "{":
                    at = self.match(at) + 1 if self.text(at) == "(" else at + 1
                return self.statements(at + 1, self.match(at), events)
            if word == "fn":
                while self.text(at) != "=>":
                    at = self.match(at) + 1 if self.text(at) == "(" else at + 1
                return self.chain(at + 1, b, events)
        if args:
            loads = self.literal(args[0])
            loads = "".join(t[1] for t in self.t[args[0][0] : args[0][1]]) if loads is None else loads
            self.put("route", f"route group {loads}", "group", loads, None, events)
        return None

    def registered(self, verb: str, args: list[Span], events: list[str]) -> None:
        at = 1 if verb == "match" else 0
        uri = "/{fallback}" if verb == "fallback" else self.literal(args[at]) if len(args) > at else None
        if uri is None:
            return
        place = {"match": 2, "fallback": 0}.get(verb, 1)
        action = args[place] if verb not in ACTIONLESS_VERBS and place < len(args) else None
        member, pair = None, self.items(action)
        if pair is not None and len(pair) > 1:
            found, method = self.constant(pair[0][1]), self.literal(pair[1][1])
            member = f"{found[0]}::{method}" if found and method is not None else None
        elif (found := self.constant(action)) is not None:
            member = found[0] + ("" if verb in CONTROLLER_VERBS else "::__invoke")
        node = f"route::{verb.upper()}::{uri}" if verb in NODE_VERBS else f"route {verb} {uri}"
        self.put("route", member or node, verb, uri, None, events)

    # Migrations.

    def operations(self) -> None:
        """What the one ``up`` method of a migration drops or renames; ``down`` undoes it and isn't read."""
        at = [k for k in range(len(self.t)) if self.text(k).lower() == "function" and self.text(k + 1 + (self.text(k + 1) == "&")) == "up"]
        if len(at) != 1:
            return
        k = self.match(at[0] + 2 + (self.text(at[0] + 1) == "&")) + 1
        while self.text(k) not in ("{", ";"):
            k += 1
        if self.text(k) == ";":
            return
        found: dict[tuple, None] = {}
        for i in range(k, self.match(k)):
            if self.text(i) != "::" or self.text(i + 2) != "(" or self.t[i - 1][0] != "name" or self.resolve(self.text(i - 1)) != SCHEMA_FACADE:
                continue
            name, args = self.text(i + 1), self.arguments(i + 2)
            table = self.literal(args[0] if args else None)
            if table is not None and name in TABLE_DROPS:
                found[(table, "drop", None, None)] = None
            elif table is not None and name in BLUEPRINTS and len(args) > 1:
                found |= dict.fromkeys(self.blueprint(table, args[1]))
        for table, op, column, to in found:
            unread = column is not None and not isinstance(column, str)
            self.put("op", table, op, None if unread else column, to)

    def blueprint(self, table: str, span: Span) -> list[tuple]:
        """(table, op, column, new name) of the calls on a closure's first parameter; a column that can't be read by its place."""
        at = span[0] + (self.text(span[0]).lower() == "static")
        if self.text(at).lower() not in ("function", "fn"):
            return []
        at += 1 + (self.text(at + 1) == "&")
        first = self.arguments(at)[:1]
        names = [self.text(i) for i in range(*first[0]) if self.t[i][0] == "var"] if first else []
        out: list[tuple] = []
        for i in range(at, span[1] - 2):
            if not names or self.text(i) != "->" or self.text(i - 1) != names[0] or self.text(i - 2) in ("->", "?->", "::") or self.text(i + 2) != "(":
                continue
            args = self.arguments(i + 2)
            if self.text(i + 1) == "dropColumn":
                values = [v for s in args for v in ([x[1] for x in self.items(s)] if self.items(s) is not None else [s])]
                if any(self.text(s[0]) == "." and s[1] - s[0] == 3 for s in args):
                    continue
                out += [(table, "dropColumn", place if (text := self.literal(v)) is None else text, None) for place, v in enumerate(values)]
            elif self.text(i + 1) == "renameColumn" and len(args) > 1:
                old, new = self.literal(args[0]), self.literal(args[1])
                if old is not None and new is not None:
                    out.append((table, "renameColumn", old, new))
        return out


def _visibility(words: set[str]) -> str:
    return next((w for w in ("private", "protected") if w in words), "public")


def rows_of(path: str, source: str | None) -> list[tuple]:
    """The rows of one file; none where it can't be scanned."""
    try:
        return Reader(path, source or "").read()
    except (Unparseable, IndexError):
        return []


def read(files: DataFrame) -> DataFrame:
    """The rows of files (path, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, s in zip(b.column("path").to_pylist(), b.column("source").to_pylist(), strict=True) if p is not None for r in rows_of(p, s)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 6 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "lane", "owner", "a", "b", "c", "tokens"])

    return files.select("path", "source").mapInArrow(run, SCHEMA)


def snapshots(base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides, without the files that can't be compared.

    A file that only head has lost nothing; only a migration's operations are taken from it.  A file gone from head
    is compared with nothing.  A file that one side has but couldn't scan, or in which a side
    that isn't empty declares no class (routes and migrations aside), is left out of both.
    """
    # Scanned once: every lane asks them.
    a, b = (write_table(read(side), "lanes") for side in (base, head))
    free = F.col("path").startswith("routes/") | F.col("path").startswith("database/migrations/")
    fine = lambda rows: rows.where("lane = 'read'").where(free | F.col("a").isNotNull()).select("path")
    held = lambda files: files.where(F.col("source").isNotNull() & (F.length("source") > 0)).select("path")
    odd = held(base).join(fine(a), "path", "left_anti").unionByName(held(head).join(fine(b), "path", "left_anti")).distinct()
    fresh = held(head).join(held(base), "path", "left_anti")
    a, b = a.join(odd, "path", "left_anti"), b.join(odd, "path", "left_anti")
    return a, b.join(fresh.where(~F.col("path").startswith("database/migrations/")), "path", "left_anti")


def _has(what: str) -> Column:
    return F.array_contains("tokens", what)


def members(rows: DataFrame) -> DataFrame:
    """cls, name, visibility, params, queued, constructor, policy, kind."""
    kind = F.when(_has("method"), "method").when(_has("property"), "property").otherwise("constant")
    return rows.where("lane = 'member'").select(
        F.col("owner").alias("cls"), F.col("a").alias("name"), F.col("b").alias("visibility"), F.col("c").alias("params"), *[_has(w).alias(w) for w in ("queued", "constructor", "policy")], kind.alias("kind")
    )


def classes(rows: DataFrame) -> DataFrame:
    """cls, policy: whether the file is a policy's."""
    return rows.where("lane = 'class'").select(F.col("owner").alias("cls"), F.col("path").startswith("app/Policies/").alias("policy"))


def guards(rows: DataFrame) -> DataFrame:
    """member, token; a member that checks nothing has one null token."""
    named = F.when(hazards.guard_alias(F.col("b")).isin(*hazards.GUARDS), F.concat(F.lit(hazards.MIDDLEWARE), hazards.guard_identity(F.col("b"))))
    return rows.where("lane = 'guard'").select(F.col("owner").alias("member"), F.coalesce("a", named).alias("token")).distinct()


def bodies(rows: DataFrame) -> DataFrame:
    """member, body, in lower case."""
    return rows.where("lane = 'body'").select(F.col("owner").alias("member"), F.lower("a").alias("body"))


def rules(rows: DataFrame) -> DataFrame:
    """request, field, rule; a field that validates nothing has one null rule."""
    return rows.where("lane = 'rule'").select(F.col("owner").alias("request"), F.col("a").alias("field"), F.col("b").alias("rule"))


def settings(rows: DataFrame) -> DataFrame:
    """model, kind, key, value; an empty setting has one null key."""
    return rows.where("lane = 'setting'").select(F.col("owner").alias("model"), F.col("a").alias("kind"), F.col("b").alias("key"), F.col("c").alias("value"))


def routes(rows: DataFrame) -> DataFrame:
    """verb, uri, action, guards: those that a route runs, added and taken away in the order of the calls, ascending; a route written twice runs both."""
    name = lambda e: F.substr(e, F.lit(2))
    guard = F.filter("tokens", lambda e: hazards.guard_alias(name(e)).isin(*hazards.GUARDS))
    events = F.transform(guard, lambda e: F.concat(F.substr(e, F.lit(1), F.lit(1)), hazards.guard_identity(name(e))))
    none = F.array().cast("array<string>")
    step = lambda acc, e: F.when(e.startswith("+"), F.array_union(acc, F.array(name(e)))).otherwise(F.array_remove(acc, name(e)))
    runs = rows.where("lane = 'route'").select("path", F.col("a").alias("verb"), F.col("b").alias("uri"), F.col("owner").alias("action"), F.aggregate(events, none, step).alias("g"))
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list("g"))))
    return runs.groupBy("path", "verb", "uri", "action").agg(F.transform(both, lambda g: F.concat(F.lit(hazards.MIDDLEWARE), g)).alias("guards")).drop("path")


def operations(rows: DataFrame) -> DataFrame:
    """file, op, tbl, col; a renamed column with its new name."""
    column = F.when(F.col("c").isNotNull(), F.concat_ws(" -> ", "b", "c")).otherwise(F.col("b"))
    return rows.where("lane = 'op'").select(F.col("path").alias("file"), F.col("a").alias("op"), F.col("owner").alias("tbl"), column.alias("col"))


def source_hazards(base: DataFrame, head: DataFrame) -> DataFrame:
    """All hazards between two snapshots of files (path, source)."""
    a, b = snapshots(base, head)
    of = lambda lane, part: lane(part(a), part(b))
    methods = lambda rows: members(rows).where("kind = 'method'")
    # A body that always allows says already that its checks are gone.
    open_now = of(hazards.neutered, bodies)
    lost = of(hazards.guard_lost, guards).join(open_now.select("member").distinct(), "member", "left_anti")
    limits = lambda rows: guards(rows).withColumn("token", F.regexp_replace("token", "^" + hazards.MIDDLEWARE, ""))
    found = [
        open_now, lost, of(hazards.rate_raised, limits), hazards.missing_members(members(a), members(b), classes(b)), of(hazards.missing_classes, classes), of(hazards.signature_changed, methods),
        of(hazards.model_settings, settings), of(hazards.rules_dropped, rules), of(hazards.route_guard_lost, routes), of(hazards.migration_ops, operations),
    ]
    out = found[0].select(*hazards.HAZARD)
    for df in found[1:]:
        out = out.unionByName(df.select(*hazards.HAZARD))
    return out
