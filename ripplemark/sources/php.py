"""Facts of PHP source files, one pass a file.

Only scanning is Python; every rule that turns facts into edges is relational
(:mod:`ripplemark.operators.extract`).  A file whose brackets or strings don't close gives
one ``unparseable`` fact and no other.

A fact is (path, fact, cls, method, name, arg, extra, line, stop, pos, nested):

====================  =======================================================================
class                 name = kind (class, interface, trait, enum), arg = parent, line and stop
implements, trait     name = the interface or used trait
method                name, arg = modifiers, extra = parameters (white space made even), span
property, constant    name, span (each name of a grouped declaration)
case                  name of an enum case, span
new                   name = class (null: dynamic), in a method
static                name = class, arg = method, extra = first argument
this                  name = method called on $this, extra = first argument
call                  name = function, extra = first argument
fetch                 name = class, arg = constant; ``C::class`` has arg ``class``
write                 name = variable, arg = class if the value is ``new CLASS``; parameters too;
                      extra = ``map`` if it is a collection mapped to ``new CLASS``, item by item
type                  name = variable, or ``this.`` and a property; arg = the one class that it is declared as;
                      extra = ``tag`` if a comment says so
on                    name = variable or ``this.`` and a property on which arg = a method is called
lead                  name = function or class asked for a setting, arg = what its first argument, text with
                      variables, begins with
====================  =======================================================================

``extra`` of a call is the literal of a string argument, ``new:CLASS``, ``class:CLASS``,
``var:NAME``, ``map:CLASS`` (a collection mapped to ``new CLASS``), ``array``, ``closure``, or null
for anything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("fact", "cls", "method", "name", "arg", "extra", "line", "stop", "pos", "nested")
SCHEMA = "path string, fact string, cls string, method string, name string, arg string, extra string, line int, stop int, pos int, nested boolean"
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<heredoc><<<\s*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\n.*?\n\s*(?P=tag)\b)"""
    r"""|(?P<var>\$\w+)|(?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[\w\x80-\U0010ffff]+)*)|(?P<number>\d[\w.]*)|(?P<op>\?->|->|::|=>|\#\[|\?\?=|[\[\](){};,])|(?P<other>.)""",
    re.S,
)
_KINDS = {"class", "interface", "trait", "enum"}
_MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}
_SELF = {"self", "static", "parent"}
# Calls on a collection that keep its items what they are, and types that are no class.
ITEM_PRESERVING = (
    "all", "values", "filter", "reject", "unique", "sort", "sortBy", "sortByDesc", "reverse", "take", "skip", "slice", "shuffle", "whereNotNull", "collect",
)
BUILTIN_TYPES = {"array", "bool", "boolean", "callable", "false", "float", "int", "integer", "iterable", "mixed", "null", "object", "self", "static", "string", "true", "void", "never", "parent"}
_LEAD = re.compile(r'"((?:[^"\\$]|\\.)*?)\{?(?<!\\)\$')
_VAR_TAG = re.compile(r"@var\s+(\S+)\s+\$(\w+)")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "#[": "]"}, {")", "]", "}"}


class Unparseable(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, position) without white space and comments; checks that brackets close."""
    start = source.find("<?php")
    if start < 0:
        return []
    out, stack, line, at = [], [], 1 + source.count("\n", 0, start), start + 5
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if kind == "tag" or kind == "q":
            kind = "heredoc"
        if kind == "other" and text in "'\"":
            raise Unparseable("a string doesn't close")
        if kind == "op":
            if text in _OPEN:
                stack.append(_OPEN[text])
            elif text in _CLOSE and (not stack or stack.pop() != text):
                raise Unparseable("brackets don't match")
        if kind not in ("space", "comment"):
            out.append(("string" if kind == "heredoc" else kind, text, line, at))
        line += text.count("\n")
        at = m.end()
    if stack:
        raise Unparseable("brackets don't close")
    return out


class Scanner:
    def __init__(self, source: str):
        self.source, self.t = source, tokens(source)
        self.facts: list[tuple] = []
        self.namespace, self.imports = "", {}

    def text(self, k: int) -> str:
        return self.t[k][1] if k < len(self.t) else ""

    def match(self, k: int) -> int:
        """The place of the bracket that closes the one at k."""
        depth = 0
        for i in range(k, len(self.t)):
            if self.t[i][0] == "op":
                depth += (self.t[i][1] in _OPEN) - (self.t[i][1] in _CLOSE)
                if depth == 0:
                    return i
        raise Unparseable("brackets don't close")

    def resolve(self, name: str, cls: str | None = None, parent: str | None = None) -> str:
        if name.lower() in ("self", "static") and cls:
            return cls
        if name.lower() == "parent" and parent:
            return parent
        if name.startswith("\\"):
            return name[1:]
        head, _, rest = name.partition("\\")
        if head.lower() in self.imports:
            return self.imports[head.lower()] + ("\\" + rest if rest else "")
        return f"{self.namespace}\\{name}" if self.namespace else name

    def add(self, fact, cls=None, method=None, name=None, arg=None, extra=None, line=None, stop=None, pos=None, nested=False):
        self.facts.append((fact, cls, method, name, arg, extra, line, stop, pos, nested))

    def scan(self) -> list[tuple]:
        k = 0
        while k < len(self.t):
            kind, text, _, _ = self.t[k]
            low = text.lower()
            if kind == "name" and low == "namespace" and k + 1 < len(self.t) and self.t[k + 1][0] == "name":
                self.namespace = self.text(k + 1)
                k += 2
            elif kind == "name" and low == "use" and self.text(k + 1) != "(":  # a closure's use imports nothing
                k = self.use(k + 1)
            elif kind == "name" and low in _KINDS and k + 1 < len(self.t) and self.t[k + 1][0] == "name" and self.text(k - 1) not in ("::", "->") and self.text(k - 1).lower() != "new":
                k = self.class_like(k)
            else:
                k += 1
        return self.facts

    def use(self, k: int) -> int:
        prefix = ""
        while k < len(self.t) and self.text(k) != ";":
            if self.t[k][0] == "name" and self.text(k).lower() not in ("function", "const", "as"):
                name = self.text(k).lstrip("\\")
                if self.text(k + 1) == "{" or self.text(k + 1) == "\\":
                    prefix = name + "\\"
                    k += 1
                    continue
                alias = name.rsplit("\\", 1)[-1]
                if self.text(k + 1).lower() == "as":
                    alias, k = self.text(k + 2), k + 2
                self.imports[alias.lower()] = prefix + name
            elif self.text(k) == "}":
                prefix = ""
            k += 1
        return k + 1

    def names(self, k: int, stop: set[str]) -> tuple[list[str], int]:
        found = []
        while self.text(k).lower() not in stop:
            if self.t[k][0] == "name":
                found.append(self.resolve(self.text(k)))
            k += 1
        return found, k

    def begun(self, k: int) -> int:
        """The line on which the declaration at k starts, attributes and modifiers included."""
        while k > 0:
            before = self.text(k - 1)
            if before.lower() in _MODIFIERS:
                k -= 1
            elif before == "]":
                depth, i = 0, k - 1
                while i >= 0:
                    depth += (self.text(i) in _CLOSE) - (self.text(i) in _OPEN)
                    if depth == 0:
                        break
                    i -= 1
                if self.text(i) != "#[":
                    break
                k = i
            else:
                break
        return self.t[k][2]

    def class_like(self, k: int) -> int:
        kind, cls, first = self.text(k).lower(), self.resolve("\\" + (f"{self.namespace}\\" if self.namespace else "") + self.text(k + 1)), self.begun(k)
        parent, interfaces, j = None, [], k + 2
        while self.text(j) != "{":
            word = self.text(j).lower()
            if word in ("extends", "implements"):
                found, j = self.names(j + 1, {"extends", "implements", "{"})
                if word == "extends" and kind != "interface":
                    parent = found[0] if found else None
                else:
                    interfaces += found
            else:
                j += 1
        end = self.match(j)
        self.add("class", cls, None, kind, parent, None, first, self.t[end][2], self.t[k][3])
        for name in interfaces:
            self.add("implements", cls, None, name, line=first)
        self.members(j + 1, end, cls, parent)
        return end + 1

    def members(self, k: int, end: int, cls: str, parent: str | None) -> None:
        while k < end:
            word = self.text(k).lower()
            if word == "#[":
                k = self.match(k) + 1
            elif word == "use":
                found, j = self.names(k + 1, {";", "{"})
                for name in found:
                    self.add("trait", cls, None, name, line=self.t[k][2])
                k = (self.match(j) if self.text(j) == "{" else j) + 1
            elif word == "function":
                k = self.function(k, cls, parent)
            elif word in ("const", "case"):
                k = self.grouped(k, cls, "constant" if word == "const" else "case")
            elif self.t[k][0] == "var":
                self.typed(k, cls, None, "this." + self.text(k)[1:])
                k = self.grouped(k, cls, "property")
            else:
                k += 1

    def grouped(self, k: int, cls: str, fact: str) -> int:
        first, j, depth, take = self.begun(k), k if fact == "property" else k + 1, 0, True
        found = []
        while not (depth == 0 and self.text(j) == ";"):
            if self.text(j) in _OPEN:
                depth += 1
            elif self.text(j) in _CLOSE:
                depth -= 1
            elif depth == 0 and self.text(j) == ",":
                take = True
            elif depth == 0 and take and self.t[j][0] in ("name", "var") and (fact == "property" or self.text(j + 1) in ("=", ";", ",")):
                found.append(self.text(j).lstrip("$"))
                take = False
            j += 1
        for name in found:
            self.add(fact, cls, None, name, line=first, stop=self.t[j][2])
        return j + 1

    def function(self, k: int, cls: str, parent: str | None) -> int:
        first, j = self.begun(k), k
        modifiers, i = [], k - 1
        while self.text(i).lower() in _MODIFIERS:
            modifiers.append(self.text(i).lower())
            i -= 1
        j = k + 1 + (self.text(k + 1) == "&")
        name, opened = self.text(j), j + 1
        closed = self.match(opened)
        params = " ".join(t[1] for t in self.t[opened + 1 : closed])
        j = closed
        while self.text(j) not in ("{", ";"):
            j += 1
        stop = self.match(j) if self.text(j) == "{" else j
        if "abstract" not in modifiers and self.text(j) == ";":
            modifiers.append("abstract")
        self.add("method", cls, name, name, " ".join(sorted(modifiers)), params, first, self.t[stop][2], self.t[k][3])
        depth = 0
        for i in range(opened + 1, closed):
            t = self.t[i]
            depth += (t[1] in _OPEN) - (t[1] in _CLOSE)
            if t[0] == "var" and depth == 0 and self.text(i - 1) != "=":
                self.add("write", cls, name, t[1][1:], line=t[2], pos=t[3])
                self.typed(i, cls, name, t[1][1:])
                if name == "__construct" and self.promoted(i, opened):
                    self.typed(i, cls, None, "this." + t[1][1:])
        if stop > j:
            self.tags(self.t[j][3], self.t[stop][3], cls, name)
            self.body(j + 1, stop, cls, parent, name)
        return stop + 1

    def typed(self, k: int, cls: str, method: str | None, name: str) -> None:
        """A type fact for the variable at k, if one class stands before it; a null beside it is nothing, another class is too much."""
        i, words = k - 1, []
        while i >= 0 and (self.t[i][0] == "name" or self.text(i) in ("?", "|", "&", ".")) and self.text(i).lower() not in _MODIFIERS:
            words.append(self.text(i))
            i -= 1
        classes = [w for w in words if w not in ("?", "|", "&", ".") and w.lower() != "null"]
        if len(classes) == 1 and "&" not in words and "." not in words and classes[0].lower() not in BUILTIN_TYPES:
            self.add("type", cls, method, name, self.resolve(classes[0]), line=self.t[k][2], pos=self.t[k][3])

    def promoted(self, k: int, opened: int) -> bool:
        """Whether the parameter at k has a modifier that makes it a property."""
        i = k - 1
        while i > opened and self.text(i) != ",":
            if self.text(i).lower() in _MODIFIERS:
                return True
            i -= 1
        return False

    def tags(self, start: int, end: int, cls: str, method: str) -> None:
        """Type facts of the ``@var`` tags in a body: one class, or one and null."""
        for m in _VAR_TAG.finditer(self.source, start, end):
            parts = [w for w in m[1].lstrip("?").split("|") if w and w.lower() != "null"]
            if len(parts) == 1 and re.fullmatch(r"\\?[\w\\]+", parts[0]) and parts[0].lower() not in BUILTIN_TYPES:
                self.add("type", cls, method, m[2], self.resolve(parts[0]), "tag", line=1 + self.source.count("\n", 0, m.start()), pos=m.start())

    def mapped(self, k: int, cls: str, parent: str | None) -> str | None:
        """The class that a collection, a variable at k and calls on it, is mapped to item by item; what follows the map must keep the items."""
        k, made = k + 1, None
        while self.text(k) in ("->", "?->") and self.t[k + 1][0] == "name" and self.text(k + 2) == "(":
            name, end = self.text(k + 1), self.match(k + 2)
            if name == "map":
                made = self.returned(k + 3, cls, parent)
            elif made is not None and name not in ITEM_PRESERVING:
                made = None
            k = end + 1
        return made if self.text(k) in (",", ")", ";", "]") else None

    def returned(self, k: int, cls: str, parent: str | None) -> str | None:
        """The class that the callable at k makes: an arrow function, or a closure that does nothing else."""
        k += self.text(k).lower() == "static"
        kind = self.text(k).lower()
        if kind not in ("fn", "function"):
            return None
        k = self.match(k + 1) + 1
        stop = "=>" if kind == "fn" else "{"
        while self.text(k) != stop:
            if self.text(k) == "(":
                k = self.match(k)
            k += 1
        first = k + 1
        if kind == "function":
            if self.text(first).lower() != "return":
                return None
            first += 1
        if self.text(first).lower() != "new" or self.t[first + 1][0] != "name" or self.text(first + 1).lower() == "class":
            return None
        after = first + 2
        if self.text(after) == "(":
            after = self.match(after) + 1
        done = self.text(after) in (",", ")") if kind == "fn" else self.text(after) == ";" and self.text(after + 1) == "}"
        return self.resolve(self.text(first + 1), cls, parent) if done else None

    def argument(self, k: int, cls: str, parent: str | None) -> str | None:
        """What the first argument after the bracket at k is."""
        kind, text = self.t[k + 1][:2]
        after = self.text(k + 2)
        if kind == "string" and after in (",", ")") and not (text[0] == '"' and "$" in text):
            return text[1:-1]
        if text.lower() == "new" and self.t[k + 2][0] == "name":
            return "new:" + self.resolve(self.text(k + 2), cls, parent)
        if kind == "name" and after == "::" and self.text(k + 3).lower() == "class":
            return "class:" + self.resolve(text, cls, parent)
        if kind == "var" and after in (",", ")"):
            return "var:" + text[1:]
        if kind == "var" and after in ("->", "?->") and text != "$this" and (made := self.mapped(k + 1, cls, parent)):
            return "map:" + made
        if text == "[":
            return "array"
        return "closure" if text.lower() in ("function", "fn") else None

    def lead(self, k: int) -> str | None:
        """What the first argument after the bracket at k begins with, if it is text with variables."""
        found = _LEAD.match(self.text(k + 1)) if self.t[k + 1][0] == "string" and self.text(k + 2) in (",", ")") else None
        return found[1] or None if found else None

    def body(self, k: int, end: int, cls: str, parent: str | None, method: str) -> None:
        anonymous: list[int] = []
        while k < end:
            kind, text, line, pos = self.t[k]
            low, after, before = text.lower(), self.text(k + 1), self.text(k - 1)
            nested = bool(anonymous and k < anonymous[-1])
            put = lambda fact, name, arg=None, extra=None: self.add(fact, cls, method, name, arg, extra, line, None, pos, nested)  # noqa: B023, E731
            if kind == "name" and low == "new":
                if after.lower() == "class":
                    j = k + 2
                    while self.text(j) != "{":
                        j = self.match(j) + 1 if self.text(j) == "(" else j + 1
                    anonymous.append(self.match(j))
                elif self.t[k + 1][0] == "name":
                    put("new", self.resolve(after, cls, parent))
                    k += 1
                else:
                    put("new", None)
            elif kind == "name" and after == "::" and before not in ("->", "?->"):
                member, called = self.text(k + 2), self.text(k + 3) == "("
                owner = self.resolve(text, cls, parent)
                if called:
                    put("static", owner, member, self.argument(k + 3, cls, parent))
                    if member == "get" and owner.endswith("Config") and (lead := self.lead(k + 3)):
                        put("lead", owner, lead)
                elif self.t[k + 2][0] == "name":
                    put("fetch", owner, member)
                k += 2
            elif kind == "var" and text == "$this" and after in ("->", "?->") and self.t[k + 2][0] == "name" and self.text(k + 3) == "(":
                put("this", self.text(k + 2), None, self.argument(k + 3, cls, parent))
                k += 2
            elif kind == "name" and after == "(" and before not in ("->", "?->", "::", "function", "new") and low not in ("if", "while", "for", "foreach", "switch", "match", "array", "list", "isset", "empty", "fn", "function", "catch", "return", "echo"):
                put("call", text.lstrip("\\"), None, self.argument(k + 1, cls, parent))
                if text.lstrip("\\") == "config" and (lead := self.lead(k + 1)):
                    put("lead", "config", lead)
            elif kind == "var" and text != "$this" and (after == "=" and self.text(k + 2) not in ("=", ">") or before.lower() in ("as", "static", "global", "&") or after in ("+", "-", ".", "*", "??=") and self.text(k + 2) in ("=", after)):
                made = after == "=" and self.text(k + 2).lower() == "new" and self.t[k + 3][0] == "name" and self.text(k + 3).lower() != "class"
                each = self.mapped(k + 2, cls, parent) if after == "=" and not made and self.t[k + 2][0] == "var" and self.text(k + 2) != "$this" else None
                put("write", text[1:], self.resolve(self.text(k + 3), cls, parent) if made else each, "map" if each else None)
            elif kind == "var" and after in ("->", "?->") and self.t[k + 2][0] == "name":
                if text != "$this" and self.text(k + 3) == "(":
                    put("on", text[1:], self.text(k + 2))
                elif text == "$this" and self.text(k + 3) in ("->", "?->") and self.t[k + 4][0] == "name" and self.text(k + 5) == "(":
                    put("on", "this." + self.text(k + 2), self.text(k + 4))
            k += 1


def return_keys(source: str | None, method: str, strict: bool = False) -> list[str] | None:
    """The keys of the one array that a method returns and does nothing else; null where that can't be vouched for.

    A spread, a key that isn't a string or a constant of the class itself, or several
    methods of the name give null.  With ``strict`` an item without a key does, too, and so
    does any constant; else such items are left out.
    """
    try:
        scan = Scanner(source or "")
        t, text = scan.t, scan.text
        at = [k for k in range(len(t)) if text(k).lower() == "function" and text(k + 1 + (text(k + 1) == "&")) == method]
        if len(at) != 1:
            return None
        k = scan.match(at[0] + 2 + (text(at[0] + 1) == "&")) + 1
        while text(k) not in ("{", ";"):
            k += 1
        end = scan.match(k) if text(k) == "{" else k
        if text(k + 1).lower() != "return" or text(k + 2) != "[" or scan.match(k + 2) != end - 2 or text(end - 1) != ";":
            return None
        keys, items, first, depth = [], [], k + 3, 0
        for i in range(k + 3, end - 1):
            depth += (text(i) in _OPEN) - (text(i) in _CLOSE)
            if (depth == 0 and text(i) == ",") or i == end - 2:
                if i > first:
                    items.append((first, i))
                first = i + 1
        for a, b in items:
            if text(a) == ".":  # a spread
                return None
            depth, arrow = 0, None
            for i in range(a, b):
                depth += (text(i) in _OPEN) - (text(i) in _CLOSE)
                if depth == 0 and text(i) == "=>" and arrow is None:
                    arrow = i
            if arrow is None or text(a).lower() in ("fn", "static"):
                if strict:
                    return None
                continue
            key = _key(scan, a, arrow, strict)
            if key is None:
                return None
            keys.append(key)
        return list(dict.fromkeys(keys))
    except (Unparseable, IndexError):
        return None


def _key(scan: Scanner, a: int, arrow: int, strict: bool) -> str | None:
    kind, word = scan.t[a][:2]
    if arrow == a + 1 and kind == "string" and not (word[0] == '"' and "$" in word):
        return word[1:-1]
    if strict or arrow != a + 3 or scan.text(a + 1) != "::" or word.lower() not in ("self", "static"):
        return None
    found = [k for k in range(len(scan.t)) if scan.text(k).lower() == "const" and scan.text(k + 1) == scan.text(a + 2) and scan.text(k + 2) == "=" and scan.t[k + 3][0] == "string"]
    return scan.text(found[0] + 3)[1:-1] if len(found) == 1 else None


def array_return_keys(files: DataFrame, method: str, strict: bool = False) -> DataFrame:
    """path, keys of files (path, source): see :func:`return_keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [return_keys(s, method, strict) for s in b.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(keys, pa.list_(pa.string()))], ["path", "keys"])

    return files.select("path", "source").mapInArrow(run, "path string, keys array<string>")


# What a source must hold for some facts; each list lets through all files that have them.
PRE_GATES = {
    "dispatch": ("dispatch", "Bus::"),
    "policy": ("Policies\\",),
    "config": ("config(", "Config::"),
    "view": ("view(", "View::"),
}


def may_match(source, gate: str, helpers: tuple[str, ...] = ()):
    """Whether a source may hold facts of a gate: a filter before the scan, never narrower than the rule."""
    found = F.lit(False)
    for needle in (*PRE_GATES[gate], *helpers):
        found = found | F.lower(source).contains(needle.lower())
    return found


def facts_of(source: str | None) -> list[tuple]:
    """The facts of one file; a null source has none."""
    if source is None:
        return []
    try:
        return Scanner(source).scan()
    except (Unparseable, IndexError):
        return [("unparseable", *[None] * 8, False)]


def facts(files: DataFrame) -> DataFrame:
    """The facts of files (path, source).  Filter files by ``contains`` first where only some facts are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f) for p, s in zip(b.column("path").to_pylist(), b.column("source").to_pylist(), strict=True) for f in facts_of(s)]
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.string()] * 7 + [pa.int32()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", *FIELDS])

    return files.select("path", "source").mapInArrow(run, SCHEMA)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.php") -> DataFrame:
    """path (below ``root``), source of the matching files of a tree."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    return files.select(path.alias("path"), F.col("value").alias("source"))


def path_to_class(path, root: str = "App"):
    """The class that a path below app/ names; elsewhere the base name alone."""
    inner = F.replace(F.regexp_replace(F.regexp_replace(path, "^app/", ""), r"\.php$", ""), F.lit("/"), F.lit("\\"))
    return F.when(path.startswith("app/"), F.concat(F.lit(root + "\\"), inner)).otherwise(F.regexp_extract(path, r"([^/]+)\.php$", 1))


def root_namespace(composer: str | None, default: str = "App", configured: str | None = None) -> str:
    """The configured namespace, or the one that composer.json maps to app/, else ``default``."""
    import json

    if configured:
        return configured.strip("\\")
    try:
        spaces = json.loads(composer or "{}").get("autoload", {}).get("psr-4", {})
    except ValueError:
        return default
    return next((ns.rstrip("\\") for ns, d in spaces.items() if (d if isinstance(d, str) else (d or [""])[0]).rstrip("/") == "app"), default)


def root_namespaces(composer, default: str = "App"):
    """As :func:`root_namespace`, for a column of composer files."""
    entries = F.map_entries(F.from_json(composer, "autoload struct<`psr-4`:map<string,string>>")["autoload"]["psr-4"])
    hit = F.filter(entries, lambda e: e["value"].rlike(r'^\[?"?app/?("|$)'))
    return F.coalesce(F.regexp_replace(F.get(hit, F.lit(0))["key"], r"\\+$", ""), F.lit(default))
