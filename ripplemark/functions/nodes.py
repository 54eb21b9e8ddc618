"""Predicates and projections on node ids, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplemark.functions.vocabulary import ENTRY_PREFIXES, SURFACE_PARTS

MEMBER = "::"
_JAVA_META = re.compile(r"([\\.\[\]{}()*+?^$|])")


def quoted(needle: str) -> str:
    """``needle`` as a literal of Java's regular expressions."""
    return _JAVA_META.sub(r"\\\1", needle)


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def is_entry_point(node: Column) -> Column:
    return any_of([node.startswith(p) for p in ENTRY_PREFIXES])


def is_surface_class(node: Column) -> Column:
    """Whether the node's class is a user-interface component."""
    return any_of([class_of(node).contains(p) for p in SURFACE_PARTS])


def class_of(node: Column) -> Column:
    """The class of a member node; other nodes as they are."""
    return F.substring_index(node, MEMBER, 1)


def member_of(node: Column) -> Column:
    """What follows the first ``::``, or null."""
    return F.when(node.contains(MEMBER), F.regexp_replace(node, "^.*?::", ""))


def is_member(node: Column) -> Column:
    """A namespaced class, ``::`` and one identifier."""
    return node.rlike(r"^[A-Za-z_][A-Za-z0-9_]*([.\\][A-Za-z_][A-Za-z0-9_]*)+::[A-Za-z_][A-Za-z0-9_]*$")


def is_app_class(node: Column, root: str = "App.") -> Column:
    return node.startswith(root) & ~node.contains(MEMBER)


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"[.\\]"), -1)


def contains_identifier(node: Column, needle: str) -> Column:
    """Case-insensitive, with no identifier character on either side; an empty needle matches nothing."""
    if not needle:
        return F.lit(False)
    return node.rlike(f"(?i)(?<![A-Za-z0-9_]){quoted(needle)}(?![A-Za-z0-9_])")


def tokens(node: Column) -> Column:
    """The distinct lower-case identifier parts of a node."""
    return F.array_distinct(F.filter(F.split(F.lower(node), "[^a-z0-9_]+"), lambda t: t != ""))


def command_label(node: Column) -> Column:
    """A command node without the arguments of its signature."""
    return F.when(node.startswith("command::"), F.element_at(F.split(node, r"\s", 2), 1)).otherwise(node)
