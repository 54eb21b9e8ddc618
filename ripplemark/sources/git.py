"""Diffs, file contents and untracked files of a git checkout.

Git runs on the driver, once a diff (and once for all its files' contents): a diff is
bounded by what people change.  What it says becomes tables; every rule over them is relational.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators.changes import unescaped

#: Where a file that was never added still matters.
RELEVANT_ROOTS = ("app/", "resources/views/", "routes/", "database/migrations/", "bootstrap/app.php")


class GitError(RuntimeError):
    """A reference that isn't there, or no checkout."""


def _git(root: str, *words: str, text: str | None = None) -> bytes | None:
    done = subprocess.run(["git", "-c", "core.quotepath=off", *words], cwd=root, input=None if text is None else text.encode(), capture_output=True, check=False)
    return done.stdout if done.returncode == 0 else None


def merge_base(root: str, base: str, head: str = "HEAD") -> str:
    found = _git(root, "merge-base", "--end-of-options", base, head)
    if found is None:
        raise GitError(f"no merge base of {base} and {head}")
    return found.decode().strip()


def prefix(root: str) -> str | None:
    """Where ``root`` lies in its repository: empty at its top, null if that can't be told."""
    found = _git(root, "rev-parse", "--show-prefix")
    return None if found is None else found.decode().strip()


def diff(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """One row (id, diff): the working tree against the merge base, or for another head its committed tree; paths below ``root``."""
    wanted = [merge_base(root, base)] if head == "HEAD" else [f"{base}...{head}"]
    found = _git(root, "diff", "-U0", "--relative", "--end-of-options", *wanted)
    if found is None:
        raise GitError(f"no diff against {base}")
    return spark.createDataFrame([(f"{base}...{head}", found.decode("utf-8", "replace"))], "id string, diff string")


def blobs(spark: SparkSession, root: str, ref: str | None, paths: list[str]) -> DataFrame:
    """path, source at a commit, or in the working tree for None; null where it can't be read."""
    rows: list[tuple[str, str | None]] = []
    if ref is None:
        for p in paths:
            try:
                with open(f"{root}/{p}", encoding="utf-8", errors="replace", newline="") as f:
                    rows.append((p, f.read()))
            except OSError:
                rows.append((p, None))
    elif paths:
        own = prefix(root) or ""
        raw = _git(root, "cat-file", "--batch", text="".join(f"{ref}:{own}{p}\n" for p in paths)) or b""
        at = 0
        for p in paths:
            head, _, _ = raw[at:].partition(b"\n")
            words = head.split()
            at += len(head) + 1
            if len(words) == 3 and words[1] == b"blob":
                size = int(words[2])
                rows.append((p, raw[at : at + size].decode("utf-8", "replace")))
                at += size + 1
            else:
                rows.append((p, None))
    return spark.createDataFrame(rows, "path string, source string")


def status(spark: SparkSession, root: str) -> DataFrame:
    """line: what git says of the checkout, a row a line; no row if it says nothing."""
    found = _git(root, "status", "--porcelain", "--end-of-options") or b""
    return spark.createDataFrame([(x,) for x in found.decode("utf-8", "replace").split("\n") if x], "line string")


def re_rooted(path: Column, own: str) -> Column:
    """A path of the repository as seen from a project at ``own`` in it; null outside of it."""
    return F.when(path.startswith(own), F.substr(path, F.lit(len(own) + 1))) if own else path


def object_path(path: Column, own: Column | str) -> Column:
    """A path of the project as the repository knows it."""
    return F.concat(F.lit(own) if isinstance(own, str) else own, path)


def untracked(lines: DataFrame, own: str | None, roots: tuple[str, ...] = RELEVANT_ROOTS) -> DataFrame:
    """path: untracked files that matter, from the lines of ``git status --porcelain``.

    Where the project's place in its repository isn't known, a path counts if a root
    stands anywhere in it: too many rather than too few.
    """
    paths = lines.where(F.col("line").startswith("?? ")).select(unescaped(F.substr("line", F.lit(4))).alias("path"))
    hit = F.lit(False)
    if own is None:
        for root in roots:
            hit = hit | F.col("path").startswith(root) | F.col("path").contains("/" + root)
        return paths.where(hit)
    for root in roots:
        hit = hit | F.col("path").startswith(root)
    return paths.select(re_rooted(F.col("path"), own).alias("path")).where(F.col("path").isNotNull() & hit)
