"""A source tree as rows: folders are dealt to tasks, and files are read where they are listed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths as P

_SCHEMA = "relative_path string, size long, content string, link boolean"
#: Folders are taken apart, level by level, until there are so many tasks.
_TASKS = 64


def ignore_rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """A line of an ignore file: (whether it takes back, whether it means folders only, expression for paths below its folder); None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    folders, line = line.endswith("/"), line.rstrip("/")
    if not line:
        return None
    out, i, line = ["" if "/" in line else "(?:.*/)?"], 0, line.removeprefix("/")
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif line.startswith("**", i) and i + 2 == len(line) and line[i - 1 : i] == "/":
            out.append(".+")
            i += 2
        elif m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(line, i):
            out.append(f"[{'^' if m[1] else ''}{m[2].replace(chr(92), chr(92) * 2).replace(']', chr(92) + ']')}]")
            i = m.end()
        elif line[i] in "*?":
            out.append("[^/]*" if line[i] == "*" else "[^/]")
            i += 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out.append(re.escape(line[i]))
            i += 1
    try:
        return negated, folders, re.compile("".join(out), re.S)
    except re.error:  # such a line means nothing
        return None


def ignored(path: str, is_folder: bool, stack: list[tuple[str, list]]) -> bool:
    """Whether a path is left out by the rules of the folders above it (from the root down): the last one that matches, of the deepest file, decides; without one, a name with a dot in front is."""
    for folder, rules in reversed(stack):
        below = path[len(folder) + 1 :] if folder else path
        for negated, folders, expression in reversed(rules):
            if (is_folder or not folders) and expression.fullmatch(below):
                return not negated
    return path.rpartition("/")[2].startswith(".")


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.skip = set(options.get("skipdirs", ",".join(P.EXCLUDED_DIRS)).split(","))
        self.filtered = options.get("filtered", "true") == "true"
        self.names = [".gitignore", ".ignore"] if options.get("gitignore", "true") == "true" else [".ignore"]

    def _rules(self, folder: str) -> list:
        out = []
        for name in self.names:
            try:
                with open(os.path.join(self.root, folder, name), encoding="utf-8", errors="replace") as f:
                    out += [r for r in map(ignore_rule, f) if r]
            except OSError:
                continue
        return out

    def _stack(self, folder: str) -> list[tuple[str, list]]:
        """The rules of a folder and of those above it, from the root down."""
        parts = folder.split("/") if folder else []
        return [(at, self._rules(at)) for at in ("/".join(parts[:n]) for n in range(len(parts) + 1))] if self.filtered else []

    def _folders(self, folder: str, stack: list) -> list[str]:
        below = (f"{folder}/{e.name}" if folder else e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False) and e.name not in self.skip)
        return sorted(f for f in below if not (self.filtered and ignored(f, True, stack)))

    def partitions(self) -> list[InputPartition]:
        """Folders with all below them; those that were taken apart have a task for their own files."""
        whole, own = [""], []
        while whole and len(whole) + len(own) < _TASKS:
            own += whole
            whole = sorted(below for f in whole for below in self._folders(f, self._stack(f)))
        return [*(_Folder(f, False) for f in own), *(_Folder(f, True) for f in whole)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Regular files with their text, and links without one."""
        folder, deep = partition.value
        todo = [(folder, self._stack(folder))]
        while todo:
            at, stack = todo.pop()
            if deep:
                todo += [(f, [*stack, (f, self._rules(f))] if self.filtered else []) for f in reversed(self._folders(at, stack))]
            for entry in sorted(os.scandir(os.path.join(self.root, at)), key=lambda e: e.name):
                relative = f"{at}/{entry.name}" if at else entry.name
                if entry.is_dir(follow_symlinks=False) or self.filtered and ignored(relative, False, stack):
                    continue
                if entry.is_symlink():
                    yield relative, None, None, True
                    continue
                try:
                    with open(entry.path, encoding="utf-8", newline="") as f:
                        text = f.read()
                except (OSError, UnicodeDecodeError):  # unreadable files and such that aren't UTF-8 are left out
                    continue
                yield relative, entry.stat().st_size, text, False


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root); the folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), focus: list[str] = (), gitignore: bool = True) -> DataFrame:
    """The files of a tree that a walk takes: relative_path, size, content, language, class, walk.

    Ignore files (.ignore and, with `gitignore`, .gitignore) hold for their
    folder and all below; names with a dot in front are left out unless a rule
    takes them back. `walk`, a path's names, sorts as the walk goes.
    """
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").option("gitignore", str(gitignore).lower()).load(root).where("not link").drop("link")
    path = F.col("relative_path")
    return rows.where(~P.skipped(path, include, exclude, focus)).withColumns({"language": P.language(path), "class": P.artifact_class(path), "walk": F.split(path, "/")})


def pages(spark: SparkSession, root: str) -> DataFrame:
    """The .txt files of a page folder: page, content, canonical, link. A link isn't read and isn't canonical."""
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").option("filtered", "false").load(root).where("relative_path like '%.txt'")
    bare = F.regexp_replace("relative_path", r"\.txt$", "")
    return rows.select(F.replace(bare, F.lit("/"), F.lit(":")).alias("page"), "content", (~F.col("link") & F.forall(F.split(bare, "/"), P.is_page_segment)).alias("canonical"), "link")
