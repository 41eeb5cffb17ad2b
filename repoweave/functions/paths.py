"""Expressions over paths: globs, languages, artifact classes, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "python": ("py", "pyx"),
    "java": ("java",),
    "javascript": ("js", "jsx", "mjs"),
    "typescript": ("ts", "tsx"),
    "go": ("go",),
    "rust": ("rs",),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "c++", "hpp", "hxx", "h++"),
    "csharp": ("cs",),
    "kotlin": ("kt", "kts"),
    "php": ("php", "phtml", "inc"),
    "ruby": ("rb", "rake"),
    "scala": ("scala", "sc"),
}
#: Folders that are never walked.
EXCLUDED_DIRS = (".git", ".state", "target", "node_modules", ".venv", "venv", ".tox", "dist", "build", "vendor", "coverage", "__pycache__")

#: Artifact classes in order, with file names, starts of file names, ends of paths and parts of paths.
ARTIFACT_RULES = (
    ("container", ("dockerfile",), ("dockerfile.",), (), ("/docker/",)),
    ("ci", (), (), (".github/workflows",), (".github/workflows/", "gitlab-ci")),
    ("manifest", ("cargo.toml", "go.mod", "pyproject.toml", "package.json", "pom.xml", "build.gradle", "setup.py"), (), (), ()),
    ("build", ("makefile", "justfile", "rakefile", "build.gradle", "gradlew", "setup.cfg"), (), (), ()),
    ("schema", (), (), (".sql",), ("/schema", "/migrations/")),
    ("config", (), ("config.",), (".env.example",), ("/config",)),
    ("script", (), (), (".sh",), ("/scripts/", "/bin/")),
    ("test_infra", (), (), (), ("/test", "/fixtures/")),
    ("packaging", ("cargo.lock", "go.sum", "requirements.txt", "poetry.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"), (), (), ()),
)
#: Roles in order, with the words that a module's name has.
ROLES = (
    ("state", ("storage", "database", "state")),
    ("interface", ("protocol", "api", "client", "server")),
    ("execution", ("execution", "runtime", "pipeline", "interpreter")),
    ("support", ("build", "test", "release", "packag")),
    ("integration", ("network", "integration")),
)


def _class(body: str, negated: bool) -> str:
    """A glob's class: characters and rising ranges; a falling range has no character, and an empty class matches nothing."""
    out, i = [], 0
    quoted = lambda c: rf"\x{{{ord(c):x}}}" if not c.isalnum() else c
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                out.append(f"{quoted(body[i])}-{quoted(body[i + 2])}")
            i += 3
        else:
            out.append(quoted(body[i]))
            i += 1
    return f"[{'^' * negated}{''.join(out)}]" if out else "." if negated else r"[^\s\S]"


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression (of Java): * and ? cross slashes, [a-z] and [!a] are classes, an unclosed [ is itself."""
    out, i = [], 0
    pattern = pattern.replace("\\", "/").removeprefix("./")
    while i < len(pattern):
        c = pattern[i]
        negated = pattern[i + 1 : i + 2] in ("!", "^")
        close = pattern.find("]", i + 2 + negated) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            out.append(_class(pattern[i + 1 + negated : close], negated))
            i = close
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/\-\s])", r"\\\1", c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def included(path: Column, patterns: list[str]) -> Column:
    """The whole path or its file name matches a pattern; all if there are none."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p)) | file_name(path).rlike(glob_regex(p))
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern matches the path, its file name or a segment, names it, or is a folder above it."""
    out = F.lit(False)
    for p in patterns:
        bare = p.removeprefix("./").rstrip("/")
        out = out | path.rlike(glob_regex(p)) | (path == bare) | path.startswith(bare + "/") | _segment(path, bare)
    return out


def _segment(path: Column, pattern: str) -> Column:
    expression = glob_regex(pattern)
    return F.exists(F.split(path, "/"), lambda s: s.rlike(expression))


def skipped(path: Column, include: list[str] = (), exclude: list[str] = (), focus: list[str] = (), dirs: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """Whether a walk leaves a file out: an excluded folder on its way, an exclude glob, no include glob, or none of the focus texts in it."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in dirs])) | excluded(path, list(exclude)) | ~included(path, list(include))
    if focus:
        wanted = F.lit(False)
        for f in focus:
            wanted = wanted | path.contains(f)
        out = out | ~wanted
    return out


def language(path: Column) -> Column:
    """The language of a file by its extension, or null."""
    known = F.create_map(*[F.lit(x) for name, ends in LANGUAGES.items() for e in ends for x in (e, name)])
    name = file_name(path)
    return F.try_element_at(known, F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit("")))


def artifact_class(path: Column) -> Column:
    """The first class whose rule a path meets, or null."""
    low = F.lower(path)
    name = file_name(low)
    out = F.lit(None).cast("string")
    for kind, names, starts, ends, parts in reversed(ARTIFACT_RULES):
        hit = name.isin(*names) if names else F.lit(False)
        for x in starts:
            hit = hit | name.startswith(x)
        for x in ends:
            hit = hit | low.endswith(x)
        for x in parts:
            hit = hit | low.contains(x)
        out = F.when(hit, kind).otherwise(out)
    return out


def safe_name(value: Column) -> Column:
    """Letters, digits, _ and - of ASCII; all else is _; empty is `repository`."""
    return F.when(value == "", "repository").otherwise(F.regexp_replace(value, "(?s)[^A-Za-z0-9_-]", "_"))


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value, "(?s)[^A-Za-z0-9]", "_")


def source_file_name(component: Column) -> Column:
    """A file name for a component's source: its first 180 characters made safe, and a digest."""
    return F.concat(F.regexp_replace(F.substring(component, 1, 180), "(?s)[^A-Za-z0-9_.-]", "__"), F.lit("_"), F.substring(F.sha2(component, 256), 1, 8), F.lit(".src"))


def is_page_segment(value: Column) -> Column:
    """Lower-case ASCII letters, digits, _ and -; neither _ nor - at an end; no double _."""
    return value.rlike("^(?!.*__)[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?$")


def is_module_name(value: Column) -> Column:
    """ASCII letters, digits, _ and -, and in lower case a page's segment."""
    return value.rlike("^[A-Za-z0-9_-]+$") & is_page_segment(F.lower(value))


def is_wiki_id(value: Column) -> Column:
    """Segments of pages with colons between them."""
    return F.forall(F.split(value, ":"), is_page_segment)


def is_session_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{1,64}$")


def is_change_id(value: Column) -> Column:
    """Two full hashes of one length with .. between them."""
    return value.rlike(r"^(?:[0-9A-Fa-f]{40}\.\.[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}\.\.[0-9A-Fa-f]{64})$")


def is_safe_path(value: Column) -> Column:
    """Relative, and nowhere up."""
    return ~value.startswith("/") & ~F.array_contains(F.split(value, "/"), "..")


def page_id(wiki: str, path: Column) -> Column:
    """The page of a module's path (an array of names); null if a name can't be in a page id."""
    names = F.transform(path, lambda s: F.lower(s))
    good = (F.size(path) > 0) & F.forall(path, lambda s: s.rlike("^[A-Za-z0-9_-]+$")) & F.forall(names, is_page_segment)
    return F.when(good, F.concat_ws(":", F.lit(wiki), F.array_join(names, ":"), F.lit("start")))


def page_file(page: Column) -> Column:
    return F.concat(F.replace(page, F.lit(":"), F.lit("/")), F.lit(".txt"))


def edition_id(change: Column) -> Column:
    """The edition of a change, two full hashes with .. between them; null for others."""
    return F.when(is_change_id(change), F.concat(F.lit("change_"), F.sha2(F.lower(change), 256)))


def role(module: Column) -> Column:
    """What a module does, by the first group of words of which its name has one."""
    low, out = F.lower(module), F.lit("subsystem")
    for name, words in reversed(ROLES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out
