"""A scanner for source text: declarations with their spans, and references with the innermost declaration around them.

One pass over a file blanks comments and strings, one pairs its brackets, and
one goes through declarations and references in order with a stack of what is
open. It finds what the tables below name, not what a grammar would.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SLASHED = "java csharp kotlin typescript javascript go rust c cpp scala php".split()
_TEXTS = {"python": r"[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|.)*?\"\"\"|'''(?:\\.|.)*?''')|"}
_TEXTS |= dict.fromkeys("kotlin scala java csharp".split(), r'"""(?:.)*?"""|') | dict.fromkeys("javascript typescript go".split(), r"`(?:\\.|[^`\\])*`|") | {"rust": r'\br(?P<h>#*)".*?"(?P=h)|'}
_NAME = r"[A-Za-z_$][\w$]*"
_OPEN, _CLOSE = "([{", dict(zip(")]}", "([{", strict=True))
_TYPE_WORDS = {"c": "struct|enum|union", "cpp": "class|struct|enum|union|namespace", "rust": "struct|enum|trait|union|mod", "php": "class|interface|trait|enum", "ruby": "class|module", "python": "class"}
_TYPE_WORDS |= {"java": "class|interface|enum|record", "csharp": "class|interface|enum|record|struct", "kotlin": "class|interface|object", "scala": "class|trait|object|enum", "typescript": "class|interface|enum|namespace|type", "javascript": "class"}
_FUNCTION_WORDS = {"python": "def", "ruby": "def", "scala": "def", "rust": "fn", "kotlin": "fun", "php": "function", "javascript": "function", "typescript": "function"}
#: Languages whose methods are known by their place in a type's body, with those that need a type before the name, and those whose functions can stand outside of types.
_PLACED, _TYPED, _FREE = "java csharp javascript typescript c cpp".split(), "java csharp c cpp".split(), ("c", "cpp")
_KINDS = {"mod": "module", "def": "function", "fn": "function", "fun": "function", "func": "function"}
_CONTAINERS = ("class", "record", "interface", "struct", "enum", "trait", "object", "module", "namespace", "impl", "union")
#: (kind, languages or all, expression whose first group is what is referred to)
REFERENCES = [
    (kind, languages.split(), re.compile(expression))
    for kind, languages, expression in (
        ("call", "", rf"(?<![\w.:$])((?:{_NAME}(?:\.|::|->|\\))*{_NAME}[!?]?)\s*\("),
        ("instantiate", "java csharp javascript typescript php cpp scala", rf"\bnew\s+((?:{_NAME}(?:\.|::|\\))*{_NAME})"),
        ("import", "python", r"(?m)^\s*(?:import\s+([\w.]+)|from\s+[\w.]+\s+import\s+\(?\s*(\w+))"),
        ("import", "java kotlin scala", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"),
        ("import", "rust", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"),
        ("import", "csharp php", r"(?m)^\s*us(?:ing|e)\s+([\w.\\]+)\s*;"),
        ("import", "c cpp", r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)"),
        ("import", "javascript typescript", r"(?:\bfrom|\brequire\(|\bimport)\s*[\"']([^\"'\n]+)"),
        ("type", "python typescript rust kotlin scala", rf"(?:[\w)\]]\s*:|->)\s*&?((?:{_NAME}(?:\.|::))*[A-Z]\w*)"),
        ("type", "java csharp cpp go c php", rf"[(,]\s*(?:const\s+|final\s+|ref\s+|out\s+)?((?:{_NAME}(?:\.|::))*[A-Z]\w*)(?:<[^<>()]*>)?[\s*&]+\w+\s*(?=[,)])"),
    )
]
#: Words before a parenthesis that call nothing.
KEYWORDS = frozenset(
    "if for while switch return catch def class fn func fun function elif and or not in is match when sizeof typeof new super print await yield throw assert lambda except with elsif unless until foreach using lock fixed do else try case".split()
)


def blanked(text: str, language: str) -> str:
    """text with its comments and strings as blanks; places and line ends stay. Comments nest in Rust, Kotlin and Scala."""
    comment = r"//[^\n]*|/\*.*?(?:\*/|\Z)|" if language in _SLASHED else ""
    comment += {"python": r"#[^\n]*|", "ruby": r"#[^\n]*|^=begin\b.*?^=end\b|", "php": r"#(?!\[)[^\n]*|"}.get(language, "")
    single = r"'(?:\\.|[^'\\\n])*'" if language in ("python", "ruby", "php", "javascript", "typescript") else r"'(?:\\[^\n']+|[^'\\\n])'"
    token = re.compile(comment + _TEXTS.get(language, "") + r'"(?:\\.|[^"\\' + ("" if language in ("php", "ruby", "rust") else r"\n") + r'])*"|' + single, re.S | re.M)
    out, at = [], 0
    while m := token.search(text, at):
        end = m.end()
        if m.group().startswith("/*") and language in ("rust", "kotlin", "scala"):
            depth, end = 0, len(text)
            for mark in re.finditer(r"/\*|\*/", text[m.start() :]):
                depth += 1 if mark.group() == "/*" else -1
                if not depth:
                    end = m.start() + mark.end()
                    break
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join(out) + text[at:]


class _Brackets:
    """The pairs of brackets, and what bracket is open at a place."""

    def __init__(self, code: str):
        self.close: dict[int, int] = {}
        self.places, self.tops, stack = [-1], [-1], []
        for m in re.finditer(r"[(){}\[\]]", code):
            c, at = m.group(), m.start()
            if c in _OPEN:
                stack.append(at)
            elif any(code[p] == _CLOSE[c] for p in stack[-8:]):  # what was left open inside ends here, too
                while code[stack[-1]] != _CLOSE[c]:
                    self.close[stack.pop()] = at
                self.close[stack.pop()] = at
            self.places.append(at)
            self.tops.append(stack[-1] if stack else -1)
        self.close |= dict.fromkeys(stack, len(code))

    def around(self, at: int) -> int:
        return self.tops[bisect_right(self.places, at) - 1]


class Declaration:
    def __init__(self, at: int, name_at: int, name: str, kind: str, owner: str = "", base: str = ""):
        self.start, self.name_at, self.name, self.kind, self.owner, self.base = at, name_at, name, kind, owner, base
        self.body = self.end = self.line = 0
        self.inside = self.bases = self.id = self.path = ""
        self.component = False


def _heads(code: str, language: str):
    """The declarations that a word announces."""
    if words := _TYPE_WORDS.get(language):
        lead = {"kotlin": r"(?:(?P<e>enum)\s+|(?P<f>fun)\s+)?", "csharp": r"", "scala": r"", "cpp": r""}.get(language, "")
        for m in re.finditer(rf"(?<![\w.@$:\\]){lead}(?P<k>{words})\s+(?:(?:class|struct)\s+)?(?P<n>{_NAME}(?:::{_NAME})*)", code):
            kind = "enum" if m.groupdict().get("e") else m["k"]
            if m["n"] not in ("extends", "implements", "for", "where"):
                yield Declaration(m.start(), m.start("n"), m["n"], _KINDS.get(kind, kind))
    if words := _FUNCTION_WORDS.get(language):
        more = {"ruby": r"(?:self\.)?(?P<n>\w+[?!=]?)", "kotlin": rf"(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<n>{_NAME})(?=\s*\()", "php": rf"&?\s*(?P<n>{_NAME})"}.get(language, rf"\*?\s*(?P<n>{_NAME})")
        for m in re.finditer(rf"(?<![\w.$])(?:{words})(?:\s+|\s*(?=\*)){more}", code):
            yield Declaration(m.start(), m.start("n"), m["n"], "function")
    if language == "go":
        for m in re.finditer(rf"(?m)^\s*type\s+(?P<n>{_NAME})(?:\[[^\]]*\])?\s+(?P<k>struct|interface)?", code):
            yield Declaration(m.start(), m.start("n"), m["n"], m["k"] or "type")
        for m in re.finditer(rf"(?m)^func\s+(?:\(\s*(?:{_NAME}\s+)?\*?\s*(?P<r>{_NAME})[^)]*\)\s*)?(?P<n>{_NAME})", code):
            yield Declaration(m.start(), m.start("n"), m["n"], "method" if m["r"] else "function", m["r"] or "")
    if language == "rust":
        for m in re.finditer(r"(?<!\w)impl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:(?P<b>[\w:]+)(?:<(?:[^<>]|<[^<>]*>)*>)?\s+for\s+)?&?(?P<n>[\w:]+)", code):
            yield Declaration(m.start(), m.start("n"), m["n"].split("::")[-1], "impl", base=m["b"] or "")
        for m in re.finditer(rf"(?<![\w.])type\s+(?P<n>{_NAME})", code):
            yield Declaration(m.start(), m.start("n"), m["n"], "type")
    if language in ("javascript", "typescript"):
        for m in re.finditer(rf"(?<![\w.$])(?:const|let|var)\s+(?P<n>{_NAME})(?:\s*:[^=;\n]+)?\s*=(?![=>])\s*(?P<f>(?:async\s*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_NAME})\s*(?::[^=;{{]+)?=>))?", code):
            yield Declaration(m.start(), m.start("n"), m["n"], "function" if m["f"] else "variable")
    if language == "kotlin":
        for m in re.finditer(rf"(?m)(?:^|[{{;])[ \t]*(?:\w+\s+)*?(?:val|var)\s+(?P<n>{_NAME})", code):
            yield Declaration(m.start("n"), m.start("n"), m["n"], "property")


def _placed(code: str, language: str, brackets: _Brackets, bodies: dict[int, Declaration]):
    """Methods and functions that are known by where they stand."""
    stops = [-1, *(m.start() for m in re.finditer(r"[;{}]", code))]
    for m in re.finditer(rf"(?<![\w.$@#])(?P<n>#?~?(?:{_NAME}::)*~?{_NAME})\s*(?:<[^<>()]*>\s*)?(?P<p>\()", code):
        top = brackets.around(m.start("p") - 1)
        free = language in _FREE and (top == -1 or (top in bodies and bodies[top].kind == "namespace"))
        if m["n"] in KEYWORDS or not (free or (top in bodies and bodies[top].kind in _CONTAINERS)):
            continue
        since = stops[bisect_right(stops, m.start()) - 1]
        before = code[since + 1 : m.start()]
        plain = re.sub(r"@[\w.]+(?:\s*\([^()]*\))?|(?m:^\s*#[^\n]*)", " ", before)
        if "=" in plain or plain.rstrip().endswith((".", "new", "return", "throw", ",")):
            continue
        words = plain.split()
        typed = [w for w in words if w not in ("public", "private", "protected", "internal", "static", "final", "abstract", "explicit", "inline", "virtual", "constexpr", "public:", "private:", "protected:")]
        if language in _TYPED and not typed:
            continue  # a constructor, or a macro
        tail = re.compile(r"\s*(?:const\b|noexcept\b|override\b|final\b|throws\s+[\w.,\s]+?|where\s[^{;]*|:\s*[^={;}]+)*\s*(\{|=>|;|=|$)").match(code, brackets.close.get(m.start("p"), len(code)) + 1)
        if tail and (tail[1] == "{" or tail[1] == "=>" and language == "csharp" or tail[1] == ";" and language not in _FREE):
            name = m["n"].split("::")
            kind = "method" if top in bodies and not free or len(name) > 1 else "function"
            yield Declaration(since + 1 + len(before) - len(before.lstrip()), m.start("n"), name[-1], kind, ".".join(name[:-1]))
    if language in ("javascript", "typescript"):
        for m in re.finditer(rf"(?<![\w.$])(?P<n>#?{_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^()]*\)|{_NAME})\s*(?::[^=;{{]+)?=>)", code):
            if (top := brackets.around(m.start())) in bodies and bodies[top].kind == "class":
                yield Declaration(m.start(), m.start("n"), m["n"], "function")


def _opened(code: str, d: Declaration) -> int:
    """Where the parenthesis opens that follows a declaration's name, or -1."""
    m = re.compile(r"[ \t]*(?:\[[^\]]*\]|<[^<>()]*>)?\s*(\()").match(code, d.name_at + len(d.name))
    return m.start(1) if m else -1


def _ends(code: str, language: str, found: list[Declaration], brackets: _Brackets) -> None:
    """Set where each declaration's body begins and ends."""
    if language == "python":
        lines = [(m.start(), len(m[1].expandtabs()), m.end()) for m in re.finditer(r"(?m)^([ \t]*)(?=\S)", code) if brackets.around(m.start() - 1) == -1]
        starts = [line[0] for line in lines]
        for d in found:
            i = bisect_right(starts, d.start) - 1
            indent, d.end = lines[i][1], len(code)
            opened = _opened(code, d)
            d.body = code.find(":", brackets.close.get(opened, d.name_at + len(d.name))) + 1
            for start, deep, _ in lines[i + 1 :]:
                if deep <= indent:
                    d.end = start
                    break
        return
    if language == "ruby":
        stack, at = [], {d.start: d for d in found}
        for m in re.finditer(r"\b(?:class|module|def|do|begin|case|end)\b|(?m:(?:^|[;=(])[ \t]*)(?:if|unless|while|until|for)\b", code):
            if m.group() != "end":
                stack.append(at.get(m.start()))
            elif stack and (d := stack.pop()):
                d.end = m.end()
        for d in found:
            d.body, d.end = (code.find("\n", d.start) + 1 or len(code)), d.end or len(code)
        return
    heads = sorted(d.start for d in found)
    for d in found:
        at = d.name_at + len(d.name)
        while True:
            m = re.compile(r"[({\[\]});]|=>?|\n\s*\n").search(code, at)
            i = bisect_right(heads, max(at, d.name_at))
            if i < len(heads) and heads[i] < (m.start() if m else len(code)):  # another one begins before this one's body: it has none
                d.body = d.end = heads[i]
            elif not m:
                d.body = d.end = len(code)
            elif m.group() in "([":
                at = brackets.close.get(m.start(), len(code)) + 1
                continue
            elif language == "go" and d.kind == "method" and "\n" in code[d.name_at : m.start()]:  # of an interface: the rest of its line
                d.body = d.end = code.index("\n", d.name_at)
            elif m.group() == "{":
                d.body, d.end = m.start(), brackets.close.get(m.start(), len(code)) + 1
            elif m.group() == ";":
                d.body = d.end = m.end()
            elif m.group() in ("=", "=>"):  # what follows is an expression, with a block of its own or not, to the end of the line or beyond open brackets
                d.body, at = m.end(), m.end()
                while (e := re.compile(r"[({\[\]});\n]").search(code, at)) and e.group() in "({[":
                    at = brackets.close.get(e.start(), len(code)) + 1
                d.end = e.start() if e else len(code)
            else:
                d.body = d.end = m.start()
            break


def _attributes(text: str, code: str, language: str, d: Declaration, brackets: _Brackets) -> None:
    """Set the text between the declaration's parentheses, and what it builds on, by commas."""
    after = d.name_at + len(d.name)
    head = code[after : d.body]
    opened = _opened(code, d)
    if d.kind not in _CONTAINERS:
        if language in ("javascript", "typescript") and opened == -1:
            opened = code.find("(", after, d.end) if "=>" in code[after : d.end] or "function" in code[after : d.end] else -1
        d.inside = text[opened + 1 : brackets.close.get(opened, opened + 1)] if opened >= 0 else ""
        return
    if language == "python":
        d.bases = text[opened + 1 : brackets.close.get(opened, opened + 1)] if opened >= 0 else ""
    elif language in ("java", "typescript", "javascript", "php", "scala"):
        m = re.search(r"\b(?:extends|implements)\b(.*)", head, re.S)
        d.bases = re.sub(r"\b(?:extends|implements|with|permits)\b", ",", m[1]) if m else ""
    elif language in ("csharp", "cpp", "kotlin"):
        at, depth = 0, 0  # past type parameters and those of a constructor
        for at, c in enumerate(head):
            depth += (c in "(<[") - (c in ")>]")
            if c == ":" and not depth and head[at - 1 : at] != ":" and head[at + 1 : at + 2] != ":":
                d.bases = re.split(r"\bwhere\b", head[at + 1 :])[0].rstrip("{ \n")
                break
    elif language == "ruby":
        m = re.match(r"\s*<\s*([\w:]+)", head)
        d.bases = m[1] if m else ""
    elif language == "rust" and d.kind == "trait":
        m = re.match(r"(?:<[^>]*>)?\s*:(.*)", re.split(r"\bwhere\b", head)[0], re.S)
        d.bases = m[1].replace("+", ",") if m else ""


def scan(text: str, language: str, path: str) -> list[tuple[Declaration, dict[tuple[str, str], int]]]:
    """The components of a file, in order, and what each refers to: {(name, kind): first line}.

    A declaration is a component unless it lies in a function. A reference
    belongs to the innermost component around it; one outside of all to none.
    """
    code = blanked(text, language)
    brackets = _Brackets(code)
    found = sorted(_heads(code, language), key=lambda d: d.start)
    _ends(code, language, found, brackets)
    if language in ("c", "cpp"):
        found = [d for d in found if code[d.body : d.body + 1] == "{" and "(" not in code[d.name_at : d.body]]
    if language == "rust":
        found = [d for d in found if d.kind != "module" or code[d.body : d.body + 1] == "{"]
    bodies = {d.body: d for d in found if d.kind in _CONTAINERS}
    if language in _PLACED or language == "go":
        known = {d.name_at for d in found}
        more = [d for d in (_placed(code, language, brackets, bodies) if language != "go" else _go_methods(code, brackets, bodies)) if d.name_at not in known]
        _ends(code, language, more, brackets)
        found = sorted(found + more, key=lambda d: d.start)

    starts = [m.end() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(starts, at) + 1
    used, open_, out, owned = set(), [], [], {}
    for d in found:
        while open_ and open_[-1].end <= d.start:
            open_.pop()
        scope = [o.name for o in open_ if o.kind in _CONTAINERS and o.kind != "namespace"]
        hidden = any(o.kind in ("function", "method") for o in open_)
        open_.append(d)
        if d.owner and not scope:
            scope = [d.owner]
        if d.kind == "impl" or hidden:
            d.path = ".".join([*scope, d.name])
            continue
        if d.kind == "function" and scope:
            d.kind = "method"
        d.path = ".".join([*scope, d.name])
        d.line = line(d.name_at)
        d.id = f"{path}::{d.path}"
        if d.id in used:
            d.id += f"#{d.line}"
        used.add(d.id)
        d.component = True
        _attributes(text, code, language, d, brackets)
        out.append((d, {}))
        owned[id(d)] = out[-1][1]

    names, hits = {d.name_at for d in found}, []
    for n, (kind, languages, expression) in enumerate(REFERENCES):
        if not languages or language in languages:
            for m in expression.finditer(text if kind == "import" else code):
                group = 1 if m[1] else 2
                first = m.start() + len(m.group()) - len(m.group().lstrip())
                if kind == "import" and code[first : first + 1].isspace() or m[group] in KEYWORDS:
                    continue  # in a comment or a string
                at = m.start(group)
                if kind == "call" and language in ("java", "scala") and code[at - 1 : at] == "@":
                    continue
                if at not in names and at + len(m[group]) - len(re.split(r"\.|::|->", m[group])[-1]) not in names:
                    hits.append((at, n, m[group], kind))
    open_, parts = [], iter(d for d in found if d.component)
    part = next(parts, None)
    for at, _, name, kind in sorted(hits):
        while part and part.start <= at:
            while open_ and open_[-1].end <= part.start:
                open_.pop()
            open_.append(part)
            part = next(parts, None)
        while open_ and open_[-1].end <= at:
            open_.pop()
        if open_:
            owned[id(open_[-1])].setdefault((name.replace("->", ".").replace("\\", "."), kind), line(at))
    types = {x.path: refs for x, refs in reversed(out)}
    for d in found:  # a type's implementation of a trait is the type's reference
        if d.kind == "impl" and d.base and d.path in types:
            types[d.path].setdefault((d.base, "base"), line(d.name_at))
    return out


def _go_methods(code: str, brackets: _Brackets, bodies: dict[int, Declaration]):
    for m in re.finditer(rf"(?m)^[ \t]*(?P<n>{_NAME})\s*\(", code):
        if (top := brackets.around(m.start("n"))) in bodies and bodies[top].kind == "interface":
            yield Declaration(m.start("n"), m.start("n"), m["n"], "method")
