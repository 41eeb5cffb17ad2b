"""Expressions over page text: headings, prose, links, diagrams, truncation, escaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for the text that a cut leaves out.
MARKER = "\n... [diff truncated] ...\n"
#: The ranges of CJK characters, which count one by one.
_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}"
#: Labels of diagrams that say nothing, and parts of those that are about building instead of running.
GENERIC_LABELS = (
    "caller", "entry", "core", "result", "reader", "readers and listings", "model", "record", "parent", "child", "module", "component", "source", "target", "input", "output",
    "fixture", "assertion", "all", "other",
)
SUPPORT_TERMS = ("build", "test", "release", "smoke", "verify", "packag", "deployment", "ci")
#: White space within a line.
_BLANK = r"[^\S\n]"
#: Blocks whose text isn't the page's, a kind at a time; one that isn't closed reaches to the end.
_KINDS = ("code", "file", "nowiki")
_OPAQUE = tuple(rf"(?s)<{kind}(?=[\x20\t\n\f\r>]|\z)(?:[^>]*>.*?(?:</{kind}>|\z)|[^>]*\z)" for kind in _KINDS)
#: What lies between marks that balance, no deeper than there are kinds, as blocks of one kind don't nest.
_MARKED = "\x02[^\x02\x03]*+\x03"
for _ in _OPAQUE[1:]:
    _MARKED = f"\x02[^\x02\x03]*+(?:{_MARKED}[^\x02\x03]*+)*+\x03"
_MERMAID = r"(?s)<mermaid>.*?(?:</mermaid>|\z)"
_HEADING = rf"(?m)^{_BLANK}*(={{2,}}+)([^\n]*?(?<!=))\1{_BLANK}*$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token_estimate(text: Column) -> Column:
    """A token for each four characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def is_heading(line: Column) -> Column:
    """Two or more = on either side, as many on one as on the other, and something between."""
    return line.rlike(_HEADING)


def headings(text: Column) -> Column:
    """The visible texts of the heading lines, A-Z lower-cased."""
    found = F.regexp_extract_all(text, F.lit(_HEADING), F.lit(2))
    return F.filter(F.transform(found, lambda x: lower_az(F.trim(visible(x)))), lambda x: x != "")


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def visible(text: Column) -> Column:
    """What a line shows: labels of links, no markup of emphasis, no tags, nothing between '' or %%."""
    return F.regexp_replace(text, r"\[\[(?:(?!\]\])[^|\n])*\|((?:(?!\]\])[^\n])*)\]\]|\[\[((?:(?!\]\])[^|\n])*)\]\]|''.*?''|%%.*?%%|\*\*|//|__|~~|<[A-Za-z/][^>\n]*>", "$1$2")


def _without(text: Column, blocks: str) -> Column:
    """text without what the expression finds; a mark and its line feeds stay for each, so that lines keep their beginnings."""

    def cut(text: Column) -> Column:
        left = F.transform(F.regexp_extract_all(text, F.lit(blocks), F.lit(0)), lambda x: F.concat(F.lit("\x01"), F.regexp_replace(x, "[^\n]+", ""), F.lit("\x01")))
        joined = F.array_join(F.zip_with(F.split(text, blocks, -1), left, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(text.rlike(blocks), joined).otherwise(text)

    return bound(text, cut)


def shown_source(text: Column) -> Column:
    """The page without code, file and nowiki blocks.

    Each kind's blocks are found without regard to the others; where blocks of
    several kinds overlap, all that they cover goes. U+0001 to U+0003 aren't
    shown in a page with blocks.
    """

    def mark(name: str, kind: str) -> Callable[[Column], Column]:
        return lambda x: F.when(F.contains(x, F.lit(f"<{name}")), F.regexp_replace(x, kind, "\x02$0\x03")).otherwise(x)

    def cut(text: Column) -> Column:
        marked = F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "")).otherwise(text)
        for name, kind in zip(_KINDS, _OPAQUE, strict=True):
            marked = bound(marked, mark(name, kind))
        return F.when(text.rlike("<(?:code|file|nowiki)"), _without(marked, _MARKED)).otherwise(text)

    return bound(text, cut)


def running_source(shown: Column) -> Column:
    """shown_source's text without diagrams."""
    return _without(shown, _MERMAID)


def prose(source: Column) -> Column:
    """The running text of running_source's: no headings, lists, quotes, tables or indented lines, and without markup."""
    kept = F.regexp_replace(source, rf"{_HEADING}|(?m)^{_BLANK}*[*\->|^][^\n]*$|(?m)^{_BLANK}{{2,}}[^\n]*$", "")
    return visible(kept)


def source_counts(source: Column) -> Column:
    """words (runs of letters, digits and _ outside CJK) and cjk (characters) of the running text of running_source's."""
    words, cjk = F.lit(rf"[[\p{{IsAlphabetic}}\p{{N}}_]&&[^{_CJK}]]+"), F.lit(f"[{_CJK}]")
    return bound(prose(source), lambda x: F.struct(F.regexp_count(x, words).cast("long").alias("words"), F.regexp_count(x, cjk).cast("long").alias("cjk")))


def prose_counts(text: Column) -> Column:
    """source_counts of a page's text."""
    return source_counts(running_source(shown_source(text)))


def truncated(text: Column, tokens: int) -> Column:
    """At most four characters a token: the head and the tail, with a marker between them."""
    most = tokens * 4
    if most <= len(MARKER):
        return F.when(F.length(text) <= most, text).otherwise(F.substring(text, 1, most))
    head = (most - len(MARKER)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(most - len(MARKER) - head))))


def source_links(source: Column) -> Column:
    """Targets of [[links]] in running_source's text, without label and section."""
    return F.transform(F.regexp_extract_all(source, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x))


def wiki_links(text: Column) -> Column:
    """source_links of a page's text."""
    return source_links(running_source(shown_source(text)))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"'#]*)"""), F.lit(1))


def title(text: Column, fallback: Column) -> Column:
    """The first heading as it is written, else the fallback."""
    first = F.trim(F.regexp_extract(text, _HEADING, 2))
    return F.when(first != "", first).otherwise(fallback)


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def anchor(page: Column) -> Column:
    return F.concat(F.lit("page-"), F.replace(page, F.lit(":"), F.lit("-")))


def unquoted(text: Column) -> Column:
    """Percent escapes decoded; + stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def rendered(template: Column | str, values: dict[str, Column]) -> Column:
    """A prompt: each {key} replaced."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def mermaid_blocks(shown: Column) -> Column:
    """The bodies of the closed diagrams in shown_source's text; an opening tag inside a diagram is text."""
    return F.regexp_extract_all(shown, F.lit(r"(?s)<mermaid>(.*?)</mermaid>"), F.lit(1))


def mermaid_balanced(shown: Column) -> Column:
    """Whether opening and closing tags of diagrams take turns in shown_source's text."""
    tags = F.array_join(F.regexp_extract_all(shown, F.lit("<(/?)mermaid>"), F.lit(1)), ",")
    return ~F.contains(shown, F.lit("mermaid>")) | tags.rlike("^(?:,/(?:,(?=,/)|$))*$")


def diagram_text(label: Column) -> Column:
    """A label as it is compared: ASCII letters and digits in lower case, one space between words."""
    low = F.when(label.rlike(r"^\p{ASCII}*\z"), F.lower(label)).otherwise(lower_az(label))
    return F.when(label.rlike(r"^[a-z0-9]*\z"), label).otherwise(F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", ""), r"\s+", " ")))


def is_generic_label(label: Column) -> Column:
    return diagram_text(label).isin(*GENERIC_LABELS)


def is_support_label(label: Column) -> Column:
    return diagram_text(label).rlike("|".join(SUPPORT_TERMS))


def source_tokens(text: Column) -> Column:
    """Runs of letters, digits and _."""
    return F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))
