"""Components of source files and what they refer to, from one scan of each file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import is_builtin
from ..session import checkpointed, whole_texts
from .scanner import KEYWORDS, scan

_FOUND = "relative_path string, language string, id string, name string, component_type string, qualified_name string, start_line int, end_line int, source_code string, inside string, bases string, refs array<struct<name:string,kind:string,line:int>>"
_TYPES = ("class", "interface", "enum", "record", "struct", "trait", "object", "type", "module", "namespace", "union")


def _scanned(batches):
    """Files -> a row for each component, with what it refers to."""
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(" array")[0].split(", ")}
        for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "language", "content")), strict=True):
            for d, refs in scan(text or "", language, path):
                code = text[d.start : d.end].rstrip()
                row = (path, language, d.id, d.name, d.kind, d.path, d.line, d.line + code[d.name_at - d.start :].count("\n"), code, d.inside, d.bases, [{"name": n, "kind": k, "line": at} for (n, k), at in refs.items()])
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
        kinds = {"start_line": pa.int32(), "end_line": pa.int32(), "refs": pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())]))}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], list(out))


def split_parameters(text: Column) -> Column:
    """What stands between the commas that are in no round, square or angle bracket, however deep; a closing one too many counts for nothing."""
    state = "struct<at:int,round:int,square:int,angle:int,cuts:array<int>>"

    def step(s: Column, c: Column) -> Column:
        depth = lambda name, a, b: F.when(c == a, s[name] + 1).when(c == b, F.greatest(s[name] - 1, F.lit(0))).otherwise(s[name]).alias(name)
        cut = (c == ",") & (s["round"] == 0) & (s["square"] == 0) & (s["angle"] == 0)
        cuts = F.when(cut, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"])
        return F.struct((s["at"] + 1).alias("at"), depth("round", "(", ")"), depth("square", "[", "]"), depth("angle", "<", ">"), cuts.alias("cuts")).cast(state)

    start = F.expr(f"cast(named_struct('at', 1, 'round', 0, 'square', 0, 'angle', 0, 'cuts', array()) as {state})")
    cuts = F.aggregate(F.split(text, ""), start, step, lambda s: s["cuts"])
    starts, ends = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda c: c + 1)), F.concat(cuts, F.array(F.length(text) + 1))
    parts = F.zip_with(starts, ends, lambda a, b: F.regexp_replace(F.substring(text, a, b - a), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def _attributes(df: DataFrame) -> DataFrame:
    """Scanned components -> with parameters, base_classes, docstring (Python's)."""
    # a base's name: no keyword argument, access word, generic part or arguments
    bases = F.filter(split_parameters(F.col("bases")), lambda x: ~x.contains("="))
    named = F.transform(bases, lambda x: F.replace(F.trim(F.regexp_replace(F.regexp_replace(x, r"^(?:(?:public|private|protected|virtual)\s+)+", ""), r"(?s)[<(\[{].*$", "")), F.lit("::"), F.lit(".")))
    doc = F.regexp_extract("source_code", r'(?s)^\s*(?:async\s+)?(?:def|class)\b.*?:[ \t]*\n\s*([rRuU]?(?:"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"[^"\n]*"|\'[^\'\n]*\'))', 1)
    return df.withColumns({
        "parameters": split_parameters(F.col("inside")),
        "base_classes": F.array_sort(F.array_distinct(F.filter(named, lambda x: (x != "") & ~is_builtin(F.col("language"), x)))),
        "docstring": F.when((F.col("language") == "python") & (doc != ""), doc),
    }).drop("inside", "bases")


def components(files: DataFrame) -> DataFrame:
    """files (relative_path, language, content) -> id, name, component_type, relative_path, language, start_line, end_line, source_code, qualified_name, parameters, base_classes, docstring, refs.

    An id is the path, :: and the names of the types around it and its own; of
    repeated ones the later have their line added. A function in a type is a
    method; what a function declares inside itself is no component. `refs` holds
    what each component refers to outside of the components inside it. Files
    without language give none; a null text is empty.
    """
    whole_texts(files.sparkSession)
    texts = files.where("language is not null").select("relative_path", "language", F.col("content").cast("string").alias("content"))
    return _attributes(checkpointed(texts.mapInArrow(_scanned, _FOUND)))


def references(components_: DataFrame) -> DataFrame:
    """components -> ref, owner, relative_path, language, name, kind (call, instantiate, import, type, base), line: what each component refers to, each name once, by its first kind and line.

    A component's own name, its type's, words that call nothing and built-in
    names are left out.
    """
    kinds = F.array(*[F.lit(k) for k in ("call", "instantiate", "import", "type", "base")])
    based = F.transform("base_classes", lambda x: F.struct(x.alias("name"), F.lit("base").alias("kind"), F.col("start_line").cast("int").alias("line")))
    rows = components_.select(F.col("id").alias("owner"), "relative_path", "language", "qualified_name", F.explode(F.concat("refs", based)).alias("r")).select("owner", "relative_path", "language", "qualified_name", "r.name", "r.kind", "r.line")
    path = F.split("qualified_name", r"\.")
    own = (F.col("name") == F.element_at(path, -1)) | (F.col("name") == F.col("qualified_name")) | F.coalesce(F.col("name") == F.try_element_at(path, F.lit(-2)), F.lit(False)) | F.endswith("qualified_name", F.concat(F.lit("."), F.col("name")))
    rows = rows.where(~own & ~F.col("name").isin(*KEYWORDS) & ~is_builtin(F.col("language"), F.col("name")))
    first = rows.groupBy("owner", "relative_path", "language", "name").agg(F.min_by("kind", F.array_position(kinds, F.col("kind"))).alias("kind"), F.min("line").alias("line"))
    return first.withColumn("ref", F.concat_ws("\x01", "owner", "name"))
