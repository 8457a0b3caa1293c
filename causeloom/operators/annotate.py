"""Silver annotations: two clauses around a connector, as column expressions; and functions out of source code.

Connectors are (language, connector, relation, direction, confidence) in order of priority, and
stop words are (language, words); both are the caller's.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.emission import lookup, node_type

#: Content words that two clauses have together, words of a sentence, and characters of a function, at least.
CONTENT, WORDS, FUNCTION = 4, 6, 50


def content_words(text: Column, stop: list[str]) -> Column:
    """Words of three letters or more that are no stop words, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^[ ,;:]+|[ ,;:]+$", "")


def silver(texts: DataFrame, connectors: list[tuple[str, str, str, str, float]], stop: dict[str, list[str]], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``texts`` with ``silver``: source, target, relation, confidence, connector of the first connector that parts a text in two, or null.

    A connector that begins a text parts it at the first comma, and what it leads in is the
    source.  Each side needs a content word, both together ``CONTENT``.
    """
    text, best = F.trim(F.col(text_col)), F.lit(None).cast("struct<source:string,target:string,relation:string,confidence:double,connector:string>")
    for language, connector, relation, direction, confidence in reversed(connectors):
        pattern = rf"(?iu)^(.*?)(?<![\p{{L}}\p{{N}}_]){re.escape(connector)}(?![\p{{L}}\p{{N}}_])(.*)$"
        part = lambda k: _trimmed(F.regexp_extract(text, f"(?s){pattern}", k))  # noqa: B023, E731
        before, after = part(1), part(2)
        led = (before == "") & (F.instr(after, ",") > 0)
        first = F.when(led, _trimmed(F.substring_index(after, ",", 1))).otherwise(before)
        second = F.when(led, _trimmed(F.substr(after, F.instr(after, ",") + 1))).otherwise(after)
        forward = led | F.lit(direction == "forward")
        many = [F.size(content_words(x, stop.get(language, []))) for x in (first, second)]
        fits = (F.col(lang_col) == language) & text.rlike(f"(?s){pattern}") & (many[0] >= 1) & (many[1] >= 1) & (many[0] + many[1] >= CONTENT)
        one = F.struct(
            F.when(forward, first).otherwise(second).alias("source"), F.when(forward, second).otherwise(first).alias("target"),
            F.lit(relation).alias("relation"), F.lit(float(confidence)).alias("confidence"), F.lit(connector).alias("connector"),
        )
        best = F.when(fits, one).otherwise(best)
    return texts.withColumn("silver", best)


def by_pattern(texts: DataFrame, patterns: list[tuple[str, str]], stop: list[str], text_col: str = "text") -> DataFrame:
    """``texts`` with ``relation``, that of the first pattern that matches, and ``labels``, its first three words of four letters that are no stop words."""
    relation = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        relation = F.when(F.col(text_col).rlike(pattern), name).otherwise(relation)
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}]{4,})"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return texts.withColumns({"relation": relation, "labels": F.slice(F.array_distinct(kept), 1, 3)})


def by_connector(texts: DataFrame, connectors: list[tuple[str, str, str]], text_col: str = "text") -> DataFrame:
    """``texts`` with ``found``: source, target, relation around the first listed connector in a text of ``WORDS`` words; one side empty gives null."""
    text = F.col(text_col)
    found = F.lit(None).cast("struct<source:string,target:string,relation:string>")
    for connector, relation, direction in reversed(connectors):
        at = F.instr(F.lower(text), connector.lower())
        before, after = F.trim(F.substr(text, F.lit(1), at - 1)), F.trim(F.substr(text, at + len(connector)))
        sides = (before, after) if direction == "forward" else (after, before)
        one = F.struct(sides[0].alias("source"), sides[1].alias("target"), F.lit(relation).alias("relation"))
        found = F.when(at > 0, F.when((before != "") & (after != ""), one)).otherwise(found)
    long = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) >= WORDS
    return texts.withColumn("found", F.when(long, found))


def normalised(edges: DataFrame, known: list[str], aliases: dict[str, str]) -> DataFrame:
    """Edges (source or sources, target, relation, …) with sources as an array and relations by their present names; unheard ones go."""
    name = F.lower(F.trim("relation"))
    relation = lookup(name, aliases, name) if aliases else name
    sources = F.col("sources") if "sources" in edges.columns else F.array("source")
    sources = F.coalesce(sources, F.array("source")) if {"source", "sources"} <= set(edges.columns) else sources
    rows = edges.withColumn("relation", relation).withColumn("sources", sources)
    return rows.where(F.col("relation").isin(*known)).drop("source")


def normalised_nodes(nodes: DataFrame, known: list[str]) -> DataFrame:
    """Nodes with types by their present names; unheard ones go."""
    return nodes.withColumn("node_type", node_type(F.lower(F.trim("node_type")))).where(F.col("node_type").isin(*known))


def positional_accuracy(rows: DataFrame) -> DataFrame:
    """One row (n, accuracy) over (predicted, gold) arrays: places of the shorter list at which both agree."""
    size = F.least(F.size("predicted"), F.size("gold"))
    both = F.zip_with(F.slice("predicted", F.lit(1), size), F.slice("gold", F.lit(1), size), lambda a, b: a.eqNullSafe(b).cast("int"))
    hits = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    return rows.agg(F.sum(size).alias("n"), F.round(F.coalesce(F.sum(hits) / F.sum(size), F.lit(0.0)), 6).alias("accuracy"))


def functions_of(source: str, language: str, heads: dict[str, str], least: int = FUNCTION) -> list[str]:
    """The functions of a source file: by its syntax tree for Python, by a head pattern and matching braces for others."""
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        lines = source.splitlines()
        found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        texts = ["\n".join(lines[n.lineno - 1 : n.end_lineno]).strip() for n in found]
    else:
        texts = []
        for head in re.finditer(heads[language], source) if language in heads else ():
            depth = 0
            for brace in re.compile("[{}]").finditer(source, head.end()):
                depth += 1 if brace.group() == "{" else -1
                if depth <= 0:
                    if depth == 0:
                        texts.append(source[head.start() : brace.end()].strip())
                    break
    return [t for t in texts if len(t) >= least]


def extract_functions(files: DataFrame, heads: dict[str, str], least: int = FUNCTION) -> DataFrame:
    """(id, place, function) of files (id, language, source); a map over the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (i, k, f) for i, language, source in zip(*(c.to_pylist() for c in batch.columns))
                for k, f in enumerate(functions_of(source or "", language or "", heads, least))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["id", "place", "function"])

    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "language", "source").mapInArrow(run, f"id {kind}, place int, function string")
