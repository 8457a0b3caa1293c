"""The question language: one verb and at most two labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import middle, reports, traverse
from .graph import Graph


class QueryParseError(ValueError):
    """The text is no question of the language."""


@dataclass(frozen=True)
class Query:
    verb: str
    args: tuple[str, ...] = ()


NONE = {"CYCLES", "GAPS", "SPOF"}
ONE = {"WHY", "WHAT", "DO", "COUNTERFACTUAL", "EXPLAIN", "ZOOM_IN", "ZOOM_OUT", "AGGREGATE", "CENTRALITY", "COVERAGE", "RELIABILITY"}
TWO = {"CHAIN", "ANALOGY", "DIFF", "CHAIN_T", "BEFORE?", "DELAY"}


def parse(text: str) -> Query:
    """Only the verb is folded to upper case; a trailing question mark is dropped; pairs part at ``->`` or a comma."""
    body = text.strip()
    head, _, rest = body.partition(" ")
    verb = head.upper()
    if verb not in TWO or rest:
        rest = rest.strip().rstrip("?").strip()
    if verb not in TWO and verb.endswith("?"):
        verb = verb.rstrip("?")
    if verb in NONE and not rest:
        return Query(verb)
    if verb == "DENSITY":
        return Query(verb, (rest,) if rest else ())
    if verb in ONE and rest:
        return Query(verb, (rest,))
    if verb in TWO:
        left, _, right = rest.partition("->") if "->" in rest else rest.partition(",")
        if left.strip() and right.strip():
            return Query(verb, (left.strip(), right.strip()))
    raise QueryParseError(f"{text!r}: expected one of {', '.join(sorted(NONE | ONE | TWO | {'DENSITY'}))}")


def _of_node(rows: DataFrame, graph: Graph, label: str) -> DataFrame:
    """The rows of the node that a label means; two nodes may share a label, so it is told by its id."""
    return rows.where(rows["node_id"] == graph.best(label)).drop("node_id")


def run(graph: Graph, text: str) -> DataFrame:
    """Answer a question of any of the verbs."""
    q = parse(text)
    walks = {
        "WHY": traverse.why, "WHAT": traverse.what, "EXPLAIN": traverse.explain, "DO": traverse.intervene, "COUNTERFACTUAL": traverse.counterfactual,
        "CHAIN": traverse.path, "CHAIN_T": traverse.temporal_chain, "BEFORE?": traverse.before, "DELAY": traverse.delay, "DIFF": traverse.difference,
        "GAPS": reports.gaps, "ANALOGY": reports.analogy, "ZOOM_IN": reports.zoom_in, "CYCLES": middle.cycles, "SPOF": middle.spof,
    }
    if q.verb in walks:
        return walks[q.verb](graph, *q.args)
    every = {"ZOOM_OUT": reports.zoom_out, "CENTRALITY": reports.centrality, "COVERAGE": reports.coverage, "RELIABILITY": reports.reliability}
    if q.verb in every:
        return _of_node(every[q.verb](graph, ids=True), graph, q.args[0])
    if q.verb == "AGGREGATE":
        node = graph.best(q.args[0])
        found = reports.aggregate(graph)
        return found.where(found["parent"] == node)
    found = reports.density(graph, ids=True)
    return _of_node(found, graph, q.args[0]) if q.args else found.select("n_nodes", "n_edges", "density").distinct()
