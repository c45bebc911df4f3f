"""What SQL a step may be: one query over one relation, without joins, set operations, subquery expressions or commands."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from splitfold.errors import BadRequest, NotImplementedQuery, planning

#: Parsed nodes with one input that a query may have.
NODES = {"Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Generate", "Pivot", "UnresolvedPivot", "Unpivot", "Sample", "UnresolvedHint"}
LEAVES = {"UnresolvedRelation", "OneRowRelation", "UnresolvedOneRowRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "LocalRelation", "ResolvedInlineTable"}


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _walk(node, inside: frozenset[str], spark: SparkSession) -> Iterator[tuple[str, str]]:
    """(kind, detail) of each finding: relation, leaf, command, inputs, subquery."""
    kind = _name(node)
    if kind == "UnresolvedWith":
        names = inside
        for pair in _seq(node.cteRelations()):
            yield from _walk(pair._2(), names, spark)
            names = names | {pair._1().lower()}
        yield from _walk(node.child(), names, spark)
        return
    if node.containsPattern(spark._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.PLAN_EXPRESSION()):
        yield "subquery", kind
    children = _seq(node.children())
    if len(children) > 1:
        yield "inputs", kind
        return
    if not children:
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if not (len(parts) == 1 and parts[0].lower() in inside):
                yield "relation", ".".join(parts)
        elif kind in LEAVES:
            yield "leaf", kind
        else:
            yield "command", kind
        return
    if kind not in NODES:
        yield "command", kind
    yield from _walk(children[0], inside, spark)


def check_step(spark: SparkSession, sql: str, relation: str | None, what: str) -> str:
    """The one relation that sql reads; it must be ``relation`` where given."""
    with planning(what):
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found = list(_walk(parsed, frozenset(), spark))
    of = lambda k: [d for kind, d in found if kind == k]
    if of("command"):
        raise BadRequest(f"{what}: only queries are allowed, not {of('command')[0]}")
    if of("inputs"):
        raise NotImplementedQuery(f"{what}: {of('inputs')[0]} has more than one input; a step reads a single source")
    if of("subquery"):
        raise NotImplementedQuery(f"{what}: subquery expressions")
    if of("leaf"):
        raise BadRequest(f"{what}: it must read a table, not {of('leaf')[0]}")
    names = {n.lower() for n in of("relation")}
    if len(names) != 1:
        raise BadRequest(f"{what}: it must read one table")
    if relation is not None and names != {relation.lower()}:
        raise BadRequest(f"{what}: it must read {relation}, not {of('relation')[0]}")
    return of("relation")[0]
