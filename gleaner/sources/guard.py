"""Read-only queries: a walk over a parsed query that lets through what is known.

Nothing is analyzed or run before the walk is over.  Nodes, functions and
relations that aren't on a list are refused, so a statement that Spark learns
later is refused too.  Only types and names are looked at, never the text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Nodes of a parsed query.
NODES = frozenset(
    "Aggregate CTE Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project ResolvedInlineTable "
    "Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases "
    "UnresolvedTableValuedFunction UnresolvedWith Window WithWindowDefinition".split()
)
#: Groups of built-in functions; the one of java_method and reflect isn't here.
GROUPS = frozenset(f"{x}_funcs" for x in "agg array bitwise collection conditional conversion datetime generator hash json lambda map math predicate string struct url variant window".split())
#: Functions that stand for a table.
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer stack json_tuple".split())
#: Expressions that hide a name until they are analyzed.
HIDDEN = frozenset(["ExpressionWithUnresolvedIdentifier", "UnresolvedExtractValueIdentifier", "PythonUDF", "ScalaUDF", "CallMethodViaReflection"])
_CATALYST = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Walk:
    def __init__(self, spark: SparkSession, relations: frozenset[str]):
        jvm, state = spark.sparkContext._jvm, spark._jsparkSession.sessionState()
        self._known, self.used = relations, set()
        self._registry, self._id = state.functionRegistry(), jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self._plan = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self._subquery = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def plan(self, node, names: frozenset[str]) -> None:
        """names: of the common table expressions in scope."""
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            raise PermissionError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            self._relation(list(_items(node.multipartIdentifier())), names)
        elif kind == "UnresolvedTableValuedFunction":
            self._name(list(_items(node.name())), TABLE_FUNCTIONS)
        elif kind == "UnresolvedWith":
            recursive = node.allowRecursion()
            for named in _items(node.cteRelations()):
                name = named._1().lower()
                self.plan(named._2(), names | {name} if recursive else names)
                names |= {name}
        for expression in _items(node.expressions()):
            self._expression(expression, names)
        for child in _items(node.children()):
            self.plan(child, names)

    def _relation(self, parts: list[str], names: frozenset[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in self._known | names:
            raise PermissionError(f"no such table: {'.'.join(parts)}")
        if parts[0].lower() not in names:
            self.used.add(parts[0].lower())

    def _name(self, parts: list[str], known: frozenset[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in known:
            raise PermissionError(f"not allowed in a query: {'.'.join(parts)}")

    def _function(self, parts: list[str]) -> None:
        found = self._registry.lookupFunction(self._id(parts[0].lower())) if len(parts) == 1 else None
        if found is None or found.isEmpty() or found.get().getGroup() not in GROUPS:
            raise PermissionError(f"not allowed in a query: {'.'.join(parts)}")

    def _expression(self, e, names: frozenset[str]) -> None:
        kind = e.getClass().getName()
        short = kind.rsplit(".", 1)[-1]
        if short in HIDDEN or not kind.startswith(_CATALYST):
            raise PermissionError(f"not allowed in a query: {short}")
        if short == "UnresolvedFunction":
            self._function(list(_items(e.nameParts())))
            if e.filter().isDefined():
                self._expression(e.filter().get(), names)
        if self._subquery.isInstance(e):
            self.plan(e.plan(), names)
        for child in _items(e.children()):
            self._expression(child, names)


def tables_of(spark: SparkSession, text: str, relations: frozenset[str]) -> set[str]:
    """Those of the relations that a query reads; PermissionError if it does
    anything but read these with functions that are known."""
    walk = _Walk(spark, relations)
    walk.plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset())
    return walk.used
