"""Three-valued logic: true, false and NULL for supported, refuted and unknown.

SQL's AND, OR and NOT are Kleene's.  Aggregates skip nulls, so conjunctions over
arrays use ``forall`` and ``exists``, which do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state_name(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value, "supported").when(~value, "refuted").otherwise("unknown")


def state_value(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name == "supported", F.lit(True)).when(name == "refuted", F.lit(False))


def all_of(values: Column | str) -> Column:
    return F.forall(values, lambda x: x)


def any_of(values: Column | str) -> Column:
    return F.exists(values, lambda x: x)


def expression_ids(expr) -> set[str]:
    """Condition ids of an expression: an id, or one of {all: [...]}, {any: [...]}, {not: ...}."""
    if isinstance(expr, str):
        return {expr}
    if not isinstance(expr, dict) or len(expr) != 1:
        raise ValueError("an expression is an id or a single all, any or not")
    ((op, value),) = expr.items()
    if op == "not":
        return expression_ids(value)
    if op not in ("all", "any") or not isinstance(value, list) or not value:
        raise ValueError("all and any take a list of expressions")
    return set().union(*map(expression_ids, value))


def compile_expression(expr, states: Column) -> Column:
    """The expression over a map column of condition states; a missing condition is unknown."""
    expression_ids(expr)
    if isinstance(expr, str):
        return F.try_element_at(states, F.lit(expr))
    ((op, value),) = expr.items()
    if op == "not":
        return ~compile_expression(value, states)
    out = compile_expression(value[0], states)
    for part in value[1:]:
        right = compile_expression(part, states)
        out = out & right if op == "all" else out | right
    return out
