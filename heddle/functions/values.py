"""Rules on tagged values. A value is a tag and its text; rules are data, compiled to Columns by kind.

`register` adds a kind of value rule, `register_node` one over a node's attributes; both take a function that builds a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("bool", "integer", "real", "complex", "string", "symbol", "reference", "list", "array", "tuple", "record", "dict", "nothing", "encoded")
VALUE_KINDS = ("any", "bool", "integer", "real", "number", "string", "symbol", "reference", "list")
RuleBuilder = Callable[[Column, Column, Column, Column], Column]  # tag, value, parameter, parameters -> passed
_rules: dict[str, RuleBuilder] = {}
_node_rules: dict[str, Callable[[Column, Column], Column]] = {}

NUMERIC = ("integer", "real")


def number(value: Column) -> Column:
    return value.try_cast("double")


def register(kind: str, build: RuleBuilder) -> None:
    _rules[kind] = build


def register_node(kind: str, build: Callable[[Column, Column], Column]) -> None:
    """`build` takes the node's attributes (map of name to text) and the rule's fields (array)."""
    _node_rules[kind] = build


register("finite", lambda t, v, p, ps: t.isin(*NUMERIC) & number(v).isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")))
register("gt", lambda t, v, p, ps: number(v) > number(p))
register("ge", lambda t, v, p, ps: number(v) >= number(p))
register("lt", lambda t, v, p, ps: number(v) < number(p))
register("le", lambda t, v, p, ps: number(v) <= number(p))
register("nonempty", lambda t, v, p, ps: F.length(v) > 0)
register("one_of", lambda t, v, p, ps: F.array_contains(ps, v))
register_node(
    "ordered",
    lambda attrs, fields: F.forall(
        F.sequence(F.lit(1), F.size(fields) - 1),
        lambda i: F.when(F.size(fields) < 2, F.lit(True)).otherwise(number(F.try_element_at(attrs, F.get(fields, i))) >= number(F.try_element_at(attrs, F.get(fields, i - 1)))),
    ),
)


def known_rule(kind: Column) -> Column:
    return kind.isin(*_rules)


def known_node_rule(kind: Column) -> Column:
    return kind.isin(*_node_rules)


def passes(kind: Column, tag: Column, value: Column, parameter: Column, parameters: Column) -> Column:
    """Whether a value passes a rule; null kinds and unknown ones don't."""
    out = reduce(lambda acc, k: acc.when(kind == k, F.coalesce(_rules[k](tag, value, parameter, parameters), F.lit(False))), _rules, F.when(F.lit(False), F.lit(True)))
    return F.coalesce(out, F.lit(False))


def node_passes(kind: Column, attrs: Column, fields: Column) -> Column:
    out = reduce(lambda acc, k: acc.when(kind == k, _node_rules[k](attrs, fields)), _node_rules, F.when(F.lit(False), F.lit(True)))
    return F.coalesce(out, F.lit(False))


def of_kind(tag: Column, kind: Column) -> Column:
    """Whether a tag is of a portable value kind; null for an unknown kind."""
    return (
        F.when(kind == "any", True)
        .when(kind == "real", tag.isin("integer", "real"))
        .when(kind == "number", tag.isin("integer", "real", "complex"))
        .when(kind == "list", tag.isin("list", "array", "tuple"))
        .when(kind.isin("bool", "integer", "string", "symbol", "reference"), tag == kind)
    )


def of_type(tag: Column, value: Column, kind: Column, enum_values: Column) -> Column:
    """Whether a tagged value has a logical type."""
    return F.coalesce(
        F.when(kind == "real", tag.isin("integer", "real")).when(kind == "enum", (tag == "symbol") & F.array_contains(enum_values, value)).otherwise(tag == kind),
        F.lit(False),
    )


def default_message(kind: Column, name: Column, parameter: Column, parameters: Column) -> Column:
    sign = F.create_map(*[F.lit(x) for kv in {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items() for x in kv])[kind]
    return (
        F.when(kind == "finite", F.format_string("attribute %s must be finite", name))
        .when(sign.isNotNull(), F.format_string("attribute %s must be %s %s", name, sign, parameter))
        .when(kind == "nonempty", F.format_string("attribute %s must not be empty", name))
        .when(kind == "one_of", F.format_string("attribute %s must be one of %s", name, F.array_join(parameters, ", ")))
        .otherwise(F.format_string("attribute %s failed validation rule %s", name, kind))
    )
