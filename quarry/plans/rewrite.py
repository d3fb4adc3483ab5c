"""Rewrites of the syntax tree before it is lowered: cost order, simplification, weakening."""

from __future__ import annotations

from collections.abc import Callable

from .query import CONTENT_KEYS, METADATA_KEYS, REACT_KEYS, SEMANTIC_KEYS, And, Node, Not, Or, Predicate, canonical, chain, flatten

#: Relative costs of predicates by class, and of what isn't a predicate.
COSTS = {**dict.fromkeys(METADATA_KEYS, 0), **dict.fromkeys(CONTENT_KEYS, 10), **dict.fromkeys(SEMANTIC_KEYS, 20), **dict.fromkeys(REACT_KEYS, 25)}
UNKNOWN_COST, NOT_COST, AND_COST, OR_COST = 30, 5, 15, 40


def cost(node: Node) -> int:
    match node:
        case Predicate(key, _):
            return COSTS.get(key, UNKNOWN_COST)
        case Not(child):
            return cost(child) + NOT_COST
        case And():
            return AND_COST
        case Or():
            return OR_COST


def cost_sorted(node: Node) -> Node:
    """AND chains with their cheap operands first; the order among equals, and of OR chains, stays."""
    match node:
        case And():
            return chain(And, sorted(map(cost_sorted, flatten(node, And)), key=cost))
        case Or(left, right):
            return Or(cost_sorted(left), cost_sorted(right))
        case Not(child):
            return Not(cost_sorted(child))
        case _:
            return node


def simplified(node: Node) -> Node:
    """Without double negation and repeated operands. For explanations: it loses a negated negation's match ranges."""
    match node:
        case Predicate():
            return node
        case Not(child):
            inner = simplified(child)
            return inner.child if isinstance(inner, Not) else Not(inner)
        case And(left, right) | Or(left, right):
            kind = type(node)
            operands = flatten(simplified(left), kind) + flatten(simplified(right), kind)
            return chain(kind, list({canonical(x): x for x in reversed(operands)}.values())[::-1])


TRUE, FALSE = True, False
Weak = Node | bool


def weakened(node: Node, keep: Callable[[Predicate], Weak], up: bool = True) -> Weak:
    """What every match of ``node`` satisfies, in terms of the predicates that ``keep`` keeps or replaces.

    ``keep`` gives a predicate that is true wherever its argument is, or True where it knows none. Under NOT the bound
    turns: a replaced predicate is no bound from below, so it counts as False there unless it was kept as it is.
    """
    match node:
        case Predicate():
            got = keep(node)
            return got if up or got == node else FALSE
        case Not(child):
            got = weakened(child, keep, not up)
            return not got if isinstance(got, bool) else Not(got)
        case And(left, right):
            a, b = weakened(left, keep, up), weakened(right, keep, up)
            if a is FALSE or b is FALSE:
                return FALSE
            return b if a is TRUE else a if b is TRUE else And(a, b)
        case Or(left, right):
            a, b = weakened(left, keep, up), weakened(right, keep, up)
            if a is TRUE or b is TRUE:
                return TRUE
            return b if a is FALSE else a if b is FALSE else Or(a, b)


def metadata_part(node: Node) -> Weak:
    return weakened(node, lambda p: p if p.key in METADATA_KEYS else TRUE)


def unsound_metadata_part(node: Node) -> Weak:
    """As an older engine prefilters: other predicates count as true wherever they stand, and so does NOT of one."""
    match node:
        case Predicate(key, _):
            return node if key in METADATA_KEYS else TRUE
        case Not(Predicate(key, _)):
            return node if key in METADATA_KEYS else TRUE
        case Not(child):
            got = unsound_metadata_part(child)
            return not got if isinstance(got, bool) else Not(got)
        case And(left, right):
            a, b = unsound_metadata_part(left), unsound_metadata_part(right)
            if a is FALSE or b is FALSE:
                return FALSE
            return b if a is TRUE else a if b is TRUE else And(a, b)
        case Or(left, right):
            a, b = unsound_metadata_part(left), unsound_metadata_part(right)
            if a is TRUE or b is TRUE:
                return TRUE
            return b if a is FALSE else a if b is FALSE else Or(a, b)
