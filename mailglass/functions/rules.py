"""The rule language, compiled to SQL expressions: twelve operators, exclusions, conjunctions, dictionaries, reasons.

A rule becomes a text that Spark parses once, not a tree of Column calls, each of which is a trip to the JVM: a book of 90
rules compiles in a fraction of a second. Fields are given as SQL references.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailglass.functions.folding import fold_one

OPERATORS = ("contains_any", "contains_all", "regex_any", "equals_any", "suffix_any", "exists", "gt", "lt", "length_gt", "length_lt", "count_gt", "regex_count_gt")


class RuleError(ValueError):
    """A rule that cannot be loaded."""


@dataclass(frozen=True)
class Spec:
    """One condition. kind: of the field, string, number, boolean or array. exclude: a condition that must not hold."""

    field: str
    operator: str
    values: tuple = ()
    case_sensitive: bool = False
    exclude: Spec | None = None
    kind: str = "string"


@dataclass(frozen=True)
class Rule:
    id: str
    points: int
    specs: tuple[Spec, ...]
    reason: str = "{value}"
    scope: str = "mail"
    enabled: bool = True
    name: str = ""
    category: str = "misc"
    detector: str | None = None


def expand(values: Sequence, dictionaries: Mapping[str, Sequence[str]]) -> tuple:
    """Puts the terms of @dict:name in its place."""
    out: list = []
    for v in values:
        if isinstance(v, str) and v.startswith("@dict:"):
            if v[6:] not in dictionaries:
                raise RuleError(f"no dictionary {v[6:]}")
            out += dictionaries[v[6:]]
        else:
            out.append(v)
    return tuple(out)


def validate(rule: Rule, dictionaries: Mapping[str, Sequence[str]]) -> None:
    if not re.fullmatch(r"[a-z0-9_]+", rule.id) or not 0 <= rule.points <= 30:
        raise RuleError(f"id or points of {rule.id}")
    for s in rule.specs:
        while s is not None:
            if s.operator not in OPERATORS:
                raise RuleError(f"operator {s.operator}")
            terms = expand(s.values, dictionaries)
            if s.operator in ("regex_any", "regex_count_gt"):
                try:
                    [re.compile(str(p)) for p in (terms if s.operator == "regex_any" else terms[:1])]
                except re.error as e:
                    raise RuleError(str(e)) from e
            s = s.exclude


#: The SQL reference of a field, or None for an unknown field.
Get = Callable[[str], "str | None"]
#: For a folded field and terms (sought, shown): the SQL reference of the first that the field holds, where the caller has it.
Slot = Callable[[str, tuple[tuple[str, str], ...]], "str | None"]
_SPECIAL = frozenset("\\.^$*+?()[]{}|")


def quoted(text: object) -> str:
    """A string literal."""
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(names: Iterable[str]) -> str:
    names = list(names)
    if not names:
        return "cast(array() as array<string>)"
    return f"split({quoted(chr(31).join(names))}, '\x1f')"


def bound(value: str, name: str, inside: str) -> str:
    """`inside` with `name` standing for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {inside})[0]"


def truthy(c: str, kind: str) -> str:
    return {"string": f"{c} <> ''", "number": f"{c} <> 0", "boolean": c, "array": f"size({c}) > 0"}[kind]


def first_term(text: str, terms: Sequence[tuple[str, str]]) -> str:
    """Of terms (sought, shown) the first that the text contains, as shown; null if it contains none."""
    keys = literal_array(k for k, _ in terms)
    found = bound(text, "_hay", f"get(filter({keys}, _t -> contains(_hay, _t)), 0)")
    return found if all(k == v for k, v in terms) else f"get({literal_array(v for _, v in terms)}, cast(array_position({keys}, {found}) as int) - 1)"


def is_plain(pattern: str) -> bool:
    """The pattern is a plain word, which is looked up as a term."""
    return not set(pattern) & _SPECIAL


def plain_runs(patterns: Sequence[tuple[str, str]]) -> list[tuple[bool, tuple[tuple[str, str], ...]]]:
    """Neighbours of one kind together, so that only true expressions are matched."""
    return [(plain, tuple(run)) for plain, run in groupby(patterns, lambda kv: is_plain(kv[0]))]


def folded_terms(s: Spec, dictionaries: Mapping[str, Sequence[str]], folds: bool) -> tuple[tuple[str, str], ...]:
    """The values of a condition as (sought, shown)."""
    fold = (lambda v: str(v)) if s.case_sensitive else (lambda v: (fold_one(str(v)) if folds else str(v)).lower())
    return tuple((fold(v), str(v)) for v in expand(s.values, dictionaries))


def term_lists(s: Spec, dictionaries: Mapping[str, Sequence[str]]) -> list[tuple[tuple[str, str], ...]]:
    """The lists of terms that a condition on a folded field looks up, which one automaton may find for all conditions."""
    if s.case_sensitive:
        return []
    terms = folded_terms(s, dictionaries, True)
    if s.operator == "contains_any":
        return [terms]
    return [run for plain, run in plain_runs(terms) if plain] if s.operator == "regex_any" else []


def condition_sql(s: Spec, get: Get, dictionaries: Mapping[str, Sequence[str]] = {}, folded: Get | None = None, slot: Slot | None = None) -> tuple[str, str | None]:
    """Whether the condition holds (never null), and what it shows as {value} (None: nothing). An unknown field: false.

    folded: gives a field's folded text in lower case where the caller has it; other fields are only put in lower case.
    """
    c = get(s.field)
    if c is None:
        return "false", None
    text = f"cast({c} as string)" if s.kind != "array" else f"array_join({c}, ',')"
    low = None if s.case_sensitive or folded is None else folded(s.field)
    hay = text if s.case_sensitive else low or f"lower({text})"
    terms = folded_terms(s, dictionaries, folded is not None)
    seek = lambda run: (slot(s.field, run) if slot and low else None) or first_term(hay, run)
    flags = "(?U)" if s.case_sensitive else "(?iuU)"
    size = f"size({c})" if s.kind == "array" else f"length({c})" if s.kind == "string" else "0"
    show: str | None = None
    if s.operator == "contains_any":
        show = seek(terms)
        hit = f"{show} is not null"
    elif s.operator == "contains_all":
        hit = " and ".join(f"contains({hay}, {quoted(k)})" for k, _ in terms) or "true"
    elif s.operator == "regex_any":
        match = lambda k, v: f"case when {hay} rlike {quoted(flags + k)} then {quoted(v)} end"
        steps = [step for plain, run in plain_runs(terms) for step in ([seek(run)] if plain else [match(*kv) for kv in run])]
        show = f"coalesce({', '.join(steps)})" if steps else "cast(null as string)"
        hit = f"{show} is not null"
    elif s.operator == "equals_any":
        hit = f"{hay} in ({', '.join(quoted(k) for k, _ in terms)})" if terms else "false"
        show = f"case when {hit} then {f'initcap({text})' if s.kind == 'boolean' else text} end"
    elif s.operator == "suffix_any":
        hit = f"{hay} rlike {quoted('(?:^|[.])(?:' + '|'.join(re.escape(k) for k, _ in terms) + ')' + chr(92) + 'z')}" if terms else "false"
        show = f"case when {hit} then {text} end"
    elif s.operator == "exists":
        want = not (terms and terms[0][1].lower() in ("false", "0", "no"))
        hit = f"coalesce({truthy(c, s.kind)}, false) = {str(want).lower()}"
        show = None if s.kind == "boolean" else text
    elif s.operator in ("gt", "lt"):
        hit = f"try_cast({text} as double) {'>' if s.operator == 'gt' else '<'} {float(terms[0][1])!r}D"
        show = text
    elif s.operator in ("length_gt", "length_lt"):
        hit = f"{size} {'>' if s.operator == 'length_gt' else '<'} {int(terms[0][1])}"
        show = f"cast({size} as string)"
    elif s.operator == "count_gt":
        needle = terms[0][1].lower()
        hit = f"(length({text}) - length(replace(lower({text}), {quoted(needle)}, ''))) / {len(needle)} > {int(terms[1][1])}"
        show = text
    elif s.operator == "regex_count_gt":
        hit = f"regexp_count({text}, {quoted(flags + terms[0][1])}) > {int(terms[1][1])}"
        show = text
    else:
        raise RuleError(f"operator {s.operator}")
    hit = f"coalesce({hit}, false)"
    if s.exclude is not None:
        hit = f"({hit} and not {condition_sql(s.exclude, get, dictionaries, folded, slot)[0]})"
    return hit, show


def holds_sql(rule: Rule, get: Get, dictionaries: Mapping[str, Sequence[str]] = {}, folded: Get | None = None, slot: Slot | None = None) -> tuple[str, str | None]:
    """All conditions of a rule on one item, and the first thing shown (None: nothing)."""
    both = [condition_sql(s, get, dictionaries, folded, slot) for s in rule.specs]
    shown = [v for _, v in both if v]
    return " and ".join(h for h, _ in both), (f"coalesce({', '.join(shown)})" if shown else None)


def reason_sql(template: str, value: str | None, get: Get) -> str:
    """The template with {value}, then each {path}, filled in; what is missing is empty."""
    parts: list[str] = []
    for piece in re.split(r"(\{[a-z_.0-9]+\})", template):
        if piece.startswith("{"):
            c = value if piece == "{value}" else get(piece[1:-1])
            if c is not None:
                parts.append(f"coalesce(cast({c} as string), '')")
        elif piece:
            parts.append(quoted(piece))
    return f"concat({', '.join(parts)})" if parts else "''"


def condition(s: Spec, get: Get, dictionaries: Mapping[str, Sequence[str]] = {}, folded: Get | None = None) -> tuple[Column, Column]:
    """condition_sql as columns."""
    hit, show = condition_sql(s, get, dictionaries, folded)
    return F.expr(hit), F.expr(show or "cast(null as string)")


def holds(rule: Rule, get: Get, dictionaries: Mapping[str, Sequence[str]] = {}, folded: Get | None = None) -> tuple[Column, Column]:
    hit, show = holds_sql(rule, get, dictionaries, folded)
    return F.expr(hit), F.expr(show or "cast(null as string)")


def signals(rules: Sequence[Rule], get: Get, dictionaries: Mapping[str, Sequence[str]] = {}) -> Column:
    """All signals of a row in the rules' order, as array of (ord, id, points, reason); disabled rules are left out."""
    out = []
    for i, r in enumerate(rules):
        if r.enabled:
            hit, value = holds_sql(r, get, dictionaries)
            out.append(f"case when {hit} then named_struct('ord', {i}, 'id', {quoted(r.id)}, 'points', {float(r.points)!r}D, 'reason', {reason_sql(r.reason, value, get)}) end")
    return F.expr(f"filter(array({', '.join(out)}), s -> s is not null)")
