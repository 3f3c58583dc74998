"""The built-in rules and dictionaries, as data, and the loader for a user's own."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from pathlib import Path

from mailglass.functions.folding import fold_one
from mailglass.functions.rules import Rule, RuleError, Spec, validate

HERE = Path(__file__).resolve().parent
#: Detectors that a rule may name.
DETECTORS = ("text_invisible_obfuscation", "from_display_email_mismatch", "anchor_text_mismatch", "att_random_name", "signal_stack")
SCOPES = ("mail", "url", "domain", "attachment")


@dataclass(frozen=True)
class Rulebook:
    """Rules in order of evaluation, dictionaries, a version that follows every byte read, and each rule's origin."""

    rules: tuple[Rule, ...]
    terms: dict[str, tuple[str, ...]]
    shadows: dict[str, tuple[str, ...]]
    version: str
    origin: dict[str, str]


def parse_terms(text: str) -> dict[str, list[str]]:
    """Sections [name], a term a line, # at a line's start is a comment; terms are folded and in lower case."""
    out: dict[str, list[str]] = {}
    now: list[str] = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            now = out.setdefault(line[1:-1], [])
        elif line and not line.startswith("#"):
            now.append(fold_one(line).lower())
    return out


def spec_of(d: dict) -> Spec:
    known = {"field", "operator", "values", "case_sensitive", "exclude"}
    if set(d) - known or "field" not in d or "operator" not in d:
        raise RuleError(f"condition {d}")
    return Spec(d["field"], d["operator"], tuple(d.get("values") or ()), bool(d.get("case_sensitive", False)), spec_of(d["exclude"]) if d.get("exclude") else None)


def rule_of(d: dict) -> Rule:
    """A rule from its fields as they stand in a file; `match` (one condition or a list) may be called `when`."""
    when = d.get("when", d.get("match"))
    detector = d.get("detector") if d.get("kind", "detector" if d.get("detector") else "declarative") == "detector" else None
    if detector is None and when is None:
        raise RuleError(f"{d.get('id')} has no condition")
    if detector is not None and detector not in DETECTORS:
        raise RuleError(f"{d['id']} names the unknown detector {detector}")
    if d.get("scope", "mail") not in SCOPES:
        raise RuleError(f"scope {d['scope']}")
    specs = tuple(spec_of(x) for x in (when if isinstance(when, list) else [when] if when else []))
    return Rule(d["id"], int(d.get("points", 0)), specs, d.get("reason") or d.get("name", d["id"]), d.get("scope", "mail"), bool(d.get("enabled", True)), d.get("name", d["id"]), d.get("category", "misc"), detector)


def _merge(files: list[tuple[str, bytes, list[dict], str]], sections: list[tuple[str, bytes, dict[str, list[str]]]]) -> Rulebook:
    seen = hashlib.sha256()
    terms: dict[str, tuple[str, ...]] = {}
    for name, raw, found in sections:
        seen.update(name.encode() + b":" + raw)
        terms |= {k: tuple(v) for k, v in found.items()}
    shadows: dict[str, list[str]] = {}
    for line in terms.pop("brand_shadow", ()):
        brand, _, context = (x.strip() for x in line.partition("="))
        if brand and context:
            shadows.setdefault(brand, []).append(context)
    rules: dict[str, Rule] = {}
    origin: dict[str, str] = {}
    for name, raw, found, source in files:
        seen.update(name.encode() + b":" + raw)
        for d in found:
            rule = rule_of(d)
            if source == "builtin" and rule.id in rules:
                raise RuleError(f"two rules {rule.id}")
            rules[rule.id], origin[rule.id] = rule, source
    for rule in rules.values():
        validate(rule, terms)
    return Rulebook(tuple(rules.values()), terms, {k: tuple(v) for k, v in shadows.items()}, seen.hexdigest()[:16], origin)


def builtin_parts() -> tuple[list, list]:
    raw, text = (HERE / "rules.jsonl").read_bytes(), (HERE / "terms.txt").read_bytes()
    rules = [json.loads(x) for x in raw.decode().splitlines() if x and not x.startswith("#")]
    return [("rules.jsonl", raw, rules, "builtin")], [("terms.txt", text, parse_terms(text.decode()))]


def builtin() -> Rulebook:
    return _merge(*builtin_parts())


def read_folder(folder: str) -> Rulebook:
    """The rules of a folder: builtin/ and custom/ hold rule files (.yaml, .yml, .jsonl; a custom rule takes the place of a
    built-in one of the same id), dicts/ a .txt for each dictionary. A part that is missing is the library's own."""
    top = Path(folder)

    def rules_in(part: str) -> list[tuple[str, bytes, list[dict], str]]:
        out = []
        for p in sorted([*(top / part).glob("*.y*ml"), *(top / part).glob("*.jsonl")]):
            raw = p.read_bytes()
            if p.suffix == ".jsonl":
                found = [json.loads(x) for x in raw.decode().splitlines() if x and not x.startswith("#")]
            else:
                try:
                    import yaml
                except ImportError as e:
                    raise RuleError("rule files in YAML need the package yaml") from e
                found = yaml.safe_load(raw) or []
            if not isinstance(found, list):
                raise RuleError(f"{p.name} holds no list of rules")
            out.append((p.name, raw, found, part))
        return out

    own = builtin_parts()
    dicts = [(p.name, p.read_bytes(), {p.stem: parse_terms("[x]\n" + p.read_text())["x"]}) for p in sorted((top / "dicts").glob("*.txt"))]
    return _merge([*(rules_in("builtin") or own[0]), *rules_in("custom")], [*own[1], *dicts])



# --- changes: each gives a new book, so a bad one leaves the old as it was


def with_rule(book: Rulebook, fields: dict) -> Rulebook:
    """The book with a custom rule, in the place of one of the same id or at the end. Fields are those of a rule file."""
    rule = rule_of(fields)
    validate(rule, book.terms)
    rules = [rule if r.id == rule.id else r for r in book.rules]
    return _changed(book, rules if rule.id in book.origin else [*rules, rule], origin=book.origin | {rule.id: "custom"})


def patched(book: Rulebook, rule_id: str, **changes) -> Rulebook:
    """The book with a rule's enabled, points, name or reason changed; nothing else may be."""
    if set(changes) - {"enabled", "points", "name", "reason"} or rule_id not in book.origin:
        raise RuleError(f"cannot change {sorted(changes)} of {rule_id}")
    rules = [replace(r, **changes) if r.id == rule_id else r for r in book.rules]
    for r in rules:
        validate(r, book.terms)
    return _changed(book, rules)


def without(book: Rulebook, rule_id: str) -> Rulebook:
    """The book without a custom rule; built-in ones can only be disabled."""
    if book.origin.get(rule_id) != "custom":
        raise RuleError(f"{rule_id} is no custom rule")
    return _changed(book, [r for r in book.rules if r.id != rule_id], origin={k: v for k, v in book.origin.items() if k != rule_id})


def with_terms(book: Rulebook, name: str, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> Rulebook:
    """The book with terms of a dictionary added (once, at its end) or taken out, folded as in files."""
    fold = lambda terms: [fold_one(t.strip()).lower() for t in terms]
    now = [t for t in book.terms.get(name, ()) if t not in fold(remove)]
    return _changed(book, book.rules, terms=book.terms | {name: tuple(dict.fromkeys([*now, *filter(None, fold(add))]))})


def listing(book: Rulebook) -> list[dict]:
    """A row per rule: id, name, category, scope, points, enabled, reason, detector, source, version."""
    keys = ("id", "name", "category", "scope", "points", "enabled", "reason", "detector")
    return [{k: getattr(r, k) for k in keys} | {"source": book.origin[r.id], "version": book.version} for r in book.rules]


def _changed(book: Rulebook, rules, terms=None, origin=None) -> Rulebook:
    terms = book.terms if terms is None else terms
    state = json.dumps([[repr(r) for r in rules], {k: list(v) for k, v in terms.items()}], sort_keys=True)
    return Rulebook(tuple(rules), terms, book.shadows, hashlib.sha256((book.version + state).encode()).hexdigest()[:16], origin or book.origin)
