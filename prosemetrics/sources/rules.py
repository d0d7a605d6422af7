"""Rule packs from plain records or from a folder of YAML files.

Each kind of record has a declared list of fields.  One reader checks records
against it and reports every fault of every record at once; what it returns is
complete and typed, so building the rule objects needs no further checks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from prosemetrics.packs.base import NORMS, Game, Profile, Rules, Section, Term

# What may be decided about a word.
DECISIONS = ("auto_replace", "allowed", "forbidden")


@dataclass(frozen=True)
class Field:
    """A field of a record: where it stands (dots for nesting), its type, its value when absent.

    ``default`` can be a function of what was read so far.
    """

    name: str
    kind: type | tuple[type, ...]
    default: Any = None
    at: str = ""
    required: bool = False
    among: tuple[str, ...] = ()


TERM = (
    Field("id", str, required=True),
    Field("decision", str, required=True, among=DECISIONS),
    Field("slang", str),
    Field("word", str),
    Field("preferred", str),
    Field("alternative", str),
    Field("rejected_replacement", str),
    Field("corpus", Mapping, {}),
    Field("note", str, ""),
)
SECTION = (
    Field("id", str, required=True),
    Field("title", str, lambda got: got["id"]),
    Field("variants", list, lambda got: [got["title"]]),
    Field("corpus_share", (int, float)),
)
PROFILE = (
    Field("id", str, required=True),
    Field("title", str, lambda got: got["id"]),
    Field("min_words", int, 0),
    Field("required", list, [], at="sections.required"),
    Field("optional", list, [], at="sections.optional"),
    Field("require_entities", bool, False, at="matchups.require_classes"),
    Field("analyzers", Mapping, {}),
    Field("weights", Mapping, {}),
    Field("hints", list, []),
)
GAME = (
    Field("id", str, required=True),
    Field("title", str, lambda got: got["id"]),
    Field("asset", str, at="names.asset"),
    Field("names_kind", str, "", at="names.kind"),
    Field("names_note", str, "", at="names.note"),
    Field("protected", list, []),
    Field("profiles", list, []),
    *(Field(norm, (int, float), at=f"norms.{norm}") for norm in NORMS),
    Field("norms_source", str, "", at="norms.source"),
    Field("provisional", bool, True, at="norms.provisional"),
)


def _at(record: Any, place: str) -> Any:
    for key in place.split("."):
        record = record.get(key) if isinstance(record, Mapping) else None
    return record


def read_records(fields: Iterable[Field], records: Iterable[Any], what: str) -> list[dict[str, Any]]:
    """Typed values of all records, or one error that names every fault."""
    fields, faults, out = tuple(fields), [], []
    for number, record in enumerate(records, 1):
        known = _at(record, "id")
        label = f"{what} {known}" if known else f"{what} number {number}"
        got: dict[str, Any] = {}
        for f in fields:
            value = _at(record, f.at or f.name)
            if value is None and f.required:
                faults.append(f"{label} is without {'an id' if f.name == 'id' else f.name}")
            elif value is not None and not isinstance(value, f.kind):
                faults.append(f"{label}: {f.at or f.name} has the wrong type")
            elif value is not None and f.among and value not in f.among:
                faults.append(f"{label}: {f.name} must be one of {', '.join(f.among)}, not {value!r}")
            if value is None:
                value = f.default(got) if callable(f.default) else f.default
            got[f.name] = value
        out.append(got)
    if faults:
        raise ValueError("; ".join(faults))
    return out


def terms_from_records(records: Iterable[Any]) -> tuple[Term, ...]:
    return tuple(Term(**got) for got in read_records(TERM, records, "term rule"))


def profiles_from_records(records: Iterable[Any]) -> tuple[dict[str, Profile], dict[str, tuple[str, ...]]]:
    """Profiles and, of those that give any, the patterns that hint at them."""
    profiles, hints = {}, {}
    for got in read_records(PROFILE, records, "profile"):
        sections = [
            Section(s["id"], s["title"], tuple(map(str.lower, s["variants"])), group == "required", s["corpus_share"])
            for group in ("required", "optional")
            for s in read_records(SECTION, got.pop(group), f"profile {got['id']}, {group} section")
        ]
        if patterns := tuple(got.pop("hints")):
            hints[got["id"]] = patterns
        profiles[got["id"]] = Profile(**got, sections=tuple(sections))
    return profiles, hints


def games_from_records(records: Iterable[Any]) -> dict[str, Game]:
    games = {}
    for got in read_records(GAME, records, "game"):
        norms = {norm: got.pop(norm) for norm in NORMS}
        lists = {name: tuple(got.pop(name)) for name in ("protected", "profiles")}
        games[got["id"]] = Game(has_names=bool(got.pop("asset")), norms=norms, **lists, **got)
    return games


def typography_from_record(record: Mapping[str, Any]) -> tuple[dict[str, str], dict[tuple[str, str], int]]:
    """Decisions by rule, and counts by rule and variant; groups of rules may be nested."""
    decisions: dict[str, str] = {}
    counts: dict[tuple[str, str], int] = {}
    open_ = [(str(name), body) for name, body in record.items()]
    while open_:
        rule, body = open_.pop(0)
        if isinstance(body, list):
            decisions[rule] = ", ".join(map(str, body))
        if not isinstance(body, Mapping):
            continue
        if "decision" in body:
            decisions[rule] = str(body["decision"])
        counts |= {(rule, str(v)): int(n) for v, n in (body.get("corpus") or {}).items()}
        open_ += [(str(name), inner) for name, inner in body.items() if name != "corpus"]
    return decisions, counts


def read_yaml_rules(folder: str, base: Rules) -> Rules:
    """``base`` with what a rule folder has: ``terminology.yaml``, ``typography.yaml``,
    ``profiles/*.yaml`` (with hints) and ``games/*.yaml``.  Needs PyYAML."""
    try:
        import yaml
    except ImportError as missing:  # pragma: no cover
        raise RuntimeError("reading YAML rules needs PyYAML") from missing

    def records(pattern: str) -> list[Mapping[str, Any]]:
        paths = sorted(Path(folder).glob(pattern))
        found = [yaml.safe_load(p.read_text(encoding="utf-8")) for p in paths]
        wrong = [p.name for p, record in zip(paths, found) if not isinstance(record, Mapping)]
        if wrong:
            raise ValueError(f"a mapping was expected at the top level of {', '.join(wrong)}")
        return found

    changes: dict[str, Any] = {}
    if found := records("terminology.yaml"):
        changes["terms"] = terms_from_records(found[0].get("rules") or [])
    if found := records("games/*.yaml"):
        changes["games"] = games_from_records(found)
    if found := records("profiles/*.yaml"):
        changes["profiles"], hints = profiles_from_records(found)
        if hints:
            changes["hints"] = hints
    if found := records("typography.yaml"):
        decisions, counts = typography_from_record(found[0])
        changes["typography_decisions"] = decisions
        changes["typography"] = tuple(
            replace(rule, count=counts.get((rule.rule, rule.variant), rule.count)) for rule in base.typography
        )
    return replace(base, **changes)
