"""Shapes of the rule data: a language pack and the tables that go with it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguagePack:
    """Everything that depends on the language of the texts, not on the genre.

    Patterns are Java regular expressions.
    """

    id: str
    address: str
    imperative: str
    concession_opening: str
    concession_inside: str
    parenthesis: str = r"\([^)]+\)"
    imperative_stop: tuple[str, ...] = ()
    # One match for each match of ``imperative`` that is no stop word; if given, it is counted in its place.
    imperative_end: str = ""
    short_sentence: int = 8
    signal_labels: dict[str, str] = field(default_factory=dict)
    heading_words: int = 6
    heading_opening: str = r"\p{Lu}"
    inflection: str = ""
    adversatives: tuple[str, ...] = ()
    keep_stance: str = ""
    discard_stance: str = ""
    impersonal: str = ""
    protected_patterns: tuple[tuple[str, str], ...] = ()
    # For some patterns, a string that every match holds: a text without it is not searched.
    needed: dict[str, str] = field(default_factory=dict)
    announced_count: str = ""
    list_item: str = r"^\s*(?:[-*•–]|\d+[.)])\s+"
    entities: tuple[str, ...] = ()
    entity_endings: str = ""
    entity_section: str = "matchups"
    score_labels: dict[str, str] = field(default_factory=dict)


# The five voice signals, in report order.
SIGNALS = ("address", "imperative", "concession", "short_sentence", "parenthesis")


@dataclass(frozen=True)
class Marker:
    id: str
    name: str
    action: str
    pattern: str
    fix: str = ""


@dataclass(frozen=True)
class Section:
    id: str
    title: str
    variants: tuple[str, ...]
    required: bool = True
    corpus_share: int | None = None


@dataclass(frozen=True)
class Profile:
    id: str
    title: str
    min_words: int = 0
    sections: tuple[Section, ...] = ()
    require_entities: bool = False
    analyzers: dict[str, bool] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


# The norms a game can have.
NORMS = (
    "rhythm_ratio",
    "rhythm_alarm",
    "sentence_mean",
    "paragraph_sentences",
    "voice_per_1k",
    "voice_low",
    "markers_per_10k",
    "author_median",
)


@dataclass(frozen=True)
class Game:
    """Norms, protected words and name dictionary of one subject area."""

    id: str
    title: str
    has_names: bool
    names_kind: str = ""
    names_note: str = ""
    protected: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    norms: dict[str, float | None] = field(default_factory=dict)
    norms_source: str = ""
    provisional: bool = True


@dataclass(frozen=True)
class Term:
    id: str
    decision: str
    slang: str | None = None
    word: str | None = None
    preferred: str | None = None
    alternative: str | None = None
    rejected_replacement: str | None = None
    corpus: dict[str, int] = field(default_factory=dict)
    note: str = ""
    # What is looked for in texts.
    subject: str = field(init=False, default="")

    def __post_init__(self) -> None:
        named = [name for name in (self.slang, self.word, self.id) if name]
        object.__setattr__(self, "subject", named[0])


@dataclass(frozen=True)
class TypographyRule:
    """One spelling variant of one typographic rule, with its pattern."""

    rule: str
    variant: str
    pattern: str
    wanted: bool
    count: int | None = None


@dataclass(frozen=True)
class Rules:
    """A whole rule set: language, profiles, games and catalogues."""

    language: LanguagePack
    profiles: dict[str, Profile]
    default_profile: str
    hints: dict[str, tuple[str, ...]]
    games: dict[str, Game]
    default_game: str
    terms: tuple[Term, ...] = ()
    typography: tuple[TypographyRule, ...] = ()
    typography_decisions: dict[str, str] = field(default_factory=dict)
    markers: tuple[Marker, ...] = ()
    artifacts: tuple[tuple[str, str], ...] = ()
    messages: dict[str, str] = field(default_factory=dict)
