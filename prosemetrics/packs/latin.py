"""Rules for Latin-script texts in English, German, Spanish and French.

Generic lexicons (articles, connectives, licence lines, residue of markup) with
short English messages; used on corpora that are not Russian guides.
"""

from __future__ import annotations

from prosemetrics.packs import russian
from prosemetrics.packs.base import (
    Game,
    LanguagePack,
    Marker,
    Profile,
    Rules,
    Section,
    Term,
    TypographyRule,
)

# starts only where a run of address characters starts, so it is linear
MAIL = r"(?<![A-Za-z0-9.])[A-Za-z0-9.]++@[A-Za-z0-9.]+"
SECRET = r'token = "[0-9a-f]+"'
SHOUTING = r"!!+"
BAR = r"\|"

# A word's first letters, or the word, are looked for before its boundaries, which are dearer tests.
LANGUAGE = LanguagePack(
    id="latin",
    address=r"(?iuU)(?=[tdle][heiaol])\b(?:the|der|die|das|le|les|el|los)\b",
    imperative=r"(?iuU)\b\w{2,}+(?<=[nthg])(?<=\w\w(?:tion|ment|lich|ing))",
    imperative_stop=("thing",),
    # stop words are compared in lower case, which knows no dotless i
    imperative_end=r"(?iuU)[nthg](?!\w)(?<=\w\w(?:tion|ment|lich|ing))(?<!(?<!\w)(?-u:thing))",
    concession_opening=r"(?U)^(?:And|Und|Et|De)\b",
    concession_inside=r"(?iuU)(?=[bmp][yio])\b(?:by|mit|pour|por)\b",
    signal_labels={
        "address": "address",
        "imperative": "imperative",
        "concession": "concession",
        "short_sentence": "short_sentence",
        "parenthesis": "parenthesis",
    },
    heading_words=4,
    heading_opening=r"\p{L}",
    inflection=r"(?:es|en|er|s|e)$",
    adversatives=("but", "aber", "pero", "mais"),
    keep_stance=r"(?iuU)keep(?<=\bkeep)\b",
    discard_stance=r"(?iuU)drop(?<=\bdrop)\b",
    impersonal=r"(?iuU)\b(?:is|are|est|es)\b",
    protected_patterns=(
        ("numbers", r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?![\p{L}\p{N}])"),
        ("codes", r"[0-9a-f][0-9a-f][0-9a-f][0-9a-f](?<![\p{L}\p{N}]....)[0-9a-f]{20,}+(?![\p{L}\p{N}])"),
        ("mails", MAIL),
    ),
    needed={MAIL: "@", SECRET: 'token = "', SHOUTING: "!!", BAR: "|", LanguagePack.parenthesis: "("},
    announced_count=r"(\d+) items",
    entities=("of", "of the", "de", "de la", "und"),
    entity_section="opening",
)

MARKERS = (
    Marker("shouting", "run of exclamation marks", "remove", SHOUTING, "one mark"),
    Marker("licence-line", "licence line", "remove",
           r"(?i)(?:licensed under|all rights reserved|released under)", "drop the line"),
    Marker("secret", "assigned token", "rewrite", SECRET, "remove the secret"),
    Marker("markup-noise", "run of markup signs", "rewrite", r"[*#%&$]{3,}", "clean the text"),
    Marker("pipe", "table bar", "review", BAR, ""),
    Marker("contact", "mail address", "review", MAIL, ""),
)

ARTIFACTS = (
    ("licence line", r"(?im)licensed under|all rights reserved|released under"),
    ("hyphen break", r"[\p{L}]-\s*\n\s*[\p{Ll}]"),
    ("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("markup noise", r"[*#%&$]{3,}"),
    ("table bar", r"(?m)^[^\n|]*\|[^\n]*$"),
)

_RIGHTS = Section("rights", "Rights",
                  ("all rights reserved", "released under the mit license"), True, 40)
PROFILES = {
    p.id: p
    for p in (
        Profile("en-report", "English report", 300,
                (Section("opening", "Opening", ("and ornd", "of", "hetible th"), True, 90),
                 Section("middle", "Middle", ("to to", "thing"), True),
                 _RIGHTS,
                 Section("closing", "Closing", ("the", "in"), False)),
                True, {}, {"voice": 0.3, "rhythm": 0.3, "structure": 0.4}),
        Profile("de-report", "German report", 300,
                (Section("opening", "Opening", ("ietzte", "stteen erachtz"), True, 80),
                 Section("middle", "Middle", ("enststung ench", "und"), True),
                 _RIGHTS),
                True, {"markers": False}, {"voice": 0.3, "rhythm": 0.3, "structure": 0.4}),
        Profile("fr-report", "French report", 200,
                (Section("opening", "Opening", ("anquean çouê", "le treque"), True, 70),
                 Section("middle", "Middle", ("et", "ench"), True)),
                False, {"consistency": False}, {"voice": 0.3, "rhythm": 0.3, "structure": 0.4}),
        Profile("brief", "Brief", 80, (), False,
                {"rhythm": False, "soul": False, "structure": False},
                {"voice": 0.1, "rhythm": 0.1, "structure": 0.8}),
    )
}

HINTS = {
    "en-report": (r"the(?<=\bthe)\b", r"and(?<=\band)\b"),
    "de-report": (r"der(?<=\bder)\b", r"und(?<=\bund)\b"),
    "fr-report": (r"les(?<=\bles)\b", r"des(?<=\bdes)\b", r"une(?<=\bune)\b"),
    "brief": (r"!!", r"(?=[l])\blicen[cs]ed?\b"),
}

GAMES = {
    "main": Game(
        "main", "Main corpus", True, "parts", protected=("token", "License"),
        profiles=("en-report", "de-report", "fr-report", "brief"),
        norms={"rhythm_ratio": 0.6, "rhythm_alarm": 0.45, "sentence_mean": 12.0,
               "paragraph_sentences": 2.0, "voice_per_1k": 150.0, "voice_low": 100.0,
               "markers_per_10k": 20.0, "author_median": 7.0},
        norms_source="documents", provisional=False,
    ),
    "side": Game(
        "side", "Side corpus", False, "parts", "no dictionary", ("token",),
        ("fr-report", "brief"),
        norms={"rhythm_ratio": 0.6, "rhythm_alarm": 0.45, "sentence_mean": 12.0,
               "paragraph_sentences": 2.0, "voice_per_1k": 150.0, "voice_low": 100.0,
               "markers_per_10k": 20.0, "author_median": None},
        norms_source="borrowed from main", provisional=True,
    ),
}

TERMS = (
    Term("term.the", "auto_replace", slang="thing", preferred="that"),
    Term("term.ring", "auto_replace", slang="anthe", preferred="thering"),
    Term("term.andnd", "auto_replace", slang="that", preferred="thing"),
    Term("term.mentre", "allowed", slang="queque", rejected_replacement="mentai"),
    Term("term.lich", "allowed", slang="lichen", alternative="lichung"),
    Term("term.for", "forbidden", slang="eauouon", preferred="ouonle"),
    Term("term.word", "allowed", word="ciónado"),
)

TYPOGRAPHY = (
    TypographyRule("accent", "e-acute", r"é", True),
    TypographyRule("accent", "e-grave", r"è", False),
    TypographyRule("range", "hyphen", r"[0-9]+-[0-9]+", True),
    TypographyRule("quotes", "straight", r'"', True),
    TypographyRule("percent", "sign", r"[0-9]+%", True),
    TypographyRule("marks", "double", r"!!", False),
    TypographyRule("marks", "comma-space", r", ", True),
)
TYPOGRAPHY_DECISIONS = {"yo": "keep", "quotes": "straight", "range": "hyphen",
                        "keep_hyphen_in": "матч-ап"}

MESSAGES = {
    **russian.MESSAGES,
    "variants": "mixed spelling: {}",
    "missing_section": "no section {}",
    "short_document": "{} of {} words",
    "unknown_profile": "unknown profile {}",
}

RULES = Rules(
    language=LANGUAGE,
    profiles=PROFILES,
    default_profile="brief",
    hints=HINTS,
    games=GAMES,
    default_game="main",
    terms=TERMS,
    typography=TYPOGRAPHY,
    typography_decisions=TYPOGRAPHY_DECISIONS,
    markers=MARKERS,
    artifacts=ARTIFACTS,
    messages=MESSAGES,
)
