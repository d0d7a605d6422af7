"""Russian game-guide rules.

The tables below are fixed values: identifiers, section titles, corpus counts,
norms and weights must equal the published ones for results to agree.
"""

from __future__ import annotations

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

LANGUAGE = LanguagePack(
    id="ru",
    address=r"(?iuU)\b(?:вы|вас|вам|вами|ваш(?:а|е|и|его|ей|ему|у|им|ем|их|ими)?)\b",
    imperative=r"(?iuU)\b\w{2,}(?:йте|ите|ьте)(?:сь)?\b",
    imperative_stop=(
        "лимите",
        "кредите",
        "бандите",
        "визите",
        "элите",
        "орбите",
        "защите",
        "аппетите",
        "дефиците",
        "сайте",
        "байте",
    ),
    concession_opening=r"(?U)^(?:Но|Однако)\b",
    concession_inside=r"(?iuU)\b(?:хотя|зато)\b",
    signal_labels={
        "address": "обращение к читателю",
        "imperative": "императив читателю",
        "concession": "уступка и поворот",
        "short_sentence": "короткое предложение",
        "parenthesis": "скобка с пояснением",
    },
    inflection=(
        r"(?:иями|ями|ами|ого|его|ому|ему|ыми|ими|ией|иям|иях|ах|ях|ов|ев|ей|ой|ом|ем|ам|ям"
        r"|ую|юю|ая|яя|ое|ее|ые|ие|ый|ий|ою|ью|ия|ию|ии|а|я|о|е|ы|и|у|ю|ь|й)$"
    ),
    adversatives=("но", "а", "зато", "однако"),
    keep_stance=r"(?iuU)\b(?:оставля\w*|оставь\w*|держи\w*|сохраня\w*)",
    discard_stance=r"(?iuU)\b(?:сбрасыва\w*|сбрось\w*|сбросит\w*|скидыва\w*|выкидыва\w*|меняйте)",
    impersonal=(
        r"(?iuU)\b(?:приходится|следует|требуется|необходимо|рекомендуется|стоит|нужно|можно)\b"
    ),
    protected_patterns=(
        ("числа", r"(?U)(?<![\w/])\d+(?:[.,]\d+)?%?(?![\w/])"),
        ("статы", r"(?U)(?<![\w/])\d+/\d+(?![\w/])"),
        ("коды колод", r"(?<![A-Za-z0-9+/=])AAE[A-Za-z0-9+/=]{8,}"),
    ),
    announced_count=r"(?iuU)(\d+)\s+карт\w*",
    entities=(
        "Воин",
        "Шаман",
        "Разбойник",
        "Паладин",
        "Охотник",
        "Друид",
        "Чернокнижник",
        "Маг",
        "Жрец",
        "Охотник на демонов",
        "Рыцарь смерти",
    ),
    score_labels={
        "voice": "живое",
        "rhythm": "ритм",
        "purity": "чистота",
        "names": "названия",
        "consistency": "согласованность",
        "structure": "структура",
    },
    entity_endings="(?:ами|ями|ах|ях|ов|ев|ей|ом|ем|ам|ям|а|я|е|ы|и|у|ю|ь)?",
)

# 30 template phrases.  Levels: remove, rewrite, review.
MARKERS = (
    Marker("chat-ostatki", "остаток диалога с помощником", "remove",
           r"(?iuU)надеюсь,?\s+это\s+помо\w+|давайте\s+разбер[её]мся|конечно!\s+вот|"
           r"если\s+(?:у\s+вас\s+)?(?:есть|возникнут)\s+вопросы", "убрать"),
    Marker("v-etoy-statye", "объявление темы", "remove",
           r"(?iuU)\bв\s+(?:этой|данной)\s+(?:статье|публикации)\s+мы\b", "начать с сути"),
    Marker("stoit-otmetit", "пустой зачин", "remove",
           r"(?iuU)\b(?:стоит|следует|нужно|важно)\s+отметить\b", "убрать зачин"),
    Marker("vazhno-ponimat", "пустой зачин", "remove",
           r"(?iuU)\bважно\s+(?:понимать|помнить)\b", "убрать зачин"),
    Marker("podvedem-itog", "объявление вывода", "remove",
           r"(?iuU)\b(?:подвед[её]м|подводя)\s+итог\w*", "сразу дать вывод"),
    Marker("ne-sekret", "пустой зачин", "remove", r"(?iuU)\bне\s+секрет,?\s+что\b", "убрать"),
    Marker("kak-izvestno", "пустой зачин", "remove", r"(?iuU)\bкак\s+известно\b", "убрать"),
    Marker("v-sovremennom-mire", "общее место", "remove",
           r"(?iuU)\bв\s+(?:современном|сегодняшнем)\s+мире\b", "убрать"),
    Marker("kancelarit-svyazka", "канцелярская связка", "rewrite",
           r"(?iuU)\bявля(?:ется|ются|ясь)\b|\bпредставля(?:ет|ют)\s+собой\b", "тире или глагол"),
    Marker("kancelarit-dannyy", "канцелярит", "rewrite",
           r"(?iuU)\bданн(?:ый|ая|ое|ые|ого|ой|ому|ым|ыми|ых|ом|ую)\b", "этот"),
    Marker("osushchestvlyat", "расщеплённое сказуемое", "rewrite",
           r"(?iuU)\bосуществл(?:ять|яет|яют|ение|ения|ить)\b", "простой глагол"),
    Marker("v-ramkah", "канцелярский предлог", "rewrite", r"(?iuU)\bв\s+рамках\b", "в"),
    Marker("v-sluchae-esli", "канцелярский союз", "rewrite",
           r"(?iuU)\bв\s+(?:том\s+)?случае,?\s+если\b", "если"),
    Marker("s-tseliu", "канцелярский предлог", "rewrite", r"(?iuU)\bс\s+целью\b", "чтобы"),
    Marker("imeet-mesto", "канцелярит", "rewrite", r"(?iuU)\bиме(?:ет|ют)\s+место\b", "есть"),
    Marker("proizvodit-deystvie", "расщеплённое сказуемое", "rewrite",
           r"(?iuU)\bпроизв(?:одить|одится|ести)\s+\w+ние\b", "простой глагол"),
    Marker("ne-prosto-a", "ложное противопоставление", "rewrite",
           r"(?iuU)\bне\s+просто\s+[^.,;!?\n]+,\s+а\b", "сказать прямо"),
    Marker("ne-tolko-no-i", "шаблонная пара", "review",
           r"(?iuU)\bне\s+только\s+[^.;!?\n]+,\s+но\s+и\b", ""),
    Marker("klyuchevoy", "усилитель", "review",
           r"(?iuU)\bключев(?:ой|ую|ым|ыми|ого|ому|ом)\b", ""),
    Marker("poistine", "усилитель", "rewrite", r"(?iuU)\bпоистине\b", "убрать"),
    Marker("moshchneyshiy", "усилитель", "rewrite", r"(?iuU)\bмощнейш\w+", "мощный"),
    Marker("unikalnyy", "усилитель", "review", r"(?iuU)\bуникальн\w+", ""),
    Marker("bezuslovno", "вводный усилитель", "review",
           r"(?iuU)\b(?:безусловно|несомненно|бесспорно)\b", ""),
    Marker("takim-obrazom", "связка-вывод", "review", r"(?iuU)\bтаким\s+образом\b", ""),
    Marker("krome-togo", "связка-перечень", "review",
           r"(?iuU)\b(?:кроме|более)\s+того\b", ""),
    Marker("v-konechnom-itoge", "связка-вывод", "review",
           r"(?iuU)\bв\s+конечном\s+(?:итоге|счёте|счете)\b", ""),
    Marker("na-segodnyashniy-den", "канцелярит времени", "rewrite",
           r"(?iuU)\bна\s+сегодняшний\s+день\b", "сейчас"),
    Marker("igraet-rol", "стёртый оборот", "review",
           r"(?iuU)\bигра(?:ет|ют)\s+(?:важную|большую|решающую)\s+роль\b", ""),
    Marker("shirokiy-spektr", "стёртый оборот", "review",
           r"(?iuU)\bширок(?:ий|ого|ому|им)\s+спектр\w*", ""),
    Marker("otkryvaet-vozmozhnosti", "стёртый оборот", "review",
           r"(?iuU)\bоткрыва(?:ет|ют)\s+[^.,;!?\n]*возможност\w+", ""),
)

# Traces of text extraction, matched case-insensitively by line.
ARTIFACTS = (
    (
        "колонтитул печати",
        r"(?iuUm)ПРОДЛИТЬ ПОДПИСКУ|\d{1,2}/\d{1,2}/\d{4},?\s*\d{1,2}:\d{2}",
    ),
    ("разрыв слова переносом", r"(?iuUm)[А-Яа-яЁё]-\s*\n\s*[а-яё]"),
    ("блок комментариев", r"(?iuUm)^\s*Ответить\s*$|Администратор\s*-\s*vasili"),
    ("сайдбар", r"(?iuUm)ПОСЛЕДНИЕ\s+СТАТЬИ|Другие\s+статьи|НАПИСАТЬНАПИСАТЬ"),
    ("форма загрузки", r"(?iuUm)Выбрать\s+файл"),
)

# Word decisions with their corpus counts.
TERMS = (
    Term("term.deck", "auto_replace", slang="дека", preferred="колода",
         corpus={"slang": 56, "preferred": 1854}),
    Term("term.stats", "auto_replace", slang="статы", preferred="характеристики",
         corpus={"slang": 15, "preferred": 128}),
    Term("term.setup", "auto_replace", slang="сетап", preferred="подготовка",
         corpus={"slang": 21, "preferred": 99}),
    Term("term.winrate", "allowed", slang="винрейт", rejected_replacement="процент побед",
         corpus={"slang": 68, "rejected": 17}),
    Term("term.lategame", "allowed", slang="лейтгейм", rejected_replacement="поздняя игра",
         corpus={"slang": 199, "rejected": 8}),
    Term("term.midgame", "allowed", slang="мидгейм", rejected_replacement="середина игры",
         corpus={"slang": 194, "rejected": 15}),
    Term("term.draw", "allowed", slang="добор", rejected_replacement="взятие карт",
         corpus={"slang": 243, "rejected": 0}),
    Term("term.ladder", "allowed", slang="ладдер", rejected_replacement="рейтинговый режим",
         corpus={"slang": 84, "rejected": 0}),
    Term("term.dust", "allowed", slang="пыль", rejected_replacement="чародейская пыль",
         corpus={"slang": 40, "rejected": 0}),
    Term("term.aggro", "allowed", slang="агро", alternative="агрессивный",
         corpus={"slang": 437, "alternative": 440}),
    Term("term.minion", "forbidden", slang="миньон", preferred="существо",
         corpus={"slang": 0, "preferred": 870}),
    Term("term.spell", "forbidden", slang="спел", preferred="заклинание",
         corpus={"slang": 0, "preferred": 1168}),
    Term("term.build", "allowed", word="сборка", corpus={"word": 769}),
)

# Typographic variants with their corpus counts; ``wanted`` marks the decision.
TYPOGRAPHY = (
    TypographyRule("yo", "without", r"(?iuU)\b(?:ее|еще)\b", True, 1587),
    TypographyRule("yo", "with", r"(?iu)ё", False, 0),
    TypographyRule("quotes", "straight", r'"', True, 466),
    TypographyRule("quotes", "curly", r"[“”„]", False, 55),
    TypographyRule("quotes", "guillemets", r"[«»]", False, 28),
    TypographyRule("archetype_hyphen", "с дефисом",
                   r"(?U)\b(?:Квест|Мех|Фейс|Бомб|Пират)-(?:Маг|Паладин|Хант|Воин)\w*", False, 0),
    TypographyRule("archetype_descriptor", "агро-колод", r"(?iuU)\bагро-колод\w*", False, 0),
    TypographyRule("range", "2-3", r"(?<!\d)\d+-\d+(?!\d)", True, 400),
    TypographyRule("range", "2–3", r"(?<!\d)\d+–\d+(?!\d)", False, 0),
    TypographyRule("stats", "3/4", r"(?<![\d/])\d+/\d+(?![\d/])", True, 231),
    TypographyRule("percent", "54%", r"\d+%", True, 14),
    TypographyRule("percent", "54 процента", r"(?iuU)\d+\s+процент\w*", False, 0),
    TypographyRule("dashes", "em", r"—", True, 3760),
    TypographyRule("dashes", "en", r"(?<!\d)–(?!\d)", False, 159),
)
TYPOGRAPHY_DECISIONS = {
    "yo": "remove",
    "quotes": "straight",
    "archetype_hyphen": "space",
    "range": "hyphen",
    "keep_hyphen_in": "официальные названия карт; матч-ап",
}

# Genre profiles.
_ALL = {
    "markers": True,
    "rhythm": True,
    "soul": True,
    "cards": True,
    "structure": True,
    "consistency": True,
}
_GUIDE_WEIGHTS = {
    "живое": 0.30,
    "ритм": 0.25,
    "чистота": 0.15,
    "названия": 0.10,
    "согласованность": 0.10,
    "структура": 0.10,
}
PROFILES = {
    p.id: p
    for p in (
        Profile(
            "battlegrounds-guide",
            "Гайд по Полям сражений",
            400,
            (
                Section("idea", "Идея стратегии",
                        ("идея стратегии", "суть стратегии", "как это работает", "о стратегии")),
                Section("minions", "Ключевые существа",
                        ("ключевые существа", "ключевые карты", "основные существа")),
                Section("curve", "План по ходам",
                        ("план по ходам", "по ходам", "тайминги", "порядок действий")),
                Section("heroes", "Герои", ("герои", "подходящие герои", "выбор героя"), False),
                Section("trinkets", "Аксессуары",
                        ("аксессуары", "безделушки", "артефакты"), False),
                Section("mistakes", "Ошибки",
                        ("ошибки", "частые ошибки", "чего не делать"), False),
                Section("final_board", "Итоговый стол",
                        ("итоговый стол", "финальный стол", "идеальный стол"), False),
                Section("alternatives", "Альтернативные линии",
                        ("альтернативные линии", "запасные планы", "если не зашло"), False),
            ),
            False,
            _ALL,
            _GUIDE_WEIGHTS,
        ),
        Profile(
            "constructed-guide",
            "Гайд по архетипу в конструированных режимах",
            600,
            (
                Section("builds", "Сборки",
                        ("сборки архетипа", "сборки", "топовые сборки", "списки колод"), True, 98),
                Section("deckbuilding", "Декбилдинг",
                        ("вопросы декбилдинга", "как собрать колоду", "основа колоды", "замены",
                         "опциональные и технические карты"), True, 98),
                Section("mulligan", "Муллиган",
                        ("муллиган", "общие правила муллигана",
                         "муллиган против каждого класса"), True, 100),
                Section("strategy", "Стратегия",
                        ("стратегия игры", "основы геймплея", "как работает колода",
                         "тонкости геймплея", "способы победы", "полезные советы"), True, 96),
                Section("matchups", "Матч-апы",
                        ("матч-апы", "матчапы", "матч-апы колоды"), True, 100),
                Section("conclusion", "Заключение", ("заключение",), False, 27),
            ),
            True,
            _ALL,
            _GUIDE_WEIGHTS,
        ),
        Profile(
            "meta-report",
            "Мета-отчёт",
            300,
            (
                Section("summary", "Обзор меты",
                        ("обзор меты", "состояние меты", "что происходит")),
                Section("tiers", "Тир-лист", ("тир-лист", "тиры", "расстановка"), False),
                Section("changes", "Изменения",
                        ("изменения", "что поменялось", "движение"), False),
            ),
            False,
            _ALL,
            {"живое": 0.20, "ритм": 0.20, "чистота": 0.20, "названия": 0.15,
             "согласованность": 0.15, "структура": 0.10},
        ),
        Profile(
            "news",
            "Новость",
            80,
            (),
            False,
            {"markers": True, "rhythm": False, "soul": False, "cards": True,
             "structure": False, "consistency": True},
            {"живое": 0.05, "ритм": 0.05, "чистота": 0.30, "названия": 0.30,
             "согласованность": 0.30, "структура": 0.0},
        ),
        Profile(
            "wow-guide",
            "Гайд по классу или специализации в World of Warcraft",
            500,
            (
                Section("rotation", "Ротация",
                        ("ротация", "приоритет способностей", "порядок действий",
                         "билд ротации")),
                Section("talents", "Таланты",
                        ("таланты", "талантовый билд", "ветки талантов", "билд")),
                Section("stats", "Приоритет статов",
                        ("приоритет статов", "статы", "характеристики",
                         "приоритет характеристик")),
                Section("gear", "Экипировка",
                        ("экипировка", "бис", "лучшие предметы", "снаряжение"), False),
                Section("consumables", "Расходники",
                        ("расходники", "зелья", "еда", "флаконы"), False),
                Section("cooldowns", "Кулдауны",
                        ("кулдауны", "большие кулдауны", "бурст"), False),
                Section("mechanics", "Механики",
                        ("механики", "механики боссов", "особенности боёв"), False),
                Section("macros", "Макросы", ("макросы", "аддоны", "вейкауры"), False),
                Section("leveling", "Прокачка", ("прокачка", "левелинг"), False),
            ),
            False,
            {"markers": True, "rhythm": True, "soul": True, "cards": False,
             "structure": True, "consistency": True},
            {"живое": 0.30, "ритм": 0.25, "чистота": 0.20, "названия": 0.0,
             "согласованность": 0.15, "структура": 0.10},
        ),
    )
}

# Genre hints; the order decides ties.
HINTS = {
    "battlegrounds-guide": (
        r"поля\s+сражений",
        r"\bбаттлграунд",
        r"\bтаверн",
        r"\bтройк\w+\s+существ",
        r"\bгерой\s+таверны",
        r"\bаксессуар",
        r"\bлобб",
    ),
    "meta-report": (
        r"тир-лист",
        r"мета-отчёт",
        r"мета-отчет",
        r"расстановк\w+\s+сил",
        r"\bпроцент\w*\s+побед",
        r"\d+\s*%",
    ),
    "news": (r"патчноут", r"патч\s*\d+\.\d+", r"разработчик\w+\s+объяв", r"анонс\w*"),
    "constructed-guide": (
        r"муллиган",
        r"декбилдинг",
        r"матч-ап",
        r"сборк\w+\s+архетипа",
        r"колод\w+",
    ),
}

# Norms of the two subject areas.
GAMES = {
    "hearthstone": Game(
        "hearthstone",
        "Hearthstone",
        True,
        names_kind="карты",
        protected=("ОТК", "возвещение"),
        profiles=("constructed-guide", "battlegrounds-guide", "meta-report", "news"),
        norms={
            "rhythm_ratio": 0.51,
            "rhythm_alarm": 0.45,
            "sentence_mean": 14.9,
            "paragraph_sentences": 2.2,
            "voice_per_1k": 29.4,
            "voice_low": 20.6,
            "markers_per_10k": 12.2,
            "author_median": 9.1,
        },
        norms_source="гайды/ (49 документов)",
        provisional=False,
    ),
    "wow": Game(
        "wow",
        "World of Warcraft",
        False,
        names_kind="заклинания, предметы, таланты",
        names_note="нужны client_id и client_secret Blizzard; "
        "без них проверка имён не работает",
        protected=("ОТК", "ГКД", "ДПС", "ХПС", "агро"),
        profiles=("wow-guide", "meta-report", "news"),
        norms={
            "rhythm_ratio": 0.51,
            "rhythm_alarm": 0.45,
            "sentence_mean": 14.9,
            "paragraph_sentences": 2.2,
            "voice_per_1k": 29.4,
            "voice_low": 20.6,
            "markers_per_10k": 12.2,
            "author_median": None,
        },
        norms_source="заимствовано из hearthstone; собственного корпуса нет",
        provisional=True,
    ),
}

# Wording of findings, notes and violations.
MESSAGES = {
    "apostrophe": "апостроф в названии карты",
    "dash": "тире в названии карты",
    "case": "регистр в названии карты",
    "typo": "возможная опечатка в названии",
    "short": "короткое имя карты",
    "variants": "разнобой: {}",
    "variants_fix": "выбрать одно написание",
    "advice": "советы по карте «{}» расходятся",
    "advice_fix": "проверить: возможно, речь о разных матч-апах",
    "missing_section": "нет обязательного раздела «{}»",
    "section_order": "раздел «{}» стоит не на своём месте",
    "coverage": "матч-апы без {} классов",
    "declared_count": "заявлено карт: {}, перечислено: {}",
    "term": "слово из словаря замен: {}",
    "typography": "оформление: {}",
    "short_document": "текст короче минимума профиля ({} из {} слов) — "
    "частотные метрики шумят, категоричных выводов не будет",
    "detected_profile": "профиль определён автоматически: {} (уверенность {}); "
    "указать явно — --profile",
    "unknown_profile": "профиль «{}» неизвестен: его разделы и пороги не проверены",
    "norm_caveat": "нормы предварительные: {}. Оценки ритма и живого — ориентир, "
    "а не эталон, пока не набран корпус текстов в этой игре",
    "names_skipped": "сверка имён отключена: {}",
    "voice_lost": "вычищено живое: {} — {} → {} мест",
    "protected_lost": "пропало защищённое ({}): {}",
    "rhythm_flattened": "ритм выровнен: {} → {}",
    "text_shrunk": "текст усох на {}% — вероятно пропали мысли",
    "original_returned": "правка не прошла проверку за {} — возвращён исходный текст",
    "norms_borrowed": "нормы для этой игры заимствованы: оценки голоса и ритма — "
    "ориентир, не эталон",
    "empty_document": "файл без текста",
    "empty_corpus": "корпус пуст",
    "missing_field": "нет поля {}",
    "duplicate_id": "идентификатор {} уже занят файлом {}",
    "unknown_genre": "жанр '{}' не соответствует ни одному профилю ({})",
    "unknown_mode": "режим '{}' неизвестен",
    "unknown_status": "статус '{}' неизвестен",
    "artifact": "{}: {} шт. — след извлечения, не авторский текст",
    "precedent_absent": "в корпусе не встречается",
}

RULES = Rules(
    language=LANGUAGE,
    profiles=PROFILES,
    default_profile="constructed-guide",
    hints=HINTS,
    games=GAMES,
    default_game="hearthstone",
    terms=TERMS,
    typography=TYPOGRAPHY,
    typography_decisions=TYPOGRAPHY_DECISIONS,
    markers=MARKERS,
    artifacts=ARTIFACTS,
    messages=MESSAGES,
)
