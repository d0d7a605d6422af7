from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from prosemetrics.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


CLEAN = """Топовые сборки
Наш герой сегодня — Мех Паладин из новой меты. Колода молодая, но уже
заметная на ладдере. Оставляйте Стража портала против быстрых соперников.
Основа колоды
Двадцать слотов заняты всегда, остальное решает вкус игрока.
Однако гибкость ограничена. Хотя вариантов хватает, вы редко меняете больше
двух карт (чаще всего ни одной).
Общие правила муллигана
Ищите ранние существа, забирайте Железный щит. Не бойтесь пустой руки.
Основы геймплея
Вы побеждаете через стол и щиты. Усиливайте роботов каждый ход.
Матчапы
Против Воина, Шамана, Разбойника, Паладина, Охотника, Друида,
Чернокнижника, Мага, Жреца, Охотника на демонов и Рыцаря смерти схема
одна: держать стол и давить числом.
"""

NAMES = (
    "Ал'Акир",
    "Кузнец – мастер клинков",
    "Страж портала",
    "Железный щит",
    "Медная монетка",
    "Громовержец",
)


@pytest.fixture(scope="session")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "official string").cache()


@pytest.fixture()
def docs(spark):
    def build(*texts: str, **named: str):
        rows = [(str(i), t) for i, t in enumerate(texts)] + list(named.items())
        return spark.createDataFrame(rows, "doc_id string, text string")

    return build
