"""URL verdicts: host and path rules first, then a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Vocabulary:
    """Terms of plain lower-case ASCII letters, digits, ``-`` and ``.``.

    One strict term rejects a URL, and so do ``soft_needed`` distinct soft terms.
    """

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    soft_needed: int = 2


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class UrlPolicy:
    rules: tuple[Rule, ...]
    vocabulary: Vocabulary = field(default_factory=lambda: DEFAULT_VOCABULARY)


DEFAULT_VOCABULARY = Vocabulary(
    strict=("casino", "porn", "xxx", "viagra", "cialis", "escort", "pills", "malware", "phishing", "warez"),
    soft=(
        "ads", "adult", "affiliate", "bet", "betting", "bonus", "cheap", "click", "coupon", "crack", "dating",
        "deal", "download", "free", "loan", "lottery", "poker", "promo", "sale", "slots", "torrent", "track", "win",
    ),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does.

    Of two rules of one length the first in alphabetical order counts.
    """
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        inside = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        fits = inside & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def term_counter(vocabulary: Vocabulary):
    """A function of a URL that counts its distinct strict and soft terms.

    A term counts where no ASCII letter or digit stands right before or after it.
    """
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, kind in [*((t, 1) for t in vocabulary.soft), *((t, 0) for t in vocabulary.strict)]:
        machine.add_word(term, (term, kind))
    machine.make_automaton()
    inner = set("abcdefghijklmnopqrstuvwxyz0123456789")
    fold = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

    def count(url: str | None) -> tuple[int, int]:
        url = (url or "").translate(fold)
        found: tuple[set[str], set[str]] = (set(), set())
        for end, (term, kind) in machine.iter(url):
            begin = end - len(term) + 1
            if (begin == 0 or url[begin - 1] not in inner) and (end + 1 == len(url) or url[end + 1] not in inner):
                found[kind].add(term)
        return len(found[0]), len(found[1])

    return count


def url_verdicts(pages: DataFrame, policy: UrlPolicy, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft``: one row for every row of ``pages``.

    A rule's verdict comes first.  A URL that no rule fits is blocked when the whole URL, A-Z
    lower-cased, holds one strict term or ``soft_needed`` distinct soft ones.

    Defined cases: a null URL, an empty one and one without ``://`` have an empty host and path;
    their terms still count (null: none).  Null or repeated ids stay as they are, other columns are
    not read, an empty table gives no rows.  The vocabulary is configuration: its size is fixed.
    """
    vocabulary = policy.vocabulary
    schema = f"`{id_col}` {dict(pages.dtypes)[id_col]}, url string, n_strict int, n_soft int"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = term_counter(vocabulary)
        for batch in batches:
            hits = [terms(url) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([h[0] for h in hits], pa.int32()),
                    pa.array([h[1] for h in hits], pa.int32()),
                ],
                names=[id_col, "url", "n_strict", "n_soft"],
            )

    counted = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url")).mapInArrow(count, schema)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), policy.rules)
    rejected = (F.col("n_strict") >= 1) | (F.col("n_soft") >= vocabulary.soft_needed)
    by_terms = F.when(rejected, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return counted.select(id_col, host.alias("host"), path.alias("path"), "n_strict", "n_soft").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "n_strict", "n_soft"
    )
