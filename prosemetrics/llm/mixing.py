"""Mixing to target weights: budgets go down a domain-language-source tree, then every leaf gives
a prefix of its seeded order.  Column functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemetrics.llm.shared import identified, stored

LEVELS = ("domain", "lang", "source")
# Parts of a leaf's order, by the first three hexadecimal digits of the hash.
PART_DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """What to take, and how much.

    ``domains`` sorts sources into domains (others: ``other_domain``).  Weights are whole numbers;
    a node that is not named has weight 1.  ``share_pct`` of all tokens is the total budget.
    A leaf can be read ``epochs`` times at most.
    """

    domains: Mapping[str, str] = field(default_factory=dict)
    other_domain: str = "other"
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    share_pct: int = 50
    epochs: int = 2
    seed: int = 42


def _lookup(key: Column, values: Mapping, default) -> Column:
    """A configured value for a key, as one expression."""
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, at most ``supply`` each.

    What a child cannot use goes to its siblings by weight, and so on.  Children sorted by supply
    for each unit of weight: those before the first one that can meet its share of the rest give
    all they have, that one and all after it get their share.  Whole tokens, rounded down.  A child
    of weight 0 gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), F.col(name))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = nodes.filter("weight > 0")
    ranked = wanted.withColumns(
        {
            "given": F.coalesce(F.sum("supply").over(earlier), F.lit(0)),
            "rest": F.sum("weight").over(later),
            "rank": F.row_number().over(order),
        }
    )
    left = F.greatest(F.col("budget") - F.col("given"), F.lit(0))
    meets = F.col("supply") * F.col("rest") >= left * F.col("weight")
    everyone = Window.partitionBy(*parent)
    ranked = ranked.withColumn("first", F.min(F.when(meets, F.col("rank"))).over(everyone))
    at_first = lambda c: F.max(F.when(F.col("rank") == F.col("first"), c)).over(everyone)
    ranked = ranked.withColumns({"unit_left": at_first(left), "unit_rest": at_first(F.col("rest"))})
    share = F.expr("unit_left * weight div unit_rest")
    got = F.when(F.col("rank") < F.coalesce(F.col("first"), F.lit(2**31 - 1)), F.col("supply")).otherwise(share)
    return ranked.withColumn("budget", got).drop("given", "rest", "rank", "first", "unit_left", "unit_rest")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``domain, lang, source, supply, budget`` from ``domain, lang, source, tokens``.

    The total goes to domains, a domain's budget to its languages and theirs to their sources.  As
    a node's supply is all that its leaves have, a shortage in a leaf is first made up by its
    siblings, then by the other languages of the domain, and last by the other domains.
    """
    weights = {
        "domain": _lookup(F.col("domain"), mixture.domain_weights, 1),
        "lang": _lookup(F.col("lang"), mixture.lang_weights, 1),
        "source": _lookup(F.col("source"), mixture.source_weights, 1),
    }
    leaves = leaves.withColumn("supply", F.col("tokens") * mixture.epochs)
    total = leaves.agg(F.coalesce(F.expr(f"sum(tokens) * {mixture.share_pct} div 100"), F.lit(0)).alias("budget"))
    given, parent = total.withColumn("root", F.lit(0)), ["root"]
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        children = leaves.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumn("root", F.lit(0))
        children = children.join(given.select(*parent, "budget"), parent)
        given = share_out(children.withColumn("weight", weights[level]), parent, level)
        parent = ["root", *path]
    return given.select(*LEVELS, "supply", "budget")


def select_prefixes(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Chosen rows of ``row, id, domain, lang, source, tokens, text_hash``, one for each epoch that
    reads them, with ``epoch`` and the leaf's ``supply`` and ``budget``.

    An epoch orders a leaf's rows by a seeded hash of the id and the text, so rows of one id (or none) lie apart.  A leaf gives
    its rows in that order, epoch after epoch, until their tokens reach its budget: the last row may
    exceed it.  No leaf is sorted as a whole: sums by the hash's first digits say which parts of an
    order are taken whole, and only the part in which the budget ends is summed row by row.
    """
    leaf = list(LEVELS)
    plan = stored(budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), mixture), "budgets")
    epochs = F.explode(F.sequence(F.lit(1), F.lit(mixture.epochs))).alias("epoch")
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_hash"))
    ordered = rows.select("*", epochs).withColumn("place", _place(mixture.seed, F.col("epoch"), key))
    ordered = ordered.withColumn("part", F.substring("place", 1, PART_DIGITS))
    part = [*leaf, "epoch", "part"]
    parts = ordered.groupBy(*part).agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.partitionBy(*leaf).orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)))
    parts = parts.join(plan, leaf).filter("part_before < budget")
    wanted = ordered.join(parts, part)
    whole = F.col("part_before") + F.col("part_tokens") < F.col("budget")
    inside = Window.partitionBy(*part).orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = wanted.filter(~whole).withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    cut = sums.filter("part_before + inside < budget")
    columns = ["row", "id", *leaf, "tokens", "epoch", "supply", "budget"]
    return wanted.filter(whole).select(*columns).unionByName(cut.select(*columns))


def _place(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), key).cast("binary"))


def described(docs: DataFrame, mixture: Mixture, row: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """What the selection needs of each document; the text stays behind."""
    blank = F.lit("")
    source = F.coalesce(F.col(source_col).cast("string"), blank)
    return docs.select(
        row.alias("row"),
        F.col(id_col).alias("id"),
        _lookup(source, mixture.domains, mixture.other_domain).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), blank).alias("lang"),
        source.alias("source"),
        token_count(F.col(text_col)).alias("tokens"),
        F.md5(F.coalesce(F.col(text_col), blank).cast("binary")).alias("text_hash"),
    )


def mixed_ids(
    docs: DataFrame,
    mixture: Mixture,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, epoch, leaf_supply, leaf_budget`` of the mixture.

    Defined cases: a null language or source counts as the empty string, a null text has no
    tokens, and a row without tokens is taken if it comes before the budget is reached; repeated
    rows are rows of their own; other columns are not read; an empty table gives no rows.
    """
    row = F.monotonically_increasing_id()
    slim = stored(described(docs, mixture, row, id_col, text_col, lang_col, source_col), "mixing")
    return select_prefixes(slim, mixture).select(
        F.col("id").alias(id_col),
        *LEVELS,
        "tokens",
        "epoch",
        F.col("supply").alias("leaf_supply"),
        F.col("budget").alias("leaf_budget"),
    )


def mix(
    docs: DataFrame,
    mixture: Mixture,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with all their columns; once for each epoch.

    Cases are defined as in :func:`mixed_ids`.
    """
    marked, row = identified(docs, "mix")
    slim = described(marked, mixture, F.struct(*row), id_col, text_col, lang_col, source_col)
    chosen = select_prefixes(stored(slim, "mixing"), mixture).select(*[F.col(f"row.{c}").alias(c) for c in row])
    # The same join at every size; a row has one partner for each epoch that reads it.
    return marked.join(stored(chosen, "chosen").hint("shuffle_hash"), row).select(*docs.columns)
