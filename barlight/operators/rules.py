"""Rule-based classification of short texts. Rules are data; they become column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.text import join_distinct, matched_terms, normalize_text, split_tags


@dataclass(frozen=True)
class Rules:
    """What to look for. ``categories`` and ``indirect`` are ordered; earlier entries win ties."""

    direct_terms: list[str]
    categories: dict[str, list[str]]
    indirect: list[dict]  # category, reason and either groups (all must hit) or topic and connection
    exclusions: dict[str, list[str]]  # headline only
    price_terms: list[str] = field(default_factory=list)  # headline, unless a material term occurs anywhere
    material_terms: list[str] = field(default_factory=list)
    aliases: dict[str, list[str]] = field(default_factory=dict)
    default_category: str = "other_direct_development"

    @classmethod
    def load(cls, path: str) -> Rules:
        with open(path, encoding="utf-8") as f:
            rules = cls(**json.load(f))
        if not rules.direct_terms or not rules.categories:
            raise ValueError("rules need direct terms and categories")
        return rules


#: A neutral set for the invented company news of the test tables.
DEFAULT = Rules(
    direct_terms=["quavolt", "qvlt"],
    categories={
        "trade": ["embargo", "customs", "export licence", "tariff", "tribunal"],
        "deals": ["deal", "pact", "merger", "acquisition", "contract", "partner"],
        "supply": ["shortage", "recall", "defect", "delay", "inventory", "supply"],
        "product": ["accelerator", "chiplet", "toolkit", "library", "driver"],
        "finance": ["dividend", "bond", "loan", "budget", "royalty", "stake"],
    },
    indirect=[
        {"category": "trade", "topic": ["embargo", "customs", "tariff"], "connection": ["accelerator", "chiplet", "lithography", "wafers"], "reason": "Trade limits can move demand for parts."},
        {"category": "supply", "groups": [["shortage", "recall", "defect"], ["substrate", "interposer", "memory", "packaging"], ["supply", "inventory", "freight"]], "reason": "Short parts can hold back shipments."},
        {"category": "deals", "topic": ["pact", "merger", "deal"], "connection": ["reactor", "grid", "data halls", "cloud"], "reason": "Deals in energy and hosting change spending plans."},
    ],
    exclusions={"results_season": ["quarterly", "results"], "pick_list": ["why", "should"], "chart_reading": ["chart", "moving average"]},
    price_terms=["shares of", "moved", "slide", "falls", "rises"],
    material_terms=["contract", "embargo", "recall", "shortage", "regulator"],
    aliases={"QVLT": ["Quavolt"], "MNEX": ["Monexa Memory"], "RVMZ": ["Rivermaze"], "ORDM": ["Ordem Micro"], "AXWV": ["Axwave Cloud"], "GLPH": ["Galphin"], "MTRA": ["Metora"], "BRCN": ["Brecon"], "TSLM": ["Talisem Foundry"]},
)


def tagged_entities(combined: Column, related: Column, aliases: dict[str, list[str]]) -> Column:
    """Sorted distinct tickers named by the provider's tags (known ones) or by an alias in the text."""
    known = F.filter(F.transform(split_tags(related), F.upper), lambda t: t.isin(*aliases))
    named = F.array_compact(F.array(*[F.when(F.size(matched_terms(combined, names)) > 0, F.lit(t)) for t, names in aliases.items()]))
    return F.array_sort(F.array_distinct(F.concat(known, named)))


def classified(items: DataFrame, rules: Rules = DEFAULT, related: str = "provider_related") -> DataFrame:
    """Items with companies, relevance, category, reason, exclusions and the terms that decided.

    The category is the one with most distinct terms in headline and summary. A direct mention
    anywhere makes an item direct; else the first indirect rule that holds does, and sets the
    category. Exclusions look at the headline and apply whatever the relevance; their reasons keep
    the order of evaluation. Everything is one projection without a shuffle.
    """
    start = items.columns
    df = items.withColumns({"_head": normalize_text(F.col("headline")), "_all": normalize_text(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit(""))))})
    head, every = F.col("_head"), F.col("_all")
    hit = lambda text, terms: F.size(matched_terms(text, terms)) > 0
    df = df.withColumns({"_direct": matched_terms(every, rules.direct_terms), "_direct_head": hit(head, rules.direct_terms)} | {f"_c{i}": matched_terms(every, t) for i, t in enumerate(rules.categories.values())})
    names = list(rules.categories)
    best = F.greatest(*[F.size(f"_c{i}") for i in range(len(names))], F.lit(0))
    category = F.when(best == 0, F.lit(""))
    for i, name in enumerate(names):
        category = category.when(F.size(f"_c{i}") == best, name)
    is_direct = F.size("_direct") > 0
    holds = []
    for r in rules.indirect:
        if "groups" in r:
            ok, terms = F.lit(True), []
            for g in r["groups"]:
                ok, terms = ok & hit(every, g), terms + g
        else:
            ok, terms = hit(every, r["topic"]) & hit(every, r["connection"]), r["topic"] + r["connection"]
        holds.append((ok, r, terms))
    rule = F.lit(-1)
    for i, (ok, _, _) in reversed(list(enumerate(holds))):
        rule = F.when(ok, i).otherwise(rule)
    df = df.withColumns({"_cat": category, "_rule": F.when(is_direct, -1).otherwise(rule), "_is": is_direct})
    pick = lambda values, other: F.coalesce(*[F.when(F.col("_rule") == i, v) for i, v in enumerate(values)], other)
    none = F.array().cast("array<string>")
    relevance = F.when(F.col("_is"), "direct").when(F.col("_rule") >= 0, "indirect").otherwise("not_relevant")
    final = F.when(F.col("_is") & (F.col("_cat") == ""), rules.default_category).otherwise(pick([F.lit(r["category"]) for _, r, _ in holds], F.col("_cat")))
    reason = F.when(F.col("_is"), "Names the company.").otherwise(pick([F.lit(r["reason"]) for _, r, _ in holds], F.lit("insufficient_connection")))
    why = [F.when(hit(head, terms), F.lit(name)) for name, terms in rules.exclusions.items()]
    why += [F.when(hit(head, rules.price_terms) & ~hit(every, rules.material_terms), F.lit("past_price_movement"))]
    why += [F.when(F.col("_is") & ~F.col("_direct_head") & ~F.greatest(F.lit(False), *[hit(head, t) for t in rules.categories.values()]), F.lit("summary_only_mention"))]
    why += [F.when(~F.col("_is") & (F.col("_rule") < 0), F.lit("insufficient_connection"))]
    terms = F.concat(F.col("_direct"), *[F.when(F.col("_cat") == n, F.col(f"_c{i}")).otherwise(none) for i, n in enumerate(names)], pick([matched_terms(every, t) for _, _, t in holds], none))
    out = {
        "companies": tagged_entities(every, F.col(related), rules.aliases), "relevance": relevance, "category": final, "reason": reason,
        "exclusion_reasons": F.array_compact(F.array(*why)), "matched_terms": join_distinct(terms),
    }
    return df.select(*[F.col(c) for c in start if c not in out], *[v.alias(k) for k, v in out.items()]).withColumn("is_excluded", F.size("exclusion_reasons") > 0)
