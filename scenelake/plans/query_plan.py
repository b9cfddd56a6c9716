"""The plan of a query: its fields, their validation, and a rule-based planner."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: the kinds of queries and the indices each searches.
TYPE_INTENTS = {
    "dialogue": ["dialogue"], "simple_scene": ["scene"], "complex_scene": ["scene", "full"], "detailed_scene": ["scene"], "event_journey": ["scene", "full"],
    "plot_level": ["plot"], "similarity": ["plot", "full"], "thematic": ["plot"], "thematic_scene": ["plot", "scene"], "filtered": ["plot", "full"],
    "multi_criteria": ["scene", "full"], "comparative": ["plot", "full"], "negation": ["plot", "full"], "multi_aspect": ["full"],
}
INTENTS = ("scene", "dialogue", "character", "full", "plot")
PLAN_SCHEMA = "query_type string, intents array<string>, filters struct<genre:string,year_min:int,year_max:int>, exclude_titles array<string>, reference_title string, rewrite string, sub_queries array<struct<intent:string,text:string>>"


@dataclass
class QueryPlan:
    query_type: str = "plot_level"
    intents: list[str] = field(default_factory=lambda: ["full"])
    genre: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    exclude_titles: list[str] = field(default_factory=list)
    reference_title: str | None = None
    rewrite: str | None = None
    sub_queries: list[dict] | None = None

    @classmethod
    def validated(cls, raw) -> "QueryPlan":
        """A plan from anything: wrong types and values fall back to the defaults."""
        if not isinstance(raw, dict):
            return cls()
        words = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
        listed = lambda v: v if isinstance(v, list) else []
        subs = [{"intent": s["intent"], "text": s["text"].strip()} for s in listed(raw.get("sub_queries")) if isinstance(s, dict) and s.get("intent") in INTENTS and words(s.get("text"))]
        intents = list(dict.fromkeys(s["intent"] for s in subs)) if subs else [i for i in listed(raw.get("intents")) if i in INTENTS]
        filters = raw.get("filters") if isinstance(raw.get("filters"), dict) else {}

        def year(v):
            try:
                return int(v)
            except (TypeError, ValueError):
                return None

        kind = raw.get("query_type")
        return cls(
            kind if isinstance(kind, str) and kind in TYPE_INTENTS else "plot_level", intents or ["full"], words(filters.get("genre")), year(filters.get("year_min")), year(filters.get("year_max")),
            [t for t in listed(raw.get("exclude_titles")) if words(t)], words(raw.get("reference_title")), words(raw.get("rewrite")), subs or None,
        )

    @classmethod
    def parsed(cls, text: str | None) -> "QueryPlan":
        """A plan from a model's answer: code fences are taken off, the first JSON object counts."""
        body = re.sub(r"^\s*```(?:json)?|```\s*$", "", text or "").strip()
        for candidate in (body, (re.search(r"\{.*\}", body, re.S) or [""])[0]):
            try:
                return cls.validated(json.loads(candidate))
            except ValueError:
                continue
        return cls()

    @classmethod
    def manual(cls, intents: str) -> "QueryPlan":
        """A plan that searches the indices named in a comma-separated list."""
        chosen = [i.strip() for i in intents.split(",") if i.strip() in INTENTS]
        if not chosen:
            raise ValueError(f"no valid intent in {intents!r}")
        return cls(intents=chosen)


def valid_type(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin(*TYPE_INTENTS), c).otherwise("plot_level")


def valid_sub_queries(column="sub_queries") -> Column:
    """Sub-queries with a known intent and a text; null where none is left."""
    kept = F.filter(column, lambda s: s["intent"].isin(*INTENTS) & (F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    return F.when(F.size(kept) > 0, kept)


def valid_intents(intents="intents", sub_queries="sub_queries") -> Column:
    """Intents of the valid sub-queries in order, else the known ones of the plan, else full."""
    from_subs = F.array_distinct(F.transform(valid_sub_queries(sub_queries), lambda s: s["intent"]))
    own = F.filter(intents, lambda i: i.isin(*INTENTS))
    return F.coalesce(from_subs, F.when(F.size(own) > 0, own), F.array(F.lit("full")))


_GENRES = "action adventure animation biography comedy crime documentary drama family fantasy film-noir history horror music musical mystery romance science-fiction sport thriller war western".split()


def rule_based(query: str) -> QueryPlan:
    """A plan by simple rules: quotations, decades and years, genres, 'not X', 'like X'."""
    text = query.strip()
    plan = QueryPlan("plot_level", ["full"])
    if re.fullmatch(r"[\"“].+[\"”]", text) or re.search(r"\b(says|said|quote)\b", text, re.I):
        return QueryPlan("dialogue", ["dialogue"])
    negated = re.search(r"\b(?:but\s+)?not\s+(?:the\s+movie\s+)?([A-Z][\w' ]+)$", text)
    if negated:
        plan = QueryPlan("negation", TYPE_INTENTS["negation"][:], exclude_titles=[negated[1].strip()], rewrite=text[: negated.start()].strip() or None)
    like = re.search(r"\b(?:movies?|films?)\s+like\s+(.+)$", text, re.I)
    if like:
        plan = QueryPlan("similarity", TYPE_INTENTS["similarity"][:], reference_title=like[1].strip())
    decade = re.search(r"\b(?:19|20)?(\d)0'?s\b", text)
    year = re.search(r"\b((?:19|20)\d\d)\b", text)
    genre = next((g for g in _GENRES if re.search(rf"\b{g.replace('-', '[ -]')}\b", text, re.I)), None)
    if decade or year or genre:
        if plan.query_type == "plot_level":
            plan.query_type, plan.intents = "filtered", TYPE_INTENTS["filtered"][:]
        if decade:
            d = int(decade[1]) * 10
            start = (1900 if d >= 30 else 2000) + d
            plan.year_min, plan.year_max = start, start + 9
        elif year:
            plan.year_min = plan.year_max = int(year[1])
        plan.genre = genre.replace("-", " ").title() if genre else None
    return plan


def classify(query: str, provider: Callable[[str], str] | None = None) -> QueryPlan:
    """The provider's plan, or the rule-based one without a provider, or where it fails the default."""
    if provider is None:
        return rule_based(query)
    try:
        return QueryPlan.parsed(provider(query))
    except Exception:  # an outside service
        return QueryPlan()
