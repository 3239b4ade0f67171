"""Structured replies as Markdown cards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.answers import json_object

# Required fields, labels of the metadata, and the sections in their order with how their items are written.
REQUIRED = ("name", "description")
LABELS = {"skill_category": "Category", "source_task_type": "Source", "abstraction_level": "Level", "success_signal": "Signal"}
SECTIONS = {
    "skill_overview": "Overview", "when_to_use": "When to Use", "when_not_to_use": "When NOT to Use", "inputs_to_identify": "Inputs to Identify", "workflow": "Workflow",
    "decision_rules": "Decision Rules", "error_handling": "Error Handling", "output_requirements": "Output Requirements",
}


def _step(x: dict) -> list[str]:
    notes = [(label, x.get(key)) for key, label in (("tools_or_strategy", "Strategy"), ("completion_condition", "Done when"))]
    return [f"{x.get('step', '?')}. **{x.get('goal', '')}**: {x.get('action', '')}", *(f"   - {label}: {note}" for label, note in notes if note)]


_WRITTEN = {"workflow": _step, "error_handling": lambda x: [f"- **{x.get('error', '')}**: {x.get('cause', '')} → {x.get('response', '')}"]}


def markdown_card(text: str | None) -> tuple[str | None, str]:
    """The card of the JSON object in a reply, and an empty string; or None and what is wrong with it."""
    found = json_object(text, (*REQUIRED, *SECTIONS))
    if found is None:
        return None, "Invalid JSON"
    held = json.loads(found)
    missing = [f for f in REQUIRED if not held.get(f)]
    if missing:
        return None, f"Missing required fields: {', '.join(missing)}"
    lines = [f"# Skill: {held['name']}", f"\n{held['description']}"]
    meta = held.get("metadata")
    told = [f"**{label}**: {meta[key]}" for key, label in LABELS.items() if meta.get(key)] if isinstance(meta, dict) else []
    lines += ["\n" + " | ".join(told)] if told else []
    for field, title in SECTIONS.items():
        if held.get(field):
            lines.append(f"\n## {title}")
            write = _WRITTEN.get(field, lambda x: [f"- {x}"])
            for item in held[field]:
                lines += write(item)
    return "\n".join(lines), ""


def _cards(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            return markdown_card(text)
        except (AttributeError, TypeError) as e:
            return None, f"Invalid JSON: {e}"  # a section of another shape

    return pd.DataFrame([one(t) for t in texts], columns=["card", "error"])


def card(text: Column) -> Column:
    """card (Markdown, null if there is none) and error of each reply. Arrow-batched."""
    return F.pandas_udf(_cards, "card string, error string")(text)


def format_verdict(text: Column, penalty: float = 1.0) -> Column:
    """penalty (0 or minus the given one) and score (1 or 0) of a reply, by whether it gives a card."""
    good = card(text)["error"] == ""
    return F.when(good, F.struct(F.lit(0.0).alias("penalty"), F.lit(1).alias("score"))).otherwise(F.struct(F.lit(-penalty).alias("penalty"), F.lit(0).alias("score")))
