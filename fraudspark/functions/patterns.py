"""Roles of columns and categories of datasets, read from their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword in a dataset name -> category, first match wins.
DATASET_CATEGORIES = {
    "permit": "permits",
    "violation": "violations",
    "complaint": "complaints",
    "license": "licenses",
    "property": "properties",
    "registration": "registrations",
    "certificate": "certificates",
    "application": "applications",
    "facade": "facades",
    "litigation": "litigation",
    "maintenance": "maintenance",
    "construction": "construction",
}
DEFAULT_CATEGORY = "properties"

# Parts of column names that give a role.
ROLE_WORDS = {
    "key": ["id", "number", "bin", "bbl"],
    "entity": [
        "applicant", "owner", "contractor", "respondent", "company", "corporation", "firm",
        "business", "name", "contact", "principal", "officer", "manager", "address", "street",
        "location", "site", "property", "id", "number", "permit", "license", "registration",
        "bin", "bbl", "ein", "registration_id", "amount", "cost", "fee", "value",
        "estimated_cost",
    ],
    "temporal": ["date", "time", "created", "issued", "filed"],
    "financial": ["amount", "cost", "fee", "value", "estimated_cost"],
    "join": ["id", "number", "bin", "bbl", "permit"],
}

# Parts of column names that point at fraud-relevant content.
FRAUD_WORDS = ["violation", "fine", "penalty", "suspend", "revok", "complaint", "emergency"]


def dataset_category(name: Column) -> Column:
    lowered = F.lower(name)
    ladder = None
    for word, category in DATASET_CATEGORIES.items():
        hit = lowered.contains(word)
        ladder = F.when(hit, category) if ladder is None else ladder.when(hit, category)
    return ladder.otherwise(DEFAULT_CATEGORY)


def column_roles(column: str) -> list[str]:
    """Roles of one column name, sorted."""
    lowered = column.lower()
    words = {**ROLE_WORDS, "fraud": FRAUD_WORDS}
    return sorted(role for role, parts in words.items() if any(p in lowered for p in parts))
