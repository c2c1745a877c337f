"""The closed category taxonomy and what maps to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 15 tags.
CATEGORIES = [
    "Music",
    "Open Mic & Comedy",
    "Theater & Stage",
    "Visual Art",
    "Dance",
    "Trivia & Games",
    "Food & Drink",
    "Health & Wellness",
    "Outdoors & Nature",
    "Sports & Recreation",
    "Talks & Learning",
    "Civic & Politics",
    "Family & Kids",
    "Community & Clubs",
    "Volunteer & Causes",
]

#: Tags that a fresh filter leaves out.
DEFAULT_EXCLUDED = ["Volunteer & Causes", "Civic & Politics", "Community & Clubs"]
DEFAULT_SELECTED = [c for c in CATEGORIES if c not in DEFAULT_EXCLUDED]

#: A listing service's own categories, as far as they map to one tag.
SOURCE_CATEGORIES = {
    "Education & Lectures": "Talks & Learning",
    "Food & Drink": "Food & Drink",
    "Local Libations": "Food & Drink",
    "Gallery & Exhibitions": "Visual Art",
    "General & Community Events": "Community & Clubs",
    "Health & Wellness": "Health & Wellness",
    "Kids & Families": "Family & Kids",
    "Music & Concerts": "Music",
    "Nature & Outdoors": "Outdoors & Nature",
    "Tours & Walks": "Outdoors & Nature",
    "Theater & Performing Arts": "Theater & Stage",
    "Trivia": "Trivia & Games",
    "Volunteer": "Volunteer & Causes",
    "Sports & Recreation": "Sports & Recreation",
}


def vocabulary() -> Column:
    return F.array(*map(F.lit, CATEGORIES))


def map_categories(names: Column, table: dict[str, str] = SOURCE_CATEGORIES) -> Column:
    """Source categories to tags: unmapped ones go, order stays, each once. A null array gives an empty one."""
    to = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mapped = F.transform(names, lambda n: F.try_element_at(to, F.coalesce(n, F.lit(""))))
    return F.coalesce(F.array_distinct(F.array_compact(mapped)), F.array().cast("array<string>"))


def strict(tags: Column) -> Column:
    """Only tags of the taxonomy; repeats stay."""
    return F.filter(tags, lambda t: t.isin(CATEGORIES))
