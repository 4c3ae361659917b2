"""Sections of any depth as rows: the way from the top to each, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.staging import staged


def step(ord: str, section_id: str):
    """One step of a path: the section's place among its siblings, then its id."""
    return F.struct(F.col(ord).cast("long").alias("ord"), F.col(section_id).alias("id"))


def paths(sections: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``sections`` (source_id, section_id, parent_id, ord, times) with path, open_from and open_to; such as have them stay as they are.

    A path is the array of steps from the top down to the section itself, so paths in order are sections depth first.
    open_from and open_to are the times for which the section and all above it last.  Each level is one join of the
    children with the level above, written out; there are as many steps as levels.  Sections whose parent is missing, and
    those that are their own ancestors, are reached from no top and left out.
    """
    if {"path", "open_from", "open_to"} <= set(sections.columns):
        return sections
    sections = sections.drop("path", "open_from", "open_to")
    # Levels pass ids, order and times alone; all else of a section meets its path once.
    rows = staged(sections.select("source_id", "section_id", "parent_id", "ord", F.col(start).alias("_start"), F.col(end).alias("_end")).distinct(), "sections")
    here = step("ord", "section_id")
    own = ["source_id", "section_id", "parent_id", "ord", "_start", "_end"]
    found = staged(rows.filter("parent_id IS NULL").select(*own, F.array(here).alias("path"), F.col("_start").alias("open_from"), F.col("_end").alias("open_to")), "level")
    out = found
    while not found.isEmpty():
        above = found.select("source_id", F.col("section_id").alias("parent_id"), F.col("path").alias("_path"), F.col("open_from").alias("_from"), F.col("open_to").alias("_to"))
        kids = rows.join(above.hint("shuffle_merge"), ["source_id", "parent_id"])
        found = staged(kids.select(*own, F.array_append("_path", here).alias("path"), F.greatest("_from", "_start").alias("open_from"), F.least("_to", "_end").alias("open_to")), "level")
        out = out.unionByName(found)
    # Rows that share an id are told apart by the rest.
    out = out.select("source_id", "section_id", "path", "open_from", "open_to", *(F.col(c).alias(f"_own{k}") for k, c in enumerate(own[2:])))
    same = [F.col(c).eqNullSafe(F.col(f"_own{k}")) for k, c in enumerate(("parent_id", "ord", start, end))]
    met = sections.join(out.hint("shuffle_merge"), ["source_id", "section_id"]).filter(same[0] & same[1] & same[2] & same[3])
    return met.select(*sections.columns, "path", "open_from", "open_to")


def deepest(sections: DataFrame) -> int:
    """Levels of ``sections``, which have paths."""
    return sections.agg(F.max(F.size("path"))).first()[0] or 0


def beneath(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """``rows`` of sections (source_id, section_id) once for each section above theirs, under its section_id."""
    up = paths(sections).filter(F.size("path") > 1).select("source_id", "section_id", F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("_up"))
    return rows.join(up.hint("shuffle_merge"), ["source_id", "section_id"]).withColumn("section_id", F.col("_up.id")).drop("_up").select(*rows.columns)
