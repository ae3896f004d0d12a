"""Corrections that a teacher makes to scores that were read, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Differences up to it are none.
TOLERANCE = 0.0001


def is_correction(original: Column, approved: Column) -> Column:
    """A value that was read was changed or cleared; filling a blank is none."""
    return F.coalesce(original.isNotNull() & (approved.isNull() | (F.abs(original - approved) > TOLERANCE)), F.lit(False))


def corrected_cells(original: DataFrame, approved: DataFrame) -> DataFrame:
    """exam, question, cells: corrected cells by question index, from rows(exam, row_id, position, scores array<double>).

    Approved rows meet the original with their row_id, else the one at their position.
    """
    o = original.select("exam", F.col("row_id").alias("o_id"), F.col("position").alias("o_position"), F.col("scores").alias("o_scores"))
    by_id = approved.join(o, (approved["exam"] == o["exam"]) & (approved["row_id"] == o["o_id"]), "left").select(approved["*"], F.col("o_scores").alias("by_id"))
    place = o.select(F.col("exam").alias("p_exam"), F.col("o_position"), F.col("o_scores").alias("by_place"))
    both = by_id.join(place, (by_id["exam"] == F.col("p_exam")) & (by_id["position"] == F.col("o_position")), "left")
    cells = both.select("exam", F.posexplode(F.zip_with(F.coalesce("by_id", "by_place"), "scores", lambda a, b: is_correction(a, b))).alias("question", "changed"))
    return cells.where("changed").groupBy("exam", "question").agg(F.count("*").alias("cells"))


def clean_counts(counts: Column) -> Column:
    """A map of question index to count, without what isn't a number, negative indexes and counts below 1."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].try_cast("int").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: (e["key"] >= 0) & (e["value"] > 0)))


def merged(counts: DataFrame) -> DataFrame:
    """exam, question, cells summed over rows(exam, cells map<int,int>)."""
    return counts.select("exam", F.explode("cells").alias("question", "cells")).groupBy("exam", "question").agg(F.sum("cells").alias("cells"))
