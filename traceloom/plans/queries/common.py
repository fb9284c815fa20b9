"""Inputs the query modules share."""

from pyspark.sql import functions as F

from ... import functions as X
from ...operators import activity as A
from ...operators.scoring import classify_events
from ..views import evidence, table

__all__ = ["F", "X", "A", "evidence", "table", "events", "classified", "ranked", "joined",
           "masked_events"]


def events(spark, sf):
    """The event view with the map column scoring reads."""
    return evidence(spark, sf, "exec_events").withColumn(
        "unavailable", F.create_map().cast("map<string,string>")).withColumn(
        "normalized_command", X.normalize_for_search(F.coalesce("full_command_line", "executable",
                                                                "process_name"))).withColumn(
        "command_evidence_strength", F.lit(None).cast("string"))


def masked_events(spark, sf):
    return events(spark, sf).withColumn("full_command_line", X.mask_secrets("full_command_line"))


def classified(spark, sf):
    return classify_events(events(spark, sf), evidence(spark, sf, "artifacts"))


def ranked(spark, sf):
    return A.rank_groups(A.activity_groups(classified(spark, sf)))


def joined(column, sep=","):
    """Arrays as text, so both engines hash the same value."""
    return F.array_join(column, sep)
