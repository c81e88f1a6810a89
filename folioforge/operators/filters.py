"""Facet filters: AND across groups, OR within a group, each many-valued group a semi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advanced(items: DataFrame, groups: dict[str, list], links: dict[str, DataFrame] | None = None) -> DataFrame:
    """groups: column or link name -> accepted values. links: name -> (item_id, value); the others are columns of `items`."""
    for name, values in groups.items():
        if not values:
            continue
        if links and name in links:
            items = items.join(links[name].filter(F.col("value").isin(*values)).select("item_id"), "item_id", "left_semi")
        else:
            items = items.filter(F.col(name).isin(*values))
    return items


def pending_review(results: DataFrame, verification: Column) -> DataFrame:
    """Results that wait for review: flagged, not verified, not blank."""
    return results.filter((F.col("status") == "NEEDS_REVIEW") & verification.isin("UNVERIFIED", "REJECTED") & F.col("text").rlike("\\S"))


def backlog(documents: DataFrame, pending: DataFrame, *conditions: Column) -> DataFrame:
    """Documents with a pending result for each of the conditions (any one result may meet a condition)."""
    for condition in conditions or (F.lit(True),):
        documents = documents.join(pending.filter(condition).select("doc_id"), "doc_id", "left_semi")
    return documents


def expired(requests: DataFrame, now: Column) -> DataFrame:
    """RUNNING requests whose lease is missing or over, missing leases first."""
    return requests.filter((F.col("status") == "RUNNING") & (F.col("lease").isNull() | (F.col("lease") <= now))).orderBy(F.col("lease").asc_nulls_first(), "request_id")


def routes(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their engine; a combination that the table lacks gets an error."""
    routed = requests.join(table, keys, "left")
    return routed.withColumn("error", F.when(F.col("engine").isNull(), F.lit("no_route")))
