"""Row predicates shared by the shipped rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trailhound.functions.text import casefold

# Policy names that grant administrator rights.
ADMIN_POLICY_MARKERS = ("administratoraccess", "poweruseraccess", "iamfullaccess")


def auth_failure() -> Column:
    return (F.col("category") == "authentication") & (F.col("outcome") == "failure")


def auth_success() -> Column:
    return (F.col("category") == "authentication") & (F.col("outcome") == "success")


def action_in(*names: str) -> Column:
    return F.col("action").isin(*names)


def admin_policy() -> Column:
    arn = F.lower(F.coalesce(F.col("policy_arn"), F.lit("")))
    return arn.rlike("|".join(ADMIN_POLICY_MARKERS))


def known_actor() -> Column:
    """Case-folded actor name, NULL when there is none."""
    return F.when(F.col("actor_name") != "", casefold(F.col("actor_name")))
