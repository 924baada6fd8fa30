"""The shipped rules, in registration order."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhound.functions.predicates import (
    action_in, admin_policy, auth_failure, auth_success, known_actor,
)
from trailhound.operators.rules import (
    HOUR, MINUTE, DistinctThresholdRule, Rule, SequenceRule, SingleEventRule, ThresholdRule,
)
from trailhound.schema import SEVERITIES

# Thresholds, windows, severities, technique ids and titles.
BURST_SIZE = 5
BURST_WINDOW = 10 * MINUTE
ENUMERATED_NAMES = 3
KEY_WINDOW = HOUR

BRUTE_FORCE = ThresholdRule(
    rule_id="brute_force_auth",
    title="Repeated authentication failures",
    severity=SEVERITIES["HIGH"],
    technique="T1110",
    subscribes_to=("authentication",),
    window_us=BURST_WINDOW,
    threshold=BURST_SIZE,
    matches=auth_failure,
)
BRUTE_FORCE_SUCCESS = SequenceRule(
    rule_id="brute_force_success",
    title="Successful authentication after repeated failures",
    severity=SEVERITIES["CRITICAL"],
    technique="T1110",
    subscribes_to=("authentication",),
    window_us=BURST_WINDOW,
    min_leading=BURST_SIZE,
    leading=auth_failure,
    trailing=auth_success,
)
INVALID_USERS = DistinctThresholdRule(
    rule_id="invalid_user_enumeration",
    title="Authentication attempts against non-existent accounts",
    severity=SEVERITIES["MEDIUM"],
    technique="T1087",
    subscribes_to=("authentication",),
    window_us=BURST_WINDOW,
    threshold=ENUMERATED_NAMES,
    matches=lambda: auth_failure() & F.coalesce(F.col("invalid_user"), F.lit(False)),
    key=known_actor,
)
ACCESS_KEY = SequenceRule(
    rule_id="access_key_after_suspicious_auth",
    title="Access key created after suspicious authentication",
    severity=SEVERITIES["HIGH"],
    technique="T1098",
    subscribes_to=("authentication", "iam"),
    window_us=KEY_WINDOW,
    min_leading=1,
    leading=auth_failure,
    trailing=lambda: action_in("access_key_create"),
)
LOGGING_DISABLED = SingleEventRule(
    rule_id="cloud_logging_disabled",
    title="Cloud audit logging disabled",
    severity=SEVERITIES["HIGH"],
    technique="T1685.002",
    subscribes_to=("configuration",),
    matches=lambda: action_in("logging_stop"),
    extra_metadata={
        "outcome": lambda: F.col("outcome"),
        "target": lambda: F.col("target_resource"),
    },
)
ADMIN_POLICY = SingleEventRule(
    rule_id="admin_policy_attached",
    title="Administrator policy attached to principal",
    severity=SEVERITIES["HIGH"],
    technique="T1098",
    subscribes_to=("iam",),
    matches=lambda: action_in("policy_attach", "policy_put") & admin_policy(),
    extra_metadata={"policy_arn": lambda: F.col("policy_arn")},
)

DEFAULT_RULES: tuple[Rule, ...] = (
    BRUTE_FORCE, BRUTE_FORCE_SUCCESS, INVALID_USERS, ACCESS_KEY, LOGGING_DISABLED, ADMIN_POLICY,
)
