"""All registered queries."""

from sentrylake.plans import (  # noqa: F401
    queries_events,
    queries_incidents,
    queries_rules,
    queries_streams,
    queries_windows,
)
from sentrylake.plans.registry import ORACLES, QUERIES, tidy
from sentrylake.plans.workspace import workspace

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, folder):
    w = workspace(spark, folder)
    return tidy(w.full.responses.select(
        "incident_id", "time_start", "time_end", "event_count", "n_users", "n_hosts", "risk_score",
        "confidence_score", "severity", "priority", "recommended_action", "explanation",
    ))
