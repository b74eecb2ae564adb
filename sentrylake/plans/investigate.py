"""The end-to-end investigation: events to ranked incidents with responses."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sentrylake.functions import fixed_values as V
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import incidents as I
from sentrylake.operators import specialists as S
from sentrylake.session import materialize


@dataclass
class Investigation:
    findings: DataFrame
    members: DataFrame
    incidents: DataFrame
    responses: DataFrame


def investigate(events, baseline=None, threats=None, safe=None, gap=V.CORRELATION_GAP,
                enabled=("auth", "process", "network")) -> Investigation:
    """Profile, detect, correlate, score and respond.

    `baseline` defaults to profiles of the events themselves; pass one built
    before a cutoff so that rules for new pairs, hosts and processes can fire.
    """
    base = baseline or B.store_baseline(B.build_baseline(events))
    findings = materialize(S.all_findings(events, base, threats, safe, enabled))
    candidates = C.collect_candidates(findings)
    members = materialize(C.incident_members(candidates, C.correlate_incidents(candidates, gap)))
    incidents = materialize(C.build_incidents(members))
    scored = I.uncertainty_notes(I.incident_confidence(I.incident_risk(incidents)))
    heads = I.entity_heads(C.incident_entities(members))
    explained = I.incident_narrative(scored, heads).drop("first_users", "first_hosts")
    return Investigation(findings, members, incidents, I.response_priority(explained, heads))
