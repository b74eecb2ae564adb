"""Evidence of all specialists against brute force."""

import __spark_entry__ as entry
from sentrylake.plans.workspace import workspace


def test_evidence_of_all_specialists(spark, folder):
    want = {}
    for f in workspace(spark, folder).findings.select("agent", "timestamp", "event_id", "evidence").collect():
        for text in f.evidence:
            first, times = want.get((f.agent, text), ((f.timestamp, f.event_id), 0))
            want[f.agent, text] = min(first, (f.timestamp, f.event_id)), times + 1
    got = entry.queries()["specialist_evidence_all"](spark, folder).collect()
    assert {(r.agent, r.evidence): (r.first_event_id, r.times) for r in got} == {k: (first[1], n) for k, (first, n) in want.items()}
    assert len(got) == len(want)
    assert len({agent for agent, _ in want}) == 3
