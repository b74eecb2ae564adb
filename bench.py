"""Headline timings. Prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentrylake.operators import baselines as B  # noqa: E402
from sentrylake.operators import correlate as C  # noqa: E402
from sentrylake.operators import evaluate as EV  # noqa: E402
from sentrylake.operators import explore as E  # noqa: E402
from sentrylake.operators import features as X  # noqa: E402
from sentrylake.operators import specialists as S  # noqa: E402
from sentrylake.operators import triage as T  # noqa: E402
from sentrylake.plans.investigate import investigate  # noqa: E402
from sentrylake.plans.workspace import workspace  # noqa: E402
from sentrylake.session import build_session, materialize  # noqa: E402


def run(df):
    """Compute every column of every row without keeping the result."""
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    w = workspace(spark, folder)
    # the stored tables a real flow starts from
    ev = w.events = materialize(w.events)
    base = w.baseline
    iocs = materialize(w.iocs)
    jobs = {
        "triage": lambda: run(T.triage(ev, rare_pair_at_most=1)),
        "baselines": lambda: B.store_baseline(B.build_baseline(ev)),
        "auth_specialist": lambda: run(S.auth_specialist(ev, base, iocs)),
        "process_specialist": lambda: run(S.process_specialist(ev, base, iocs)),
        "network_specialist": lambda: run(S.network_specialist(ev, base, iocs)),
        "correlate_incidents": lambda: run(C.correlate_incidents(w.candidates)),
        "graph_alert_clusters": lambda: run(C.graph_alert_clusters(ev)),
        "window_features": lambda: run(X.window_features(w.indicated)),
        "host_window_features": lambda: run(X.host_window_features(ev)),
        "stratified_reservoir": lambda: run(E.stratified_reservoir(ev)),
        "roc_auc": lambda: run(EV.roc_auc(w.triaged, "is_redteam", "risk_score")),
        "incident_attack_match": lambda: run(EV.incident_attack_match(w.labels, w.members, w.bridge)),
        "investigation": lambda: run(investigate(ev, base, iocs).responses),
    }
    # inputs of single steps are tables in a real flow: written before timing
    w.candidates, w.triaged, w.members
    run(ev.limit(1000))
    times = {}
    for name, job in jobs.items():
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "events": ev.count(), "threads": int(cpus),
    }))


if __name__ == "__main__":
    main()
