"""Shared intermediates of one data folder.

The same tables the batch flow hands from step to step (triaged events,
candidates, incident members, findings) are written once to shared storage and
reused by every query of the session that needs them.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.operators import baselines as B
from sentrylake.operators import correlate as C
from sentrylake.operators import features as X
from sentrylake.operators import incidents as I
from sentrylake.operators import specialists as S
from sentrylake.operators.lists import build_iocs
from sentrylake.operators.triage import triage
from sentrylake.plans.investigate import investigate
from sentrylake.session import materialize
from sentrylake.sources.driver_tables import canonical_events, red_team_labels, table, threat_rows

TRAIN_END, VALIDATION_END, END = 702000, 707400, 712800
ML_WINDOW = 30

_open = {}


def workspace(spark: SparkSession, folder: str, wide=False) -> "Workspace":
    """The workspace of a folder; of a folder that was rewritten, a new one."""
    events = table(spark, folder, "events")
    state = events.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    version = state.agg(F.max("file_modification_time"), F.sum("file_size"), F.count("*")).first()
    key = (spark.sparkContext.applicationId, folder, wide)
    if key not in _open or _open[key][0] != version:
        _open[key] = version, Workspace(spark, folder, 1 if wide else 120)
    return _open[key][1]


class Workspace:
    def __init__(self, spark, folder, squeeze=120):
        self.spark, self.folder, self.squeeze = spark, folder, squeeze
        self.train_end, self.validation_end = (
            V.STUDY_ORIGIN + (t - V.STUDY_ORIGIN) * 120 // squeeze for t in (TRAIN_END, VALIDATION_END))

    @cached_property
    def events(self) -> DataFrame:
        return canonical_events(self.spark, self.folder, self.squeeze)

    @cached_property
    def stored(self) -> DataFrame:
        """The same events, parsed once, for steps that read them several times."""
        return materialize(self.events)

    @cached_property
    def wide(self) -> DataFrame:
        """The same events in real time, over thirty days."""
        return canonical_events(self.spark, self.folder, squeeze=1)

    @cached_property
    def labels(self) -> DataFrame:
        return red_team_labels(self.events)

    @cached_property
    def iocs(self) -> DataFrame:
        return materialize(build_iocs(threat_rows(self.stored)))

    @cached_property
    def triaged(self) -> DataFrame:
        return materialize(triage(self.stored, rare_pair_at_most=1))

    @cached_property
    def candidates(self) -> DataFrame:
        """All events that triage flags, with their users and both hosts."""
        flagged = self.triaged.filter("is_suspicious = 1")
        rows = S.route_events(flagged).select(
            "event_id", "timestamp", "event_type", "user", "source_user", "destination_user",
            "source_host", "destination_host", "process", "action", "details", "agent",
            F.col("risk_score").cast("bigint").alias("risk_score"),
            F.col("triggered_rules").alias("rules"), F.col("triage_reasons").alias("evidence"),
        )
        return materialize(rows)

    @cached_property
    def components(self) -> DataFrame:
        return materialize(C.correlate_incidents(self.candidates))

    @cached_property
    def members(self) -> DataFrame:
        return materialize(C.incident_members(self.candidates, self.components))

    @cached_property
    def bridge(self) -> DataFrame:
        return C.incident_entities(self.members)

    @cached_property
    def incidents(self) -> DataFrame:
        return C.build_incidents(self.members)

    @cached_property
    def scored(self) -> DataFrame:
        rows = I.incident_confidence(I.incident_risk(self.incidents))
        return materialize(I.incident_confidence_v1(I.incident_risk_v1(rows)))

    @cached_property
    def heads(self) -> DataFrame:
        return I.entity_heads(self.bridge)

    @cached_property
    def baseline(self) -> B.Baseline:
        """Profiles learned before the training cutoff, applied to later rows too."""
        return B.store_baseline(B.build_baseline(B.baseline_cutoff(self.stored, self.train_end)))

    @cached_property
    def findings(self) -> DataFrame:
        return materialize(S.all_findings(self.stored, self.baseline, self.iocs))

    @cached_property
    def full(self):
        """The whole chain on specialist findings, with real users and both hosts."""
        return investigate(self.stored, self.baseline, self.iocs)

    @cached_property
    def rare(self) -> DataFrame:
        return materialize(B.rare_process_set(self.stored, self.train_end))

    @cached_property
    def indicated(self) -> DataFrame:
        return X.event_indicators(self.stored, self.rare)

    @cached_property
    def windows(self) -> DataFrame:
        """Five-minute windows with features, label and split."""
        return materialize(X.window_features(self.indicated, split=self.split_of(V.WINDOW_SECONDS)))

    @cached_property
    def ml_windows(self) -> DataFrame:
        """Half-minute windows with the rarer label, for models."""
        indicated = self.indicated.withColumn("is_redteam", F.col("is_extreme"))
        return materialize(X.window_features(indicated, size=ML_WINDOW, split=self.split_of(ML_WINDOW)))

    def split_of(self, size):
        start = F.col("window_id") * size + V.STUDY_ORIGIN
        return F.when(start < self.train_end, "train").when(start < self.validation_end, "validation").otherwise("test")

    def ml_split(self, name) -> DataFrame:
        return self.ml_windows.filter(F.col("split") == name)
