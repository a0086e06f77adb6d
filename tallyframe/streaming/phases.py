"""The second phase as a stream: packets wait for permission and for answers, whichever comes when.

Two keyed operators, each a stream of its own with its own checkpoint. `clearances` is keyed by export: it holds the
export's packets (ten at most) until a permission says whether answers may be used, and tells every packet of each later change.
`outcomes` is keyed by packet hash: it holds cleared packets and the latest answer of each question set, provider and model.
An answer counts if it was given before the packet's deadline; a timer at the deadline ends the wait with
`retries_exhausted`. A permission that allows nothing ends it with its reason.

What is chosen depends on the times of the events alone, not on the batches they come in: of each asker's latest answer by
the deadline the newest valid one. Outcomes are merged by finding, newest first, so replayed events, repeated files and restarts
give one result. State is bounded: a key is dropped `keep` after its last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyframe.operators.answers import validate_answers
from tallyframe.session import configure
from tallyframe.sources.keyed import KeyedTable

FINDING = ["tenant_id", "export_id", "evidence_id"]
PACKET = "tenant_id string, export_id string, evidence_id string, packet_sha256 string, at timestamp"
PERMISSION = "tenant_id string, export_id string, unavailable_reason string, at timestamp"
CALL = ("tenant_id string, packet_sha256 string, question_set_version string, provider string, model_requested string, "
        "status string, answers string, created_at timestamp")
CLEARED = "tenant_id string, packet_sha256 string, export_id string, evidence_id string, packet_at timestamp, unavailable_reason string, at timestamp"
OUTCOME = "tenant_id string, export_id string, evidence_id string, packet_sha256 string, answers string, answered_at timestamp, unavailable_reason string, decided_at timestamp"
#: Before every time of an event.
LONG_AGO = 0
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


def _text(value: object) -> str | None:
    return None if value is None or value != value else str(value)


def _frame(rows: list[tuple], columns: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


class _Kept(StatefulProcessor):
    """State that goes `keep` after the key's last event."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def last(self, at: int) -> int:
        """When the key goes, given an event at that time (microseconds): every event sets its own timer, the last one counts."""
        before = self.expiry.get()[0] if self.expiry.exists() else LONG_AGO
        expiry = max(before, at // 1000 + self.keep)
        if expiry > before:
            self.expiry.update((expiry,))
            self.handle.registerTimer(expiry)
        return expiry

    def gone(self, fired: int) -> bool:
        return self.expiry.exists() and fired >= self.expiry.get()[0]

    def close(self) -> None:
        pass


class Clearance(_Kept):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")
        self.packets = handle.getMapState("packets", "evidence_id string", "sha string, at long")
        self.permission = handle.getValueState("permission", "reason string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tenant, export = key
        fresh: set[str] = set()
        changed = False
        for part in rows:
            for r in part.itertuples(index=False):
                at = _micros(r.at)
                self.last(at)
                if r.kind == "packet":
                    known = self.packets.getValue((r.evidence_id,)) if self.packets.containsKey((r.evidence_id,)) else None
                    if known is None or (at, r.packet_sha256) > (known[1], known[0]):
                        self.packets.updateValue((r.evidence_id,), (r.packet_sha256, at))
                        fresh.add(r.evidence_id)
                else:
                    now = self.permission.get() if self.permission.exists() else None
                    mine = (at, _text(r.unavailable_reason) or "")
                    if now is None or mine > (now[1], now[0] or ""):
                        self.permission.update((mine[1], at))
                        changed = True
        if not self.permission.exists():
            return
        reason, since = self.permission.get()
        out = []
        for (evidence,), (sha, at) in list(self.packets.iterator()):
            if changed or evidence in fresh:
                out.append((tenant, sha, export, evidence, _time(at), reason or None, _time(max(at, since))))
        yield from _frame(sorted(out, key=lambda r: r[3]), CLEARED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.gone(expiredTimerInfo.getExpiryTimeInMs()):
            self.packets.clear()
            self.permission.clear()
            self.expiry.clear()
        yield from ()


class Outcome(_Kept):
    def __init__(self, keep_ms: int, patience_ms: int) -> None:
        super().__init__(keep_ms)
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")
        self.waiting = handle.getMapState("waiting", "export_id string, evidence_id string", "reason string, at long, deadline long")
        self.told = handle.getMapState("told", "export_id string, evidence_id string", "state string, at long")
        self.latest = handle.getListState("latest", "asked string, valid boolean, answers string, at long")

    def chosen(self, deadline: int) -> tuple[str, int] | None:
        """(answers, time) of the newest valid among each asker's latest answers up to the deadline."""
        by: dict[str, tuple] = {}
        for asked, valid, answers, at in self.latest.get():
            if at <= deadline and (asked not in by or (at, answers) > (by[asked][0], by[asked][2])):
                by[asked] = (at, valid, answers)
        best = max(((at, asked, answers) for asked, (at, valid, answers) in by.items() if valid), default=None)
        return None if best is None else (best[2], best[0])

    def tell(self, tenant: str, sha: str, now_ms: int | None) -> list[tuple]:
        """The outcomes that differ from what was told before. now_ms: the deadline that a timer says is over."""
        out = []
        for (export, evidence), (reason, at, deadline) in list(self.waiting.iterator()):
            answer = None if reason else self.chosen(deadline)
            over = now_ms is not None and now_ms * 1000 >= deadline
            if reason:
                row = (None, None, reason, at)
            elif answer:
                row = (answer[0], answer[1], None, max(at, answer[1]))
            elif over:
                row = (None, None, "retries_exhausted", max(at, deadline))
            else:
                continue
            mark = (f"{row[0]}|{row[2]}", row[3])
            if self.told.containsKey((export, evidence)) and tuple(self.told.getValue((export, evidence))) == mark:
                continue
            self.told.updateValue((export, evidence), mark)
            out.append((tenant, export, evidence, sha, row[0], _time(row[1]), row[2], _time(row[3])))
        return sorted(out, key=lambda r: r[1:3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tenant, sha = key
        known = {tuple(x) for x in self.latest.get()} if self.latest.exists() else set()
        new: set[tuple] = set()
        for part in rows:
            for r in part.itertuples(index=False):
                at = _micros(r.at)
                self.last(at)
                if r.kind == "call":
                    new.add((r.asked, bool(r.valid), r.answers, at))
                    continue
                place = (r.export_id, r.evidence_id)
                mine = (_text(r.unavailable_reason) or "", at, _micros(r.packet_at) + self.patience * 1000)
                before = self.waiting.getValue(place) if self.waiting.containsKey(place) else None
                if before is None or (mine[1], mine[0]) > (before[1], before[0] or ""):
                    self.waiting.updateValue(place, mine)
                    if not mine[0]:
                        self.handle.registerTimer(-(-mine[2] // 1000))  # no earlier than the deadline
        for row in sorted(new - known, key=lambda x: (x[3], x[0], x[2])):
            self.latest.appendValue(row)
        yield from _frame(self.tell(tenant, sha, None), OUTCOME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        yield from _frame(self.tell(*key, fired), OUTCOME)
        if self.gone(fired):
            for state in (self.waiting, self.told, self.latest, self.expiry):
                state.clear()


def _source(spark: SparkSession, path: str, schema: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def clearances(packets: DataFrame, permissions: DataFrame, late: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """CLEARED rows of streams PACKET and PERMISSION. Events later than `late` behind the newest are dropped. Rows without keys or time are left out."""
    both = packets.select("tenant_id", "export_id", F.lit("packet").alias("kind"), "evidence_id", "packet_sha256", F.lit(None).cast("string").alias("unavailable_reason"), "at").unionByName(
        permissions.select("tenant_id", "export_id", F.lit("permission").alias("kind"), F.lit("").alias("evidence_id"), F.lit("").alias("packet_sha256"), "unavailable_reason", "at"))
    fine = F.col("tenant_id").isNotNull() & F.col("export_id").isNotNull() & F.col("evidence_id").isNotNull() & F.col("packet_sha256").isNotNull() & F.col("at").isNotNull()
    return both.where(fine).withWatermark("at", late).groupBy("tenant_id", "export_id").transformWithStateInPandas(
        Clearance(keep_days * 86_400_000), outputStructType=CLEARED, outputMode="Append", timeMode="EventTime")


def outcomes(cleared: DataFrame, calls: DataFrame, question_set: str | None = None, provider: str | None = None, model: str | None = None,
             patience_hours: float = 24, late: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """OUTCOME rows of streams CLEARED and CALL. Answers are judged before they reach the state; failed calls never do."""
    wanted = F.lit(True)
    for column, value in {"question_set_version": question_set, "provider": provider, "model_requested": model}.items():
        wanted = wanted & (F.lit(True) if value is None else F.col(column) == value)
    judged = validate_answers(calls.where((F.col("status") == "succeeded") & F.col("answers").isNotNull() & wanted))
    asked = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("question_set_version", "provider", "model_requested")])
    none = lambda kind: F.lit(None).cast(kind)
    both = cleared.select("tenant_id", "packet_sha256", F.lit("packet").alias("kind"), "export_id", "evidence_id", "unavailable_reason", "packet_at",
                          F.lit("").alias("asked"), F.lit(False).alias("valid"), F.lit("").alias("answers"), "at").unionByName(
        judged.select("tenant_id", "packet_sha256", F.lit("call").alias("kind"), F.lit("").alias("export_id"), F.lit("").alias("evidence_id"), none("string").alias("unavailable_reason"),
                      none("timestamp").alias("packet_at"), asked.alias("asked"), "valid", "answers", F.col("created_at").alias("at")))
    fine = F.col("tenant_id").isNotNull() & F.col("packet_sha256").isNotNull() & F.col("at").isNotNull()
    return both.where(fine).withWatermark("at", late).groupBy("tenant_id", "packet_sha256").transformWithStateInPandas(
        Outcome(keep_days * 86_400_000, int(patience_hours * 3_600_000)), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")


def second_phase(spark: SparkSession, packets: str, permissions: str, calls: str, out: str, checkpoint: str, max_files: int = 1_000, **options) -> None:
    """Process what has arrived in three folders of Parquet files (PACKET, PERMISSION, CALL) and stop; `read_outcomes` has the result."""
    configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    shared = {k: v for k, v in options.items() if k in ("late", "keep_days")}
    cleared = clearances(_source(spark, packets, PACKET, max_files), _source(spark, permissions, PERMISSION, max_files), **shared)
    _run(cleared.writeStream.format("parquet").option("path", f"{out}/cleared").option("checkpointLocation", f"{checkpoint}/cleared"))
    found = outcomes(_source(spark, f"{out}/cleared", CLEARED, max_files), _source(spark, calls, CALL, max_files), **options)

    def merge(rows: DataFrame, batch: int) -> None:
        KeyedTable(rows.sparkSession, f"{out}/outcome").merge(rows, f"outcomes-{batch}", FINDING, ["decided_at", "answers", "unavailable_reason"])

    _run(found.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/outcomes"))


def _run(writer) -> None:
    query: StreamingQuery = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def read_outcomes(spark: SparkSession, out: str) -> DataFrame | None:
    """One row per finding that has an outcome: the answer it may use, or why there is none."""
    return KeyedTable(spark, f"{out}/outcome").read()


def answered_findings(findings: DataFrame, outcome: DataFrame) -> DataFrame:
    """findings (tenant_id, export_id, evidence_id, ...) with `answer` and `unavailable_reason`, ready to be decided: what
    `Analysis.with_answers` gives in a batch. Findings without an outcome still wait."""
    judged = validate_answers(outcome.where("answers IS NOT NULL")).select(*FINDING, "answer")
    told = outcome.select(*FINDING, "unavailable_reason").join(judged, FINDING, "left")
    return findings.join(told, FINDING, "left").withColumn(
        "unavailable_reason", F.when(F.col("answer").isNull(), F.coalesce("unavailable_reason", F.lit("awaiting_unlock"))))
