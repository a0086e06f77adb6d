"""Every operator as a query over whole tables, with text, integer and double columns at its edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import cells, labels
from tallyframe.functions.numeric import plain
from tallyframe.operators import (
    answers, cards, detect, funnel, gate, history, monthly, packets, periods, portfolio, quality, records, reports, summary,
)
from tallyframe.plans import desk, exports_from_star, star
from tallyframe.plans.analyze import Analysis
from tallyframe.plans.ingest import ParsedExports
from tallyframe.schema import KEYS, PACKET_V2
from tallyframe.session import cut, dealt
from tallyframe.sources import landing, ranges
from tallyframe.sources.exports import parse_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_shared: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def forget() -> None:
    """Drop derived tables shared between queries of one session (a timing run starts from nothing)."""
    _shared.clear()


def _once(spark: SparkSession, key: tuple, build: Callable[[], object]) -> object:
    full = (spark.sparkContext.applicationId, *key)
    if full not in _shared:
        _shared[full] = build()
    return _shared[full]


def analysis(spark: SparkSession, sf: str, variant: str = "tagged") -> Analysis:
    def build() -> Analysis:
        # Read several times, by dates, by months and behind findings: the joins run once, for all variants.
        rows = star.varied(_once(spark, ("records", sf), lambda: cut(star.records(spark, sf))), variant)
        coverage = cut(periods.month_coverage(periods.day_totals(rows), star.TODAY))
        return Analysis(rows, star.profile_of(coverage), star.TODAY, coverage=coverage)
    return _once(spark, ("analysis", sf, variant), build)


def daily_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, ("daily", sf), lambda: cut(
        periods.month_coverage(periods.day_totals(star.records(spark, sf, grain="day")), star.TODAY)))


def parsed(spark: SparkSession, sf: str, kind: str) -> ParsedExports:
    build = {"long": exports_from_star.long_files, "wide": exports_from_star.wide_files}[kind]
    return _once(spark, ("parsed", kind, sf), lambda: ParsedExports(build(spark, sf)))


def d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def i(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def t(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


TENANT = "tenant_id"


# ---- months and series ---------------------------------------------------------------------------------
@query
def monthly_total(spark, sf):
    return monthly.monthly_total(analysis(spark, sf, "untagged").coverage).select(
        TENANT, t("month").alias("month"), d("total").alias("total"), d("unallocated_total").alias("unallocated_total"))


@query
def monthly_series(spark, sf):
    return monthly.monthly_series(star.records(spark, sf)).select(
        TENANT, "dimension", "label", t("month").alias("month"), d("cost").alias("cost"))


@query
def unallocated_keys(spark, sf):
    return monthly.unallocated_keys(analysis(spark, sf, "untagged").series).select(TENANT, "dimension", "label")


@query
def month_coverage(spark, sf):
    return daily_coverage(spark, sf).select(
        TENANT, t("month").alias("month"), "granularity", i("complete").alias("complete"),
        F.coalesce("reason", F.lit("-")).alias("reason"), i("days").alias("days"), d("total").alias("total"))


@query
def event_coverage(spark, sf):
    rows = star.event_records(spark, sf)
    return periods.month_coverage(periods.day_totals(rows), star.TODAY.replace(year=2024)).select(
        t("month").alias("month"), "granularity", i("complete").alias("complete"),
        F.coalesce("reason", F.lit("-")).alias("reason"), i("records").alias("records"), d("total").alias("total"))


@query
def comparison_pair(spark, sf):
    return periods.comparison_pair(daily_coverage(spark, sf)).select(
        TENANT, t("baseline_month").alias("baseline_month"), t("current_month").alias("current_month"),
        d("baseline_total").alias("baseline_total"), d("current_total").alias("current_total"))


@query
def period_issues(spark, sf):
    return periods.period_issues(daily_coverage(spark, sf)).select(TENANT, "code", "severity", i("count").alias("count"))


@query
def covered_period(spark, sf):
    return periods.covered_period(analysis(spark, sf).coverage).select(
        TENANT, "granularity", t("period_start").alias("period_start"), t("period_end").alias("period_end"))


@query
def covered_spend(spark, sf):
    return monthly.covered_spend(analysis(spark, sf).focus).select(TENANT, d("covered_monthly_spend").alias("covered_monthly_spend"))


@query
def top_items(spark, sf):
    return analysis(spark, sf).top_items.select(TENANT, i("rank").alias("rank"), "label", d("cost").alias("cost"), d("share").alias("share"))


@query
def finding_history(spark, sf):
    months = F.array_join(F.transform("history", lambda h: F.concat_ws("=", F.date_format(h["month"], "yyyy-MM"), plain(h["cost"]))), ";")
    return analysis(spark, sf).history.select("evidence_id", months.alias("history"))


@query
def source_refs(spark, sf):
    return analysis(spark, sf).refs.select(
        "evidence_id", F.array_join(F.transform("refs", monthly.ref_text), ",").alias("refs"))


@query
def unallocated_refs(spark, sf):
    return analysis(spark, sf, "untagged").refs.select(
        "evidence_id", F.array_join(F.transform("refs", monthly.ref_text), ",").alias("refs"))


@query
def export_totals(spark, sf):
    return star.profile(star.records(spark, sf)).select(
        TENANT, i("lines_seen").alias("lines_seen"), i("records").alias("records"), d("total_cost").alias("total_cost"))


# ---- detection -----------------------------------------------------------------------------------------
@query
def thresholds(spark, sf):
    return analysis(spark, sf).thresholds.select(
        TENANT, *[d(c).alias(c) for c in ("covered_monthly_spend", "material_absolute", "relative_min_delta", "new_service_min")])


@query
def changes(spark, sf):
    return detect.changes(analysis(spark, sf).moves).select(
        TENANT, "dimension", "label", *[d(c).alias(c) for c in ("baseline", "current", "delta", "delta_pct")])


@query
def largest_changes(spark, sf):
    return analysis(spark, sf).largest_changes.select(TENANT, "dimension", i("rank").alias("rank"), "label", d("delta").alias("delta"))


def _finding_edge(df: DataFrame) -> DataFrame:
    return df.select(
        TENANT, "evidence_id", "finding_key", "kind", "dimension", "label", i("rank").alias("rank"), t("current_month").alias("current_month"),
        *[d(c).alias(c) for c in ("current", "baseline", "delta", "delta_pct", "share_of_current")],
        i("material_absolute").alias("material_absolute"), i("material_relative").alias("material_relative"), "severity", "default_category")


@query
def ranked_findings(spark, sf):
    return _finding_edge(analysis(spark, sf).ranked)


@query
def new_services(spark, sf):
    return _finding_edge(analysis(spark, sf, "launch").ranked)


@query
def unallocated_finding(spark, sf):
    return _finding_edge(analysis(spark, sf, "untagged").ranked)


@query
def unallocated_share(spark, sf):
    return analysis(spark, sf, "untagged").unallocated.select(
        TENANT, "dimension", d("current").alias("current"), d("baseline").alias("baseline"), d("share").alias("share"))


@query
def components(spark, sf):
    text = F.array_join(F.transform("components", lambda c: F.concat_ws(
        "|", c["dimension"], c["label"], plain(c["delta"], 4), t(c["share"]))), ";")
    return analysis(spark, sf).findings.select("evidence_id", text.alias("components"))


@query
def usage_split(spark, sf):
    s = F.col("usage_split")
    return analysis(spark, sf).findings.select(
        "evidence_id", d(s["volume_effect"]).alias("volume_effect"), d(s["rate_effect"]).alias("rate_effect"), s["dominant"].alias("dominant"))


@query
def missing_evidence(spark, sf):
    return analysis(spark, sf).findings.select(
        "evidence_id", F.array_join("missing_evidence", ",").alias("missing_evidence"),
        F.coalesce(cards.owner_from_tags(F.col("components")), F.lit("-")).alias("owner"))


# ---- scoring, packets, decisions -----------------------------------------------------------------------
@query
def readiness(spark, sf):
    from tallyframe.operators.readiness import COMPONENTS
    return analysis(spark, sf, "untagged").readiness.select(TENANT, *[i(c).alias(c) for c in COMPONENTS], i("score").alias("score"))


@query
def safe_labels(spark, sf):
    return analysis(spark, sf).safe_labels().select(
        "evidence_id", i("position").alias("position"), "dimension", "label", "safe_label", i("withheld").alias("withheld"))


@query
def document_labels(spark, sf):
    """Masking and withholding over whole free texts."""
    text = labels.masked(F.col("text"))
    return star.table(spark, sf, "documents").select(
        "doc_id", F.sha2(text, 256).alias("masked_sha"), i(labels.must_withhold(text)).alias("withheld"),
        labels.environment_class(F.col("text")).alias("environment"))


@query
def evidence_packets(spark, sf):
    return analysis(spark, sf).packets().select("evidence_id", i("rank").alias("rank"), "packet_version", "packet", "packet_sha256")


@query
def evidence_packets_v2(spark, sf):
    packed = analysis(spark, sf).packets(PACKET_V2)
    at = lambda path: F.coalesce(F.get_json_object("packet", path), F.lit("-"))
    return packed.select(
        "evidence_id", "packet_version", at("$.finding.peer_context.share_of_bill_increase").alias("share_of_bill_increase"),
        at("$.finding.peer_context.findings_this_month").alias("findings_this_month"),
        at("$.finding.peer_context.other_material_movements").alias("other_material"),
        at("$.finding.environment.class").alias("environment"), at("$.finding.charge_type").alias("charge_type"),
        at("$.finding.usage.mostly").alias("mostly"), at("$.finding.composition[0].value").alias("first_part"),
        i(F.col("packet_sha256") == F.sha2("packet", 256)).alias("hash_ok"))


@query
def run_hash(spark, sf):
    return packets.run_hash(analysis(spark, sf).packets()).select(TENANT, "packets_sha256")


def _answered(spark, sf) -> DataFrame:
    """Findings with the rule-based stand-in as their answer; one region's exports lack permission."""
    a = analysis(spark, sf)

    def build() -> DataFrame:
        label = a.safe_labels().where(F.col("position") == 0).select(*KEYS, "evidence_id", "safe_label")
        found = answers.rule_answers(a.findings.join(label, [*KEYS, "evidence_id"]))
        basis = F.when(F.col("tenant_id") == "ASIA", "pending").when(F.col("tenant_id") == "EUROPE", "declined").otherwise("granted")
        reason = answers.answer_availability(basis, F.lit(True), F.lit(True))
        return found.withColumn("unavailable_reason", reason).withColumn("answer", F.when(reason.isNull(), F.col("answer")))
    return _once(spark, ("answered", sf), lambda: a._cut(a.decide(build())))


@query
def rule_answers(spark, sf):
    x = F.col("answer")
    return _answered(spark, sf).select(
        "evidence_id", F.coalesce("unavailable_reason", F.lit("-")).alias("unavailable_reason"),
        *[F.coalesce(x[c], F.lit("-")).alias(c) for c in ("category", "owner", "urgency", "risk", "primary_missing")],
        d(x["owner_confidence"]).alias("owner_confidence"), d(x["change_material"]).alias("change_material"))


@query
def gate_decisions(spark, sf):
    return _answered(spark, sf).select(
        "evidence_id", "final_category", "model_status", "policy_status", F.array_join("policy_reasons", ",").alias("policy_reasons"),
        i("review_required").alias("review_required"), F.array_join("missing", ",").alias("missing"),
        F.array_join(labels.notable_reasons(F.col("policy_reasons"), F.col("answer.category_confidence")), ",").alias("notable"))


@query
def run_model_status(spark, sf):
    return gate.run_model_status(_answered(spark, sf)).select(TENANT, "model_status")


@query
def finding_cards(spark, sf):
    facts = F.array_join(F.transform("what_we_know", lambda s: s["text"]), " ")
    return _answered(spark, sf).select("evidence_id", "title", "what_changed", "next_action", facts.alias("facts"))


@query
def run_summary(spark, sf):
    s = F.col("summary")
    return analysis(spark, sf).summary.select(
        TENANT, s["investigation_impact"].alias("investigation_impact"), s["period"]["start"].alias("period_start"),
        s["period"]["end"].alias("period_end"), s["total"].alias("total"), s["comparison"]["delta"].alias("delta"),
        s["comparison"]["delta_pct"].alias("delta_pct"), i(F.size(s["months"])).alias("months"),
        F.array_join(F.transform(s["top_items"], lambda x: F.concat_ws("=", x["label"], x["share"])), ";").alias("top_items"),
        F.array_join(F.transform(s["data_gaps"], lambda x: x["code"]), ",").alias("data_gaps"), i(s["readiness"]["score"]).alias("score"))


@query
def run_completion(spark, sf):
    return summary.run_status(analysis(spark, sf).focus).select(TENANT, "status", F.coalesce("issue.code", F.lit("-")).alias("issue"))


@query
def teasers(spark, sf):
    a = analysis(spark, sf)
    counts = a.ranked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("finding_count"))
    return portfolio.teasers(a.summary, counts).select(
        TENANT, "total_covered", "baseline_month", "current_month", "change", "top_driver", "top_driver_change",
        "investigation_impact", i("finding_count").alias("finding_count"))


# ---- stored answers ------------------------------------------------------------------------------------
@query
def validate_answers(spark, sf):
    checked = answers.validate_answers(desk.model_calls(spark, sf))
    return checked.select(
        "run_id", i("created_at").alias("created_at"), i("valid").alias("valid"), F.coalesce("invalid_question", F.lit("-")).alias("invalid_question"),
        F.coalesce("answer.category", F.lit("-")).alias("category"), F.coalesce("answer.urgency", F.lit("-")).alias("urgency"))


@query
def latest_answers(spark, sf):
    return answers.latest_answers(desk.model_calls(spark, sf)).select(
        TENANT, "packet_sha256", i("created_at").alias("created_at"),
        F.get_json_object("answers", "$.decision_category.choice").alias("category"))


@query
def replay(spark, sf):
    calls = desk.model_calls(spark, sf)
    packed = calls.groupBy("tenant_id", "run_id", "packet_sha256").agg(F.max("created_at").alias("evidence_id")).select(
        "*", F.lit("INVESTIGATE").alias("stored_category"), F.lit(0.5).alias("stored_confidence"))
    return reports.replay(packed, calls).select(
        "run_id", i("evidence_id").alias("evidence_id"), F.coalesce("replay_category", F.lit("-")).alias("replay_category"),
        F.split("note", ":")[0].alias("note"), i("changed").alias("changed"))


def _decisions(spark, sf) -> DataFrame:
    """Each stored answer against a rule category taken from its status."""
    checked = answers.validate_answers(desk.model_calls(spark, sf))
    rule = F.when(F.col("status") == "succeeded", "INVESTIGATE").otherwise("MONITOR")
    found = gate.decide(rule, F.lit(True), F.col("answer"), F.lit("malformed_response"), F.lit(80))
    return checked.select("answer", "status", rule.alias("rule_category"), F.col("answer.category").alias("model_category"),
                          F.col("answer.category_confidence").alias("confidence"), found.alias("_d")).select("*", "_d.*").drop("_d")


@query
def agreement(spark, sf):
    r = reports.agreement(_decisions(spark, sf))
    return r.select(*[i(c).alias(c) for c in ("findings", "agreed", "differed", "overridden", "review", "agreed_pct")],
                    *[F.round(c, 6).alias(c) for c in ("confidence_min", "confidence_median", "confidence_max")])


@query
def confusion(spark, sf):
    return reports.confusion(_decisions(spark, sf)).select("rule_category", "model_category", i("findings").alias("findings"))


@query
def reason_counts(spark, sf):
    return reports.reason_counts(_decisions(spark, sf)).select("reason", i("n").alias("n"))


@query
def variant_report(spark, sf):
    answered = _decisions(spark, sf).select(F.col("status").alias("variant"), F.lit("service").alias("dimension"), "rule_category", "answer")
    r = reports.variant_report(answered)
    return r.select("variant", *[i(c).alias(c) for c in ("findings", "categories_used", "sufficiency_distinct", "needs_review", "agreed", "bars_cleared")],
                    *[d(c).alias(c) for c in ("median_confidence", "median_owner_confidence")])


# ---- history and portfolio -----------------------------------------------------------------------------
def _previous(spark, sf) -> DataFrame:
    return history.previous_run(desk.runs(spark, sf), portfolio.owners(desk.leads(spark, sf)))


@query
def previous_run(spark, sf):
    return _previous(spark, sf).select("owner", "run_id", F.coalesce(t("month"), F.lit("-")).alias("month"), "previous_run_id",
                                       t("previous_month").alias("previous_month"))


@query
def carry_over(spark, sf):
    return history.carry_over(_previous(spark, sf), desk.findings(spark, sf)).select(
        "run_id", "previous_run_id", "finding_key", "title", "previous_category", d("previous_current").alias("previous_current"),
        d("current_current").alias("current_current"), "outcome")


@query
def new_subjects(spark, sf):
    return history.new_subjects(_previous(spark, sf), desk.findings(spark, sf)).select("run_id", "previous_run_id", i("new_count").alias("new_count"))


@query
def tenants_for(spark, sf):
    people = desk.leads(spark, sf)
    wanted = people.where(F.col("status") == "pilot_requested").select(F.upper("email").alias("email"))
    return portfolio.tenants_for(people, wanted).select("owner", TENANT)


@query
def run_status(spark, sf):
    return portfolio.run_status(desk.runs(spark, sf), desk.findings(spark, sf)).select(
        "run_id", "status", i("rows_rejected").alias("rows_rejected"), i("warning_count").alias("warning_count"),
        i("completed").alias("completed"), i("unlocked").alias("unlocked"), F.coalesce("message", F.lit("-")).alias("message"),
        i("finding_count").alias("finding_count"))


@query
def run_list(spark, sf):
    tenants = portfolio.tenants_for(desk.leads(spark, sf), desk.leads(spark, sf))
    return portfolio.run_list(portfolio.scoped(desk.runs(spark, sf), tenants), desk.files(spark, sf)).select(
        TENANT, "run_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), "filename")


@query
def run_detail(spark, sf):
    return portfolio.run_detail(desk.runs(spark, sf), desk.files(spark, sf), desk.findings(spark, sf)).select(
        "run_id", "run_status", "filename", i("rank").alias("rank"), "title", d("observed_value").alias("observed_value"))


@query
def lead_portfolio(spark, sf):
    return portfolio.lead_portfolio(desk.leads(spark, sf), desk.files(spark, sf), desk.runs(spark, sf), desk.pilots(spark, sf)).select(
        i("lead_id").alias("lead_id"), "lead_status", i("uploads").alias("uploads"), F.coalesce("latest_run_id", F.lit("-")).alias("latest_run_id"),
        F.coalesce("latest_run_status", F.lit("-")).alias("latest_run_status"), i("pilot_requests").alias("pilot_requests"),
        i("manual_review").alias("manual_review"))


@query
def lead_rollup(spark, sf):
    rolled = portfolio.lead_rollup(desk.leads(spark, sf), desk.files(spark, sf), desk.runs(spark, sf), desk.findings(spark, sf),
                                   desk.consents(spark, sf), desk.PROVIDER)
    return rolled.select(i("lead_id").alias("lead_id"), "filename", i("consent").alias("consent"), "run_id", "run_status",
                         i("findings").alias("findings"), i("review_required").alias("review_required"))


@query
def retention_due(spark, sf):
    now = F.lit("1999-01-01").cast("date")
    return portfolio.retention_due(desk.files(spark, sf), now).select(
        i("file_id").alias("file_id"), F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), i("claimed").alias("claimed"))


@query
def erase(spark, sf):
    files = desk.files(spark, sf)
    gone = files.where(F.col("status") == "rejected")
    kept = portfolio.erase({"source_file": files, "snapshot_run": desk.runs(spark, sf), "snapshot_finding": desk.findings(spark, sf),
                            "model_call": desk.model_calls(spark, sf), "consent": desk.consents(spark, sf)}, gone)
    counted = [df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), i("rows").alias("rows"))
               for name, df in kept.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


# ---- landing files -------------------------------------------------------------------------------------
def _document_files(spark, sf) -> DataFrame:
    return star.table(spark, sf, "documents").select(
        F.col("source").alias("tenant_id"), F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"),
        F.encode("text", "utf-8").alias("content"), F.when(F.col("lang") == "es", "rejected").otherwise("accepted").alias("status"),
        F.col("n_chars").alias("created_at"))


@query
def fingerprints(spark, sf):
    return _document_files(spark, sf).select(i("file_id").alias("file_id"), F.sha2("content", 256).alias("export_id"), i(F.length("content")).alias("bytes"))


@query
def dedupe_uploads(spark, sf):
    return landing.dedupe_uploads(_document_files(spark, sf)).select(TENANT, i("file_id").alias("file_id"), "sha256")


@query
def duplicate_uploads(spark, sf):
    return landing.duplicate_of(_document_files(spark, sf)).select(i("file_id").alias("file_id"), i("duplicate_of").alias("duplicate_of"))


@query
def verify_hash(spark, sf):
    docs = _document_files(spark, sf).select(TENANT, F.sha2("content", 256).alias("export_id"), t("file_id").alias("path"), "content")
    recorded = star.table(spark, sf, "documents").select(
        F.col("source").alias("tenant_id"), t("doc_id").alias("path"),
        # German uploads were recorded with another hash, French ones are past their retention.
        F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"),
        F.when(F.col("lang") == "fr", F.lit("1999-01-01").cast("timestamp_ntz")).alias("raw_deleted_at"))
    ok, issues = landing.verify_hash(docs, recorded)
    return ok.select(i("path").alias("file_id"), F.lit("ok").alias("code")).unionByName(issues.select(i("path").alias("file_id"), "code"))


@query
def screen(spark, sf):
    pages = star.table(spark, sf, "pages").select(F.concat(F.lit("p"), t("page_id")).alias("file"), F.encode("html", "utf-8").alias("content"))
    docs = star.table(spark, sf, "documents").select(F.concat(F.lit("d"), t("doc_id")).alias("file"), F.encode("text", "utf-8").alias("content"))
    # Events as binary uploads: their type picks a signature, a NUL, broken UTF-8, a BOM or nothing at all.
    kind = F.col("event_type")
    head = (F.when(kind == "click", F.unhex(F.lit("504B0304"))).when(kind == "view", F.unhex(F.lit("41002C")))
            .when(kind == "purchase", F.unhex(F.lit("2CC328"))).when(kind == "error", F.unhex(F.lit("EFBBBF612C62"))).otherwise(F.unhex(F.lit(""))))
    events = star.table(spark, sf, "events").select(F.concat(F.lit("e"), t("event_id")).alias("file"), head.alias("content"))
    return landing.screen(pages.unionByName(docs).unionByName(events)).select("file", F.coalesce("reject_code", F.lit("ok")).alias("code"))


@query
def parse_documents(spark, sf):
    """Whole free texts through the parser: delimiter, layout and the reason each is refused."""
    docs = star.table(spark, sf, "documents").select(
        F.lit("docs").alias("tenant_id"), t("doc_id").alias("export_id"), t("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    facts = quality.file_facts(parse_lines(docs))
    return facts.select(i("export_id").alias("doc_id"), F.coalesce("delimiter", F.lit("-")).alias("delimiter"),
                        F.coalesce("layout", F.lit("-")).alias("layout"), F.coalesce("fatal_code", F.lit("-")).alias("fatal_code"))


# ---- cells ---------------------------------------------------------------------------------------------
@query
def money_cells(spark, sf):
    """Balances written in five styles and read back."""
    bal = F.col("c_acctbal").cast("decimal(18,2)")
    text, seg = F.format_number(F.abs(bal), 2), F.col("c_mktsegment")
    plain_text = F.translate(text, ",", "")
    raw = (F.when(seg == "AUTOMOBILE", F.concat(F.when(bal < 0, "-").otherwise(""), F.lit("$"), text))
           .when(seg == "BUILDING", F.concat(F.lit("("), plain_text, F.lit(")")))
           .when(seg == "FURNITURE", F.concat(F.lit("  "), plain_text, F.lit("E3 ")))
           .when(seg == "HOUSEHOLD", F.translate(plain_text, ".", ","))
           .otherwise(F.concat(F.lit("(-"), plain_text, F.lit(")"))))
    cell = cells.money(raw, seg == "HOUSEHOLD")
    return star.table(spark, sf, "customer").select(i("c_custkey").alias("c_custkey"), cell["status"].alias("status"), d(cell["value"]).alias("value"))


@query
def quantity_cells(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    flag = F.col("l_returnflag")
    raw = F.when(flag == "A", F.concat(q, F.lit(",500"))).when(flag == "N", F.concat(F.lit("$"), q)).otherwise(F.concat(q, F.lit("e20")))
    cell = cells.quantity(raw)
    return star.table(spark, sf, "lineitem").select(
        i(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), cell["status"].alias("status"), d(cell["value"]).alias("value"))


@query
def date_cells(spark, sf):
    """Order dates in five forms, read in both slash orders."""
    day, p = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    f = lambda pattern: F.date_format(day, pattern)
    raw = (F.when(p == "1", f("yyyy-MM-dd")).when(p == "2", f("yyyy-MM")).when(p == "3", F.concat(f("yyyy-MM-dd"), F.lit("T00:00:00Z")))
           .when(p == "4", f("M/d/yyyy")).otherwise(F.concat(f("yyyy-MM"), F.lit("-31"))))
    return star.table(spark, sf, "orders").select(
        i("o_orderkey").alias("o_orderkey"), F.coalesce(t(cells.to_day(raw, "mdy")), F.lit("-")).alias("mdy"),
        F.coalesce(t(cells.to_day(raw, "dmy")), F.lit("-")).alias("dmy"))


@query
def slash_order(spark, sf):
    """Date order of each customer's order dates written day first."""
    raw = F.date_format("o_orderdate", "dd/MM/yyyy")
    first, second = cells.slash_first(raw), cells.slash_second(raw)
    grouped = star.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.bool_or(first > 12).alias("f"), F.bool_or(second > 12).alias("s"), F.bool_or(first.isNotNull()).alias("a"))
    order, assumed = cells.slash_order_from(F.col("f"), F.col("s"), F.col("a"))
    return grouped.select(i("o_custkey").alias("o_custkey"), order.alias("slash_order"), i(assumed).alias("assumed"))


@query
def header_cells(spark, sf):
    """Headers built from part attributes: currency marker, bare label and normalised name."""
    mark = F.when(F.col("p_size") < 10, "($)").when(F.col("p_size") < 20, " ( EUR ) ").when(F.col("p_size") < 30, "(usd)").otherwise("")
    name = F.concat(F.initcap("p_name"), F.lit("_"), F.col("p_brand"))
    raw = F.concat(F.replace(name, F.lit(" "), F.lit("")), mark)
    return star.table(spark, sf, "part").select(
        i("p_partkey").alias("p_partkey"), F.coalesce(cells.header_currency(raw), F.lit("-")).alias("currency"),
        cells.header_label(raw).alias("label"), cells.normalized_header(raw).alias("normalized"))


@query
def clean_labels(spark, sf):
    text = F.col("text")
    return star.table(spark, sf, "conversations").select(
        i("conv_id").alias("conv_id"), i("turn").alias("turn"), cells.clean_label(text).alias("label"),
        i(cells.is_unallocated_label(F.concat(F.when(F.col("role") == "user", "No ").otherwise(""), F.col("role")))).alias("unallocated"))


# ---- parsed exports ------------------------------------------------------------------------------------
@query
def parse_long(spark, sf):
    p = parsed(spark, sf, "long").profile
    return p.select("export_id", "delimiter", "layout", "primary_dimension", F.array_join("dimensions_available", ",").alias("dimensions"),
                    "currency", *[i(c).alias(c) for c in ("lines_seen", "lines_accepted", "lines_rejected", "cells_rejected", "duplicate_lines", "records")],
                    d("total_cost").alias("total_cost"))


@query
def long_records(spark, sf):
    r = parsed(spark, sf, "long").records_once
    return r.groupBy("service", "tag", t("month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum("quantity").alias("quantity"),
        F.count_if("unallocated").alias("unallocated")).select(
        "service", "tag", "month", i("n").alias("n"), d("cost").alias("cost"), d("quantity").alias("quantity"), i("unallocated").alias("unallocated"))


@query
def rejections(spark, sf):
    return parsed(spark, sf, "long").rejections.groupBy("export_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("col").alias("col")).select(
        "export_id", "reason", i("n").alias("n"), i("first_line").alias("first_line"), i("col").alias("col"))


@query
def rejection_sample(spark, sf):
    return parsed(spark, sf, "long").rejection_sample.select("export_id", i("line").alias("line"), "reason")


@query
def conflicting_keys(spark, sf):
    """Line items keyed by ship date and part size: neighbours in key order with another price."""
    rows = star.table(spark, sf, "lineitem").join(star.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("x").alias("tenant_id"), F.col("l_returnflag").alias("export_id"), F.col("l_shipdate").cast("date").alias("period_start"),
        F.col("p_type").alias("usage_type"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.lit(None).cast("int").alias("col"),
        F.col("l_quantity").cast("decimal(28,15)").alias("cost"))
    return records.conflicting_keys(rows).select("export_id", i("count").alias("count"))


@query
def quality_issues(spark, sf):
    return parsed(spark, sf, "long").issues.select("export_id", "code", "severity", i("count").alias("count"))


@query
def parse_wide(spark, sf):
    p = parsed(spark, sf, "wide").profile
    return p.select("export_id", "delimiter", "layout", "primary_dimension", "dimension_label", i("had_bom").alias("had_bom"), "currency",
                    *[i(c).alias(c) for c in ("lines_seen", "lines_accepted", "empty_cells", "records")], d("total_cost").alias("total_cost"))


@query
def wide_records(spark, sf):
    return parsed(spark, sf, "wide").records.select(
        "export_id", t("month").alias("month"), F.col("tag").alias("tag"), d("cost").alias("cost"), i("line").alias("line"),
        i("col").alias("col"), i("unallocated").alias("unallocated"))


@query
def reconcile(spark, sf):
    return parsed(spark, sf, "wide").reconciliation.select("export_id", i("count").alias("count"))


@query
def currency_consensus(spark, sf):
    """One export per customer nation, its market segments standing for currencies."""
    rows = star.table(spark, sf, "customer").select(
        F.lit("x").alias("tenant_id"), t("c_nationkey").alias("export_id"), F.lit(None).cast("int").alias("col"),
        F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).alias("currency"))
    facts = rows.select(*KEYS).distinct().select(
        *KEYS, F.lit("long").alias("layout"), F.lit(None).cast("string").alias("fatal_code"), F.lit(None).cast("array<string>").alias("header_currencies"))
    return quality.currency_consensus(rows, facts).select(
        "export_id", F.array_join("currencies", ",").alias("currencies"), F.coalesce("currency", F.lit("-")).alias("currency"))


@query
def ranged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one file a month whose lines lie in ranges of 2,048 orders; quotes open, close, turn round or leave alone what follows."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(",done,"), F.col("o_custkey").cast("string")))
        .when(F.col("o_orderstatus") == "O", F.concat(key, F.lit(',"open')))
        .otherwise(F.concat(F.lit('"'), key, F.lit('"",",'), F.col("o_custkey").cast("string"))),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(',"')).otherwise(""))
    month = F.date_format("o_orderdate", "yyyy-MM")
    lines = star.table(spark, sf, "orders").select(
        F.lit("star").alias("tenant_id"), month.alias("export_id"), month.alias("path"), F.lit(0).cast("bigint").alias("size"),
        F.floor(F.col("o_orderkey") / 2048).alias("block"), F.struct(F.col("o_orderkey").alias("id"), F.lit(0).alias("part")).alias("at"), text.alias("text"), F.lit("\n").alias("ended"))
    found = ranges.records(ranges.with_states(lines, F.lit(",")))
    return found.groupBy(F.col("export_id").alias("month")).agg(
        F.count("*").alias("records"), F.sum("line").alias("ends"), F.sum(F.length("body")).cast("bigint").alias("chars"),
        F.sum(F.col("line") * F.length("body")).alias("weighted"), F.max(F.length("body")).cast("bigint").alias("longest"))


@query
def event_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Users that sign up, then view, click and buy, whatever else they do between."""
    steps = ["signup", "view", "click", "purchase"]
    return funnel.funnel(funnel.slice_states(star.table(spark, sf, "events"), steps), steps)


@query
def fatal_files(spark: SparkSession, sf: str) -> DataFrame:
    """A small export for every customer, unusable in a way that the market segment decides: the reason and what is missing."""
    kinds = {"AUTOMOBILE": "Date,Service\n2026-06-01,EC2\n", "BUILDING": "Date,Cost\n2026-06-01,5\n", "FURNITURE": "Service,Cost\nEC2,5\nS3,6\n",
             "HOUSEHOLD": "Date,Service,Cost\n2026-06-01,EC2,n/a\n", "MACHINERY": "Date,Service,Cost\n"}
    text = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("c_mktsegment"))
    # A file costs far more to judge than a customer to read: customers of a whole table may be one split.
    customers = dealt(star.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    files = customers.select(
        F.lit("star").alias("tenant_id"), t("c_custkey").alias("export_id"), t("c_custkey").alias("path"), F.encode(text, "utf-8").alias("content"))
    return ParsedExports(files).fatal.select(i("export_id").alias("c_custkey"), "code", "severity", "message")


@query
def coverage_end(spark: SparkSession, sf: str) -> DataFrame:
    """How far the rows of a month reach, rows that end before they start left aside, and what that says of the month."""
    ship, reach = F.col("l_shipdate").cast("date"), F.expr("date_add(cast(l_shipdate AS date), cast(cast(l_quantity AS int) div 5 - 20 AS int))")
    rows = star.table(spark, sf, "lineitem").select(
        F.lit("star").alias("tenant_id"), (F.col("l_suppkey") % 50).cast("string").alias("export_id"), F.trunc(ship, "month").alias("period_start"), F.trunc(ship, "month").alias("month"),
        F.lit(1).cast("decimal(28,15)").alias("cost"), F.lit(False).alias("unallocated"), F.when(F.col("l_linenumber") < 6, F.least(reach, F.last_day(ship))).otherwise(F.least(F.date_add(reach, 20), F.last_day(ship))).alias("period_end"),
        (F.col("l_orderkey") % 400 == 0).alias("partial"))
    months = periods.month_coverage(periods.day_totals(rows), star.TODAY)
    return months.select("export_id", F.date_format("month", "yyyy-MM").alias("month"), F.coalesce(F.date_format("reach", "yyyy-MM-dd"), F.lit("-")).alias("reach"),
                         i("partial").alias("partial"), F.coalesce("reason", F.lit("-")).alias("reason"))


@query
def wide_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Wide exports of 2,048 orders, a row an order: rows that repeat the one before them in their month, and months with differing rows."""
    orders = star.table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2048).alias("chunk"), "o_orderkey", F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-01"), F.ascii("o_orderstatus").cast("string")).alias("text"))
    body = orders.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "text"))), lambda r: r["text"]), "\n").alias("body"))
    files = body.select(F.lit("star").alias("tenant_id"), t("chunk").alias("export_id"), t("chunk").alias("path"), F.encode(F.concat(F.lit("Service,EC2($)\n"), "body"), "utf-8").alias("content"))
    rows = ParsedExports(files).rows
    repeats = rows.where("reject_reason = 'duplicate_row'").groupBy("export_id").agg(F.count("*").alias("repeats"), F.min("line").alias("first_line"))
    return repeats.join(records.conflicting_periods(rows).select("export_id", F.col("count").alias("conflicts")), "export_id", "full").select(
        i("export_id").alias("chunk"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("first_line", F.lit(0)).alias("first_line"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
