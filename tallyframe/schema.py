"""Canonical columns, vocabularies and fixed values shared by every operator."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

#: Every table carries these two; every grouping and window starts with them.
KEYS = ["tenant_id", "export_id"]

# ---- fixed values: dimension vocabulary -------------------------------------------------------
DIMENSIONS = [
    "account", "availability_zone", "charge_type", "cost_category", "environment", "instance_type",
    "operation", "other", "region", "service", "tag", "usage_type",
]
#: Dimensions a one-row-per-charge export can carry, in the order that picks the primary one.
LONG_DIMENSIONS = ["service", "account", "region", "usage_type", "tag", "environment", "charge_type"]
#: Priority that names an export's primary dimension among the ones it carries.
PRIMARY_ORDER = [*LONG_DIMENSIONS, "instance_type", "operation", "availability_zone", "cost_category", "other"]
#: Groupings whose catch-all values mean "nobody owns this".
OWNERSHIP_DIMENSIONS = ["tag", "account", "cost_category"]
NAMES_AN_OWNER = ["tag", "cost_category"]
SHOWS_CAPACITY = ["usage_type", "instance_type"]

# ---- fixed values: limits of an accepted export ------------------------------------------------
MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_LINES = 1_000_000
MAX_COLUMNS = 1_000
MAX_FIELD_CHARS = 10_000
MAX_ABS_COST = Decimal("1e12")
MAX_ABS_QUANTITY = Decimal("1e21")
RECONCILE_TOLERANCE = Decimal("0.01")
REJECTION_SAMPLE = 50

# ---- fixed values: materiality and output sizes ------------------------------------------------
MATERIAL_ABS_FLOOR = Decimal("500.00")
MATERIAL_ABS_SHARE = Decimal("0.05")
MATERIAL_RELATIVE = Decimal("0.20")
RELATIVE_MIN_SHARE_OF_ABS = Decimal("0.25")
NEW_SERVICE_SHARE = Decimal("0.05")
UNALLOCATED_SHARE = Decimal("0.10")
ESCALATE_SHARE = Decimal("0.10")
HIGH_SEVERITY_MULTIPLE = 3
COMPONENT_MIN_SHARE = Decimal("0.15")
OWNER_KNOWN_SHARE = Decimal("0.9")
MAX_FINDINGS = 10
MAX_COMPONENTS = 3
MAX_REFS = 20
MAX_MISSING = 3
HISTORY_MONTHS = 6
TOP_ITEMS = 5
LARGEST_CHANGES = 5
READINESS_FLOOR = 50

# ---- fixed values: decision vocabulary ---------------------------------------------------------
CATEGORIES = ["INVESTIGATE", "REQUEST_EVIDENCE", "MONITOR", "ESCALATE"]
OWNER_GROUPS = {
    "platform_infrastructure": "Platform / Infrastructure",
    "ml_ai": "ML / AI",
    "application_engineering": "Application Engineering",
    "data": "Data",
    "security": "Security",
    "finance": "Finance",
    "unknown": "Unknown",
}
MISSING_LABELS = {
    "utilization_metrics": "CloudWatch utilization for the affected resources",
    "owner_confirmation": "confirmation of which team owns this spend",
    "environment_classification": "whether this is production or non-production",
    "allocation_tags": "team or cost-allocation tags",
    "change_context": "the deployment, launch or configuration change behind it",
    "commitment_coverage": "Savings Plans or Reserved Instance coverage",
    "finer_grained_billing": "resource-level billing data (Cost and Usage Report)",
    "none": "nothing further",
}
URGENCY_LEVELS = ["low", "medium", "high", "critical"]
RISK_LEVELS = ["low", "medium", "high"]
QUESTION_KEYS = [
    "decision_category", "owner_group", "urgency", "risk_without_evidence",
    "primary_missing_evidence", "evidence_sufficient", "needs_human_review", "change_material",
]

PARSER_VERSION = "tallyframe-delimited-2"
PACKET_V1 = "ep/1"
PACKET_V2 = "ep/2"

# ---- types -------------------------------------------------------------------------------------
COST = T.DecimalType(28, 15)
QUANTITY = T.DecimalType(38, 15)

COST_RECORD = T.StructType(
    [T.StructField("tenant_id", T.StringType()), T.StructField("export_id", T.StringType()),
     T.StructField("period_start", T.DateType()), T.StructField("month", T.DateType())]
    + [T.StructField(d, T.StringType()) for d in DIMENSIONS]
    + [T.StructField("cost", COST), T.StructField("currency", T.StringType()),
       T.StructField("line", T.LongType()), T.StructField("col", T.IntegerType()),
       T.StructField("unallocated", T.BooleanType()),
       T.StructField("quantity", QUANTITY), T.StructField("unit", T.StringType()),
       T.StructField("period_end", T.DateType()), T.StructField("partial", T.BooleanType())]
)

ISSUE_FIELDS = ["code", "severity", "message", "count", "detail"]
