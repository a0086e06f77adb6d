"""Billing-export analytics as Spark DataFrame jobs, keyed by (tenant_id, export_id)."""
