"""skywatch: cloud-account log and posture analytics as Spark DataFrame jobs.

Sub-packages:
  sources/    readers for access logs, audit trails, reports, inventories; sinks
  functions/  Column-returning scalar helpers (dates, IPs, text)
  operators/  relational building blocks (usage, risk, logins, rules, drift,
              devices, issues, inventory)
  plans/      composed jobs (reports), driver-table shims and the query registry
  streaming/  Structured Streaming versions of the event-driven jobs
"""

from skywatch.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
