"""mailglass: mail-triage analytics as Spark DataFrame jobs."""
