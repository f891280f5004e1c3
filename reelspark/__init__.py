"""Spark jobs over speech-capture recordings: scripts, journals, sample timelines,
telemetry, deliveries and fleet qualification."""
