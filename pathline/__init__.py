"""PySpark jobs for tracking, re-identification, telemetry and text-corpus tables."""
