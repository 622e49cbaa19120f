"""logmill: log corpus preparation and triage as Spark DataFrame operators."""

__version__ = "0.1.0"
