"""Column functions: text, redaction, severity, fingerprints, JSON records, batching."""
