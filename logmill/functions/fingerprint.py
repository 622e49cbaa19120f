"""Fingerprints: texts that differ only in digits (and ASCII case) fall together."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logmill.functions.text import ascii_lower, redact_all, trim_space_end


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(ascii_lower(text), "[0-9]+", "#")


def audit_signature(text: Column) -> Column:
    """Audit key: all secrets redacted, lower case, right-trimmed, digit runs as ``#``."""
    return F.regexp_replace(trim_space_end(F.lower(redact_all(text))), "[0-9]+", "#")
