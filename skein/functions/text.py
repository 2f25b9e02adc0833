"""Cleaning and redaction of text columns, as chains of regular expressions in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a log line must not show, and what takes its place.
REDACTIONS = (
    (r"/(home|Users)/[^/\s]+", "/$1/[user]"),
    (r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [redacted]"),
    (r"\b(sk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}", "[redacted]"),
    (r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)\S+", "$1$2[redacted]"),
)


#: Control characters but tab and line feed; the second also has C1 controls and bidi overrides, and leaves carriage returns.
ASCII_CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def sanitize(c: Column, limit: int | None = None, controls: str = CONTROLS) -> Column:
    """Without control characters, angle brackets escaped, whole or at most so many characters."""
    plain = F.regexp_replace(c, controls, "")
    escaped = F.replace(F.replace(plain, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return escaped if limit is None else F.substring(escaped, 1, limit)


def redact(c: Column) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), REDACTIONS, c)
