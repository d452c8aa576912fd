"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEB = r"(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::\d*)?(?:[/?#]|$)"


def web_host(url: Column) -> Column:
    """Host in lower case of an http or https URL; null for anything else."""
    host = F.lower(F.regexp_extract(url, _WEB, 1))
    return F.when(host == "", None).otherwise(host)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")
