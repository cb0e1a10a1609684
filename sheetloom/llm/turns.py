"""Turns of conversations as slim rows: what the operators on conversations share.

A turn is told by ``digest``, the MD5 of its role and text; null roles and
texts are read as a given default.  Turns are ordered by number, those without
one first, and equal numbers by digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_digest(role: Column, text: Column) -> Column:
    """Tells a (role, text) from all others."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
