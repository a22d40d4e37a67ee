"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..operators.graph import components

__all__ = ["Scratch", "components", "words"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, lower: bool = False) -> Column:
    """Array of the maximal runs without ASCII white space ([^\\x20\\x09-\\x0D]+); null gives an empty array."""
    source = "\t\n\x0b\x0c\r" + (UPPER if lower else "")
    flat = F.translate(F.coalesce(text, F.lit("")), source, " " * 5 + (LOWER if lower else ""))
    return F.filter(F.split(flat, " "), lambda w: w != "")
