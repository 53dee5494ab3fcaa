"""What several operators of this folder share: written tables, words, text normalisation."""

from __future__ import annotations

import re
import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between blanks, tabs and line ends only.
WORD = re.compile("[^\x20\x09-\x0d]+")


def by_value(module: str) -> None:
    """Functions of this module travel to the executors by value; they need no installed copy."""
    register_pickle_by_value(sys.modules[module])


by_value(__name__)

__all__ = ["WORD", "ascii_lower", "by_value", "lowered", "stored", "text_or_empty"]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def lowered(text: str) -> str:
    """``ascii_lower`` for one Python string; lengths in characters stay equal."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
