"""Numeric expressions: weighted yield and safe text-to-number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def yield_pct(out_qty: Column, in_qty: Column) -> Column:
    """Weighted yield in percent with two decimals; null when there was no input.

    Callers pass integer totals, so the quotient does not depend on the order
    in which partitions were added up.
    """
    return F.when(
        in_qty != 0, F.round(out_qty.cast("double") * F.lit(100.0) / in_qty.cast("double"), 2)
    )


def number_or_null(text: Column) -> Column:
    """Parse measurement text to double; text that is not a number is null.

    The cast alone would also take '1.5d', '2f' and hexadecimal floats.
    """
    clean = F.lower(F.trim(text))
    suffixed = F.right(clean, F.lit(1)).isin("d", "f") & ~F.endswith(clean, F.lit("inf"))
    return F.when(~(suffixed | F.contains(clean, F.lit("x"))), clean.try_cast("double"))


def yield_text_to_number(text: Column) -> Column:
    """'96.2%' -> 96.2, null when the rest is not a number."""
    return number_or_null(F.replace(text, F.lit("%"), F.lit("")))
