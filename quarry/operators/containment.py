"""Which texts hold which needles: an exact containment join over an inverted index of q-grams.

Of a needle's q-grams the one that the fewest texts hold is its key, so a pair of text and needle meets only where that gram stands in the text; then the whole needle is sought.
Only grams that needles have leave the texts. Needles shorter than q are keys themselves, by grams of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import first_by
from quarry.shared import written

#: Grams of needles that are broadcast to the texts at most; more meet them by a shuffle.
SENT = 1_000_000


def _grams(text: Column, q: int) -> Column:
    """All runs of q characters, by one pass of overlapping matches."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def containing(texts: DataFrame, ident: str, text: str, needles: DataFrame, needle: str, on: list[str] | None = None, q: int = 5) -> DataFrame:
    """(on, ident, needle): texts that hold a needle, among texts and needles of equal ``on`` columns if any are named; each pair once. Null and empty needles and null
    texts match nothing. Case counts; lower both sides before, if it should not."""
    on = on or []
    sought = needles.where(F.length(needle) > 0).select(*on, F.col(needle).alias("needle")).distinct()
    held = texts.where(F.col(text).isNotNull()).select(*on, F.col(ident).alias("ident"), F.col(text).alias("text"))
    size = F.least(F.length("needle"), F.lit(q))
    sizes = sorted(r[0] for r in sought.select(size).distinct().collect())  # q values at most
    if not sizes:
        return texts.limit(0).select(*on, F.col(ident), F.lit("").alias("needle"))
    parts = None
    for n in sizes:
        grams = sought.where(size == n).select(*on, "needle", F.explode(_grams(F.col("needle"), n)).alias("gram"))
        every = grams.select(*on, "gram").distinct()
        some = F.broadcast(every) if every.limit(SENT + 1).count() <= SENT else every
        spread = written(held.where(F.length("text") >= n).select(*on, "ident", F.explode(_grams(F.col("text"), n)).alias("gram")).join(some, [*on, "gram"], "left_semi"))
        often = spread.groupBy(*on, "gram").agg(F.count("*").alias("texts"))
        key = first_by(grams.join(often, [*on, "gram"]), [*on, "needle"], [F.col("texts"), F.col("gram")]).select(*on, "needle", "gram")
        # A needle one of whose grams no text holds is in none; the others are sought where their rarest gram is.
        lacking = grams.join(often, [*on, "gram"], "left_anti").select(*on, "needle").distinct()
        key = key.join(lacking, [*on, "needle"], "left_anti")
        met = spread.join(key, [*on, "gram"]).select(*on, "ident", "needle")
        parts = met if parts is None else parts.union(met)
    found = parts.join(held, [*on, "ident"]).where(F.contains("text", F.col("needle")))
    return found.select(*on, F.col("ident").alias(ident), "needle").distinct()
