"""Claims: sentences as events or quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DENIAL, DIRECTION, QUANT, collapse, split_sentences


#: Lines of a text, and sentences of a line, that ids tell apart.
LINES, SENTENCES = 1 << 20, 1 << 12


def claim_id(n: Column, line: Column, pos: Column) -> Column:
    """One number for the sentence ``pos`` of line ``line`` of the text ``n``; no two places have the same. A text of more
    lines, a line of more sentences or a text number beyond 2^31 is an error."""
    fits = (line < LINES) & (pos < SENTENCES) & (n < 1 << 31) & (n >= 0)
    return F.when(fits, (n.cast("long") * LINES + line) * SENTENCES + pos).otherwise(F.raise_error(F.lit("a text has too many lines or sentences for claim ids")).cast("long"))


def sentences(rows: DataFrame, text: str = "text") -> DataFrame:
    """Explode text into line, pos and sentence (as split, not collapsed); other columns stay."""
    lines = rows.select("*", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("line", "_line"))
    return lines.select(*rows.columns, "line", F.posexplode(split_sentences(F.btrim("_line", F.lit(" \t\n\r\f\x0b")))).alias("pos", "sentence"))


def extract(rows: DataFrame, least: int = 25) -> DataFrame:
    """The claims of rows (text, entity_ids, published_at and any others): each sentence of ``least`` characters
    or more is a quantity if it states one, else an event, denied or asserted.

    Adds line, pos, claim_type, claim, modality, entity_id, metric, value, unit, as_of, direction; drops text.
    A number with thousands separators is read up to the first one, and the entity keeps the metric's plural.
    """
    s = sentences(rows).withColumn("claim", collapse(F.col("sentence"))).filter(F.length("claim") >= least)
    part = lambda i: F.nullif(F.regexp_extract("claim", QUANT, i), F.lit(""))
    s = s.withColumns({"_metric": F.lower(part(1)), "_value": part(2), "_unit": F.lower(part(3)), "_direction": F.lower(F.nullif(F.regexp_extract("claim", DIRECTION, 1), F.lit("")))})
    quant = F.col("_metric").isNotNull()
    return s.select(
        *[c for c in rows.columns if c != "text"], "line", "pos", "claim",
        F.when(quant, "quantitative").otherwise("event").alias("claim_type"),
        F.when(~quant & F.col("claim").rlike(DENIAL), "denied").otherwise("asserted").alias("modality"),
        F.when(quant, F.coalesce(F.try_element_at("entity_ids", F.lit(1)), "_metric")).alias("entity_id"),
        F.when(quant, F.rtrim("_metric", F.lit("s"))).alias("metric"),
        F.when(quant, F.col("_value").cast("double")).alias("value"),
        F.when(quant, F.col("_unit")).alias("unit"),
        F.when(quant, F.date_format("published_at", "yyyy-MM-dd")).alias("as_of"),
        F.when(quant, F.col("_direction")).alias("direction"),
    )
