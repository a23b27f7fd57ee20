"""Search queries from titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uploadwatch import config
from uploadwatch.functions.text import canonical


def expand(titles: DataFrame, brand_terms: tuple[str, ...] = config.BRAND_TERMS, max_queries: int | None = 50) -> DataFrame:
    """query, rank of titles (seq, title): title with brand terms, then titles alone, then evasive spellings.

    A query belongs to the first title and class that makes it, in order of titles; it is kept once.
    """
    made = [(1, k, f" {t}") for k, t in enumerate(brand_terms)] + [(2, 0, "")]
    made += [(3, k, f" {v}") for k, v in enumerate(v for t in brand_terms for v in config.EVASIONS.get(t, ()))]
    forms = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(k).alias("pos"), F.lit(s).alias("suffix")) for c, k, s in made))
    base = titles.select("seq", canonical(F.col("title")).alias("norm")).filter("norm <> ''")
    made_queries = base.select("seq", "norm", F.inline(forms)).select("seq", "class", "pos", F.concat("norm", "suffix").alias("query"))
    # The least (title, class, place) of each query, by a plain aggregate.
    kept = made_queries.groupBy("query").agg(F.min(F.struct("seq", "class", "pos")).alias("first"))
    ordered = kept.select("query", F.col("first.class").alias("class"), F.col("first.seq").alias("seq"), F.col("first.pos").alias("pos")).orderBy("class", "seq", "pos")
    if max_queries is None:
        return ordered
    top = ordered.limit(max_queries)  # bounded, so one window may number it
    return top.select("query", F.row_number().over(Window.orderBy("class", "seq", "pos")).alias("rank"))
