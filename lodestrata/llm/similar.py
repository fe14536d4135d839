"""The pipeline's near-dedup: one document of each group of near copies, by fingerprints and then by exact Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, removed, settled, stored
from .jaccard import similar_groups
from .simhash import firsts, near_duplicates, numbered, unnumbered

#: Words of a shingle; texts are near copies if their sets of shingles are this similar, in hundredths.
WORDS, PERCENT = 5, 80


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each group of near copies, so that no two rows with words that stay are so similar.

    Groups by fingerprint, as in op5, come first, which takes copies away; then, of the rows that are left, groups that are linked
    by an exact Jaccard similarity of at least percent / 100 of their sets of runs of ``words`` words. Of a group the row of the smallest id
    stays; null ids come last, and rows of the same id are judged by their texts. Texts without words are one group.
    """
    rows, text = numbered(settled(docs)), f"c_{text_col}"
    found = near_duplicates(rows, id_col="_rid", text_col=text).select(F.col("doc_id").alias("_rid"), F.col("component_id").alias("group"))
    keep = stored(firsts(found, rows, id_col), "kept")
    groups = similar_groups(among(rows, keep), percent, words, text)
    out = unnumbered(among(rows, stored(firsts(groups, rows, id_col), "firsts")))
    for used in (keep, groups):
        removed(used)
    return out
