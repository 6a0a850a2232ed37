"""Near copies of whole documents: SimHash fingerprints in BK-trees and MinHash bands, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import simhash
from kindred.llm.lines import words_of
from kindred.llm.paragraphs import ROWS, SHINGLE, SIMILARITY, unit_components
from kindred.session import cut

BANDS = 20
#: Documents are longer than paragraphs, so fewer of them are compared in one group.
BLOCK = 512


def whole_text(text: str) -> Iterator[tuple[int, list[str]]]:
    """The whole text as one unit: (0, lower-cased words)."""
    yield 0, words_of(text.lower())


def near_copies(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS,
                rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, comp`` for every row of ``docs``; ``comp`` names the component.

    Documents are linked if the Jaccard similarity of their distinct lower-cased
    ``k``-word shingles is ``similarity`` or more. Candidates are the documents of
    one component of ``simhash.near_duplicates`` and, as its 3 bits hold few pairs
    of 0.8, those that share a band. Every candidate is verified
    exactly; at 0.8 bands miss a pair with chance 3e-5 (``recall(0.8, 20)``).
    Texts of fewer words make one shingle, null and empty ones are equal.
    """
    def close_prints(found: DataFrame) -> DataFrame:
        prints = simhash.near_duplicates(docs).select("text_key", F.xxhash64(F.lit("print"), "comp").alias("bucket")).distinct()
        return found.select("name", "text_key").distinct().join(prints, "text_key").select("name", "bucket").distinct()

    found, named = unit_components(docs, whole_text, k, similarity, bands, rows, buckets=close_prints, block=BLOCK)
    return found.join(cut(named.select("name", "comp"), "named"), "name").select("doc_id", "text_key", "comp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id (then text); all its columns."""
    return simhash.keep_least(docs, near_copies(docs, **options))
