"""N-gram Jaccard join with Bayesian candidate pruning.

Candidates share a band of MinHash values over word 5-grams. A candidate pair's values are compared 32 at a time; after
each step it is dropped if the posterior probability that its similarity reaches the threshold, given the matches so far
and a uniform prior, is below the tolerance. What remains is verified by exact Jaccard similarity. The machinery, and how
it avoids listing a group's pairs, is described in `similar`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from framewright.llm.similar import TOLERANCE, keep_one, near_classes

THRESHOLD = 0.8


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links of every row: see `near_classes` for nulls, ties, repeated rows and empty tables."""
    return near_classes(docs, doc_id, text, threshold, tolerance).select("doc_id", "class_id", "n_links")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the smallest id, in all columns."""
    return keep_one(docs, threshold)
