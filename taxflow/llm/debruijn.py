"""Substring dedup by de Bruijn compaction (operator 6).

The 35-word k-mers of all documents are the edges of a de Bruijn graph.  A run
of consecutive edges that share their least 12-word gram is a path; it is
compacted to one node with its content as its name.  A path that occurs twice
as a whole is repeated without looking at its edges.  Where paths of one gram
fork, Spark joins single edges to tell which of them are repeated.  The source
coordinates of the repeated edges (document and word) give the spans to remove.
See ``taxflow.llm.repeats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxflow.llm.repeats import Shape, remove_repeats, repeated_edges

WINDOW = 35
GRAM = 12


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_sha256 of every document.

    Removed is each word that lies in ``window`` consecutive words whose
    sequence also starts anywhere else in the table, the same document included.
    Words are runs of other characters than space and U+0009 to U+000D,
    unchanged.  kept_sha256 is of the kept words, joined by one space.

    Null and empty texts have no words and the digest of the empty string.
    Rows with equal doc_id and text are one document, not repeats of each other;
    equal texts under different ids, null included, are repeats.  Further
    columns are not read.  An empty table gives no rows.
    """
    shape = Shape("word", window, max(1, min(GRAM, window - 1)))
    found = remove_repeats(docs, shape, lambda texts, scratch: repeated_edges(texts, shape, scratch, wide_only=False), wide=0, label="debruijn")
    return found.select("doc_id", found["n"].alias("n_words"), "n_removed", "kept_sha256")
