"""A corpus pipeline of five stages over documents; each stage reads what its predecessor wrote.

Each stage learns, where it learns, from what its predecessor kept: the quality classifier from the labels of the tables, the language classifier from the documents' own `lang`.

Defined results: a null or empty text is scored by the quality classifier as an empty block, and goes in the language stage, as it has no letter; a null lang or
source is learned from in no case, and is a source of its own; of copies the one with the smallest id stays, and one of a null id only where no other is there; rows of one
id with other texts are documents of their own; a document that the mix takes more than once comes out as often; extra columns, whatever their names, go along up to the
last stage, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetloom.llm import bpe, jaccard, language, mixing, quality
from facetloom.llm.common import cut, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality.keep),
    ("language ID", language.keep),
    ("n-gram Jaccard join", jaccard.keep),
    ("mixing sources to target weights", mixing.mix),
    ("byte-level BPE encoding and decoding", bpe.encode_stage),
]

#: Trained models have no SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
