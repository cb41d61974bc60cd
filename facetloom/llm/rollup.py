"""Token counts as delta-maintained rollups.

Changes are signed: an insert adds a document and its tokens to the total of its source, language and tokenizer
version, a delete takes them away, and a revised count is both, under the old and the new version. A batch of changes is
summed to one row a group before anything is kept, and stands in a folder of its own, named by the batch: Spark's commit marker
says that it counts, a batch that was committed is skipped when it comes again, and one whose job died is
written anew. Totals are the sum over committed batches; compact() folds them into one.

Defined results: null sources, languages and versions are groups of their own; a null count is 0 tokens; a group whose
documents and tokens have all gone is left out; an empty batch commits and changes nothing; no batches: no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import cut, shared_dir, table

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(df: DataFrame, sign: int, tokenizer: str | Column, tokens: str | Column) -> DataFrame:
    """Changes of +1 (insert) or -1 (delete) for each row of df, which has source and lang."""
    version = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    count = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select("source", "lang", version.alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(count, F.lit(0))).cast("long").alias("tokens"))


def revised(df: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """A revised count: (version, column of tokens) before and after."""
    return signed(df, -1, *old).unionByName(signed(df, 1, *new))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Committed batches below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def committed(self) -> list[str]:
        """Folders of batches that count, those folded into a base aside."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if self._exists(f"{self.path}/{n}/_SUCCESS")]
        bases = sorted(n for n in done if n.startswith("base-"))
        folded = set()
        if bases:
            folded = {r[0] for r in self.spark.read.parquet(f"{self.path}/{bases[-1]}/folded").collect()}
        return bases[-1:] + sorted(n for n in done if n.startswith("batch-") and n not in folded)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False where the batch had been committed: nothing is added twice."""
        folder = self._folder(batch)
        if self._exists(f"{folder}/_SUCCESS"):
            return False
        _summed(changes).write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        paths = [f"{self.path}/{n}/sums" if n.startswith("base-") else f"{self.path}/{n}" for n in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return _summed(self.spark.read.schema(SCHEMA).parquet(*paths)).where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Folds committed batches into a base; the base counts once its marker stands. Their folders stay as the record of what was committed."""
        names = self.committed()
        number = 1 + max([int(n[5:]) for n in names if n.startswith("base-")], default=0)
        base = f"{self.path}/base-{number:08d}"
        earlier = [n for n in names if n.startswith("base-")]
        folded = [(n,) for n in names if n.startswith("batch-")] + [tuple(r) for n in earlier for r in self.spark.read.parquet(f"{self.path}/{n}/folded").collect()]
        self.totals().write.mode("overwrite").parquet(f"{base}/sums")
        self.spark.createDataFrame(folded, "name string").write.mode("overwrite").parquet(f"{base}/folded")
        fs, p = self._fs(f"{base}/_SUCCESS")
        fs.create(p, True).close()


#: Two versions of a counter: words between white space, and runs of letters and digits.
V1, V2 = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op10_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with counts of version 1; those labelled 1 are counted anew with version 2, those labelled 0 are deleted; the second batch comes twice."""
    docs = table(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", "source", "lang", *(F.regexp_count("text", F.lit(v)).alias(n) for n, v in (("v1", V1), ("v2", V2)))), "counts")
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = slim.join(quality, "doc_id")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", signed(slim, 1, "words-1", "v1"))
    recount = revised(labelled.where("quality = 1"), ("words-1", "v1"), ("words-2", "v2"))
    rollup.commit("recount", recount)
    rollup.commit("recount", recount)
    rollup.commit("remove", signed(labelled.where("quality = 0"), -1, "words-1", "v1"))
    return rollup.totals()


OP10_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, quality, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS v1,
        coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS v2
      FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id)
SELECT source, lang, CASE WHEN quality = 1 THEN 'words-2' ELSE 'words-1' END AS tokenizer, count(*) AS docs, sum(CASE WHEN quality = 1 THEN v2 ELSE v1 END)::BIGINT AS tokens
FROM d WHERE quality IS NULL OR quality <> 0 GROUP BY ALL
"""
