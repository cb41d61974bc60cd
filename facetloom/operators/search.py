"""Full text, tags, numbers and fused rankings over documents (id, text fields, tags, numbers)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The stop words, and BM25's parameters.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
]
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased words of more than one byte, without stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) > 1) & ~t.isin(*STOPWORDS))


@dataclass
class Index:
    """postings (field, term, id, tf, positions), docs (id and stored columns, len) and field weights. Written as Parquet by save(), so that searches prune to the terms that they name."""

    postings: DataFrame
    docs: DataFrame
    weights: dict[str, float]

    @staticmethod
    def create(docs: DataFrame, id_: str, fields: dict[str, float]) -> Index:
        df = docs.withColumn("id", F.col(id_).cast("string"))
        lists = df.select("id", *(tokens(F.col(f)).alias(f) for f in fields))
        rows = None
        for f in fields:
            one = lists.select(F.lit(f).alias("field"), "id", F.posexplode(f).alias("pos", "term"))
            rows = one if rows is None else rows.unionByName(one)
        postings = rows.groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        size = sum((F.size(tokens(F.col(f))) for f in fields), F.lit(0))
        return Index(postings, df.withColumn("len", size), fields)

    def save(self, path: str) -> Index:
        """Postings ordered by term, so that Parquet's statistics skip files and row groups."""
        spark = self.docs.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), self.weights)

    @staticmethod
    def load(spark: SparkSession, path: str, weights: dict[str, float]) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), weights)

    def add(self, docs: DataFrame, id_: str) -> Index:
        """With more documents; those of the same id are replaced, and lengths count living documents only."""
        new = Index.create(docs, id_, self.weights)
        ids = new.docs.select("id")
        return Index(self.postings.join(ids, "id", "left_anti").unionByName(new.postings), self.docs.join(ids, "id", "left_anti").unionByName(new.docs), self.weights)

    def remove(self, ids: DataFrame) -> Index:
        return Index(self.postings.join(ids, "id", "left_anti"), self.docs.join(ids, "id", "left_anti"), self.weights)

    @staticmethod
    def names(spark: SparkSession, path: str) -> list[str]:
        """Indexes that save() has finished below a folder."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        child = lambda s: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "docs/_SUCCESS")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(child(s)))

    @staticmethod
    def drop(spark: SparkSession, path: str) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def info(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("docs"), F.sum("len").alias("terms"), F.avg("len").alias("avg_len"))

    # Nodes of a query: each is (id, score).

    def term(self, term: str, field: str | None = None) -> DataFrame:
        """BM25, summed over the fields by weight."""
        hits = self.postings.where(F.col("term") == term.lower())
        hits = hits if field is None else hits.where(F.col("field") == field)
        counts = F.broadcast(hits.groupBy("field").agg(F.count("*").alias("df")))  # a row for each field
        hits = hits.select("field", "id", "tf").join(counts, "field")
        stats = F.broadcast(self.docs.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg")))  # one row
        weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in self.weights.items()), F.lit(1.0))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        return hits.join(self.docs.select("id", "len"), "id").crossJoin(stats).groupBy("id").agg(F.sum(idf * norm * weight).alias("score"))

    def prefix(self, start: str) -> DataFrame:
        """One point for each posting of a term that begins so."""
        return self.postings.where(F.col("term").startswith(start.lower())).groupBy("id").agg(F.count("*").cast("double").alias("score"))

    def phrase(self, words: list[str], field: str | None = None, positional: bool = True) -> DataFrame:
        """Words in a row (or, not positional, all of them), scored by the first."""
        hits = self.postings.where(F.col("term").isin(*[w.lower() for w in words]))
        hits = hits if field is None else hits.where(F.col("field") == field)
        place = F.lit(None).cast("array<int>")
        for w in words:
            place = F.when(F.col("term") == w.lower(), F.array(*[F.lit(j) for j, x in enumerate(words) if x.lower() == w.lower()])).otherwise(place)
        if positional:
            starts = hits.select("field", "id", F.explode("positions").alias("p"), place.alias("w")).select("field", "id", F.explode("w").alias("w"), "p")
            found = starts.groupBy("field", "id", (F.col("p") - F.col("w")).alias("at")).agg(F.count_distinct("w").alias("n")).where(F.col("n") == len(words)).select("id").distinct()
        else:
            found = hits.groupBy("field", "id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(words))).select("id").distinct()
        return self.term(words[0], field).join(found, "id", "left_semi")

    def numeric(self, column: str, low: float, high: float) -> DataFrame:
        return self.docs.where(F.col(column).between(low, high)).select("id", F.lit(1.0).alias("score"))

    def tag(self, column: str, values: list[str]) -> DataFrame:
        """One point for each matching tag of a comma-separated column."""
        tags = self.docs.select("id", F.explode(F.split(F.lower(column), ",")).alias("tag")).where(F.trim("tag").isin(*[v.lower() for v in values]))
        return tags.groupBy("id").agg(F.count("*").cast("double").alias("score"))

    def not_(self, node: DataFrame) -> DataFrame:
        return self.docs.select("id", F.lit(1.0).alias("score")).join(node, "id", "left_anti")

    @staticmethod
    def and_(*nodes: DataFrame) -> DataFrame:
        return _combined(nodes).where(F.col("n") == len(nodes)).drop("n")

    @staticmethod
    def or_(*nodes: DataFrame) -> DataFrame:
        return _combined(nodes).drop("n")

    def parse(self, query: str) -> DataFrame:
        """Words that all must match; a word with a star is a prefix."""
        nodes = [self.prefix(w[:-1]) if w.endswith("*") else self.term(w) for w in query.lower().split()]
        return nodes[0] if len(nodes) == 1 else self.and_(*nodes) if nodes else self.docs.select("id", F.lit(0.0).alias("score")).limit(0)

    def search(self, node: DataFrame | str, offset: int = 0, limit: int = 10, returns: list[str] | None = None, sort_by: str | None = None, desc: bool = False) -> DataFrame:
        found = self.parse(node) if isinstance(node, str) else node
        if sort_by:
            found = found.join(self.docs.select("id", F.col(sort_by).alias("by__")), "id")
            return found.orderBy(F.desc("by__") if desc else F.asc("by__"), "id").offset(offset).limit(limit).drop("by__")
        page = found.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
        return page if not returns else page.join(self.docs.select("id", *returns), "id")


def _combined(nodes: tuple[DataFrame, ...]) -> DataFrame:
    """One aggregate over all nodes, where a chain of joins would shuffle for each."""
    out = None
    for node in nodes:
        out = node.select("id", "score") if out is None else out.unionByName(node.select("id", "score"))
    return out.groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))


def _ranked(results: DataFrame, window: int) -> DataFrame:
    """The window's best with their ranks from 1: cut before they are numbered, so that the single task holds no more than the window."""
    top = results.orderBy(F.desc("score"), "id").limit(window)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(parts: list[DataFrame], constant: float = 60.0, window: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists."""
    out = None
    for p in parts:
        one = _ranked(p, window).select("id", (1.0 / (constant + F.col("rank"))).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def linear(parts: list[tuple[DataFrame, float]], window: int = 20) -> DataFrame:
    """Weighted sum of scores, each list divided by its largest."""
    out = None
    for p, weight in parts:
        top = p.orderBy(F.desc("score"), "id").limit(window)
        most = F.max("score").over(Window.partitionBy())
        one = top.withColumn("m__", most).select("id", F.when(F.col("m__") > 0, F.col("score") / F.col("m__") * weight).otherwise(0.0).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.sum("score").alias("score"))
