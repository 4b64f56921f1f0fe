"""An inverted index of segments: each addition of documents is one, and reading merges their statistics.

A segment is written sorted by term, in files of ranges of terms, so a question reads only the files and row groups that can
hold its words: the commit names each file with its first and last term, and the files' own statistics do the rest. A
segment keeps its documents' keys and lengths, its terms' document frequencies, and its sums of documents and words. What BM25
needs of the whole, the mean of all terms' idf above all, is reckoned from these small tables when a segment is added, so a
question never reads the whole vocabulary.

Documents whose key the index has are left out, so adding twice is adding once. Null texts are empty documents: they count.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.operators import retrieval
from lodestone.sources.commits import Commits
from lodestone.sources.tables import bounded, cut

#: Rows of a file of postings, at least, before another is made.
FILE = 250_000
#: Bytes of a text a word, about.
BYTES = 6
#: Ids that are numbers, of documents that are there, up to which they are sent to the texts.
IDS = 4_000_000


class InvertedIndex:
    """Postings under a folder, for documents (doc_id, text)."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT):
        self.spark, self.config, self.log = spark, config, Commits(spark, folder)

    def add(self, docs: DataFrame) -> int:
        """Add a segment of the documents whose doc_id isn't there; the index's new version, or the old one if there are none."""
        version, state = self.log.last()
        segments = state.get("segments", [])
        docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # ids go to the texts, if they are few enough: texts stay where they are
        most = self.config.broadcast_rows if dict(docs.dtypes)["doc_id"] == "string" else IDS
        if segments:
            docs = docs.join(bounded(self._union(segments, "docs").select("doc_id"), most), "doc_id", "left_anti")
        twice = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
        if not twice.isEmpty():
            twice = bounded(twice, most)
            docs = docs.join(twice, "doc_id", "left_anti").unionByName(docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if not n:
            return version
        folder = self.log.new_folder()
        self._write_postings(docs, folder, max(1, min(10_000, size // BYTES // FILE + 1)))
        n, words = self.spark.read.parquet(f"{folder}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        segment = {"folder": folder, "docs": n, "words": words, "files": self._files(folder)}
        segments = [*segments, segment]
        n, words = sum(s["docs"] for s in segments), sum(s["words"] for s in segments)
        mean = retrieval.raw_idf(self._union(segments, "terms").groupBy("term").agg(F.sum("df").alias("df")), n).agg(F.avg("raw")).first()[0]
        self.log.commit(version + 1, {"segments": segments, "docs": n, "words": words, "mean_idf": mean})
        return version + 1

    def _write_postings(self, docs: DataFrame, folder: str, files: int) -> None:
        """Postings, and from them documents and terms: a document's own row, without a term, stands before all terms."""
        rows = retrieval.postings(docs, lengths=True)
        # few words hold a great part of all rows, so files are ranges of (term, document)
        rows.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/postings")
        made = self.spark.read.parquet(f"{folder}/postings")
        made.where("term IS NULL").select("doc_id", "dl").write.parquet(f"{folder}/docs")
        made.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")

    def _files(self, folder: str) -> list[list[str]]:
        """Name, first and last term of each file of postings; as many as there are files."""
        rows = self.spark.read.parquet(f"{folder}/postings").groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
        return sorted([f"{folder}/postings/{r['f'].rsplit('/', 1)[1]}", r["lo"], r["hi"]] for r in rows.where("lo IS NOT NULL").collect())

    def _union(self, segments: list[dict], table: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{s['folder']}/{table}" for s in segments))

    def files(self, terms: list[str], version: int | None = None) -> tuple[list[str], int]:
        """The files that can hold a posting of one of ``terms``, and how many there are in all."""
        state = self.log.read(version) if version else self.log.last()[1]
        every = [f for s in state.get("segments", []) for f in s["files"]]
        order = sorted(set(terms), key=lambda t: t.encode())
        keys = [t.encode() for t in order]
        hit = [f for f, lo, hi in every if (at := bisect_left(keys, lo.encode())) < len(keys) and keys[at] <= hi.encode()]
        return hit, len(every)

    def search(self, questions: DataFrame, k: int | None = None, version: int | None = None) -> DataFrame:
        """qid, rank, doc_id and score of BM25 over all segments of a version, the last one by default, for questions (qid, text)."""
        scores = self.scores(questions, version).withColumn("score", F.round("score", 6))
        return retrieval.top(scores, k or self.config.top_k, F.desc("score"), "doc_id").select("qid", "rank", "doc_id", "score")

    def scores(self, questions: DataFrame, version: int | None = None) -> DataFrame:
        state = self.log.read(version) if version else self.log.last()[1]
        asked = retrieval.term_rows(questions, "qid").select("term").distinct()
        terms = [r["term"] for r in asked.limit(self.config.broadcast_rows + 1).collect()]
        few = len(terms) <= self.config.broadcast_rows
        files = self.files(terms, version)[0] if few else [f for s in state.get("segments", []) for f, _, _ in s["files"]]
        kinds = dict(questions.dtypes)
        if not files:
            return self.spark.createDataFrame([], f"qid {kinds['qid']}, doc_id long, score double")
        post = self.spark.read.parquet(*files)
        stats = self._union(state["segments"], "terms")
        if few:  # as a literal list it goes down to the scan, where the files' statistics leave out row groups
            post, stats = post.where(F.col("term").isin(terms)), stats.where(F.col("term").isin(terms))
        else:
            wanted = bounded(asked, self.config.broadcast_rows)
            post, stats = post.join(wanted, "term", "left_semi"), stats.join(wanted, "term", "left_semi")
        stats = retrieval.raw_idf(stats.groupBy("term").agg(F.sum("df").alias("df")), state["docs"])
        stats = stats.select("term", "df", retrieval.floored(F.lit(state["mean_idf"]), self.config).alias("idf"))
        return retrieval.bm25_from(post, stats, state["words"] / state["docs"], questions, self.config)

