"""The term index: postings, document lengths and corpus statistics, as ordinary tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.text import run_starts, tokens
from loamdex.session import materialize

#: The identifier's column counts as one token of a document's length, as in the score's definition.
ID_TOKENS = 1


@dataclass
class TermIndex:
    """postings(term, doc_id, tf_title, tf_body, length, df, df_title, df_body), lengths(doc_id, length) and one row of
    totals(n_docs, avg_length). A posting has its document's length and its term's document frequencies (in any field, in
    titles, in bodies), which sorted columns hold in little space, so that a search reads one table."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    _stats: tuple[int, float] | None = field(default=None, repr=False)

    def stats(self) -> tuple[int, float]:
        """(number of documents, average length), read once."""
        if self._stats is None:
            row = self.totals.first()
            self._stats = (row.n_docs, row.avg_length or 1.0)
        return self._stats

    def frequencies(self) -> DataFrame:
        """(term, df, df_title, df_body), counted from the postings, which needs no join of them."""
        return _frequencies(self.postings)


def tokenized(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, title_tokens, body_tokens) of rows with doc_id, title and body."""
    t, b = tokens(F.col("title")), tokens(F.col("body"))
    if stem:
        from loamdex.functions.analysis import raw_words
        from loamdex.functions.stem import stem_tokens

        t, b = (stem_tokens(raw_words(F.col(f))) for f in ("title", "body"))
    return docs.select("doc_id", t.alias("title_tokens"), b.alias("body_tokens"))


def _counted(docs: DataFrame, stem: bool) -> DataFrame:
    """(term, doc_id, length, tf_title, tf_body), and for each row of `docs` a row of no term. Tokens are counted within their row,
    as runs of the sorted ones, so nothing is shuffled."""
    words = tokenized(docs, stem)
    length = (F.size("title_tokens") + F.size("body_tokens") + ID_TOKENS).alias("length")
    words = words.select("doc_id", length, "title_tokens", F.sort_array(F.concat("title_tokens", "body_tokens")).alias("all"))
    starts = words.withColumn("starts", run_starts("all"))

    def run(i: Column, k: Column) -> Column:
        term = F.get("all", i)
        in_title = F.when(F.array_contains("title_tokens", term), F.size(F.filter("title_tokens", lambda w: w == term))).otherwise(0)
        n = F.coalesce(F.get("starts", k + 1), F.size("all")) - i
        return F.struct(term.alias("term"), n.cast("long").alias("n"), in_title.cast("long").alias("tf_title"))

    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("tf_title"))
    rows = starts.select("doc_id", "length", F.explode(F.concat(F.transform("starts", run), F.array(none))).alias("w"))
    return rows.select("w.term", "doc_id", "length", "w.tf_title", (F.col("w.n") - F.col("w.tf_title")).alias("tf_body"))


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("tf_title") > 0).alias("df_title"), F.count_if(F.col("tf_body") > 0).alias("df_body"))


def _finished(counted: DataFrame) -> TermIndex:
    """From (term, doc_id, length, tf_title, tf_body), where each document has a row of no term for its length. It is written: it is
    read for lengths, for frequencies, and twice for the ranges of terms. Rows that share a doc_id are one document's; only
    where there are such, counts are added by a shuffle."""
    counted = materialize(counted, "postings")
    if not counted.filter("term IS NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        counted = materialize(counted.groupBy("term", "doc_id", "length").agg(F.sum("tf_title").alias("tf_title"), F.sum("tf_body").alias("tf_body")), "postings")
    lengths, counted = counted.filter("term IS NULL").select("doc_id", "length"), counted.filter("term IS NOT NULL")
    # Every term has its frequencies, so this is an inner join; as a left one, Spark leaves it out where no frequency is read.
    postings = counted.join(_frequencies(counted), "term", "left").select("term", "doc_id", "tf_title", "tf_body", "length", "df", "df_title", "df_body")
    return TermIndex(postings, lengths, lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")))


def build(docs: DataFrame, stem: bool = False) -> TermIndex:
    """One pass over the texts for postings."""
    return _finished(_counted(docs, stem))


def _distinct_words(docs: DataFrame) -> DataFrame:
    """(term, doc_id, df, df_title, df_body): a row's distinct words, each with three booleans (counts for a document, for its title,
    its body). A word of both fields has two rows, of which one counts for the document. Without doc_id, a row counts for none."""
    words = tokenized(docs).select("doc_id", F.array_distinct("title_tokens").alias("title"), F.array_distinct("body_tokens").alias("body"))
    words = words.withColumn("both", F.array_intersect("body", "title")).withColumn("title", F.array_except("title", "both"))
    n = F.when(F.col("doc_id").isNotNull(), F.size("body"))
    rows = words.select("doc_id", n.alias("n_body"), (n + F.size("title")).alias("n_all"), F.posexplode(F.concat("body", "title", "both")).alias("at", "term"))
    return rows.select("term", "doc_id", F.expr("at < n_all").alias("df"), F.expr("at >= n_body").alias("df_title"), F.expr("at < n_body").alias("df_body"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, df_title, df_body) of rows with doc_id, title and body, as an index of them has, without its postings: distinct words
    are told apart within a row, and tasks add up theirs before the shuffle, so nothing is written and only sums by term
    move. Rows that share a doc_id are one document's: their words alone are first brought together by document."""
    names = ("df", "df_title", "df_body")
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if ids.isEmpty():
        rows = _distinct_words(docs)
    else:
        ids = materialize(ids, "shared_ids")
        alone, shared = (_distinct_words(docs.join(ids, "doc_id", how)) for how in ("left_anti", "left_semi"))
        rows = alone.unionByName(shared.groupBy("term", "doc_id").agg(*(F.bool_or(c).alias(c) for c in names)))
    return rows.groupBy("term").agg(*(F.count_if(F.col(c)).alias(c) for c in names))


def refresh(stored: TermIndex, changed: DataFrame, live: DataFrame, stem: bool = False) -> TermIndex:
    """The index after a change: only the texts of `changed` are read again. `live` has the doc_id of all documents."""
    same = live.select("doc_id").join(changed.select("doc_id"), "doc_id", "left_anti")
    rows = stored.postings.select("term", "doc_id", "length", "tf_title", "tf_body")
    none = stored.lengths.select(F.lit(None).cast("string").alias("term"), "doc_id", "length", F.lit(0).cast("long").alias("tf_title"), F.lit(1).cast("long").alias("tf_body"))
    kept = rows.unionByName(none).join(same, "doc_id", "left_semi")
    return _finished(kept.unionByName(_counted(changed, stem)))


def save(index: TermIndex, path: str, partitions: int | None = None) -> None:
    """Postings are ranged by term, so that a query's terms prune row groups by their statistics."""
    ranged = index.postings.repartitionByRange(partitions, "term") if partitions else index.postings.repartitionByRange("term")
    ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def load(spark, path: str) -> TermIndex:
    return TermIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "totals")))
