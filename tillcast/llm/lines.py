"""Line dedup by levelled sorted runs of line hashes.

A run is a table of (hash, number of documents), bucketed and sorted by the hash.  Batches
of documents arrive one after the other.  The counts of a batch are merge-anti-joined with
the settled runs, that is with the lines already known to be too frequent, and what is left
becomes a run of level 0.  As soon as a level holds ``fanout`` runs, they are merged into one
run of the next level, and lines that reach the limit move to a settled run.  A line thus
takes part in a logarithmic number of merges, and the buckets spare the old runs a shuffle.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` are
never dropped; each row counts as a document, so a row given twice counts twice; a text may
hold a dropped line many times and loses all of them; a dropped last line leaves no trace.
An empty table gives an empty result.  Columns besides id and text are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot, staging_folder
from tillcast.llm.common import BLANKS, ascii_lower, digest, fresh, held, row_key

HASH = ["h1", "h2"]


def line_table(docs: DataFrame, id_column: str, text_column: str, min_chars: int,
               batches: int) -> DataFrame:
    """One row per line: row key, position, hash, whether first of its key in the text, batch."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(row_key(F.col(id_column), F.col(text_column)).alias("row"),
                        ascii_lower(text).alias("text"))

    def entry(line: Column, at: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        first, second = digest(key)
        return F.struct(first.alias("h1"), second.alias("h2"), at.alias("at"),
                        F.char_length(key).alias("n"))

    sorted_lines = held(keyed, lines=F.sort_array(
        F.transform(F.split("text", "\n", -1), entry)))
    marked = F.transform("lines", lambda x, j: F.struct(
        x.h1.alias("h1"), x.h2.alias("h2"), x.at.alias("at"), x.n.alias("n"),
        ((j == 0) | (F.get("lines", j - 1).h1 != x.h1)
         | (F.get("lines", j - 1).h2 != x.h2)).alias("first")))
    return (sorted_lines.select("row", F.inline(marked)).where(F.col("n") >= min_chars)
            .drop("n").withColumn("batch", F.pmod("row.b", F.lit(batches))))


class LineRuns:
    """The levels of runs; ``min_docs`` documents make a line too frequent."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{staging_folder(self.spark).rstrip('/')}/{name}"
        (counts.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH)
         .sortBy(*HASH).option("path", path).saveAsTable(name))
        return self.spark.table(name)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def ingest(self, lines: DataFrame) -> None:
        """Count the lines of a batch, leave out the settled ones, add the rest as a run."""
        counts = (lines.where("first").groupBy(*HASH)
                  .agg(F.count(F.lit(1)).alias("n_docs")))
        for run in self.settled:
            counts = counts.join(run, HASH, "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(counts))
        self._compact(0)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        merged = snapshot(self._merge(self.levels[level]), "merged_lines")
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        frequent = F.col("n_docs") >= self.min_docs
        self.settled.append(self._write(merged.where(frequent)))
        self.levels[level + 1].append(self._write(merged.where(~frequent)))
        if len(self.settled) >= self.fanout:
            self.settled = [self._write(self._merge(self.settled))]
        self._compact(level + 1)

    def frequent(self) -> DataFrame:
        """The hashes found in at least ``min_docs`` documents over all batches."""
        runs = [run for level in self.levels for run in level]
        found = self._merge(runs).where(F.col("n_docs") >= self.min_docs).select(*HASH)
        for run in self.settled:
            found = found.unionByName(run.select(*HASH))
        return found.distinct()


def drop_frequent_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        min_docs: int = 10, min_chars: int = 1, batches: int = 4,
                        fanout: int = 2) -> DataFrame:
    """The given rows and columns, the text without frequent lines, and two counts.

    Added: ``n_lines`` before dropping and ``n_dropped`` (renamed if the input has these).
    A text that loses nothing stays as it is, null included.
    """
    table = snapshot(line_table(docs, id_column, text_column, min_chars, batches), "lines")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.ingest(table.where(F.col("batch") == batch))
    # A line of every document is one key here: the sort-merge join splits such a partition.
    dropped = (table.join(runs.frequent(), HASH, "left_semi")
               .groupBy("row").agg(F.collect_set("at").alias("dropped")))

    key, gone, lines, n_lines, n_dropped = fresh(
        docs, "row", "dropped", "lines", "n_lines", "n_dropped")
    joined = (docs.withColumn(key, row_key(F.col(id_column), F.col(text_column)))
              .join(dropped.select(F.col("row").alias(key), F.col("dropped").alias(gone)),
                    key, "left").drop(key))
    split = held(joined, **{lines: F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)})
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i))))
    return (split.withColumn(n_lines, F.size(lines).cast("long"))
            .withColumn(n_dropped, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
                        .cast("long"))
            .withColumn(text_column, text).drop(gone, lines))
