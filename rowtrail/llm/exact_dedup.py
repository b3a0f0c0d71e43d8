"""Exact dedup with a persistent digest index.

The index is Parquet tables bucketed and sorted by digest. A batch is reduced to
its distinct digests, a sort-merge anti-join keeps those the index lacks, and
these are appended to it. That join shuffles and sorts the batch alone, not the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, scratch_path, text_of, written

#: Digests that a bucket of a full index should hold, about 250 MB of them.
BUCKET_DIGESTS = 4_000_000
LEAST_BUCKETS = 16
#: The recent part is merged into the base when it exceeds this share of it.
RECENT_SHARE = 0.25
BUCKET_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the unchanged text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.encode(text_of(text_col), "UTF-8"), 256))


def buckets_for(rows: int) -> int:
    """Buckets for an index over a corpus of so many rows."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_DIGESTS))


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made within use the order of bucket files where a bucket has one file."""
    before = spark.conf.get(BUCKET_ORDER, None)
    spark.conf.set(BUCKET_ORDER, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BUCKET_ORDER)
        else:
            spark.conf.set(BUCKET_ORDER, before)


class DigestIndex:
    """Digests with the key of the row that stays and the number of rows seen in its batch.

    ``path`` is a folder that outlives the session; opening it again finds the
    digests of earlier batches. ``buckets`` is fixed when the index is made and
    should fit the corpus it is meant for (``buckets_for``). Tables' names live
    in the session's catalogue until ``close()``; the folder stays.

    A base holds one sorted file a bucket, which a merge join reads as it is: neither
    shuffled nor sorted. Batches are appended to a recent part beside it, and the next
    append merges both into a new base once the recent part exceeds ``RECENT_SHARE`` of
    the old. A new base counts when it is complete, so a merge that fails is done anew.
    One writer at a time; frames read before a merge end with it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS, key_type: str = "bigint"):
        self.spark, self.buckets, self.key_type = spark, buckets, key_type
        self.path = path or scratch_path(spark, "digest-index")
        self.tables: list[str] = []
        self._open(self._generation())

    def _file_system(self, folder: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _generation(self) -> int:
        """The number of the last complete base; 0 where there is none yet."""
        system, place = self._file_system(self.path)
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        bases = [int(n.removeprefix("base-")) for n in names if n.startswith("base-")]
        return max((n for n in bases if system.exists(self._file_system(f"{self.path}/base-{n}/_SUCCESS")[1])), default=0)

    def _table(self, folder: str) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id {self.key_type}, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return name

    def _open(self, generation: int) -> None:
        self.close()
        self.generation = generation
        self.tables = [self._table(f"{part}-{generation}") for part in (("base", "recent") if generation else ("recent",))]

    def parts(self) -> list[DataFrame]:
        """The base, if there is one, and the recent part; no digest is in both."""
        return [self.spark.table(t) for t in self.tables]

    def read(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts())

    def lacking(self, digests: DataFrame) -> DataFrame:
        """Those that the index lacks."""
        for part in self.parts():
            digests = digests.join(part.select("digest").hint("merge"), "digest", "left_anti")
        return digests

    def append(self, digests: DataFrame) -> None:
        """Add the digests that the index lacks; adding the same batch twice changes nothing."""
        if self._size("recent") > RECENT_SHARE * self._size("base"):
            self.merge()
        with sorted_buckets(self.spark):
            self._insert(self.lacking(digests), self.tables[-1])

    def merge(self) -> None:
        """Write base and recent part as a new base and delete them."""
        system, unfinished = self._file_system(f"{self.path}/base-{self.generation + 1}")
        system.delete(unfinished, True)
        new = self._table(f"base-{self.generation + 1}")
        schema, folders = self.spark.table(new).schema, (f"{self.path}/{part}-{self.generation}" for part in ("base", "recent"))
        # as plain files: from bucketed tables Spark would leave the shuffle out and write several files a bucket
        old_files = [self.spark.read.schema(schema).parquet(f) for f in folders if system.exists(self._file_system(f)[1])]
        self._insert(reduce(DataFrame.unionByName, old_files, self.spark.createDataFrame([], schema)), new)
        self.spark.sql(f"DROP TABLE {new}")
        old = self.generation
        self._open(old + 1)
        for part in ("base", "recent"):
            system.delete(self._file_system(f"{self.path}/{part}-{old}")[1], True)

    def _insert(self, rows: DataFrame, table: str) -> None:
        # inserting keeps the table's bucketing and sorting
        rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(table)
        self.spark.catalog.refreshTable(table)

    def _size(self, part: str) -> int:
        system, place = self._file_system(f"{self.path}/{part}-{self.generation}")
        return system.getContentSummary(place).getLength() if system.exists(place) else 0

    def close(self) -> None:
        """Take the tables out of the catalogue."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []


def deduplicate(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append a batch to the index and tell for each of its rows whether it stays.

    Returns key, keep_id, group_size long, kept boolean, text_sha256. Of equal
    texts the row with the largest key stays, unless an earlier batch holds the
    text: then the earlier row does and all rows of the batch go. ``group_size``
    counts the rows of the batch in which the text came first. Rows with a null
    key stay only where no other row has their text; rows repeated with the same
    key count as copies that share one fate. An empty table changes nothing. The
    result does not need the index any more.
    """
    rows = docs.select(F.col(key), digest(text_col).alias("digest"))
    batch = written(rows.groupBy("digest").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "batch-digests")
    index.append(batch)
    # one row for each text of the batch, written, so that Spark can split a text with very many rows
    found = [batch.select("digest").join(part.hint("merge"), "digest") for part in index.parts()]
    with sorted_buckets(docs.sparkSession):
        fates = written(reduce(DataFrame.unionByName, found), "batch-fates")
    dropped(batch)
    return rows.join(fates, "digest").select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate_once(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with a new index, made for the number of rows of ``docs``."""
    index = DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count()), key_type=docs.schema[key].dataType.simpleString())
    try:
        return deduplicate(docs, index, key, text_col)
    finally:
        index.close()
