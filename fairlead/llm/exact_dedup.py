"""Exact dedup by an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays; a null doc_id is smaller than any other, and of rows alike in doc_id and text exactly one stays. An empty
table gives an empty result. Only doc_id and text are read; other columns keep their values whatever their names.

1. Each row's key is a 64-bit hash of its text. The directory starts as one bucket and doubles as long as a bucket holds
   more keys than its page: an overfull bucket is split by the next bits of its keys.
2. The directory sends each text to its bucket, whose owner task sorts it by key, compares the bytes of texts with the
   same key and chains those that differ. Keys of very many rows are gathered map-side first, so that an owner gets one
   text a task of theirs and not all copies.
3. A row finds its entry by its key. Only where a key has a chain of several texts is the row's text compared with
   those of the chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.llm.common import LOWER, UPPER, materialize, release, text_or_empty

#: Keys of a bucket's page, and buckets that fill the directory before pages grow with the table instead: it is broadcast.
PAGE_KEYS, PAGES = 2048, 1 << 18
#: Bits that one round of doubling looks ahead.
STEP = 8
#: A key is hot from HOT_ROWS rows on and from one row in HOT_SHARE of the table on; so at most HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1000, 50_000

Key = Callable[[Column], Column]


def normalised(text: str | Column = "text") -> Column:
    return F.translate(text_or_empty(text) if isinstance(text, str) else F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _first_bits(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, page_keys: int = PAGE_KEYS) -> DataFrame:
    """(prefix, depth, keys): the buckets, each the keys that begin with the `depth` bits of `prefix`.

    `keys` has one row a distinct key `h`. Each round counts the keys of the overfull buckets by their next STEP bits and
    gives every one of them the least depth at which it fits its page; what still does not fit is split in the next
    round. There is no last round but the end of the key.
    """
    left, depth, found, rounds = keys.select("h"), 0, None, []
    while True:
        deep = min(depth + STEP, 64)
        counts = left.groupBy(_first_bits(F.col("h"), deep).alias("slot")).agg(F.count("*").alias("n"))
        levels = F.sequence(F.lit(depth + 1 if depth else 0), F.lit(deep))
        at = counts.select("slot", "n", F.explode(levels).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {deep} - depth)"))
        held = materialize(at.withColumn("held", F.sum("n").over(W.partitionBy("depth", "prefix"))), "dedup-histogram")
        rounds.append(held)
        fits = held.filter((F.col("held") <= page_keys) | (F.col("depth") == 64))
        chosen = fits.groupBy("slot").agg(F.min(F.struct("depth", "prefix", "held")).alias("c")).select("c.prefix", "c.depth", F.col("c.held").alias("keys")).distinct()
        found = chosen if found is None else found.unionByName(chosen)
        over = held.filter((F.col("depth") == deep) & (F.col("held") > page_keys)).select("slot")
        if deep == 64 or over.isEmpty():
            whole = materialize(found, "dedup-directory")
            release(*rounds)
            return whole
        left = left.join(over.withColumnRenamed("slot", "__slot"), _first_bits(F.col("h"), deep) == F.col("__slot"), "left_semi")
        depth = deep


def _slots(buckets: DataFrame) -> tuple[DataFrame, int]:
    """The directory as its slots: each first `deep` bits of a key with the bucket that holds it."""
    deep = buckets.agg(F.max("depth")).first()[0] or 0
    slots = buckets.withColumn("__nth", F.explode(F.expr(f"sequence(0L, shiftleft(1L, {deep} - depth) - 1)")))
    return slots.select(F.expr(f"shiftleft(prefix, {deep} - depth) + __nth").alias("__slot"), F.expr(f"shiftleft(prefix, {deep} - depth)").alias("__bucket"), F.col("depth").alias("__depth")), deep


class Index:
    """The keys of a table, the directory over them and the entries of its texts.

    rows: doc_id, h, m (how often); hot: the keys of very many rows; entries: bucket, depth, h, chain, links, keep_id,
    group_size, sha and, where a key has several texts, the text.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, key: Key = F.xxhash64, page_keys: int | None = None, hot_rows: int = HOT_ROWS):
        self.names = list(docs.columns)
        self._docs = docs.toDF(*[f"__d{i}" for i in range(len(self.names))])
        at = {c: f"__d{i}" for i, c in enumerate(self.names)}
        self._id, self._norm, self._text = F.col(at[doc_id]).cast("long"), normalised(at[text]), at[text]
        self._key = key(self._norm)
        self.rows = materialize(self._docs.select(self._id.alias("doc_id"), self._key.alias("h")).groupBy("doc_id", "h").agg(F.count("*").alias("m")), "dedup-rows")
        keys = materialize(self.rows.groupBy("h").agg(F.sum("m").alias("n")), "dedup-keys")
        size = keys.agg(F.sum("n").alias("rows"), F.count("*").alias("keys")).first()
        most = max(hot_rows, -(-(size.rows or 0) // HOT_SHARE))
        self.hot = keys.filter(F.col("n") > most).select("h")
        self.buckets = directory(keys, page_keys or max(PAGE_KEYS, -(-size.keys // PAGES)))

    def _routed(self, *columns: Column) -> tuple[DataFrame, DataFrame]:
        """(cold, hot) rows with their key, bucket and depth; the bucket is looked up in the directory."""
        slots, deep = _slots(self.buckets)
        rows = self._docs.select(*columns, self._key.alias("__h")).withColumn("__slot", _first_bits(F.col("__h"), deep))
        rows = rows.join(F.broadcast(slots), "__slot").drop("__slot")
        hot = F.broadcast(self.hot.withColumnRenamed("h", "__h"))
        return rows.join(hot, "__h", "left_anti").repartition("__bucket"), rows.join(hot, "__h", "left_semi")

    def entries(self) -> DataFrame:
        cold, hot = self._routed(self._id.alias("__id"), F.col(self._text))
        keys = ["__bucket", "__depth", "__h", "__norm"]
        both = [r.withColumn("__norm", normalised(self._text)).groupBy(*keys).agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size")) for r in (cold, hot)]
        chain = W.partitionBy("__bucket", "__h")
        out = []
        for part in both:
            part = part.withColumn("chain", F.row_number().over(chain.orderBy("__norm"))).withColumn("links", F.count("*").over(chain))
            out.append(part.select(F.col("__bucket").alias("bucket"), F.col("__depth").alias("depth"), F.col("__h").alias("h"), "chain", "links", "keep_id", "group_size", F.unhex(F.sha2("__norm", 256)).alias("sha"), F.when(F.col("links") > 1, F.col("__norm")).alias("text")))
        return materialize(out[0].unionByName(out[1]), "dedup-index")

    def kept(self) -> DataFrame:
        """Of each chain's texts the row that stays, with all columns: the owner picks it, so a text moves once."""
        cold, hot = self._routed(F.struct(*self._docs.columns).alias("__row"), self._id.alias("__id"))
        text = F.col("__row")[self._text].cast("string")
        best = F.max_by("__row", F.struct(F.col("__id").isNotNull(), "__id", text))
        keys = ["__bucket", "__h", "__norm"]
        first = W.partitionBy(*keys).orderBy(F.col("__id").desc_nulls_last(), text.desc())
        cold = cold.withColumn("__norm", normalised(text)).withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select("__row")
        hot = hot.withColumn("__norm", normalised(text)).groupBy(*keys).agg(best.alias("__row")).select("__row")
        return cold.unionByName(hot).select("__row.*").toDF(*self.names)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64, page_keys: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    index = Index(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", key, page_keys, hot_rows)
    entries = index.entries()
    said = ["keep_id", "group_size", "sha"]
    alone, chained = entries.filter("links = 1").select("h", *said), entries.filter("links > 1").select("h", "text", *said)
    hot = F.broadcast(index.hot)
    found = index.rows.join(hot, "h", "left_anti").join(alone.join(hot, "h", "left_anti"), "h")
    found = found.unionByName(index.rows.join(F.broadcast(alone.join(hot, "h", "left_semi")), "h"))
    if not chained.isEmpty():
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("text")).withColumn("h", key(F.col("text")))
        met = texts.join(chained, ["h", "text"]).groupBy("doc_id", "h", *said).agg(F.count("*").alias("m"))
        found = found.unionByName(met.select(*found.columns))
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64, page_keys: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that stay, with all their columns."""
    return Index(docs, doc_id, text, key, page_keys, hot_rows).kept()


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
n AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND nth = 1 AS kept, text_sha256 FROM n
"""
