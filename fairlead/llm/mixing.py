"""Mixing sources to target weights by systematic sampling, in integer arithmetic so that reruns agree.

A document's size is its number of words (null text: 0). Sources in code-point order, null last, weigh 5, 2, 1,
repeating. Together they take `share` of all words; a source's target stops at `most` times its own words and what is
over is shared again by weight. Empty tables give empty results; repeated rows are sampled one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.llm.common import WORD_PATTERN, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
#: Expected copies are held as whole multiples of 2**-UNIT_BITS, so prefix sums are exact for 2**38 documents a source.
UNIT_BITS = 24
#: Documents of a table for each salt, and the least number of salts: a size class of a source is ranked in as many parts,
#: so that a class of many alike documents, however many, is not ranked in one task.
SALT_ROWS, LEAST_SALTS = 20_000, 32


def _word_count(text):
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate (expected copies in units), start (random offset in units). One row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    rising = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    t = t.withColumn("full", level * F.col("w") >= F.col("cap"))
    left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(W.partitionBy())
    spare = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(W.partitionBy())
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * spare / left))
    unit = 1 << UNIT_BITS
    return t.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("long").alias("rate"),
        F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")))), 1, UNIT_BITS // 4), 16, 10).cast("long").alias("start"),
    )


def _key(source):
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(source).cast("string").alias("source"), _word_count(text_or_empty(text)).alias("size"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])


def _dealt(sized: DataFrame, salts: int) -> DataFrame:
    bits = F.length(F.bin("size"))
    rows = sized.withColumn("__class", (bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0)) & 15")).cast("int"))
    rows = rows.withColumn("__salt", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long"), F.lit(salts)))
    return rows.withColumn("__key", _key(F.col("source")))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, salt_rows: int = SALT_ROWS, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and source, and the `carry` columns): one row per input row.

    Words are counted once, into a table of (id, source, size); with `carry` once more for the rows that go along.
    Within a source documents stand in order of size class, salt, size and doc_id; the prefix sum of expected copies
    is rank times rate, so it needs one count a (source, class, salt) and a rank inside it, never a whole source in one
    task. A document is taken once for each integer that the prefix sum plus the source's offset crosses at it.
    """
    light = materialize(_sized(docs, doc_id, text, source), "mix-sizes")
    salts = max(LEAST_SALTS, -(-light.count() // salt_rows))
    targets = source_targets(light.select("source", "size"), share, most).withColumn("__key", _key(F.col("source"))).drop("source")
    parts = _dealt(light, salts).groupBy("__key", "__class", "__salt").agg(F.count("*").alias("__n"))
    classes = parts.groupBy("__key", "__class").agg(F.sum("__n").alias("__m"))
    upto = W.partitionBy("__key").orderBy("__class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.withColumn("__lower", F.coalesce(F.sum("__m").over(upto), F.lit(0).cast("long"))).drop("__m")
    ahead = W.partitionBy("__key", "__class").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0).cast("long"))).drop("__n")
    parts = parts.join(classes, ["__key", "__class"]).withColumn("__before", F.col("__before") + F.col("__lower")).drop("__lower").join(targets, "__key")
    inside = W.partitionBy("__key", "__class", "__salt").orderBy("size", F.col("__id").asc_nulls_last())
    rows = _dealt(_sized(docs, doc_id, text, source, carry) if carry else light, salts)
    ranked = rows.withColumn("__rank", F.row_number().over(inside).cast("long")).join(parts, ["__key", "__class", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    copies = F.expr(f"shiftright(start + __rank * rate, {UNIT_BITS}) - shiftright(start + (__rank - 1) * rate, {UNIT_BITS})")
    return ranked.select(F.col("__id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: each row as often as it is taken, with all its columns."""
    names = [f"__d{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names)
    at = dict(zip(docs.columns, names, strict=True))
    kept = mix_sources(whole, doc_id=at[doc_id], text=at[text], source=at[source], carry=tuple(names)).filter("copies > 0")
    return kept.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in at.items()])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, length(bin(size)) * 16 + ((size >> greatest(length(bin(size)) - 5, 0)) & 15) AS class,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % (SELECT greatest({LEAST_SALTS}, (count(*) + {SALT_ROWS - 1}) // {SALT_ROWS}) FROM d) AS salt FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS LAST) AS rk FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w >= cap AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * {1 << UNIT_BITS}) AS BIGINT) ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, {UNIT_BITS // 4}) AS BIGINT) AS start FROM t)
SELECT r.doc_id, r.size, u.source_size, round(u.target, 6) AS target,
       CAST((((u.start + r.rk * u.rate) >> {UNIT_BITS}) - ((u.start + (r.rk - 1) * u.rate) >> {UNIT_BITS})) * r.size AS BIGINT) AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
"""
