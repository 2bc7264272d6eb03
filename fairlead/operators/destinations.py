"""Destinations: resolving texts to port codes, categories, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import text as T


def gazetteer(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes: code, seaport, lat, lon; names: name, code of names that one seaport alone has) from a UN/LOCODE table."""
    codes = raw.filter("length(Location) > 0").select(
        F.concat(F.upper("Country"), F.upper("Location")).alias("code"),
        F.col("Function").startswith("1").alias("seaport"),
        T.normal_form(F.coalesce("NameWoDiacritics", "Name")).alias("name"),
        T.degrees_of(F.col("Coordinates"), 2, "N").alias("lat"),
        T.degrees_of(F.substring_index("Coordinates", " ", -1), 3, "E").alias("lon"),
    )
    names = codes.filter("seaport and name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("code").alias("code")).filter("n = 1").select("name", "code")
    return codes, names


def resolve(rows: DataFrame, raw: str, codes: DataFrame, names: DataFrame, seaports_only: bool = True) -> DataFrame:
    """Adds code and level: exact code, unambiguous port name, five-letter prefix, none or empty.

    The gazetteer is a fixed public list; Spark broadcasts it while its size is under the threshold.
    """
    good = (codes.filter("seaport") if seaports_only else codes).select("code").distinct()
    t = rows.withColumn("__t", T.normal_form(F.col(raw)))
    exact = good.select(F.col("code").alias("__t"), F.col("code").alias("__exact"))
    prefix = good.select(F.col("code").alias("__p"), F.col("code").alias("__prefix"))
    t = t.join(exact, "__t", "left").join(names.select(F.col("name").alias("__t"), F.col("code").alias("__name")), "__t", "left")
    t = t.withColumn("__p", F.when(F.length("__t") > 5, F.substring("__t", 1, 5))).join(prefix, "__p", "left")
    empty = F.col("__t").isin(*T.EMPTY_DESTINATION)
    e = F.when(F.length("__t") == 5, F.col("__exact"))
    level = F.when(empty, "ures").when(e.isNotNull(), "pontos").when(F.col("__name").isNotNull(), "nev").when(F.col("__prefix").isNotNull(), "prefix").otherwise("nincs")
    return t.select(*rows.columns, F.when(~empty, F.coalesce(e, "__name", "__prefix")).alias("code"), level.alias("level"))


def categorise(rows: DataFrame, raw: str, codes: DataFrame, lenient: bool = False) -> DataFrame:
    """Adds category. Strict: the whole field is a code that exists; lenient: so is its first code-like part."""
    known = codes.select(F.col("code").alias("__code"), F.lit(True).alias("__known")).distinct()
    t = rows.withColumn("__s", T.collapsed(F.col(raw)))
    t = t.withColumn("__code", T.port_code(F.col("__s"), T.STRICT_CODE)).join(known, "__code", "left").withColumnRenamed("__known", "__strict").withColumnRenamed("__code", "__c1")
    out = F.when(F.col("__strict"), T.category_of_country(F.substring("__c1", 1, 2))).otherwise(T.category_of_text(F.col("__s")))
    if lenient:
        t = t.withColumn("__code", T.port_code(F.col("__s"), T.LENIENT_CODE)).join(known, "__code", "left")
        out = F.when(F.col("__known"), T.category_of_country(F.substring("__code", 1, 2))).otherwise(out)
    return t.select(*rows.columns, out.alias("category"))


def composition(rows: DataFrame, window: str, category: str) -> DataFrame:
    """Share of each category in its window."""
    n = rows.groupBy(window, category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(window)))


def interpretable(rows: DataFrame, window: str, population: str, category: str = "category") -> DataFrame:
    """Share that can be read, by window and population and by window alone."""
    return rows.groupingSets([[F.col(window), F.col(population)], [F.col(window)]], window, population).agg(F.count("*").alias("n"), F.avg((F.col(category) != T.CAT_NONE).cast("double")).alias("share"))


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, of equally frequent ones the least."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc()).limit(k)
