"""Product catalogues: cleaning, and how well neighbours keep attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import scalars
from nearfield.operators.ranks import running
from nearfield.operators.search import small
from nearfield.operators.workload import draw

#: Names that columns of product tables go by, in order of preference.
CANDIDATES = {
    "title": ("title", "name", "product_title", "product_name", "item_name"),
    "description": ("description", "product_description", "about_product", "about this item", "details"),
    "category": ("category", "main_category", "sub_category", "product_category"),
    "price": ("price", "discount_price", "actual_price", "sale_price", "list_price"),
    "rating": ("rating", "ratings", "review_rating", "stars"),
}


def resolve(columns: list[str], wanted: str) -> str | None:
    """The first column that goes by one of a field's names, whatever its case."""
    by_name = {c.strip().lower(): c for c in reversed(columns)}
    return next((by_name[c] for c in CANDIDATES[wanted] if c in by_name), None)


def clean(products: DataFrame) -> DataFrame:
    """(title, description, category, price, rating, source_file, text_for_embedding) of the rows that have a title; fields that are missing are null."""
    found = {f: resolve(products.columns, f) for f in CANDIDATES}
    if found["title"] is None:
        raise ValueError("no title column")
    text = lambda f: F.trim(F.col(f"`{found[f]}`").cast("string")) if found[f] else F.lit(None).cast("string")
    source = F.col("source_file") if "source_file" in products.columns else F.lit(None).cast("string")
    title = scalars.missing_to_null(text("title"))
    out = products.select(title.alias("title"), scalars.missing_to_null(text("description")).alias("description"), scalars.top_category(text("category")).alias("category"), scalars.price(text("price")).alias("price"), scalars.rating(text("rating")).alias("rating"), source.alias("source_file"))
    return out.where("title is not null").withColumn("text_for_embedding", scalars.embedding_text(F.col("title"), F.col("description")))


def filter_metadata(rows: DataFrame, column: str, key: str, scale: int = 100, categorical: bool = False) -> DataFrame:
    """(key, code): a column as integers: values by scale, rounded half to even, or dense codes of sorted categories; rows without a value are left out."""
    rows = rows.where(F.col(column).isNotNull())
    if not categorical:
        return rows.select(key, F.bround(F.col(column) * scale).cast("long").alias("code"))
    codes = rows.select(column).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(column)).cast("long") - 1)
    return rows.join(small(codes), column).select(key, "code")


def top_or_other(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """rows with label: the column's n most frequent values, 'Other' for the rest."""
    top = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), column).limit(n).select(F.col(column).alias("_top"))
    return rows.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn("label", F.coalesce("_top", F.lit("Other"))).drop("_top")


def neighbour_pairs(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, vec_id, a, b): values (vec_id, value) of both sides of each neighbour pair, where both are there."""
    v = values.where("value is not null")
    out = neighbours.join(v.select(F.col("vec_id").alias("query_id"), F.col("value").alias("a")), "query_id")
    return out.join(v.select("vec_id", F.col("value").alias("b")), "vec_id").select("query_id", "vec_id", "a", "b")


def numeric_difference(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """One row (mean_abs_diff, pairs)."""
    return neighbour_pairs(neighbours, values).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.count("*").alias("pairs"))


def categorical_match(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """One row (match_share, pairs)."""
    return neighbour_pairs(neighbours, values).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("match_share"), F.count("*").alias("pairs"))


def shuffled(values: DataFrame, salt: int = 8) -> DataFrame:
    """values (vec_id, value) with the values that are there dealt anew: the row at a place in order of ids gets the value at that place in order of a hash."""
    v = values.where("value is not null")
    by_id = running(v.select("vec_id"), "vec_id", "r")
    by_hash = running(v.withColumn("u", draw(F.col("vec_id"), salt)), "u", "r", ("vec_id",)).select("value", "r")
    return by_id.join(by_hash, "r").select("vec_id", "value")


def locality(neighbours: DataFrame, numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """(attribute, real, random, signal): neighbours' agreement against shuffled values."""
    def row(name: str, real: DataFrame, other: DataFrame, c: str, lower: bool) -> DataFrame:
        both = real.select(F.col(c).alias("real")).crossJoin(other.select(F.col(c).alias("random")))
        better: Column = F.col("real") < F.col("random") if lower else F.col("real") > F.col("random")
        return both.select(F.lit(name).alias("attribute"), "real", "random", F.when(better, F.lit("signal")).otherwise(F.lit("none")).alias("signal"))

    a = row("numeric", numeric_difference(neighbours, numeric), numeric_difference(neighbours, shuffled(numeric)), "mean_abs_diff", True)
    b = row("categorical", categorical_match(neighbours, categorical), categorical_match(neighbours, shuffled(categorical)), "match_share", False)
    return a.unionByName(b)


def group_spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, std): sample standard deviation."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
