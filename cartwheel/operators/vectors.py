"""Exact nearest neighbours by cosine, and residual quantisation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.operators.order import head


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """To unit length; the norm is at least 1e-12."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


#: Bytes of query vectors that are broadcast; more are dealt to tiles.
BROADCAST_BYTES = 64 << 20


def meet(vectors: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_id, v, query_id, q): every vector with every one of a stated query set.

    The query set is measured.  If it is small it is broadcast; else queries are dealt to
    tiles of that size and every vector meets every tile once.
    """
    own = vectors.select("vec_id", F.col("embedding").alias("v"))
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    size = queries.agg(F.sum(F.size("embedding") * 8 + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        return own.crossJoin(F.broadcast(asked))
    tiles = -(-size // max(1, broadcast_bytes))
    dealt = asked.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)))
    copied = own.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    return copied.join(dealt, "tile").drop("tile")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, vec_id, similarity, rank): a stated query set against all (vec_id, embedding).

    The limit per query is applied in each task before the shuffle.
    """
    unit = lambda df, key: df.select(key, normalised(F.col("embedding")).alias("embedding"))
    met = meet(unit(vectors, "vec_id"), unit(queries, "query_id"), broadcast_bytes)
    scored = met.select("query_id", "vec_id", dot(F.col("q"), F.col("v")).alias("similarity"))
    return head(scored, ["query_id"], [F.desc("similarity"), "vec_id"], k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _encoded(rows: DataFrame, codebooks: list[list[list[float]]]) -> DataFrame:
    """``rows`` (with embedding) plus r, what the levels leave, and codes; books come as one broadcast row."""
    spark = rows.sparkSession
    out = rows.withColumns({"r": F.transform("embedding", lambda x: x.cast("double")), "codes": F.array().cast("array<int>")})
    for book in codebooks:
        shared = spark.createDataFrame([([[float(x) for x in c] for c in book],)], "_book array<array<double>>")
        met = out.crossJoin(F.broadcast(shared))
        # The least (distance, code): ties go to the lower code.
        gaps = F.transform("_book", lambda c, k: F.struct(squared_distance(F.col("r"), c).alias("gap"), k.alias("code")))
        coded = met.withColumn("_code", F.array_min(gaps)["code"].cast("int"))
        left = F.zip_with("r", F.get("_book", F.col("_code")), lambda x, y: x - y)
        out = coded.withColumns({"r": left, "codes": F.concat("codes", F.array("_code"))}).drop("_book", "_code")
    return out


def encode(vectors: DataFrame, codebooks: list[list[list[float]]]) -> DataFrame:
    """(vec_id, codes): per level the nearest centroid of what earlier levels left; ties to the lower code."""
    return _encoded(vectors.select("vec_id", "embedding"), codebooks).select("vec_id", "codes")


def centroid_means(vectors: DataFrame, books: list[list[list[float]]], book: list[list[float]]) -> DataFrame:
    """(code, mean): of what ``books`` leave of the vectors, the mean of those nearest to each centroid of ``book``."""
    left = _encoded(vectors.select("vec_id", "embedding"), books).select("vec_id", F.col("r").alias("embedding"))
    coded = _encoded(left, [book]).select(F.get("codes", F.lit(0)).alias("code"), array_to_vector("embedding").alias("v"))
    return coded.groupBy("code").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def train_quantizer(vectors: DataFrame, levels: int = 3, clusters: int = 256, iterations: int = 10, seed: int = 2026) -> list[list[list[float]]]:
    """Codebooks by k-means on residuals; a cluster that gets no vector keeps its centroid.

    Starts are the vectors that come first by a hash of vec_id.  Each iteration is one pass
    over the vectors that recomputes residuals from the books so far, so no lineage grows;
    a codebook (levels x clusters x dimensions) is all that the driver holds.
    """
    rows = vectors.select("vec_id", "embedding")
    if rows.limit(clusters).count() < clusters:
        raise ValueError("there are fewer vectors than clusters")
    books: list[list[list[float]]] = []
    for level in range(levels):
        first = rows.orderBy(F.xxhash64("vec_id", F.lit(seed + level)), "vec_id").limit(clusters)
        book = [list(r["r"]) for r in _encoded(first, books).select("r", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(seed + level)), "vec_id").collect()]
        for _ in range(iterations):
            for r in centroid_means(rows, books, book).collect():
                book[r["code"]] = r["mean"]
        books.append(book)
    return books
