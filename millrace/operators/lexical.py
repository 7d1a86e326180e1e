"""TF-IDF with smooth idf, nearest neighbours by cosine, and word n-gram containment - as tall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams
from ..session import kept, spread
from .scans import Blocks

#: Words of two letters or digits or more, as is usual for TF-IDF.
WORD = r"[\p{L}\p{N}_]{2,}"


def terms(df: DataFrame, key: str, text: Column, n: tuple[int, ...] = (1, 2)) -> DataFrame:
    """key, term, tf: word n-grams of the lower-cased text, worked out once."""
    w = F.col("__w")
    every = F.flatten(F.array(*[w if k == 1 else grams(w, k) for k in n]))
    split = spread(df.select(F.col(key), text.alias("__text"))).select(key, F.regexp_extract_all(F.lower("__text"), F.lit(WORD), F.lit(0)).alias("__w"))
    return kept(split.select(key, F.explode(every).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))


def idf(t: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """term, idf = ln((1 + n) / (1 + df)) + 1; with `most`, of the terms with the largest counts, ties
    to the smaller term. The count where the cut falls is found from how many terms have each, so
    that only its own terms are put in order, by blocks."""
    g = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if most:
        g = kept(g)
        upto = F.sum("terms").over(Window.orderBy(F.desc("total")))
        levels = g.groupBy("total").agg(F.count("*").alias("terms")).withColumn("upto", upto)
        cut = levels.where(F.col("upto") > most).orderBy("upto").first()
        if cut:
            last = Blocks(g.where(F.col("total") == cut["total"]), [], ["term"]).scan(sums={"place": F.lit(1)}).frame()
            room = most - (cut["upto"] - cut["terms"])
            g = g.where(F.col("total") > cut["total"]).unionByName(last.where(F.col("place") <= room).select(*g.columns))
    return g.select("term", (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(t: DataFrame, idf_table: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """key, term, w: normalised to length 1."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    w = t.join(idf_table, "term").withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("norm", norm).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


#: Rows of the base in one block of a term's list; longer lists are dealt to as many blocks as they need.
BLOCK = 20_000
#: The rarest terms of a query that find its first candidates, and how many of these are worked out.
RAREST, FIRST = 8, 3


def pairs_on(q: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """query, base, dot over the query terms given. A long list lies in blocks by its rows, and a
    query's term goes to each of them."""
    q = q.select("query", "qw", *on, F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))).alias("block"))
    return q.join(b, [*on, "block"]).groupBy("query", "base").agg(F.sum(F.col("qw") * F.col("bw")).alias("dot"))


def dots_of(pairs: DataFrame, q: DataFrame, b: DataFrame) -> DataFrame:
    """pairs with the dot over all terms of q that both have (0 if none)."""
    each = pairs.select("query", "base").join(q.select("query", "term", "qw"), "query")
    rest = each.join(b.select("base", "term", "bw"), ["base", "term"]).groupBy("query", "base").agg(F.sum(F.col("qw") * F.col("bw")).alias("rest"))
    return pairs.join(rest, ["query", "base"], "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))


def bounded(query: DataFrame, base: DataFrame, key: str, by: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, b, best): the query's terms with what they and all commoner terms of the query can add at
    most (`bound`), the base's rows by term and block, and a cosine that each query surely reaches.

    Of commoner terms together no row gets more than the sum of the query's weights times the largest
    weights in the base, nor more than the length of the query's vector over them.

    The base's rows of terms that a query has, and the lists, are written once: each step reads them
    and none works them out again. Rows without a key are no answer.
    """
    on = ["term"] + ([by] if by else [])
    q = kept(query.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col("w").alias("qw"), *on))
    b = kept(base.where(F.col(key).isNotNull()).select(F.col(key).alias("base"), F.col("w").alias("bw"), *on).join(q.select("term").distinct(), "term", "left_semi"))
    lists = kept(b.groupBy("term").agg(F.max("bw").alias("most"), F.count("*").alias("df")).withColumn("blocks", F.ceil(F.col("df") / BLOCK).cast("int")))
    long = F.broadcast(lists.where("blocks > 1").select("term", "blocks"))  # one in BLOCK rows at most
    b = b.join(long, "term", "left").withColumn("block", F.pmod(F.xxhash64("base"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    q = q.join(lists, "term")
    w = Window.partitionBy("query").orderBy(F.desc("df"), "term")
    line = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumn("bound", F.least(F.sum(F.col("qw") * F.col("most")).over(line), F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(line))))
    q = kept(q.withColumn("rare", F.row_number().over(Window.partitionBy("query").orderBy("df", F.desc("term")))))
    first = pairs_on(q.where(F.col("rare") <= RAREST), b, on)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dot"), "base"))).where(F.col("n") <= FIRST)
    best = dots_of(kept(first), q, b).groupBy("query").agg(F.max("rest").alias("best"))
    return q, b, best


def nearest(query: DataFrame, base: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Per query row the base row with the largest cosine (ties to the smaller key), exactly; queries
    that share no term with any base row have none. `by` restricts pairs to equal groups, given as a
    column of both.

    A query's rarest terms give a cosine to reach. Its common terms, as many as cannot reach that
    together, then find no candidates: a row that shares only those is not the nearest. They are
    worked out only for the rows that the other terms find and that may still be the nearest.
    """
    on = ["term"] + ([by] if by else [])
    q, b, best = bounded(query, base, key, by)
    slack = 1 + 1e-9  # sums in another order differ by less
    q = kept(q.join(best, "query", "left").withColumn("needed", F.col("best").isNull() | (F.col("bound") * slack >= F.col("best"))))
    found = pairs_on(q.where("needed"), b, on)
    limits = q.groupBy("query").agg(F.max("best").alias("best"), F.coalesce(F.max(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("more"))
    found = found.join(limits, "query").where(F.col("best").isNull() | ((F.col("dot") + F.col("more")) * slack >= F.col("best")))
    full = dots_of(kept(found), q.where(~F.col("needed")), b).select("query", "base", (F.col("dot") + F.col("rest")).alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "base")
    return full.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def near_existing(new: DataFrame, existing: DataFrame, key: str, text: str, threshold: float = 0.85, least: int = 120, most: int | None = 50_000) -> DataFrame:
    """New rows near an existing one; idf is of the existing rows alone, texts of `least` characters.
    `most` terms of the existing rows count, the commonest; None: all."""
    e, q = existing.where(F.length(text) >= least), new.where(F.length(text) >= least)
    t = terms(e, key, F.col(text))
    i = idf(t, e.count(), most)
    return nearest(weights(terms(q, key, F.col(text)), i, key), weights(t, i, key), key).where(F.col("cosine") >= threshold)


def gram_sets(df: DataFrame, key: str, text: Column, n: int = 5) -> DataFrame:
    """key, gram: 64-bit hashes of the distinct word n-grams of the lower-cased text."""
    words = F.filter(F.split(F.lower("__text"), r"\s+"), lambda x: x != "")
    split = spread(df.select(F.col(key), text.alias("__text"))).select(key, words.alias("__w"))
    return split.select(key, F.explode(F.array_distinct(F.transform(grams(F.col("__w"), n), lambda g: F.xxhash64(g)))).alias("gram"))


def containment(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Per pair of rows that share one: how many of the first row's n-grams the second has."""
    sizes = part.groupBy(F.col(key).alias("part")).agg(F.count("*").alias("total"))
    p, w = part.select(F.col(key).alias("part"), "gram"), whole.select(F.col(key).alias("whole"), "gram")
    return p.join(w, "gram").groupBy("part", "whole").agg(F.count("*").alias("shared")).join(sizes, "part")
