"""Containment joins: which names hold which patterns, by an inverted index of grams in place of a nested loop.

Every distinct pattern is blocked by the one of its grams that fewest names hold; only names with that
gram are compared with it. A gram that very many names hold is dealt over several tasks, by its
count, so that a pattern all of whose grams are common is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES_A_TASK = 100_000


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def containing(names: DataFrame, patterns: DataFrame, by: list[str] = (), q: int = 3, names_a_task: int = NAMES_A_TASK) -> DataFrame:
    """name, pattern and the columns ``by``: every distinct pair whose name holds the pattern.

    names: name; patterns: pattern; both with the columns ``by``, which must be equal. Null and
    empty patterns hit nothing, null names and nulls in ``by`` neither. Patterns of fewer than
    ``q`` characters are looked up whole.
    """
    named = names.select(*by, "name").filter("name <> ''").distinct()
    asked = patterns.select(*by, "pattern").filter("pattern <> ''").distinct().withColumn("size", F.least(F.length("pattern"), F.lit(q)))
    sizes = asked.select("size").distinct()  # q rows at most
    fitting = named.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(q)))))
    held = fitting.join(F.broadcast(sizes), "size").select(*by, "name", F.explode(_grams(F.col("name"), F.col("size"))).alias("gram"))
    often = held.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    own = asked.select(*by, "pattern", F.explode(_grams(F.col("pattern"), F.col("size"))).alias("gram"))
    # A gram that no name holds is the rarest: its pattern is in none.
    rarest = own.join(often, [*by, "gram"], "left").groupBy(*by, "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    deals = F.ceil(F.col("n") / names_a_task).cast("int")
    blocks = rarest.select(*by, "pattern", "least.gram", F.explode(F.sequence(F.lit(0), F.ceil(F.col("least.n") / names_a_task).cast("int") - 1)).alias("deal"))
    wanted = rarest.select(*by, "least.gram", "least.n").distinct()
    dealt = held.join(wanted, [*by, "gram"]).select(*by, "gram", "name", F.pmod(F.xxhash64("name"), deals.cast("long")).cast("int").alias("deal"))
    return dealt.join(blocks, [*by, "gram", "deal"]).filter(F.col("name").contains(F.col("pattern"))).select(*by, "name", "pattern")


def first_containing(names: DataFrame, patterns: DataFrame, order: list[str], key: str = "id", by: list[str] = (), **options) -> DataFrame:
    """pattern, the columns ``by`` and ``key`` of the first of the names that hold it, in the order of the columns ``order``."""
    pairs = containing(names, patterns, by, **options)
    best = names.groupBy(*by, "name").agg(F.min(F.struct(*order, F.col(key).alias("_key"))).alias("x"))
    return pairs.join(best, [*by, "name"]).groupBy(*by, "pattern").agg(F.min("x").alias("x")).select(*by, "pattern", F.col("x._key").alias(key))


def simple_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def mapper_methods(statements: DataFrame, methods: DataFrame, **options) -> DataFrame:
    """namespace, statement_id, id of the first method, by name and id, that holds the statement's name in any case and whose class holds the namespace's simple name; null without one.

    statements: namespace, statement_id. methods: id, class_name, name.
    """
    asked = statements.select("namespace", "statement_id").distinct().withColumn("pattern", simple_name(F.col("namespace")))
    pairs = containing(methods.select(F.col("class_name").alias("name")), asked, **options)
    of_class = pairs.select("pattern", F.col("name").alias("class_name")).join(methods.select("id", "class_name", F.col("name").alias("method")), "class_name")
    hits = asked.join(of_class, "pattern").filter(F.lower("method").contains(F.lower("statement_id")))
    first = hits.groupBy("namespace", "statement_id").agg(F.min(F.struct(F.coalesce("method", "id").alias("name"), "id")).alias("x"))
    return asked.drop("pattern").join(first, ["namespace", "statement_id"], "left").select("namespace", "statement_id", "x.id")


def interface_implementations(methods: DataFrame, **options) -> DataFrame:
    """interface_id, id: methods of classes not named after an implementation, with the methods of the same name in the classes ..Impl whose name holds theirs.

    Of several methods of one name in a class the one with the greatest id stands for all. methods: id, class_name, name.
    """
    own = methods.filter("class_name <> '' AND name <> ''").groupBy("class_name", "name").agg(F.max("id").alias("id"))
    made = F.col("class_name").endswith("Impl")
    classes = own.select("class_name").distinct()
    pairs = containing(classes.filter(made).select(F.col("class_name").alias("name")), classes.filter(~made).select(F.col("class_name").alias("pattern")), **options)
    faces = pairs.select(F.col("pattern").alias("class_name"), F.col("name").alias("impl")).join(own, "class_name").select("impl", "name", F.col("id").alias("interface_id"))
    return faces.join(own.select(F.col("class_name").alias("impl"), "name", "id"), ["impl", "name"]).select("interface_id", "id")


def keyword_scores(classes: DataFrame, keywords: list[str], **options) -> DataFrame:
    """id, score, hits: how many of the keywords a class name holds in any case, and which; classes that hold none have no row."""
    spark = classes.sparkSession
    asked = spark.createDataFrame([(k.lower(),) for k in sorted(set(keywords))], "pattern string")
    named = classes.select("id", F.lower("name").alias("name"))
    pairs = containing(named, asked, **options).groupBy("name").agg(F.count("*").alias("score"), F.sort_array(F.collect_list("pattern")).alias("hits"))
    return named.join(pairs, "name").select("id", "score", "hits")
