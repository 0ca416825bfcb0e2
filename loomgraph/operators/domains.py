"""Business domains: their rings of capabilities and code, the contexts of their classes, and entries for requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import class_role

CODE_TYPES = ("class", "interface", "method")

# What the words in a method's name, and the parts of its path, say that a class does.
NAME_CAPABILITIES = {"创建 / 新增": ["create", "add", "save"], "修改 / 更新": ["update", "modify"], "删除 / 移除": ["delete", "remove"], "查询 / 列表 / 搜索": ["list", "page", "query", "search"]}
PATH_CAPABILITIES = {"订单相关操作": ["/order"], "商品相关操作": ["/product", "/goods"]}
UNKNOWN, NO_METHODS, ROUTE = "未知", "(无方法或未收集)", "  路由: "
CONTEXT_LINES = ["类名: {}", "角色: {}", "模块: {}", "推测包名/路径: {}", "关联业务域: {}", "", "主要方法（含路由信息，节选）:"]


def _first(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def domain_rings(nodes: DataFrame, edges: DataFrame, domains: DataFrame, most_capabilities: int = 20, most_of_type: int = 30) -> DataFrame:
    """domain, ring, entity_type, id, name, derived of the capabilities (ring 1) and the code (ring 2) around each domain.

    Code is what lies in the domain by an edge; only where no such edge leads to code, what belongs to a module
    of a service of the domain (derived). The first by id of each domain and type are shown. domains: id.
    """
    relation = lambda name: edges.filter(F.lower("rel_type") == name)
    named = nodes.select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.lower(F.coalesce("entity_type", F.lit(""))).alias("entity_type"), "module_id")
    asked = domains.select(F.col("id").alias("domain")).distinct()
    held = relation("contains_capability").select(F.col("source_id").alias("domain"), F.col("target_id").alias("id")).distinct().join(asked, "domain", "left_semi")
    ring1 = _first(held.join(named, "id", "left"), ["domain"], ["id"], most_capabilities).select("domain", F.lit(1).alias("ring"), F.coalesce("entity_type", F.lit("")).alias("entity_type"), "id", F.coalesce("name", "id").alias("name"), F.lit(False).alias("derived"))
    code = named.filter(F.col("entity_type").isin(*CODE_TYPES))
    inside = relation("in_domain").select(F.col("target_id").alias("domain"), F.col("source_id").alias("id")).distinct().join(asked, "domain", "left_semi").join(code, "id")
    without = asked.join(inside.select("domain"), "domain", "left_anti")
    services = relation("belongs_to_domain").select(F.regexp_replace("source_id", "^service://", "").alias("module_id"), F.col("target_id").alias("domain")).distinct().join(without, "domain", "left_semi")
    derived = code.join(services, "module_id")
    both = inside.select("domain", "id", "name", "entity_type", F.lit(False).alias("derived")).unionByName(derived.select("domain", "id", "name", "entity_type", F.lit(True).alias("derived")))
    ring2 = _first(both, ["domain", "entity_type"], ["id"], most_of_type).select("domain", F.lit(2).alias("ring"), "entity_type", "id", "name", "derived")
    return ring1.unionByName(ring2)


def _touched(table: dict[str, list[str]], text: Column) -> list[Column]:
    return [F.when(text.rlike("|".join(words)), name) for name, words in table.items()]


def class_contexts(classes: DataFrame, methods: DataFrame, module_domains: DataFrame, most_lines: int = 40, most_read: int = 30) -> DataFrame:
    """id, domains, capabilities, role, context of every class.

    classes: id, name, module_id, package. methods: id, class_name, name, signature, path; those of a class go by id: the
    first ``most_lines`` are shown, and the first ``most_read`` say what the class does, each thing once, in the order in which it comes. module_domains: module_id, domain.
    """
    rank = F.row_number().over(W.partitionBy("class_name").orderBy("id"))
    own = methods.join(classes.select(F.col("name").alias("class_name")).distinct(), "class_name", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= max(most_lines, most_read))
    path = F.coalesce("path", F.lit(""))
    line = F.concat(F.lit("- "), F.coalesce(F.nullif("signature", F.lit("")), "name"), F.when(path != "", F.concat(F.lit(ROUTE), path)).otherwise(""))
    says = F.array_compact(F.array(*_touched(NAME_CAPABILITIES, F.lower(F.coalesce("name", F.lit("")))), *_touched(PATH_CAPABILITIES, path)))
    told = own.select("class_name", F.struct("rank", line.alias("line"), says.alias("says")).alias("x")).groupBy("class_name").agg(F.sort_array(F.collect_list("x")).alias("x"))
    shown = F.transform(F.filter("x", lambda m: m["rank"] <= most_lines), lambda m: m["line"])
    does = F.array_distinct(F.flatten(F.transform(F.filter("x", lambda m: m["rank"] <= most_read), lambda m: m["says"])))
    told = told.select("class_name", shown.alias("lines"), F.array_join(does, ", ").alias("capabilities"))
    names = module_domains.select("module_id", "domain").distinct().groupBy("module_id").agg(F.array_join(F.sort_array(F.collect_list("domain")), ", ").alias("domains"))
    out = classes.join(told, classes["name"] == told["class_name"], "left").drop("class_name").join(names, "module_id", "left")
    given = lambda c: F.coalesce(c, F.lit(""))
    values = [given("name"), class_role(F.col("name")), given("module_id"), given("package"), F.coalesce(F.nullif("domains", F.lit("")), F.lit(UNKNOWN))]
    head = [F.concat(F.lit(text.partition("{}")[0]), values[i]) if "{}" in text else F.lit(text) for i, text in enumerate(CONTEXT_LINES)]
    context = F.array_join(F.concat(F.array(*head), F.coalesce("lines", F.array(F.lit(NO_METHODS)))), "\n")
    return out.select("id", given("domains").alias("domains"), given("capabilities").alias("capabilities"), class_role(F.col("name")).alias("role"), context.alias("context"))


def requirement_entries(hits: DataFrame, levels: DataFrame, most: int = 10) -> DataFrame:
    """id, level, coverage, total, score: methods that several items of a requirement hit, the best entry points first.

    hits: item, id, score; levels: id, level (a method without one is at 0). Score: ten for each level, five for each item, two for each unit of summed similarity; ties by id.
    """
    found = hits.groupBy("id").agg(F.countDistinct("item").alias("coverage"), F.round(F.sum("score"), 4).alias("total")).join(levels.select("id", "level").hint("merge"), "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    scored = found.select("id", "level", "coverage", "total", F.round(10 * F.col("level") + 5 * F.col("coverage") + 2 * F.col("total"), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(most)


def mean_hit_rate(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """items, rate: the mean over all items of the share of their wanted ids among their hits. hits: item, id; wanted: item, id; an item without hits counts as 0."""
    w = wanted.select("item", "id").distinct()
    met = w.join(hits.select("item", "id").distinct().withColumn("hit", F.lit(1)), ["item", "id"], "left")
    each = met.groupBy("item").agg((F.count("hit") / F.count("*")).alias("rate"))
    return each.agg(F.count("*").alias("items"), F.coalesce(F.round(F.avg("rate"), 6), F.lit(0.0)).alias("rate"))
