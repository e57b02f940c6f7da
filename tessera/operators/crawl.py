"""A bounded crawl over category members, breadth first, as one join a level on written frontiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import first_rows
from tessera.registry import query, table
from tessera.sources.shared import new_path

CATEGORY = 14
EVENTS = "key array<long>, title string, page_id long, namespace int, source string, depth int, reason string"


@dataclass(frozen=True)
class Policy:
    """What a crawl may take and when it ends; patterns are parts of names, in any case."""

    max_depth: int
    max_pages: int
    max_members: int = 500
    allowed: frozenset[int] = frozenset({0})
    denied: frozenset[int] = frozenset()
    title_deny: tuple[str, ...] = ()
    category_deny: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.max_depth < 0 or self.max_pages <= 0 or self.max_members <= 0:
            raise ValueError("limits must be positive")
        if self.allowed & self.denied:
            raise ValueError(f"namespaces both allowed and denied: {sorted(self.allowed & self.denied)}")


def matches(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the name holds one of the patterns, in any case."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.lower(name).contains(pattern.lower())
    return F.coalesce(found, F.lit(False))


def page_reason(policy: Policy) -> Column:
    """Why a page (title, namespace) is no part of the corpus; null if it may be."""
    namespace = F.coalesce(F.col("namespace"), F.lit(0))
    none = F.lit(False)
    return F.when(namespace.isin(*policy.denied) if policy.denied else none, "denied_namespace").when(~namespace.isin(*policy.allowed) if policy.allowed else ~none, "namespace_not_allowed").when(matches(F.col("title"), policy.title_deny), "denied_title")


class _Walk:
    """The written state of a walk: a folder a level for visited categories, included pages and events."""

    def __init__(self, spark, policy: Policy) -> None:
        self.spark, self.policy, self.base, self.taken = spark, policy, new_path(spark, "crawl"), 0
        self.kept: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str, level: int) -> DataFrame:
        path = f"{self.base}/{name}/level={level}"
        df.write.parquet(path)
        self.kept.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def before(self, name: str, schema: str) -> DataFrame:
        """All earlier levels' rows, as one scan."""
        paths = self.kept.get(name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def judge(self, pages: DataFrame, others: DataFrame | None, level: int) -> bool:
        """Includes a level's pages (key, title, page_id, namespace, source, depth) and writes its events; whether the cap is reached.

        A page is taken at its first place where nothing is against it; from there on it is a duplicate.
        """
        pages = self.keep(pages.withColumn("refused", page_reason(self.policy)), "pages", level)
        known = self.before("included", "page_id long, key array<long>").select("page_id").distinct()
        first = pages.where("refused is null").join(known, "page_id", "left_anti").groupBy("page_id").agg(F.min("key").alias("key"))
        first = self.keep(first, "included", level)
        n = first.count()
        cut = None
        if self.taken + n >= self.policy.max_pages:
            cut = first_rows(first.select("key"), ["key"], self.policy.max_pages - self.taken).agg(F.max("key")).first()[0]
        at = first.select(F.col("page_id").alias("of"), F.col("key").alias("first"))
        told = pages.join(known.select(F.col("page_id").alias("seen")), F.col("page_id") == F.col("seen"), "left").join(at, F.col("page_id") == F.col("of"), "left")
        reason = F.when(F.col("seen").isNotNull() | (F.col("first") < F.col("key")), "duplicate_page").otherwise(F.col("refused"))
        told = told.select("key", "title", "page_id", "namespace", "source", "depth", reason.alias("reason"))
        told = told if others is None else told.union(others)
        self.keep(told if cut is None else told.where(F.col("key") <= F.array(*(F.lit(x).cast("long") for x in cut))), "events", level)
        self.taken += n
        return cut is not None


def crawled(members: DataFrame, seed_pages: DataFrame, seed_categories: DataFrame, policy: Policy) -> DataFrame:
    """title, page_id, namespace, source, depth, reason (null: included), place and truncated of all that a walk considers.

    members: category, title, page_id, namespace, ord; those of namespace 14 are categories. seed_pages: title, page_id,
    namespace, ord. seed_categories: title, ord. Categories are visited in the order of (depth, path of ords), each once
    whatever its case; their pages are considered in order, and the walk ends with the page that fills max_pages:
    nothing behind it is considered or reported. Each level is one join with the members of what the level before has
    queued; frontiers, visited names and included pages are written, so that every level's plan starts from scans.
    place sorts by level and path.
    """
    spark = members.sparkSession
    members = members.select("category", "title", F.col("page_id").cast("long"), F.col("namespace").cast("int"), F.col("ord").cast("long"))
    walk = _Walk(spark, policy)
    key = lambda df: F.array(F.col("ord").cast("long"))
    seeds = seed_pages.select(key(seed_pages).alias("key"), "title", F.col("page_id").cast("long"), F.col("namespace").cast("int"), F.concat(F.lit("seed:"), "title").alias("source"), F.lit(0).alias("depth"))
    truncated = walk.judge(seeds, None, -1)
    queue = seed_categories.select("title", key(seed_categories).alias("path"))
    depth = 0
    while not truncated and depth <= policy.max_depth:
        queue = walk.keep(queue.withColumns({"name": F.lower("title"), "denied": matches(F.col("title"), policy.category_deny)}), "queue", depth)
        if queue.isEmpty():
            break
        visited = walk.before("visited", "name string, title string, path array<long>")
        fresh = queue.where("not denied").join(visited.select("name"), "name", "left_anti").groupBy("name").agg(F.min(F.struct("path", "title")).alias("v"))
        fresh = walk.keep(fresh.select("name", "v.title", "v.path"), "visited", depth)
        popped = queue.join(fresh.select(F.col("name").alias("of"), F.col("path").alias("first")), F.col("name") == F.col("of"), "left")
        reason = F.when(F.col("denied"), "denied_category").when(F.col("first").isNull() | (F.col("first") != F.col("path")), "duplicate_category")
        event = lambda path, last, title, page_id, source, d, why: [F.concat(path, F.array(last)).alias("key"), F.col(title).alias("title"), page_id.cast("long").alias("page_id"), F.lit(CATEGORY).alias("namespace"), F.col(source).alias("source"), F.lit(d).alias("depth"), why.alias("reason")]
        dropped = popped.withColumn("why", reason).where("why is not null").select(*event(F.col("path"), F.lit(-1).cast("long"), "title", F.lit(None), "title", depth, F.col("why")))

        order = Window.partitionBy("category").orderBy("ord", "title", "page_id")
        of = members.join(fresh.select(F.col("title").alias("category"), "path"), "category").withColumn("n", F.row_number().over(order)).where(F.col("n") <= policy.max_members)
        of = walk.keep(of.withColumn("is_category", F.coalesce(F.col("namespace") == CATEGORY, F.lit(False))), "members", depth)
        pages = of.where("not is_category").select(F.concat("path", F.array("ord")).alias("key"), "title", "page_id", "namespace", F.col("category").alias("source"), F.lit(depth).alias("depth"))
        below = of.where("is_category").withColumn("why", F.when(matches(F.col("title"), policy.category_deny), "denied_category") if depth < policy.max_depth else F.lit("depth_limit"))
        refused = below.where("why is not null").select(*event(F.col("path"), F.col("ord"), "title", F.col("page_id"), "category", depth + 1, F.col("why")))
        queue = below.where("why is null").select("title", F.concat("path", F.array("ord")).alias("path"))
        truncated = walk.judge(pages, dropped.union(refused), depth)
        depth += 1
    level = F.regexp_extract(F.input_file_name(), r"level=(-?[0-9]+)", 1).cast("int").alias("level")
    every = walk.before("events", EVENTS).select("*", level)
    return every.select("title", "page_id", "namespace", "source", "depth", "reason", F.struct("level", "key").alias("place"), F.lit(truncated).alias("truncated"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'denied_namespace' WHEN page_id % 5 > 2 THEN 'namespace_not_allowed' WHEN contains(lower(url), '/p7') OR contains(lower(url), 'host1') THEN 'denied_title' ELSE 'included' END AS reason FROM pages""")
def flt_deny_patterns(spark, sf):
    """Addresses as titles, in namespaces 0 to 4, of which 0 and 2 are allowed and 1 is denied."""
    policy = Policy(0, 1, allowed=frozenset({0, 2}), denied=frozenset({1}), title_deny=("/P7", "Host1"))
    rows = table(spark, sf, "pages").select("page_id", F.col("url").alias("title"), (F.col("page_id") % 5).alias("namespace"))
    return rows.select("page_id", F.coalesce(page_reason(policy), F.lit("included")).alias("reason"))


def _members(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, nations and their suppliers as categories, customers and suppliers as pages; some are met twice, some are of odd namespaces."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    member = lambda df, category, title, page, namespace, ord_: df.select(category.alias("category"), title.alias("title"), page.cast("long").alias("page_id"), namespace.cast("int").alias("namespace"), ord_.cast("long").alias("ord"))
    nation, customer, supplier = (table(spark, sf, x) for x in ("nation", "customer", "supplier"))
    none, category, n = F.lit(None), F.lit(CATEGORY), F.col("n_nationkey")
    space = F.when(F.col("c_custkey") % 11 == 0, 10).when(F.col("c_custkey") % 13 == 0, 4).otherwise(0)
    rows = member(nation, name("R", "n_regionkey"), name("N", "n_nationkey"), none, category, n)
    rows = rows.union(member(nation, name("N", "n_nationkey"), F.concat(F.lit("r"), (F.col("n_regionkey") + 1) % 5), none, category, F.lit(0)))
    rows = rows.union(member(nation, name("N", "n_nationkey"), name("S", "n_nationkey"), none, category, F.lit(1)))
    rows = rows.union(member(customer, name("N", "c_nationkey"), F.col("c_name"), F.col("c_custkey"), space, F.col("c_custkey") + 10))
    rows = rows.union(member(supplier, name("S", "s_nationkey"), F.col("s_name"), F.col("s_suppkey") + 1_000_000_000, F.lit(0), F.col("s_suppkey")))
    rows = rows.union(member(customer.where("c_custkey % 17 = 0"), name("S", "c_nationkey"), F.col("c_name"), F.col("c_custkey"), space, F.col("c_custkey") + 1_000_000_000))
    rows = rows.union(member(nation, name("S", "n_nationkey"), name("Z", "n_nationkey"), none, category, F.lit(-1)))
    pages = supplier.where("s_suppkey < 3").select(F.col("s_name").alias("title"), (F.col("s_suppkey") + 1_000_000_000).alias("page_id"), F.lit(0).alias("namespace"), F.col("s_suppkey").alias("ord"))
    seeds = table(spark, sf, "region").where("r_regionkey < 3").select(name("R", "r_regionkey").alias("title"), F.col("r_regionkey").alias("ord"))
    return rows, pages, seeds.union(seeds.where("ord = 1").select("title", F.lit(9).alias("ord")))


_MEMBERS = """m AS (
 SELECT 'R' || n_regionkey AS category, 'N' || n_nationkey AS title, NULL::BIGINT AS page_id, 14 AS namespace, n_nationkey::BIGINT AS ord FROM nation
 UNION ALL SELECT 'N' || n_nationkey, 'r' || (n_regionkey + 1) % 5, NULL, 14, 0 FROM nation UNION ALL SELECT 'N' || n_nationkey, 'S' || n_nationkey, NULL, 14, 1 FROM nation
 UNION ALL SELECT 'N' || c_nationkey, c_name, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 10 WHEN c_custkey % 13 = 0 THEN 4 ELSE 0 END, c_custkey + 10 FROM customer
 UNION ALL SELECT 'S' || s_nationkey, s_name, s_suppkey + 1000000000, 0, s_suppkey FROM supplier
 UNION ALL SELECT 'S' || c_nationkey, c_name, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 10 WHEN c_custkey % 13 = 0 THEN 4 ELSE 0 END, c_custkey + 1000000000 FROM customer WHERE c_custkey % 17 = 0
 UNION ALL SELECT 'S' || n_nationkey, 'Z' || n_nationkey, NULL, 14, -1 FROM nation),
q0 AS (SELECT 'R' || r_regionkey AS title, [r_regionkey::BIGINT] AS path FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'R1', [9])"""


def _level(d: int, last: bool) -> str:
    seen = "".join(f" AND lower(title) NOT IN (SELECT k FROM v{e})" for e in range(d))
    why = "'depth_limit'" if last else "CASE WHEN contains(lower(title), 'n3') THEN 'denied_category' END"
    more = "" if last else f", q{d + 1} AS (SELECT title, list_append(path, ord) AS path FROM o{d} WHERE namespace = 14 AND NOT contains(lower(title), 'n3'))"
    return f""", v{d} AS (SELECT lower(title) AS k, min(path) AS path, arg_min(title, path) AS title FROM q{d} WHERE NOT contains(lower(title), 'n3'){seen} GROUP BY 1),
 o{d} AS (SELECT m.*, path FROM m JOIN v{d} ON m.category = v{d}.title QUALIFY row_number() OVER (PARTITION BY category ORDER BY ord) <= 500),
 x{d} AS (SELECT {d} AS level, list_append(q.path, -1) AS key, q.title, NULL::BIGINT AS page_id, 14 AS namespace, q.title AS source, {d} AS depth, CASE WHEN contains(lower(q.title), 'n3') THEN 'denied_category' WHEN v.path IS NULL OR v.path <> q.path THEN 'duplicate_category' END AS reason
 FROM q{d} q LEFT JOIN v{d} v ON lower(q.title) = v.k UNION ALL SELECT {d}, list_append(path, ord), title, page_id, 14, category, {d + 1}, {why} FROM o{d} WHERE namespace = 14),
 g{d} AS (SELECT {d} AS level, list_append(path, ord) AS key, title, page_id, namespace, category AS source, {d} AS depth FROM o{d} WHERE namespace <> 14){more}"""


@query(f"""WITH {_MEMBERS}{_level(0, False)}{_level(1, False)}{_level(2, True)},
g AS (SELECT -1 AS level, [s_suppkey::BIGINT] AS key, s_name AS title, s_suppkey + 1000000000 AS page_id, 0 AS namespace, 'seed:' || s_name AS source, 0 AS depth FROM supplier WHERE s_suppkey < 3 UNION ALL SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2),
j AS (SELECT *, CASE WHEN namespace = 10 THEN 'denied_namespace' WHEN namespace <> 0 THEN 'namespace_not_allowed' WHEN contains(title, '77') THEN 'denied_title' END AS refused, row_number() OVER (ORDER BY level, key) AS p FROM g),
f AS (SELECT page_id, min(p) AS f FROM j WHERE refused IS NULL GROUP BY 1),
e AS (SELECT level, key, title, j.page_id, namespace, source, depth, CASE WHEN f < p THEN 'duplicate_page' ELSE refused END AS reason, coalesce(f = p, false) AS taken FROM j LEFT JOIN f USING (page_id)
 UNION ALL SELECT *, false FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) WHERE reason IS NOT NULL),
n AS (SELECT *, row_number() OVER (ORDER BY level, key) AS r, sum(taken::INT) OVER (ORDER BY level, key) AS c FROM e),
s AS (SELECT coalesce(min(r) FILTER (c >= 500), 1000000000) AS stop, count(*) FILTER (c >= 500) > 0 AS truncated FROM n)
SELECT title, page_id, namespace, source, depth, coalesce(reason, 'included') AS reason, r AS place, truncated FROM n, s WHERE r <= stop""")
def job_bounded_bfs(spark, sf):
    """At most 500 pages, two levels below the seeds; the place is told as a number."""
    policy = Policy(max_depth=2, max_pages=500, denied=frozenset({10}), title_deny=("77",), category_deny=("n3",))
    found = crawled(*_members(spark, sf), policy)
    place = F.row_number().over(Window.orderBy("place.level", "place.key")).cast("long")  # the report is of 500 pages and what was refused on the way
    return found.select("title", "page_id", "namespace", "source", "depth", F.coalesce("reason", F.lit("included")).alias("reason"), place.alias("place"), "truncated")
