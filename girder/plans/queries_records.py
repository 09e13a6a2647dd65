"""Queries over questions, names, tenants, stored rows, runs and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import text as T
from girder.operators import clean, log, model, retrieval, rules, stats
from girder.plans import fixtures as X
from girder.plans import tables as P
from girder.plans.registry import query
from girder.plans.staging import new_path
from girder.plans.tables import dealt, table

HEADS = ("", "请问", "你好", "介绍一下", "谢谢", "西安", "上海今天", "什么是")
TAILS = ("螺纹钢多少钱", "P.O 42.5水泥价格", "HRB400E行情", "合同付款条款", "帮我审查标书", "梳理所有规范", "你是谁？", "  ", "高线 单价", "revit建模", "采购供应商报价", "!!", "Hello")
FILES = ("技术标.docx", "商务标-投标函.pdf", "施工组织设计.doc", "报价清单.xlsx", "营业执照.jpg", "README.txt", "专项方案.pdf", None)
LAYERS = ("X$0$S-WALL", "a-wall", "A-部件", " A-PART ", "S_BEAM 01", "DIM", "xref$0$A-后砌", None)
SLABS = ("地砖面层", "结构板", "landing", "环氧地坪", "LB1", None)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _any(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


QUESTION_SQL = f"question AS (SELECT p_partkey AS k, {_list(HEADS)}[p_partkey % 8 + 1] || {_list(TAILS)}[p_partkey // 8 % 13 + 1] AS q FROM part)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(_pick(HEADS, k % 8), _pick(TAILS, F.floor(k / 8) % 13)).alias("q"))


_VARIANT = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{m}'" for p, m in D.MATERIAL_VARIANTS) + " END"
_TAIL = r"[\s!！?？。~～,.，啊呀呢吧吗]*"


@query(f"""WITH {QUESTION_SQL},
v AS (SELECT *, {_VARIANT} AS variant, trim(q) AS s, lower(trim(q)) AS low, regexp_replace(lower(trim(q)), '[\\s!！?？。~～,.，]+$', '') AS bare FROM question)
SELECT k, {_any('lower(q)', D.PRICE_WORDS)} AND ({_any('lower(q)', D.PRICE_MATERIALS)} OR variant IS NOT NULL) AS asks,
       coalesce(variant, {X.sql_contains('q', [(m, m) for m in D.PRICE_MATERIALS], "''")}) AS material, {X.sql_contains('q', [(m, m) for m in D.MARKETS], "''")} AS market,
       CASE WHEN {_any('low', D.GENERAL_WORDS)} THEN 'GENERAL' WHEN length(low) <= 6 AND {_any('low', D.VAGUE_WORDS)} THEN 'VAGUE' WHEN {_any('low', D.BROAD_WORDS)} THEN 'BROAD' ELSE 'PRECISE' END AS kind,
       CASE {' '.join(f"WHEN bare IN ({', '.join(chr(39) + w + chr(39) for w in words)}) THEN '{kind}'" for kind, words in D.GREETINGS.items())}
            WHEN regexp_matches(s, '^(你|您)(是谁|叫什么名字|叫什么|叫啥|是什么){_TAIL}$') THEN 'identity' END AS greeting
FROM v""")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, sf_dir).select("k", D.asks_price(q).alias("asks"), D.asked_material(q).alias("material"), D.asked_market(q).alias("market"), D.query_type(q).alias("kind"), D.greeting(q).alias("greeting"))


INTENTS = tuple(D.ROUTES)


@query(f"""WITH {QUESTION_SQL},
a AS (SELECT k, q, {_list(INTENTS)}[k % {len(INTENTS)} + 1] AS intent, (k % 10)::DOUBLE / 10 AS confidence, CASE WHEN k % 3 = 0 THEN NULL ELSE 'p1' END AS project, k % 4 AS n FROM question),
b AS (SELECT *, intent = 'bid_query' AND regexp_matches(q, '审查|审核|评审|审一下|审一审') AS review FROM a),
c AS (SELECT *, (CASE WHEN (review OR intent IN ('contract_review', 'bim_command')) AND n = 0 THEN 1 ELSE 0 END) + (CASE WHEN intent IN ('bid_query', 'bim_command') AND project IS NULL THEN 1 ELSE 0 END) AS lacks FROM b)
SELECT k, CASE WHEN confidence < 0.55 OR lacks > 0 THEN 'clarify' WHEN review THEN 'workflow.bid_review' ELSE CASE intent {' '.join(f"WHEN '{i}' THEN '{r[0]}'" for i, r in D.ROUTES.items())} END END AS route,
       review OR CASE intent {' '.join(f"WHEN '{i}' THEN {str(r[1]).lower()}" for i, r in D.ROUTES.items())} END AS confirm, lacks
FROM c""")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    r = D.route(F.col("q"), _pick(INTENTS, k % len(INTENTS)), (k % 10) / 10, F.when(k % 3 != 0, "p1"), k % 4)
    return questions(spark, sf_dir).select("k", r.alias("r")).select("k", "r.route", F.col("r.requires_confirmation").alias("confirm"), F.size("r.missing").cast("long").alias("lacks"))


@query(f"""WITH n AS (SELECT p_partkey AS k, {_list(FILES)}[p_partkey % 8 + 1] AS file, {_list(LAYERS)}[p_partkey % 8 + 1] AS layer, {_list(LAYERS)}[p_partkey // 8 % 8 + 1] AS other, {_list(SLABS)}[p_partkey % 6 + 1] AS slab, p_size FROM part),
m AS (SELECT *, upper(trim(coalesce(layer, ''))) AS up FROM n),
l AS (SELECT *, regexp_replace(up, '^.*\\$0\\$', '') AS leaf FROM m)
SELECT k, {X.sql_contains("lower(coalesce(file, ''))", [(w, kind) for kind, words in D.BID_FILE_RULES for w in words], "'通用'")} AS file_class,
       CASE WHEN leaf = 'S-WALL' THEN 'S' WHEN leaf IN ('A-WALL', 'A-WALL-S', 'A-PART', 'A-PART-S', 'A-后砌', 'A-MASONRY', 'WALL') THEN 'A' END AS wall_group,
       CASE WHEN coalesce(upper(layer) LIKE '%S-WALL', false) OR coalesce(upper(other) LIKE '%S-WALL', false) THEN 'S-WALL' WHEN coalesce(upper(layer) LIKE '%A-WALL-CONC', false) OR coalesce(upper(other) LIKE '%A-WALL-CONC', false) THEN 'A-WALL-CONC' ELSE 'partition' END AS family,
       coalesce(regexp_matches(lower(layer), 'wall|beam'), false) AND NOT coalesce(regexp_matches(lower(layer), '^x'), false) AS included,
       CASE WHEN p_size % 9 = 0 THEN 'landing' WHEN {_any("coalesce(slab, '')", D.FINISHING_WORDS)} THEN 'finishing' ELSE 'structural' END AS slab_class,
       substr(upper(regexp_replace(coalesce(layer, ''), '[\\s_-]+', '', 'g')), 1, 80) AS token,
       CASE k % 4 WHEN 0 THEN 300.0 WHEN 1 THEN 200.0 WHEN 2 THEN 120.0 END::DOUBLE AS width, CASE k % 4 WHEN 0 THEN 600.0 END::DOUBLE AS depth
FROM l""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), _pick(FILES, k % 8).alias("file"), _pick(LAYERS, k % 8).alias("layer"), _pick(LAYERS, F.floor(k / 8) % 8).alias("other"), _pick(SLABS, k % 6).alias("slab"), "p_size", _pick(("beam", "wall", "slab", "roof"), k % 4).alias("kind"))
    size = D.with_defaults(F.col("kind"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    layer = F.col("layer")
    return rows.select(
        "k", D.bid_file_class(F.col("file")).alias("file_class"), D.wall_group(layer).alias("wall_group"), D.layer_family(F.array(F.coalesce(layer, F.lit("")), F.coalesce("other", F.lit("")))).alias("family"),
        D.layer_matches(F.coalesce(layer, F.lit("")), ["wall", "beam"], ["^x"]).alias("included"), D.slab_class(F.col("slab"), F.lit(None).cast("string"), F.when(F.col("p_size") % 9 == 0, "LANDING")).alias("slab_class"),
        T.layer_token(F.coalesce(layer, F.lit(""))).alias("token"), size["width"].alias("width"), size["depth"].alias("depth"))


@query("""WITH n AS (SELECT p_partkey AS k, p_size AS z, p_retailprice AS price FROM part)
SELECT k, CASE WHEN k % 3 = 0 THEN -1 ELSE z END AS page, CASE WHEN k % 10 <= 3 THEN 'x' || repeat('é', k % 10) ELSE 'xééé' END AS cut,
       CASE k % 3 WHEN 0 THEN (z * 100)::DOUBLE / 1000 WHEN 1 THEN z::DOUBLE ELSE -z::DOUBLE END AS elevation, z::DOUBLE AS bottom, (z + 3)::DOUBLE AS top,
       CASE k % 3 WHEN 0 THEN 'B' || z WHEN 1 THEN z || 'F' ELSE 'RF' END AS floor, CASE WHEN k % 7 = 0 THEN 0 ELSE least(6, length((k * k)::VARCHAR)) END AS band,
       sha256('["t' || z || '","s' || k || '"]') AS memory, CASE WHEN k % 2 = 0 THEN z::VARCHAR ELSE z || '-' || (z + 0.5)::VARCHAR END AS range_text
FROM n""")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    page = F.when(k % 3 == 0, "no page").otherwise(F.concat(F.lit("intro\n# Page "), s(z), F.lit("\n\ntext")))
    elevation = F.when(k % 3 == 0, F.concat(F.lit("标高 +"), s(z * 100), F.lit(" mm"))).when(k % 3 == 1, F.concat(F.lit("±"), s(z), F.lit(" m"))).otherwise(F.concat(F.lit("H -"), s(z), F.lit("M")))
    floor = F.when(k % 3 == 0, F.concat(F.lit(" b"), s(z))).when(k % 3 == 1, F.concat(s(z), F.lit(" f"))).otherwise("rf")
    levels = T.level_range(F.concat(s(z), F.lit("~"), s(z + 3)))
    z_double = z.cast("double")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), T.page_number(page, F.lit(-1)).alias("page"), T.utf8_cut(F.concat(F.lit("x"), F.repeat(F.lit("é"), (k % 10).cast("int"))), 8).alias("cut"), T.elevation_value(elevation).alias("elevation"),
        levels["bottom"].alias("bottom"), levels["top"].alias("top"), T.floor_code(floor).alias("floor"), T.count_band(F.when(k % 7 == 0, 0).otherwise(k * k)).alias("band"),
        T.memory_key(F.concat(F.lit("t"), s(z)), F.concat(F.lit("s"), s(k))).alias("memory"), T.range_text(z_double, F.when(k % 2 == 0, z_double).otherwise(z_double + 0.5)).alias("range_text"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN (p_size + 1)::DOUBLE WHEN 2 THEN (p_size * 2)::DOUBLE WHEN 3 THEN (p_size * 10)::DOUBLE END AS thickness,
       CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS a FROM part""")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    one = lambda key, value: F.create_map(F.lit(key), value)
    props = F.when(k % 5 == 0, one("Thickness", F.concat(F.lit(" "), z.cast("string")))).when(k % 5 == 1, F.create_map(F.lit("Thickness"), F.lit("0"), F.lit("Width"), (z + 1).cast("string"))).when(k % 5 == 2, one("厚度", (z * 2).cast("string")))
    props = props.when(k % 5 == 3, one("Reference", F.concat(F.lit("W "), (z * 10).cast("string"), F.lit(" mm")))).otherwise(one("Thickness", F.lit("thin")))
    raw = F.when(z % 2 == 0, F.concat(F.lit('{"a": '), z.cast("string"), F.lit("}"))).when(z % 3 == 0, "{broken").otherwise(None)
    return table(spark, sf_dir, "part").select(k.alias("k"), D.wall_thickness(props).alias("thickness"), P.json_or(raw, "a int", F.struct(F.lit(-1).alias("a")))["a"].alias("a"))


TENANT_SQL = "own AS (SELECT c_custkey AS k, c_mktsegment AS tenant_id, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'p' || c_nationkey END AS project_id FROM customer)"


@query(f"WITH {TENANT_SQL} SELECT k, project_id IS NULL AS strict_none, project_id IS NOT DISTINCT FROM 'p4' AS strict_p4, project_id IS NULL AS lenient_none, project_id IS NULL OR project_id = 'p4' AS lenient_p4 FROM own WHERE tenant_id = 'BUILDING'")
def tenant_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("tenant_id"), F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))).alias("project_id"))
    mine = P.tenant_rows(rows, "BUILDING").unionByName(P.tenant_rows(rows, None))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return mine.select("k", P.project_strict(None).alias("strict_none"), P.project_strict("p4").alias("strict_p4"), flag(P.project_lenient(None)).alias("lenient_none"), flag(P.project_lenient("p4")).alias("lenient_p4"))


@query(f"WITH {X.PRICE_SQL} SELECT ord, material, market FROM price WHERE contains(material, '砂') AND market LIKE '%1'")
def prices_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prices_like(X.price_rows(spark, sf_dir), "砂", "%1").select("ord", "material", "market")


@query("""SELECT c.l_orderkey AS doc_id, c.l_linenumber AS line, count(*) AS n, count(d.o_custkey) AS known FROM lineitem c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 < 2) d ON d.o_orderkey = c.l_orderkey AND d.o_orderkey % 2 = c.l_linenumber % 2 GROUP BY ALL""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("long").alias("tenant_id"), F.col("l_linenumber").alias("line"))
    documents = table(spark, sf_dir, "orders").filter("o_orderkey % 4 < 2").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 2).cast("long").alias("tenant_id"), "o_custkey")
    return model.with_documents(chunks, documents).groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.count("o_custkey").alias("known"))


@query("SELECT n_nationkey AS project_id, c_custkey AS level_id, c_acctbal AS elevation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def tenant_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("level_id"), F.col("c_acctbal").alias("elevation"))
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").cast("string").alias("tenant_id"))
    return model.project_levels(levels, projects, "2").select("project_id", "level_id", "elevation")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, count(*) FILTER (l_suppkey % 2 = 0) AS uncited FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY ALL""")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    known = table(spark, sf_dir, "part").filter("p_size < 25").select("p_partkey")
    lost = P.unknown_references(lines, "l_partkey", known, "p_partkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"))
    uncited = retrieval.uncited(lines.filter("l_suppkey % 2 = 0"), known.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("uncited"))
    return lost.join(uncited, ["l_orderkey", "l_linenumber", "l_partkey"], "left").na.fill(0, ["uncited"])


@query("""WITH a AS (SELECT o_orderkey AS k, [o_orderkey % 3, o_orderkey % 5] AS x, [o_orderkey % 4, o_orderkey % 3] AS y FROM orders)
SELECT k, array_to_string([v FOR v, i IN list_concat(x, y) IF list_position(list_concat(x, y), v) = i], ',') AS seen, array_to_string(list_sort(list_intersect(x, y)), ',') AS both, list_has_any(x, y) AS meet, coalesce(CASE WHEN k % 2 = 0 THEN k END, CASE WHEN k % 3 = 0 THEN -k END, 0) AS present FROM a""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y = F.array(k % 3, k % 5), F.array(k % 4, k % 3)
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    present = model.first_present(F.when(k % 2 == 0, k), F.when(k % 3 == 0, -k), F.lit(0).cast("long"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), text(model.first_seen(F.array(x, y))).alias("seen"), text(F.array_sort(model.shared(x, y))).alias("both"), model.frames_interact(x, y).alias("meet"), present.alias("present"))


@query("""SELECT coalesce(o.k, n.k) AS k, coalesce(n.s, o.s) AS summary, CASE WHEN n.k IS NOT NULL AND o.k IS NOT NULL THEN o.v + 1 ELSE coalesce(o.v, 1) END AS version
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, (o_orderkey % 5)::INT AS v FROM orders WHERE o_orderkey % 3 <> 0) o
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS s FROM orders WHERE o_orderkey % 2 = 0) n ON n.k = o.k""")
def counted_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    old = orders.filter(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("summary"), (k % 5).cast("int").alias("version"))
    new = orders.filter(k % 2 == 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("summary"))
    return clean.upsert_counted(old, new, "k")


@query("""WITH s AS (SELECT o_custkey % 100 AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS b, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT o_orderkey AS k, first AS stored_k FROM orders LEFT JOIN s ON a = o_custkey % 100 AND b IS NOT DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END WHERE o_orderkey % 2 = 1""")
def earliest_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), (F.col("o_custkey") % 100).alias("a"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("b"))
    return clean.earliest_same(rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1"), ["a", "b"], [F.col("k")]).select("k", "stored_k")


STATES = ("queued", "running", "succeeded", "failed")


@query(f"""WITH o AS (SELECT o_orderkey AS k, 'running' AS status, o_orderpriority AS note FROM orders),
n AS (SELECT o_orderkey AS k, {_list(STATES)}[o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'n' || o_orderkey END AS note FROM orders WHERE o_orderkey % 3 = 0)
SELECT k, coalesce(n.status, o.status) AS status, coalesce(n.note, o.note) AS note, coalesce(n.status IN ('succeeded', 'failed'), false) AS finished FROM o LEFT JOIN n USING (k)""")
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    old = orders.select(k.alias("k"), F.lit("running").alias("status"), F.col("o_orderpriority").alias("note"), F.lit(None).cast("timestamp").alias("finished_at"))
    change = orders.filter(k % 3 == 0).select(k.alias("k"), _pick(STATES, k % 4).alias("status"), F.when(k % 5 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"))
    out = clean.update_keeping(old, change, "k", ["status", "note"], now=F.lit("2024-01-01").cast("timestamp"))
    return out.select("k", "status", "note", F.col("finished_at").isNotNull().alias("finished"))


@query("SELECT o_orderpriority AS source, epoch(TIMESTAMP '2001-07-31 12:00:00' - max(o_orderdate)::TIMESTAMP) >= 24 * 3600 AS stale, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders GROUP BY ALL")
def snapshot_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03 per source, K02, K06, K11, K12: a stale source's new snapshot is published as a version and read back."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    root, now = new_path(spark, "snapshot"), F.lit("2001-07-31 12:00:00").cast("timestamp_ntz")
    newest = orders.groupBy("source").agg(F.max("updated_at").alias("updated_at"))
    parts = []
    for r in orders.select("source").distinct().collect():  # five priorities
        parts.append(clean.is_stale(newest.filter(F.col("source") == r.source), now).withColumn("source", F.lit(r.source)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    clean.save_versioned(clean.snapshot(newest.limit(0), newest, True), root, "0002")
    clean.save_versioned(newest.limit(1), root, "0001")
    return spark.read.parquet(clean.newest_version(spark, root)).join(every, "source").select("source", "stale", F.date_format("updated_at", "yyyy-MM-dd").alias("newest"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' ELSE 'processing' END AS status, (o_orderkey % 7)::INT AS attempts, (o_orderkey % 4)::INT AS version FROM orders),
a AS (SELECT id, CASE WHEN id % 2 = 0 THEN (id % 4)::INT WHEN id % 5 <> 0 THEN NULL ELSE (id % 3)::INT END AS cv, CASE WHEN id % 2 = 1 THEN (id % 7)::INT END AS ca, id % 11 < 5 AS ok FROM r WHERE id % 10 <> 9),
j AS (SELECT r.*, ok, coalesce(status = 'processing' AND CASE WHEN cv IS NOT NULL THEN cv = version WHEN ca IS NOT NULL THEN ca = attempts ELSE false END, false) AS mine FROM r LEFT JOIN a USING (id))
SELECT id, CASE WHEN mine AND ok THEN 'published' WHEN mine AND attempts >= 5 THEN 'dead' WHEN mine THEN 'pending' ELSE status END AS status, CASE WHEN mine THEN version + 1 ELSE version END AS version,
       CASE WHEN mine AND NOT ok THEN 1 + id % 9 ELSE 0 END AS delay, CASE WHEN mine AND ok THEN NULL WHEN mine THEN repeat('e', (id % 3)::INT) ELSE 'old' END AS last_error FROM j""")
def outbox_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("o_orderkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(k.alias("id"), F.when(k % 3 == 0, "pending").otherwise("processing").alias("status"), (k % 7).cast("int").alias("attempts"), (k % 4).cast("int").alias("version"), now.alias("available_at"), F.lit("old").alias("last_error"), F.lit(None).cast("timestamp").alias("published_at"))
    acks = orders.filter(k % 10 != 9).select(k.alias("id"), F.when(k % 2 == 0, (k % 4).cast("int")).when(k % 5 == 0, (k % 3).cast("int")).alias("claim_version"), F.when(k % 2 == 1, (k % 7).cast("int")).alias("claim_attempts"), (k % 11 < 5).alias("ok"), F.repeat(F.lit("e"), (k % 3).cast("int")).alias("error"), (1 + k % 9).cast("int").alias("delay_seconds"))
    return log.settle_outbox(rows, acks, now).select("id", "status", "version", F.timestamp_diff("SECOND", now, F.col("available_at")).alias("delay"), "last_error")


RUN_SQL = """step AS (SELECT l_orderkey AS run_id, l_linenumber AS position, (l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT AS ord, ['succeeded', 'failed', 'waiting_human', 'succeeded'][l_suppkey % 4 + 1] AS status FROM lineitem),
last AS (SELECT run_id, position, max(ord) AS ord, max_by(status, ord) AS status FROM step GROUP BY ALL)"""


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), ((F.col("l_partkey") * 100000 + s) * 100 + F.col("l_quantity").cast("long")).alias("ord"), _pick(("succeeded", "failed", "waiting_human", "succeeded"), s % 4).alias("status"))


@query(f"""WITH {RUN_SQL},
start AS (SELECT run_id, coalesce(max(position) FILTER (run_id % 2 = 0 AND status = 'waiting_human'), 0) + 1 AS start FROM last GROUP BY ALL)
SELECT run_id, position, last.status, start FROM last JOIN start USING (run_id) WHERE position >= start AND status <> 'succeeded'""")
def run_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = log.last_attempts(run_steps(spark, sf_dir))
    start = log.resume_position(last, F.col("run_id") % 2 == 0)
    todo = log.steps_to_run(last.select("run_id", "position", "status"), last, start)
    return todo.join(start.select("run_id", F.col("position").alias("start")), "run_id").select("run_id", "position", "status", F.col("start").cast("long").alias("start"))


@query("""SELECT 'run-' || o_orderkey || ':step:' || i AS child_key, i AS position, ['plan', 'build', 'check'][i] AS step FROM orders, (VALUES (1), (2), (3)) t(i) WHERE i <= o_orderkey % 4""")
def composite_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    plans = table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), k.cast("string")).alias("idempotency_key"), F.slice(F.array(F.lit("plan"), F.lit("build"), F.lit("check")), F.lit(1), (k % 4).cast("int")).alias("steps"))
    return log.composite_children(plans).select("child_key", "position", "step")


@query("""WITH s AS (SELECT l_orderkey AS model_id, ['PASS', 'WARN', 'PASS', 'FAIL', 'PASS'][l_suppkey % 5 + 1] AS status, l_quantity AS quality, l_linenumber AS risks FROM lineitem)
SELECT model_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'WARN') AS n_warn, count(*) FILTER (status = 'FAIL') AS n_fail, round(avg(quality), 6) AS quality, sum(risks)::BIGINT AS risks,
       CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM s GROUP BY ALL""")
def model_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model_id"), _pick(("PASS", "WARN", "PASS", "FAIL", "PASS"), F.col("l_suppkey") % 5).alias("status"), F.col("l_quantity").alias("quality"), F.col("l_linenumber").alias("risks"))
    return stats.risk_report(steps).withColumn("quality", F.round("quality", 6))


@query("""WITH g AS (SELECT p_partkey AS k, (p_size % 11)::DOUBLE / 10 AS attach_rate, p_partkey % 6 AS n_x, p_partkey % 5 AS n_y, p_size AS extracted, p_partkey % 90 AS inserted, (p_partkey % 7)::DOUBLE / 10 AS floating_rate FROM part)
SELECT k, CASE WHEN n_x < 3 OR n_y < 3 THEN 'fail' WHEN attach_rate < 0.7 OR (inserted > 0 AND extracted / greatest(inserted, 1) < 0.5) THEN 'warn' ELSE 'pass' END AS verdict,
       CASE WHEN attach_rate >= 0.7 AND floating_rate < 0.3 THEN 'PASS' ELSE 'FAIL' END AS gate, CASE WHEN attach_rate >= 0.7 AND floating_rate <= 0.3 THEN 'PASS' ELSE 'FAIL' END AS older FROM g""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), ((z % 11) / 10).alias("attach_rate"), (k % 6).alias("n_x"), (k % 5).alias("n_y"), z.alias("extracted"), (k % 90).alias("inserted"), ((k % 7) / 10).alias("floating_rate"))
    both = stats.structure_gate(stats.geometry_gate(rows))
    older = stats.structure_gate(rows.select("k", "attach_rate", "floating_rate"), older=True).select("k", F.col("gate").alias("older"))
    return both.select("k", "verdict", "gate").join(older, "k")


@query("""WITH r AS (SELECT l_suppkey AS g, l_linenumber AS n, CASE WHEN l_quantity::INT % 5 = 0 THEN NULL WHEN l_quantity::INT % 7 = 0 THEN 0.0 ELSE l_quantity / 50 END AS confidence, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 100 + l_partkey % 3 * 50.5 END AS thickness, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 3 = 1 END AS paired FROM lineitem),
t AS (SELECT g, CASE WHEN thickness IS NULL THEN 'unknown' ELSE printf('%g', thickness::DOUBLE) END AS label, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS place FROM t)
SELECT r.g, round(avg((CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END < 0.7)::INT), 9) AS share, avg((CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END < 0.7)::INT) > 0.2 AS warns,
       count(*) FILTER (coalesce(paired, false)) AS paired_n, count(*) FILTER (NOT coalesce(paired, false)) AS unpaired_n, coalesce(sum(r.n) FILTER (coalesce(paired, false)), 0)::DOUBLE AS paired_length, coalesce(sum(r.n) FILTER (NOT coalesce(paired, false)), 0)::DOUBLE AS unpaired_length,
       count(*) FILTER (r.n <= 1) AS le_1, count(*) FILTER (r.n <= 4) AS le_4, any_value(p.label) AS common_label, any_value(p.n) AS common_n
FROM r JOIN p ON p.g = r.g AND p.place = 1 GROUP BY r.g""")
def supplier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, pk = F.col("l_quantity").cast("int"), F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_linenumber").cast("double").alias("n"), F.when(q % 5 == 0, None).when(q % 7 == 0, 0.0).otherwise(F.col("l_quantity") / 50).alias("confidence"),
        F.when(pk % 4 != 0, 100 + pk % 3 * 50.5).alias("thickness"), F.when(pk % 3 != 0, pk % 3 == 1).alias("paired"))
    out = stats.low_confidence_share(rows, ["g"]).withColumn("share", F.round("share", 9)).join(stats.paired_totals(rows, ["g"], length="n"), "g")
    out = out.join(stats.counters(rows, ["g"], "n").select("g", "le_1", "le_4"), "g")
    common = stats.thickness_counts(rows, ["g"]).filter("place = 1").select("g", F.col("label").alias("common_label"), F.col("n").alias("common_n"))
    return out.join(common, "g")


@query("""SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, 0) - coalesce(o.a, 0) AS delta_a, coalesce(n.b, 0) - coalesce(o.b, 0) AS delta_b, coalesce(o.a, 0) AS old_a, coalesce(n.b, 0) AS new_b
FROM (SELECT o_custkey AS k, count(*) AS a, sum(o_orderkey)::BIGINT AS b FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) o FULL JOIN (SELECT o_custkey AS k, count(*) AS a, sum(o_orderkey)::BIGINT AS b FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) n ON n.k = o.k""")
def version_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n: table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % n == 0).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"), F.sum("o_orderkey").alias("b"))
    return stats.delta(of(2), of(3), ["k"], ["a", "b"]).select("k", "delta_a", "delta_b", "old_a", "new_b")


@query("""SELECT l_partkey AS drawing, l_linenumber AS label, min_by(l_suppkey, (l_orderkey * 100 + l_quantity::BIGINT) * 100000 + l_suppkey)::DOUBLE AS local, median(l_quantity) AS page FROM lineitem GROUP BY ALL""")
def label_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("drawing"), F.col("l_linenumber").alias("label"), s.cast("double").alias("local"), F.col("l_quantity").alias("page"), ((F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long")) * 100000 + s).alias("ord"))
    return stats.label_medians(samples, ["drawing", "label"])


DIMENSIONS = tuple(D.BID_WEIGHTS)


@query(f"""WITH s AS (SELECT l_orderkey AS bid_id, {_list(DIMENSIONS)}[l_linenumber % 4 + 1] AS dimension, (l_partkey % 6 * 20)::DOUBLE AS score, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_suppkey % 3 AS n FROM lineitem),
w AS (SELECT bid_id, round(sum(score * CASE dimension {' '.join(f"WHEN '{d}' THEN {w}" for d, w in D.BID_WEIGHTS.items())} END), 1) AS weighted FROM s GROUP BY ALL),
i AS (SELECT bid_id, CASE WHEN score < 60 THEN 'high' WHEN score < 75 THEN 'medium' ELSE 'low' END AS priority, dimension, 'issue ' || t.i AS description, ord, t.i AS pos FROM s, (VALUES (0), (1)) t(i) WHERE t.i < n),
p AS (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ord, pos) AS place FROM i)
SELECT bid_id, weighted, priority, dimension, description FROM w LEFT JOIN (SELECT * FROM p WHERE place = 1) p USING (bid_id)""")
def bid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid_id"), _pick(DIMENSIONS, n % 4).alias("dimension"), (F.col("l_partkey") % 6 * 20).cast("double").alias("score"), ((n * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"), F.slice(F.array(F.lit("issue 0"), F.lit("issue 1")), F.lit(1), (F.col("l_suppkey") % 3).cast("int")).alias("issues"))
    first = rules.bid_issues(rows).filter("place = 1").select("bid_id", "priority", "dimension", "description")
    return rules.weighted_scores(rows).select("bid_id", F.round("weighted_score", 1).alias("weighted")).join(first, "bid_id", "left")


VERDICTS = ("pass", "reject", "review", "pass", "pass")


@query(f"""WITH v AS (SELECT o_orderkey AS k, {_list(VERDICTS)}[o_orderkey % 5 + 1] AS a, {_list(VERDICTS)}[o_custkey % 5 + 1] AS b, o_orderkey % 9 AS n, o_custkey % 6 AS m FROM orders)
SELECT k, CASE WHEN a = 'review' OR b = 'review' THEN 'review' WHEN a = 'reject' OR b = 'reject' THEN 'reject' ELSE 'pass' END AS verdict, least(n + m, 10) AS n_issues, least(n, 10) AS from_rules, n > 2 AND m < 5 AS passed, (n > 2)::INT + (m < 5)::INT AS n_ok FROM v""")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), _pick(VERDICTS, k % 5).alias("a"), _pick(VERDICTS, c % 5).alias("b"), (k % 9).alias("n"), (c % 6).alias("m"))
    said = lambda mark, n: F.array_repeat(F.lit(mark), F.col(n).cast("int"))
    rows = rules.model_checks(rows.withColumn("issues", rules.first_issues(said("rule", "n"), said("model", "m"))), {"rules": F.col("n") > 2, "model": F.col("m") < 5})
    return rows.select("k", rules.merged_verdict(F.col("a"), F.col("b")).alias("verdict"), F.size("issues").cast("long").alias("n_issues"), F.size(F.filter("issues", lambda x: x == "rule")).cast("long").alias("from_rules"), "passed", F.size(F.filter(F.map_values("checks"), lambda x: x)).alias("n_ok"))


@query("""WITH c AS (SELECT o_orderkey AS k, ['admin', 'user', 'guest', NULL, 'ghost'][o_orderkey % 5 + 1] AS role, ['read', 'write', 'drop'][o_custkey % 3 + 1] AS tool FROM orders)
SELECT k, role IS NULL OR role = 'admin' OR (role IN ('user', 'ghost') AND tool IN ('read', 'write')) OR (role = 'guest' AND tool = 'read') AS allowed FROM c""")
def tool_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _pick(("admin", "user", "guest", None, "ghost"), F.col("o_orderkey") % 5).alias("role"), _pick(("read", "write", "drop"), F.col("o_custkey") % 3).alias("tool"))
    acl = spark.createDataFrame([("admin", "*"), ("user", "read"), ("user", "write"), ("guest", "read")], "role string, tool string")
    return rules.access_allowed(calls, acl).select("k", "allowed")


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_partkey AS doc_key, max(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, 100 - score AS rerank FROM s WHERE doc_key % 3 = 0),
o AS (SELECT s.query_id, s.doc_key, row_number() OVER (PARTITION BY s.query_id ORDER BY coalesce(rerank, s.score) DESC, s.doc_key) AS rank FROM s LEFT JOIN r USING (query_id, doc_key)),
l AS (SELECT query_id, doc_key, 0.6 * score / 50 + 0.4 * CASE WHEN doc_key % 2 = 0 THEN (doc_key % 10)::DOUBLE / 10 ELSE 0.0 END AS score FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_key) AS legacy_rank FROM l WHERE round(score, 9) >= 0.45)
SELECT query_id, doc_key, rank, legacy_rank FROM (SELECT * FROM o WHERE rank <= 3) o FULL JOIN (SELECT query_id, doc_key, legacy_rank FROM m WHERE legacy_rank <= 2) m USING (query_id, doc_key)""")
def rerank_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_key"), "l_quantity")
    scores = dealt(items, "query_id").groupBy("query_id", "doc_key").agg(F.max("l_quantity").alias("score"))
    again = scores.filter("doc_key % 3 = 0").withColumn("score", 100 - F.col("score"))
    ranked = retrieval.rerank(scores.withColumn("rank", F.lit(0)), again, 3).select("query_id", "doc_key", "rank")
    old = scores.select("query_id", "doc_key", (F.col("score") / 50).alias("dense_score"), ((F.col("doc_key") % 10) / 10).alias("sparse_score"), (F.col("doc_key") % 2 == 0).alias("shared"))
    w = 0.6  # scores rounded alike in both engines before they are compared
    mixed = F.round(w * F.col("dense_score") + (1 - w) * F.when(F.col("shared"), F.col("sparse_score")).otherwise(0.0), 9)
    legacy = retrieval.legacy_hybrid(old.withColumn("dense_score", mixed / w).withColumn("shared", F.lit(False)).filter(mixed >= 0.45), 0.0, 2).select("query_id", "doc_key", F.col("rank").alias("legacy_rank"))
    return ranked.join(legacy, ["query_id", "doc_key"], "full")


@query("""SELECT o_orderkey AS run_id, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT o_orderkey, o_orderstatus, count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log, and its counts kept under their digest and read again."""
    log_path, cache = new_path(spark, "audit"), new_path(spark, "digests")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for odd in (0, 1):
        model.append(orders.filter(F.col("o_orderkey") % 2 == odd), log_path)
    build = lambda: spark.read.parquet(log_path).groupBy(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    model.cached_by_digest(spark, cache, "a1", build)
    return model.cached_by_digest(spark, cache, "a1", lambda: build().limit(0))
