"""Queries over prices, orders, bids, elements, conversations and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import text as T
from girder.operators import clean, diff, log, rules, stats
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.tables import table

_CLEAN = f"""WITH {X.PRICE_SQL},
norm AS (SELECT ord, {X.sql_material("upper(trim(material))")} AS material, spec, market, price_low, price_high, source, updated_at,
         CASE unit WHEN '元/立方米' THEN '元/方' WHEN '元/m³' THEN '元/方' WHEN '元/m3' THEN '元/方' WHEN '元/平方米' THEN '元/平米' WHEN '' THEN '元/吨' ELSE unit END AS unit,
         CASE WHEN price_date > '{X.AS_OF[5:]}' THEN '{int(X.AS_OF[:4]) - 1}-' ELSE '{X.AS_OF[:4]}-' END || price_date AS price_date FROM price),
good AS (SELECT * FROM norm WHERE price_low > 0 AND price_high >= price_low
         AND price_low >= CASE material {' '.join(f"WHEN '{m}' THEN {r[0]}" for m, r in D.PRICE_LIMITS.items())} ELSE 1 END
         AND price_high <= CASE material {' '.join(f"WHEN '{m}' THEN {r[1]}" for m, r in D.PRICE_LIMITS.items())} ELSE 1000000 END),
cleaned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material, spec, market, source, price_date ORDER BY ord) AS k FROM good) WHERE k = 1)
"""


@query(_CLEAN + "SELECT ord, material, spec, market, source, price_date, unit, price_low, price_high FROM cleaned")
def price_clean_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.clean_prices(X.price_rows(spark, sf_dir), X.AS_OF)
    return rows.select("ord", "material", "spec", "market", "source", "price_date", "unit", "price_low", "price_high")


@query(_CLEAN + "SELECT material, market, ord, price_low FROM (SELECT *, row_number() OVER (PARTITION BY material, market ORDER BY updated_at DESC, ord DESC) AS n FROM cleaned) WHERE n = 1")
def price_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.clean_prices(X.price_rows(spark, sf_dir), X.AS_OF)
    return clean.latest(rows, ["material", "market"], [F.col("updated_at"), F.col("ord")]).select("material", "market", "ord", "price_low")


@query(f"""WITH {X.PRICE_SQL}, item AS (SELECT DISTINCT ['钢筋', '砼', '砂', '铝', '铜'][p_size % 5 + 1] AS material_name, p_size AS item_id FROM part),
f AS (SELECT item.*, price.*, row_number() OVER (PARTITION BY item_id, material_name ORDER BY updated_at DESC, price_date DESC, ord DESC) AS n FROM item LEFT JOIN price ON contains(material, material_name))
SELECT item_id, material_name, round(CASE WHEN price_low > 0 AND price_high > 0 THEN (price_low + price_high) / 2 END, 1) AS market_price, unit AS market_unit FROM f WHERE n = 1""")
def price_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("钢筋", "砼", "砂", "铝", "铜")))
    items = table(spark, sf_dir, "part").select(F.col("p_size").alias("item_id"), F.get(names, F.col("p_size") % 5).alias("material_name")).distinct()
    return clean.lookup_price(items, X.price_rows(spark, sf_dir)).select("item_id", "material_name", F.round("market_price", 1).alias("market_price"), "market_unit")


@query(f"""WITH {X.PRICE_SQL},
o AS (SELECT material, spec, market, source, min(ord) AS id, min_by(price_low, ord) AS price_low FROM price WHERE ord % 2 = 0 GROUP BY ALL),
n AS (SELECT material, spec, market, source, max(ord) AS id, max_by(price_low, ord) AS price_low FROM price WHERE ord % 2 = 1 GROUP BY ALL)
SELECT material, spec, market, source, coalesce(o.id, n.id) AS id, coalesce(n.price_low, o.price_low) AS price_low FROM o FULL JOIN n USING (material, spec, market, source)""")
def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["material", "spec", "market", "source"]
    rows = X.price_rows(spark, sf_dir).select(*keys, F.col("ord").alias("id"), "price_low")
    old = clean.keep_first(rows.filter("id % 2 = 0"), keys, [F.col("id")])
    out = clean.upsert(old, rows.filter("id % 2 = 1"), keys, ["price_low"], [F.col("id")])
    return out.select(*keys, "id", "price_low")


@query("""
WITH o AS (SELECT doc_id, quality AS value, (doc_id % 7)::DOUBLE / 7 AS confidence FROM labels WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, toxic AS value, (doc_id % 5)::DOUBLE / 5 AS confidence FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id::VARCHAR AS element_id, CASE WHEN n.doc_id IS NOT NULL AND (o.doc_id IS NULL OR n.confidence >= o.confidence) THEN n.value ELSE o.value END AS value,
       round(CASE WHEN n.doc_id IS NOT NULL AND (o.doc_id IS NULL OR n.confidence >= o.confidence) THEN n.confidence ELSE o.confidence END, 9) AS confidence, CASE WHEN n.doc_id IS NULL THEN 'base' ELSE 'merged' END AS source
FROM o FULL JOIN n USING (doc_id)""")
def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    make = lambda df, value, k: df.select(F.col("doc_id").cast("string").alias("element_id"), F.col(value).alias("value"), (F.col("doc_id") % k / k).alias("confidence"), F.lit("base").alias("source"), F.col("doc_id").alias("ord"))
    out = clean.merge_by_confidence(make(l.filter("doc_id % 3 <> 0"), "quality", 7), make(l.filter("doc_id % 2 = 0"), "toxic", 5))
    return out.select("element_id", "value", F.round("confidence", 9).alias("confidence"), "source")


@query("""
SELECT count(*) AS calls, coalesce(sum(c_in), 0)::BIGINT AS input_chars, coalesce(sum(c_out), 0)::BIGINT AS output_chars, coalesce(sum(ms), 0)::BIGINT AS duration_ms, round(coalesce(sum(cost), 0)::DOUBLE, 4) AS cost
FROM (SELECT user_id * 100 AS c_in, user_id * 10 AS c_out, event_id % 500 AS ms, (user_id % 8)::DOUBLE / 8 AS cost FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR)""")
def call_stats_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("ts").alias("start_ts"), (F.col("user_id") * 100).alias("input_chars"), (F.col("user_id") * 10).alias("output_chars"), (F.col("event_id") % 500).alias("duration_ms"), (F.col("user_id") % 8 / 8).alias("cost"))
    return stats.call_stats(calls, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 24)


@query("SELECT conv_id, turn, floor(length(text) / 1.5::DOUBLE)::BIGINT AS tokens_in, floor(length(role) / 1.5::DOUBLE)::BIGINT AS tokens_out, floor(floor(length(text) / 1.5::DOUBLE) * 0.5::DOUBLE + floor(length(role) / 1.5::DOUBLE) * 2::DOUBLE + 0.5::DOUBLE) / 1000000 AS cost FROM conversations")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", D.call_cost(F.length("text"), F.length("role")).alias("c")).select("conv_id", "turn", "c.*")


_ITEMS = f"""WITH {X.ITEM_SQL},
i AS (SELECT *, quantity * unit_price AS amount, list_filter([
  CASE WHEN trim(material_name) = '' THEN 'name_missing' END, CASE WHEN quantity <= 0 THEN 'quantity' END, CASE WHEN unit_price <= 0 THEN 'price' END, CASE WHEN quantity * unit_price >= 100000 THEN 'large_amount' END,
  CASE WHEN market_price > 0 AND unit <> '吨' THEN 'unit_differs' END, CASE WHEN market_price > 0 AND unit = '吨' AND abs((unit_price - market_price) / market_price) > 0.30::DOUBLE THEN 'price_deviates' END,
  CASE WHEN market_price IS NULL AND unit_price >= 5000 THEN 'red_line' END], lambda x: x IS NOT NULL) AS issues FROM item)
"""


@query(_ITEMS + "SELECT ord, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) > 0 THEN 'review' ELSE 'pass' END AS verdict, amount FROM i")
def order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.review_items(X.order_items(spark, sf_dir)).select("ord", F.array_join("issues", ",").alias("issues"), "verdict", "amount")


@query(_ITEMS + """, o AS (SELECT order_no, count(*) AS n_items, sum(len(issues))::BIGINT AS n_issues, max(amount) AS largest, bool_or(len(issues) > 0) AS any_review FROM i GROUP BY 1)
SELECT order_no, n_items, n_issues, any_review, largest, CASE WHEN NOT any_review AND largest < 10000 THEN 'auto_approved' ELSE 'waiting_human' END AS tier FROM o""")
def order_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rules.approval_tier(rules.review_orders(rules.review_items(X.order_items(spark, sf_dir))))
    return orders.select("order_no", "n_items", "n_issues", "any_review", "largest", "tier")


#: English stand-ins for the bid's required materials, so that the fixture's texts can hold them.
_REQUIRED = (("letter", ("the ", "le ")), ("licence", ("der ", "la ")), ("proxy", ("ing",)))
_RISKS = ("###", "%%%")


_HOLDS = [" OR ".join(f"contains(t, '{w}')" for w in words) for _, words in _REQUIRED] + [" OR ".join(f"contains(t, '{w}')" for w in _RISKS)]


@query(f"""WITH t AS (SELECT doc_id AS bid_id, coalesce(text, '') AS t FROM documents), f AS (SELECT bid_id, t, NOT ({_HOLDS[0]}) OR NOT ({_HOLDS[1]}) OR NOT ({_HOLDS[2]}) OR {_HOLDS[3]} AS critical FROM t)
SELECT bid_id, critical, regexp_matches(t, '[0-9]+') AS has_amount, CASE WHEN critical THEN 'rejected' WHEN length(t) % 100 >= 80 THEN 'approved' WHEN length(t) % 100 >= 60 THEN 'review' ELSE 'rejected' END AS verdict,
       CASE WHEN critical OR length(t) % 100 < 60 THEN 'high' WHEN length(t) % 100 < 75 THEN 'medium' ELSE 'low' END AS risk FROM f""")
def bid_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27, P28 with stand-in words; a document is a bid."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bid_id"), F.coalesce("text", F.lit("")).alias("t"))
    out = t.withColumn("hits", D.disqualifications(F.col("t"), _REQUIRED, _RISKS, "[0-9]+")).withColumn("critical", F.exists("hits", lambda h: h["severity"] == "critical"))
    verdict = D.bid_verdict(F.length("t") % 100, F.col("critical"))
    return out.select("bid_id", "critical", (~F.exists("hits", lambda h: h["rule"] == "报价缺失")).alias("has_amount"), verdict["verdict"].alias("verdict"), verdict["risk_level"].alias("risk"))


_VIOLATIONS = f"""WITH {X.ELEMENT_SQL},
v AS (SELECT ord, element_id, unnest(list_filter([
  CASE WHEN ifc_type = 'IFCWALL' AND NOT (has_geometry AND source = 'ifc_parse') AND (thickness IS NULL OR thickness::DOUBLE <= 0) THEN 'HR-001' END,
  CASE WHEN ifc_type = 'IFCSLAB' AND element_category <> 'finishing' AND NOT (has_geometry AND source = 'ifc_parse') AND elevation IS NULL THEN 'HR-002' END,
  CASE WHEN ifc_type = 'IFCSLAB' AND element_category <> 'finishing' AND NOT (has_geometry AND source = 'ifc_parse') AND thickness::DOUBLE > 0 AND thickness::DOUBLE < 100 THEN 'HR-005' END,
  CASE WHEN ifc_type = 'IFCCOLUMN' AND NOT (has_geometry AND source = 'ifc_parse') THEN 'HR-006' END, CASE WHEN ifc_type = 'IFCBEAM' AND NOT (has_geometry AND source = 'ifc_parse') THEN 'HR-007' END,
  CASE WHEN name = '' THEN 'HR-003' END, CASE WHEN ifc_type IN ('IFCWALL', 'IFCCOLUMN', 'IFCBEAM') AND material IS NULL THEN 'HR-004' END], lambda x: x IS NOT NULL)) AS rule_id FROM element)
"""


@query(_VIOLATIONS + "SELECT element_id, rule_id FROM v")
def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_rules(X.elements(spark, sf_dir)).select("element_id", "rule_id")


@query(_VIOLATIONS + "SELECT rule_id, count(*) AS affected, min(ord) AS first_ord, array_to_string((list(element_id ORDER BY ord))[1:5], ',') AS examples FROM v GROUP BY 1")
def violation_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.check_rules(X.elements(spark, sf_dir))
    return rules.group_violations(found).select("rule_id", "affected", "first_ord", F.array_join("examples", ",").alias("examples"))


@query("""
WITH f AS (SELECT user_id AS report_id, CASE WHEN event_id % 7 = 0 THEN 'hard' ELSE 'soft' END AS track, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, value / 500 AS confidence FROM events WHERE event_type <> 'view'),
g AS (SELECT report_id, count(*) FILTER (track = 'hard') AS hard_count, count(*) FILTER (track = 'soft') AS soft_count, count(*) FILTER (track = 'hard' AND severity = 'critical') AS hard_critical_count, count(*) FILTER (track = 'soft' AND confidence < 0.6::DOUBLE) AS low_confidence_count, count(*) FILTER (severity = 'warning') AS w FROM f GROUP BY 1)
SELECT * EXCLUDE w, CASE WHEN hard_critical_count > 0 THEN 'high' WHEN w > 0 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN hard_count > 0 OR low_confidence_count > 0 THEN 'review' ELSE 'pass' END AS verdict FROM g""")
def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    rows = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("report_id"), F.when(F.col("event_id") % 7 == 0, "hard").otherwise("soft").alias("track"), severity.alias("severity"), (F.col("value") / 500).alias("confidence"))
    return rules.merge_reports(rows)


#: Intents with terms of the fixture's languages.
_TERMS = (("contract_review", ("thanti", "contract", "the a")), ("bim_command", ("revit", "der")), ("bid_query", ("que", "tion")), ("procurement_query", ("ing", "ung")))


def _intent_sql(text: str) -> str:
    clean_text = f"regexp_replace(lower({text}), '\\s+', '', 'g')"
    scored = []
    for i, (intent, words) in enumerate(_TERMS):
        words = ["".join(w.split()) for w in words]
        n = " + ".join(f"contains({clean_text}, '{w}')::INT" for w in words)
        weight = " + ".join(f"contains({clean_text}, '{w}')::INT * {len(w)}" for w in words)
        scored.append(f"{{'m': {n}, 'w': {weight}, 'o': {-i}, 'i': '{intent}'}}")
    return f"list_max([{', '.join(scored)}])"


@query(f"""WITH b AS (SELECT conv_id, turn, {_intent_sql('text')} AS b FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN b.m > 0 THEN b.i ELSE 'general_question' END AS intent, round(CASE WHEN b.m > 0 THEN least(0.98::DOUBLE, 0.58::DOUBLE + 0.1::DOUBLE * b.m + least(0.2::DOUBLE, b.w / 100)) ELSE 0.6::DOUBLE END, 9) AS confidence FROM b""")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", D.best_intent(F.col("text"), _TERMS).alias("b"))
    return rows.select("conv_id", "turn", "b.intent", F.round("b.confidence", 9).alias("confidence"))


@query(f"""
WITH c AS (SELECT conv_id, turn, list_filter([regexp_replace(x, '^[ \t.!?]+|[ \t.!?]+$', '', 'g') FOR x IN string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[,;\\n]')], lambda x: x <> '') AS c FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, unnest(c) AS clause, generate_subscripts(c, 1) - 1 AS pos FROM c WHERE len(c) <= 20),
i AS (SELECT *, CASE WHEN {_intent_sql('clause')}.m > 0 THEN {_intent_sql('clause')}.i ELSE 'general_question' END AS intent FROM e),
s AS (SELECT *, CASE WHEN lag(intent) OVER (PARTITION BY conv_id, turn ORDER BY pos) = intent THEN 0 ELSE 1 END AS st FROM i),
r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM s)
SELECT conv_id, turn, run::BIGINT AS run, intent, count(*) AS n_clauses, md5(string_agg(clause, '；' ORDER BY pos)) AS digest FROM r GROUP BY 1, 2, 3, 4""")
def clause_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    out = log.clause_runs(rows, ["conv_id", "turn"], terms=_TERMS)
    return out.select("conv_id", "turn", "run", "intent", "n_clauses", F.md5(F.col("query").cast("binary")).alias("digest"))


@query("""
WITH q AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(CASE WHEN before IS NOT NULL AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) <= 6 THEN left(left(before, 600) || chr(10) || '追问：' || text, 2000) ELSE text END) AS digest FROM q""")
def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.follow_ups(table(spark, sf_dir, "conversations").filter("role = 'user'"))
    return rows.select("conv_id", "turn", F.md5(F.col("contextual").cast("binary")).alias("digest"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn)::INT AS place FROM r WHERE role = 'system' OR b <= 4""")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "place")


@query("SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) // 2 AS rounds, count(*) FILTER (role IN ('user', 'assistant')) // 2 >= 2 AND count(*) FILTER (role IN ('user', 'assistant')) // 2 % 2 = 0 AS due FROM conversations GROUP BY 1")
def summary_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.summary_due(table(spark, sf_dir, "conversations"), 2)


@query("""
WITH t AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, '用户：' || event_type || '；历史回复（未复核）：' || props AS line FROM events)
SELECT conv_id, seq, md5(left(coalesce(array_to_string(list(line) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING), chr(10)), ''), 6000)) AS digest FROM t""")
def rolling_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.next_sequence(table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), "event_id", F.col("event_type").alias("user_text"), F.col("props").alias("answer")), None, "conv_id", ["event_id"])
    return log.rolling_digest(rows).select("conv_id", "seq", F.md5(F.col("digest").cast("binary")).alias("digest"))


@query("""
WITH o AS (SELECT user_id, max(event_id) AS top FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, e.user_id, coalesce(top, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS seq FROM events e LEFT JOIN o USING (user_id) WHERE event_id % 2 = 1""")
def next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    stored = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("seq"))
    return log.next_sequence(e.filter("event_id % 2 = 1"), stored, "user_id", ["event_id"])


_STATUS = {"click": "running", "error": "failed", "purchase": "succeeded", "signup": "queued", "view": "waiting_human"}


@query(f"""
WITH s AS (SELECT event_id, user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM s)
SELECT event_id, status, CASE WHEN previous IS NULL THEN status = 'queued' ELSE {' OR '.join(f"(previous = '{k}' AND status = '{x}')" for k, v in log.TRANSITIONS.items() for x in v)} END AS legal FROM l""")
def state_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = D.first_equal(F.col("event_type"), [(k, F.lit(v)) for k, v in _STATUS.items()], F.lit(None))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"))
    return log.check_transitions(rows, "user_id", ["event_id"]).select("event_id", "status", "legal")


@query("SELECT event_id, user_id FROM events WHERE event_id > 9000")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = T.event_cursor(F.lit("9000"), F.lit(100).cast("long"))
    return log.events_after(table(spark, sf_dir, "events"), cursor, "user_id", "event_id").select("event_id", "user_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn > 0) WHERE n <= 3")
def page_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest_page(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, F.lit(0)).select("conv_id", "turn", "place")


@query("""
WITH o AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'published' ELSE 'pending' END AS status, ts AS created_at, ts + INTERVAL 1 HOUR AS available_at, ts AS published_at, (event_id % 5)::INT AS attempts, event_id % 9 AS version FROM events)
SELECT id, 'processing' AS status, attempts + 1 AS attempts, version + 1 AS version FROM o
WHERE (status = 'pending' AND available_at <= TIMESTAMP '2024-01-15 00:00:00') OR (status = 'processing' AND published_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 SECOND) ORDER BY created_at, id LIMIT 50""")
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim takes at most 50, which is the operator's own limit."""
    status = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "click", "published").otherwise("pending")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("available_at"), F.col("ts").alias("published_at"), (F.col("event_id") % 5).cast("int").alias("attempts"), (F.col("event_id") % 9).alias("version"))
    return log.claim_outbox(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 50).select("id", "status", "attempts", "version")


@query("""
WITH w AS (SELECT user_id, ts, event_type AS value FROM events WHERE event_id % 3 = 0), r AS (SELECT user_id, ts, event_id AS read_id FROM events WHERE event_id % 3 = 1),
j AS (SELECT r.user_id, r.read_id, r.ts, w.ts AS wts, w.value FROM r ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.ts >= w.ts)
SELECT user_id, read_id, CASE WHEN epoch_us(ts) - epoch_us(wts) <= 3600::BIGINT * 1000000 * 6 THEN value END AS value FROM j""")
def ttl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    writes = e.filter("event_id % 3 = 0").select("user_id", "ts", F.col("event_type").alias("value"))
    reads = e.filter("event_id % 3 = 1").select("user_id", "ts", F.col("event_id").alias("read_id"))
    return log.live_values(reads, writes, "user_id", 6 * 3600).select("user_id", "read_id", "value")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, t AS start, t, 1::BIGINT AS count FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - f.start >= 86400000000 THEN e.t ELSE f.start END, e.t, CASE WHEN e.t - f.start >= 86400000000 THEN 1 ELSE f.count + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, count, start AS window_start_us FROM f""")
def fixed_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.fixed_window_counts(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400)


@query()
def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.breaker_trace(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type").isin("error", "view"), 3, 7200)


@query("""
WITH e AS (SELECT nation.*, n_regionkey AS project_id, n_name AS floor_code, n_nationkey * 3000 AS elevation FROM nation),
o AS (SELECT * FROM e WHERE n_nationkey % 2 = 0), n AS (SELECT project_id, CASE WHEN n_nationkey % 5 = 0 THEN 'NEW' || n_nationkey ELSE floor_code END AS floor_code, elevation + CASE WHEN n_nationkey % 4 = 0 THEN 100 ELSE 0 END AS elevation FROM e)
SELECT n.project_id, n.floor_code, n.elevation, CASE WHEN c.elevation = n.elevation THEN 'existing' WHEN c.elevation IS NOT NULL THEN 'code_has_other_elevation' WHEN v.floor_code IS NOT NULL THEN 'elevation_has_other_code' ELSE 'created' END AS status
FROM n LEFT JOIN o c ON c.project_id = n.project_id AND c.floor_code = n.floor_code LEFT JOIN o v ON v.project_id = n.project_id AND v.elevation = n.elevation""")
def level_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("project_id"), F.col("n_name").alias("floor_code"), (F.col("n_nationkey") * 3000).alias("elevation"))
    k = F.col("n_nationkey")
    new = e.select("project_id", F.when(k % 5 == 0, F.concat(F.lit("NEW"), k.cast("string"))).otherwise(F.col("floor_code")).alias("floor_code"), (F.col("elevation") + F.when(k % 4 == 0, 100).otherwise(0)).alias("elevation"))
    return clean.register_levels(e.filter(k % 2 == 0).drop("n_nationkey"), new)


_BUILT = f"""WITH {X.ELEMENT_SQL},
a AS (SELECT element_id, CASE WHEN ord % 17 = 0 THEN 'IFCDOOR' ELSE ifc_type END AS ifc_type, CASE WHEN ord % 19 = 0 THEN name || 'x' ELSE name END AS name, CASE WHEN ord % 23 = 0 THEN thickness || '.5' ELSE thickness || '.0' END AS thickness, CASE WHEN ord % 29 = 0 THEN NULL ELSE material END AS material, elevation FROM element WHERE ord % 31 <> 0
      UNION ALL SELECT 'x' || element_id, ifc_type, name, thickness, material, elevation FROM element WHERE ord % 37 = 0)
"""


@query(_BUILT + """, j AS (SELECT coalesce(element.element_id, a.element_id) AS id, element.element_id IS NULL AS extra, a.element_id IS NULL AS missing, element.ifc_type AS bt, a.ifc_type AS aty, element.name AS bn, a.name AS an, element.thickness AS b1, a.thickness AS a1, element.material AS b2, a.material AS a2 FROM element FULL JOIN a USING (element_id))
SELECT id AS element_id, d.kind AS kind, d.prop AS prop FROM (SELECT id, unnest(list_filter([
  CASE WHEN missing THEN {'kind': 'missing', 'prop': ''} END, CASE WHEN extra THEN {'kind': 'extra', 'prop': ''} END, CASE WHEN bt <> aty THEN {'kind': 'type_mismatch', 'prop': ''} END, CASE WHEN bn <> an THEN {'kind': 'name_mismatch', 'prop': ''} END,
  CASE WHEN NOT missing AND NOT extra AND b1 IS NOT NULL AND a1::DOUBLE <> b1::DOUBLE THEN {'kind': 'property_mismatch', 'prop': 'Thickness'} END, CASE WHEN NOT missing AND NOT extra AND b2 IS NOT NULL AND a2 IS NULL THEN {'kind': 'property_missing', 'prop': 'Material'} END], lambda x: x IS NOT NULL)) AS d FROM j)""")
def model_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.elements(spark, sf_dir)
    k, get = F.col("ord"), lambda n: F.try_element_at("properties", F.lit(n))
    props = {"Thickness": F.concat(get("Thickness"), F.when(k % 23 == 0, ".5").otherwise(".0")), "Material": F.when(k % 29 != 0, get("Material")), "Elevation": get("Elevation")}
    entries = lambda p: F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in p.items()])))
    same = base.filter(k % 31 != 0).select("element_id", F.when(k % 17 == 0, "IFCDOOR").otherwise(F.col("ifc_type")).alias("ifc_type"), F.when(k % 19 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), entries(props).alias("properties"), "location")
    extra = base.filter(k % 37 == 0).select(F.concat(F.lit("x"), "element_id").alias("element_id"), "ifc_type", "name", "properties", "location")
    return diff.model_diff(base, same.unionByName(extra))


@query("""
WITH e AS (SELECT p_brand AS group_id, p_partkey AS ord, 'n' || p_partkey AS name, (p_partkey * 10)::DOUBLE AS x, (p_partkey * 20)::DOUBLE AS y FROM part),
a AS (SELECT group_id, name, x + CASE WHEN ord % 7 = 0 THEN 150 ELSE 0 END AS ax, y - CASE WHEN ord % 11 = 0 THEN 100.5::DOUBLE ELSE 0 END AS ay FROM e WHERE ord % 13 <> 0),
d AS (SELECT group_id, ord, unnest(CASE WHEN a.name IS NULL THEN [{'kind': 'missing', 'axis': ''}] ELSE list_filter([CASE WHEN abs(x - ax) > 100 THEN {'kind': 'position', 'axis': 'x'} END, CASE WHEN abs(y - ay) > 100 THEN {'kind': 'position', 'axis': 'y'} END], lambda v: v IS NOT NULL) END) AS d FROM e LEFT JOIN a USING (group_id, name)),
r AS (SELECT group_id, ord, d.kind AS kind, d.axis AS axis, row_number() OVER (PARTITION BY group_id, d.kind ORDER BY ord, d.axis) AS n FROM d)
SELECT group_id, ord, kind, axis, CASE WHEN kind = 'position' THEN n <= 5 ELSE true END AS shown FROM r""")
def compare_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), k.alias("ord"), F.concat(F.lit("n"), k.cast("string")).alias("name"), k.alias("element_id"), (k * 10).cast("double").alias("x"), (k * 20).cast("double").alias("y"))
    o = F.col("ord")
    a = e.filter(o % 13 != 0).select("group_id", "name", (F.col("x") + F.when(o % 7 == 0, 150).otherwise(0)).alias("x"), (F.col("y") - F.when(o % 11 == 0, 100.5).otherwise(0)).alias("y"), "ord")
    return diff.compare_positions(e, a, 100.0, 5).select("group_id", "ord", "kind", "axis", "shown")


@query(_VIOLATIONS + """, n AS (SELECT v.*, element.name FROM v JOIN element USING (element_id)),
rn AS (SELECT *, ['HR-001', 'HR-002', 'HR-005', 'HR-006', 'HR-007', 'HR-003', 'HR-004'] AS o FROM n),
w AS (SELECT *, ord * 10 + list_position(o, rule_id) - 1 AS vo FROM rn),
i AS (SELECT element_id, list(rule_id ORDER BY vo)[1:5] AS l FROM w GROUP BY 1), m AS (SELECT name, list(rule_id ORDER BY vo)[1:5] AS l FROM w WHERE name <> '' GROUP BY 1)
SELECT element.element_id, array_to_string(list_concat(coalesce(i.l, []), coalesce(m.l, []))[1:5], ',') AS review FROM element LEFT JOIN i USING (element_id) LEFT JOIN m ON m.name = element.name""")
def inject_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.elements(spark, sf_dir)
    found = rules.check_rules(e).select("element_id", "name", "rule_id", "severity", (F.col("ord") * 10 + F.col("rule_ord")).alias("ord"))
    return diff.inject_findings(e, found).select("element_id", F.array_join(F.transform("review", lambda r: r["rule_id"]), ",").alias("review"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.streaming import windows

    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * i FOR i IN range(0, 4)]) AS s FROM events) GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.streaming import windows

    out = windows.sliding(table(spark, sf_dir, "events"), "ts", "24 hours", "6 hours", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.streaming import windows

    out = windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")
