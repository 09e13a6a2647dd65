import datetime as dt

import pytest
from pyspark.sql import functions as F

from girder.functions import text as T
from girder.operators import clean, diff, log, retrieval, rules, spatial, stats
from girder.plans import tables
from girder.sources import documents, drawings, prices

TS = dt.datetime


def test_guards(spark):
    rows = spark.createDataFrame([(1, "t", None, "global"), (2, "t", "p", "project"), (3, "u", "q", "tenant")], "id int, tenant_id string, project_id string, scope string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(tables.tenant_rows(rows, "t")) == [1, 2] and ids(tables.tenant_rows(rows, "")) == []
    assert ids(rows.filter(tables.project_strict(None))) == [1] and ids(rows.filter(tables.project_lenient("p"))) == [1, 2]
    null = F.lit(None).cast("string")
    assert ids(rows.filter(tables.scope_visible("tenant", None, null))) == [1, 3] and ids(rows.filter(tables.scope_visible("project", "p", null))) == [1, 2, 3] and ids(rows.filter(tables.scope_visible("global", None, F.lit("failed")))) == []
    j = spark.createDataFrame([(1, '{"a": 5}'), (2, '{"a": "5"}'), (3, "{}"), (4, "bad"), (5, '{"a": true}')], "id int, p string")
    assert ids(j.filter(tables.metadata_matches(F.col("p"), {"a": 5}))) == [1] and ids(j.filter(tables.metadata_matches(F.col("p"), {"a": "5"}))) == [2] and ids(j.filter(tables.metadata_matches(F.col("p"), {"a": True}))) == [5]
    assert tables.duplicate_keys(rows, ["tenant_id"]).count() == 1


def test_prices(spark):
    rows = [(1, "HRB400", "s", "西安", "3000", "3100", "元/吨", "05-01", "x"), (2, "螺纹钢", "s", "西安", "3200", "3300", "元/吨", "2001-05-01", "x"), (3, "铜", "", "", "1", "2", "", "", ""), (4, "铝", None, None, "5", "4", "", "", ""), (5, "玻璃", None, None, "bad", "4", "", "", "")]
    df = spark.createDataFrame(rows, "ord int, material string, spec string, market string, price_low string, price_high string, unit string, price_date string, source string")
    got = clean.clean_prices(df, "2001-06-15").collect()
    assert [(r.ord, r.material, r.price_low, r.price_date) for r in got] == [(1, "螺纹钢", 3000.0, "2001-05-01")]


def test_upserts(spark):
    old = spark.createDataFrame([("k1", 1, "a"), ("k2", 2, None)], "k string, id int, v string")
    new = spark.createDataFrame([("k2", 9, "n"), ("k3", 3, "c")], "k string, id int, v string")
    assert sorted(map(tuple, clean.upsert(old, new, ["k"], ["v"]).collect())) == [("k1", 1, "a"), ("k2", 2, "n"), ("k3", 3, "c")]
    counted = clean.upsert_counted(spark.createDataFrame([("s", "old", 3)], "k string, summary string, version int"), spark.createDataFrame([("s", None), ("t", "x")], "k string, summary string"), "k")
    assert sorted(map(tuple, counted.collect())) == [("s", "old", 4), ("t", "x", 1)]
    assert clean.insert_absent(old, new, ["k"]).collect()[0].k == "k3"
    assert clean.snapshot(old, new.limit(0), True).count() == 2 and clean.snapshot(old, new.filter("k = 'k3'"), True).count() == 1
    kept = clean.update_keeping(spark.createDataFrame([("b", "running", "q", None)], "k string, status string, quality string, finished_at string"), spark.createDataFrame([("b", "succeeded", None)], "k string, status string, quality string"), "k", ["status", "quality"], now=F.lit("now"))
    assert tuple(kept.collect()[0]) == ("b", "succeeded", "q", "now")
    row = lambda i, c, o, s="base": (i, c, s, o)
    schema = "element_id string, confidence double, source string, ord int"
    merged = clean.merge_by_confidence(spark.createDataFrame([row("a", 0.5, 1), row("b", 0.9, 2), row("", 1.0, 3)], schema), spark.createDataFrame([row("a", 0.5, 1), row("b", 0.1, 2), row("c", 0.2, 3)], schema))
    assert sorted((r.element_id, r.confidence, r.source) for r in merged.collect()) == [("a", 0.5, "merged"), ("b", 0.9, "merged"), ("c", 0.2, "merged")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert clean.newest_version(spark, root) is None
    clean.save_versioned(spark.range(3), root, "001")
    path = clean.save_versioned(spark.range(5), root, "002")
    assert clean.newest_version(spark, root).endswith("version=002") and spark.read.parquet(path).count() == 5


def test_hard_rules(spark):
    schema = "ord int, element_id string, ifc_type string, name string, source string, has_geometry boolean, element_category string, properties map<string,string>"
    rows = [
        (1, "w", "IFCWALL", "w", "drawing", False, None, {"Thickness": "0", "Material": "c"}), (2, "g", "IFCWALL", "w", "ifc_parse", True, None, {"Material": "c"}),
        (3, "s", "IFCSLAB", "s", "drawing", False, None, {"Thickness": "90", "Elevation": "3"}), (4, "f", "IFCSLAB", "f", "drawing", False, "finishing", {}),
        (5, "c", "IFCCOLUMN", "未命名", "drawing", False, None, {"Width": "300", "Grade": "C30"}), (6, "b", "IFCBEAM", "b", "drawing", False, "non_structural", {}),
    ]
    df = spark.createDataFrame(rows, schema)
    hits = {(r.element_id, r.rule_id) for r in rules.check_rules(df).collect()}
    assert hits == {("w", "HR-001"), ("s", "HR-005"), ("c", "HR-003"), ("b", "HR-004")}
    assert ("b", "HR-004") not in {(r.element_id, r.rule_id) for r in rules.check_rules(df, model_input=False).collect()}


def test_procurement(spark):
    items = [("o1", 1, "x", 1.0, 9999.0, "吨", 9999.0, "元/吨"), ("o2", 2, "x", 1.0, 5000.0, "吨", None, None), ("o3", 3, "x", 10.0, 10000.0, "吨", 10000.0, "元/吨"), ("o4", 4, " ", 0.0, 0.0, "方", 13.0, "元/吨"), ("o5", 5, "x", 1.0, 130.0, "吨", 100.0, "元/吨"), ("o6", 6, "x", 1.0, 131.0, "吨", 100.0, "元/吨")]
    df = spark.createDataFrame(items, "order_no string, ord int, material_name string, quantity double, unit_price double, unit string, market_price double, market_unit string")
    reviewed = rules.review_items(df)
    got = {r.order_no: list(r.issues) for r in reviewed.collect()}
    assert got == {"o1": [], "o2": ["red_line"], "o3": ["large_amount"], "o4": ["name_missing", "quantity", "price", "unit_differs"], "o5": [], "o6": ["price_deviates"]}
    tiers = {r.order_no: r.tier for r in rules.approval_tier(rules.review_orders(reviewed)).collect()}
    assert tiers["o1"] == "auto_approved" and tiers["o5"] == "auto_approved" and tiers["o2"] == "waiting_human"
    assert spark.range(1).select(rules.merged_verdict(F.lit("pass"), F.lit("reject")), rules.merged_verdict(F.lit("review"), F.lit("reject"))).first()[0:2] == ("reject", "review")


def test_bids(spark):
    files = spark.createDataFrame([("b", 1, "投标函.pdf", "投标函 营业执照 授权委托书 保证金"), ("b", 2, "x.pdf", "资质 法定代表人 100元")], "bid_id string, ord int, filename string, raw_text string")
    r = rules.review_bids(files).first()
    assert r.classes == ["商务标", "通用"] and r.hits == [] and not r.critical
    scores = spark.createDataFrame([("b", 1, "技术方案", 80.0, ["t1"]), ("b", 2, "商务响应", 50.0, ["s1", "s2"]), ("b", 3, "资质业绩", 70.0, []), ("b", 4, "合规风险", 90.0, ["r"])], "bid_id string, ord int, dimension string, score double, issues array<string>")
    assert rules.weighted_scores(scores).first().weighted_score == 69.0
    assert [(x.priority, x.description) for x in rules.bid_issues(scores).orderBy("place").collect()] == [("high", "s1"), ("high", "s2"), ("low", "t1"), ("low", "r")]


def test_access(spark):
    acl = spark.createDataFrame([("admin", "*"), ("user", "search")], "role string, tool string")
    calls = spark.createDataFrame([("t", None), ("t", "admin"), ("search", "guest"), ("t", "user")], "tool string, role string")
    assert {(r.tool, r.role): r.allowed for r in rules.access_allowed(calls, acl).collect()} == {("t", None): True, ("t", "admin"): True, ("search", "guest"): True, ("t", "user"): False}


def test_fixed_windows_and_breaker(spark):
    at = lambda s: TS(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", i, at(s)) for i, s in enumerate([0, 30, 59, 60, 61, 121])] + [("j", 9, at(5))]
    df = spark.createDataFrame(rows, "key string, id int, ts timestamp_ntz")
    assert {(r.key, r.id): r["count"] for r in log.fixed_window_counts(df, "key", "ts", "id", 60).collect()} == {("k", 0): 1, ("k", 1): 2, ("k", 2): 3, ("k", 3): 1, ("k", 4): 2, ("k", 5): 1, ("j", 9): 1}
    calls = [("k", i, at(i), True) for i in range(5)] + [("k", 5, at(10), False), ("k", 6, at(34), True), ("k", 7, at(40), False), ("k", 8, at(64), False)]
    df = spark.createDataFrame(calls, "key string, id int, ts timestamp_ntz, bad boolean")
    got = [(r.before, r.after) for r in log.breaker_trace(df, "key", "ts", "id", F.col("bad")).orderBy("id").collect()]
    assert got == [("closed", "closed")] * 4 + [("closed", "open"), ("open", "open"), ("half_open", "open"), ("open", "open"), ("half_open", "closed")]


def test_outbox(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    old = TS(2024, 1, 1)
    rows = [(1, "pending", old, old, None, 0, 1, None), (2, "processing", old, old, old, 4, 7, None), (3, "processing", old, old, TS(2024, 1, 1, 0, 9, 30), 1, 1, None), (4, "pending", old, TS(2024, 1, 2), None, 0, 1, None)]
    schema = "id int, status string, created_at timestamp_ntz, available_at timestamp_ntz, published_at timestamp_ntz, attempts int, version int, last_error string"
    claimed = log.claim_outbox(spark.createDataFrame(rows, schema), now)
    assert sorted((r.id, r.attempts, r.version) for r in claimed.collect()) == [(1, 1, 2), (2, 5, 8)]
    acks = spark.createDataFrame([(1, 2, None, True, None, None), (2, 8, None, False, "boom", 5), (3, None, None, True, None, None)], "id int, claim_version int, claim_attempts int, ok boolean, error string, delay_seconds int")
    done = log.settle_outbox(claimed.unionByName(spark.createDataFrame(rows[2:3], schema)), acks, now)
    assert {r.id: r.status for r in done.collect()} == {1: "published", 2: "dead", 3: "processing"}


def test_conversations(spark):
    turns = spark.createDataFrame([("c", i, "q" * (i + 1), "a" * 200) for i in range(1, 41)], "conv_id string, seq int, user_text string, answer string")
    digest = {r.seq: r.digest for r in log.rolling_digest(turns).collect()}
    assert digest[10] == "" and digest[11].count("\n") == 0 and digest[40].count("\n") == 19 and digest[40].startswith("用户：" + "q" * 12)
    rounds = spark.createDataFrame([("c", i, i in (1, 2, 5)) for i in range(8)], "conv_id string, turn int, ready boolean")
    assert [r.stage for r in log.stage_machine(rounds, ["quote", "tech", "sign"]).orderBy("turn").collect()] == ["quote", "tech", "tech", "tech", "tech", "sign", "sign", "done"]
    follow = spark.createDataFrame([("c", 1, "混凝土的养护时间要求"), ("c", 2, "那价格呢"), ("c", 3, "另一个完整的独立问题")], "conv_id string, turn int, text string")
    assert [r.contextual for r in log.follow_ups(follow).orderBy("turn").collect()] == ["混凝土的养护时间要求", "混凝土的养护时间要求\n追问：那价格呢", "另一个完整的独立问题"]
    runs = log.clause_runs(spark.createDataFrame([(1, "审核合同，合同条款；采购水泥")], "k int, text string"), ["k"]).orderBy("run").collect()
    assert [(r.intent, r["query"]) for r in runs] == [("contract_review", "审核合同；合同条款"), ("procurement_query", "采购水泥")]


def test_live_values(spark):
    at = lambda s: TS(2024, 1, 1) + dt.timedelta(seconds=s)
    writes = spark.createDataFrame([("k", at(0), "a"), ("k", at(50), "b")], "key string, ts timestamp_ntz, value string")
    reads = spark.createDataFrame([("k", at(10), 1), ("k", at(60), 2), ("k", at(110), 3), ("k", at(111), 4), ("x", at(1), 5)], "key string, ts timestamp_ntz, read_id long")
    assert {r.read_id: r.value for r in log.live_values(reads, writes, "key", 60).collect()} == {1: "a", 2: "b", 3: "b", 4: None, 5: None}


def test_model_diff(spark):
    schema = "element_id string, ifc_type string, name string, properties map<string,string>, location string"
    base = spark.createDataFrame([("a", "IFCWALL", "n", {"T": "240", "M": "x"}, "F1"), ("b", "IFCWALL", "n", {}, None)], schema)
    built = spark.createDataFrame([("a", "ifcwall", "m", {"T": "240.0"}, "F2"), ("c", "IFCWALL", "n", {}, None)], schema)
    assert {(r.element_id, r.kind, r.prop) for r in diff.model_diff(base, built).collect()} == {("a", "name_mismatch", ""), ("a", "property_missing", "M"), ("a", "location_mismatch", ""), ("b", "missing", ""), ("c", "extra", "")}
    sets = F.create_map(F.lit("s"), F.create_map(F.lit("k"), F.lit("1")), F.lit("t"), F.create_map(F.lit("k"), F.lit("2")))
    flat = spark.range(1).select(diff.flatten_properties(sets, F.create_map(F.lit("q"), F.create_map(F.lit("w"), F.lit("3"))), F.array(F.lit("c"), F.lit("d"))).alias("m")).first().m
    assert flat == {"k": "2", "w": "3", "Material": "c、d"}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "art party art"), (2, "part of it"), (3, "nothing here")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "art zz")], "query_id int, query string")
    got = {r.doc_key: r.score for r in retrieval.bm25(docs, q, "doc_id").collect()}
    import math

    n, avg = 3, (3 + 3 + 2) / 3
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    score = lambda tf, length: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    assert set(got) == {1, 2} and math.isclose(got[1], score(3, 3)) and math.isclose(got[2], score(1, 3))
    ranked = retrieval.rerank(spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.1, 3)], "query_id int, doc_key long, score double, rank int"), spark.createDataFrame([(0, 3, 5.0)], "query_id int, doc_key long, score double"), 2)
    assert [r.doc_key for r in ranked.orderBy("rank").collect()] == [3, 1]
    assert spark.range(1).select(retrieval.shares_entity(F.array(F.lit("施工规"), F.lit("女儿墙")), F.array(F.lit("施工规")))).first()[0] is False


def test_stats(spark):
    cols = spark.createDataFrame([("d", v, i) for i, v in enumerate([3.0, 1.0, 3.0, 1.0])], "g string, v double, ord int")
    assert stats.mode_first(cols, ["g"], "v", "ord").first().mode == 3.0
    assert stats.line_fit(spark.createDataFrame([("a", 1.0, 2.0)], "g string, x double, y double"), ["g"]).first().slope is None
    seg = spark.createDataFrame([("d", 0.0, 0.0, 10.0, 0.0), ("d", 0.0, 0.0, 0.0, 4.0), ("d", 0.0, 0.0, 3.0, 3.0)], "g string, x1 double, y1 double, x2 double, y2 double")
    assert stats.dominant_rotation(seg, ["g"]).first().rotation == 0.0
    thick = spark.createDataFrame([("g", 200.0), ("g", 200.04), ("g", None)], "g string, thickness double")
    assert [(r.label, r.n) for r in stats.thickness_counts(thick, ["g"]).orderBy("place").collect()] == [("200", 2), ("unknown", 1)]
    gate = spark.createDataFrame([(0.7, 0.3)], "attach_rate double, floating_rate double")
    assert stats.structure_gate(gate).first().gate == "FAIL" and stats.structure_gate(gate, older=True).first().gate == "PASS"
    ents = spark.createDataFrame([("d", i, "A-Wall", "LINE", None) for i in range(12)] + [("d", 20, "cols", "CIRCLE", "B 1")], "drawing_id string, ord int, layer string, entity_type string, block string")
    f = stats.fingerprint(ents).first()
    assert f.active_layers == ["AWALL", "COLS"] and f.blocks == ["B1"] and [(b.entity_type, b.band) for b in f.bands] == [("CIRCLE", 1), ("LINE", 2)]


def test_strict_matching(spark):
    left = spark.createDataFrame([(1,), (2,)], "l int")
    right = spark.createDataFrame([(7,), (8,)], "r int")
    good = spark.createDataFrame([(1, 7), (2, 8)], "l int, r int")
    assert spatial.strict_one_to_one(left, right, good, "l", "r").count() == 2
    with pytest.raises(Exception, match="not one to one"):
        spatial.strict_one_to_one(left, right, good.filter("l = 1"), "l", "r").collect()


PAGE = '<tr><td class="t3">P.O42.5</td> <td class="t2">西安</td>\n<td class="t3"> 310 - 330 </td><td class="t2">05-01</td></tr><td class="t3">水泥</td><td class="t2">上海</td><td class="t3">—</td><td class="t2">05-02</td>'


def test_price_sources(spark):
    got = prices.page_prices(spark.createDataFrame([(1, PAGE)], "id int, html string"), "html", F.lit("水泥"), F.lit("元/吨"), "web").collect()
    assert [(r.spec, r.market, r.price_low, r.price_high) for r in got] == [("P.O42.5", "西安", 310.0, 330.0)]
    fields = ["螺纹钢连续"] + ["1"] * 7 + ["0"] + ["3"] * 7 + ["螺纹钢", "2024-01-02"]
    fields[2] = "3500"
    feed = f'var hq_str_nf_RB0="{",".join(fields)}";var hq_str_nf_X="";var hq_str_nf_Y="a,b";'
    q = prices.quotes(spark.createDataFrame([(1, feed)], "id int, body string"), "body", "2024-01-09").collect()
    assert [(r.material, r.price_low, r.price_date) for r in q] == [("螺纹钢", 3500.0, "2024-01-02")]


def test_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "a.md").write_bytes("# T\n\nbody\xff".encode("latin-1"))
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.bin").write_text("x")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "e.ifc").write_text("#1=IFCWALL('GID1',#2,'Wall A',$,$);\n#2=IFCOWNERHISTORY('x');\n#3= IFCBEAM('GID2',#2,$,'d''e');")
    docs = documents.read_documents(spark, str(tmp_path))
    good = {r.path.rpartition("/")[2]: r.content for r in documents.good(docs).collect()}
    assert good == {"a.md": "# T\n\nbody�", "d.docx": "one\nx | y", "e.ifc": "IFCWALL | GID1 | Wall A | \nIFCBEAM | GID2 |  | d'e"}
    assert documents.quarantine(docs).count() == 2


DXF = "0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n10\n1.0\n20\n0.0\n0\nLINE\n8\nW\n10\n1.0\n20\n0.0\n11\n2.0\n21\n0.0\n0\nINSERT\n2\nB\n10\n0\n20\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nA\n10\n0\n20\n0\n11\n5\n21\n0\n0\nINSERT\n2\nB\n10\n10.0\n20\n10.0\n50\n90\n41\n2\n42\n2\n0\nTEXT\n8\nT\n10\n1\n20\n2\n1\nhello\n0\nENDSEC\n0\nEOF\n"


def test_drawings(spark, tmp_path):
    (tmp_path / "x.dxf").write_text(DXF)
    rows = drawings.read_dxf(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.kind, r.layer, r.block_path) for r in rows] == [("LINE", "A", ""), ("LINE", "W", "B"), ("TEXT", "T", "")]
    assert [round(v, 9) for v in (rows[1].x1, rows[1].y1, rows[1].x2, rows[1].y2)] == [10.0, 10.0, 10.0, 12.0]


def test_loose_json(spark):
    cases = {'```json\n{"a": 1}\n```': {"a": 1}, 'say {"b": "}"} end': {"b": "}"}, "[1, 2]": None, "no": None, '{"x": {"y": "\\""}} {"z": 1}': {"x": {"y": '"'}}}
    for text, want in cases.items():
        assert drawings.loose_json(text) == want
    got = spark.createDataFrame([("x {\"b\": 1, \"a\": 2}",)], "t string").select(drawings.loose_json_column(F.col("t")).alias("j")).first().j
    assert got == '{"a":2,"b":1}'
    assert spark.createDataFrame([("[墙] 名称: W",)], "t string").select(drawings.line_id(F.col("t")).alias("j")).first().j.startswith("draw-")


def test_text_of_chunks(spark):
    assert spark.range(1).select(T.content_hash(F.lit(" a \n\n b "))).first()[0] == spark.range(1).select(F.sha2(F.lit("a\nb").cast("binary"), 256)).first()[0]
