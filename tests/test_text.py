import math
import re

import pytest
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import text as T
from girder.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def model_split(text, size=1200, overlap=150):
    """A plain model of the chunking rules."""
    out, now, heading = [], "", ""
    for p in [x.strip() for x in re.split(r"\n\s*\n", text.strip()) if x.strip()]:
        if re.match(r"#{1,6}\s+|第[一二三四五六七八九十百]+[章节条]", p):
            heading = p.split("\n")[0][:200]
        joined = f"{now}\n\n{p}" if now else p
        if len(joined) <= size:
            now = joined
        elif now:
            out.append(now)
            lead = f"{heading}\n\n" if heading and heading not in p else ""
            now = f"{lead}{now[-overlap:]}\n\n{p}".strip()
        else:
            out += [p[i:i + size] for i in range(0, len(p), size - overlap)]
    return [x for x in [*out, now] if x.strip()]


CHUNKS = [
    "", "  \n ", "short", "# H\n\nbody " + "x" * 900 + "\n\n" + "y" * 500 + "\n\n" + "z" * 1500, "a" * 2500, "a" * 1200, "a" * 1201,
    "第一章 总则\n\n" + "内容" * 700 + "\n\n" + "尾" * 30, "p\n \t\n" + "q" * 1190 + "\n\nr", "m" * 1300 + "\n\n" + "n" * 10,
]


def test_split_text(spark):
    rows = spark.createDataFrame(list(enumerate(CHUNKS)), "k int, t string").select("k", T.split_text(F.col("t")).alias("c")).orderBy("k").collect()
    for r, t in zip(rows, CHUNKS, strict=True):
        assert list(r.c) == model_split(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))), r.k


def test_normalize_and_strip(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="　a\r\nb\t\t c\n\n\n\nd　 ") == "a\nb c\n\nd"
    assert one(spark, T.strip(F.col("t")), t="\x1c x y　") == "x y"


def test_tokens(spark):
    assert one(spark, T.lexical_tokens(F.col("t")), t="HRB400 钢筋A价格 b?") == ["hrb400", "钢筋", "筋价", "价格", "钢筋价", "筋价格"]
    assert one(spark, T.lexical_tokens(F.col("t")), t="") == []
    assert one(spark, T.lexical_tokens(F.col("t")), t="怎么 的") == ["么的", "怎么的"]


def test_hash_embedding(spark):
    v = one(spark, T.hash_embedding(F.col("t")), t="ab abc")
    assert len(v) == 256 and math.isclose(sum(x * x for x in v), 1.0)
    assert sum(one(spark, T.hash_embedding(F.col("t")), t="")) == 0


def test_windows(spark):
    assert one(spark, T.fixed_windows(F.col("t")), t="   ") == []
    assert [len(x) for x in one(spark, T.fixed_windows(F.col("t")), t="x" * 6000)] == [3000, 3000, 400]


def test_utf8_cut(spark):
    for text in ("héllo", "钢筋混凝土", "a😀b", "abc", ""):
        for n in (1, 2, 3, 4, 5, 7):
            assert one(spark, T.utf8_cut(F.col("t"), n), t=text) == text.encode()[:n].decode("utf-8", "ignore"), (text, n)


@pytest.mark.parametrize("value", [0.0, 1.0, 200.0, 150.5, 123456.0, 1234567.0, 0.1, 0.00012, 3.14159265, 99999.96])
def test_general_number(spark, value):
    assert one(spark, T.general_number(F.col("v")), v=value) == f"{value:g}"


def test_small_parsers(spark):
    assert one(spark, T.page_number(F.col("t"), F.lit(9)), t="x\n# Page 12\ny") == 12
    assert one(spark, T.page_number(F.col("t"), F.lit(9)), t="no page") == 9
    assert one(spark, T.event_cursor(F.col("t"), F.lit(5).cast("long")), t="12") == 12
    assert one(spark, T.event_cursor(F.col("t"), F.lit(5).cast("long")), t="-3") == 5
    assert one(spark, T.event_cursor(F.col("t"), F.lit(5).cast("long")), t="x") == 5
    assert one(spark, T.count_band(F.col("n")), n=1234567890) == 6
    assert one(spark, T.layer_token(F.col("t")), t=" a-Wall_s ") == "AWALLS"
    assert one(spark, T.floor_code(F.col("t")), t=" b1 ") == "B1"
    assert one(spark, T.elevation_value(F.col("t")), t="标高 -1200mm") == -1.2
    assert tuple(one(spark, T.level_range(F.col("t")), t="-0.5~3.3")) == (-0.5, 3.3)
    for bad in ("x", "F1", "0F"):
        with pytest.raises(Exception, match="floor code"):
            one(spark, T.floor_code(F.col("t")), t=bad)
    with pytest.raises(Exception, match="level range"):
        one(spark, T.level_range(F.col("t")), t="3~1")


def test_clauses(spark):
    assert one(spark, T.clauses(F.col("t")), t="审核合同，然后 采购水泥；。") == ["审核合同", "采购水泥"]


def test_prices(spark):
    for raw, want in (("HRB400", "螺纹钢"), ("螺纹钢主连", "螺纹钢"), ("P.O 42.5", "水泥"), ("沥青", "沥青"), (" c30混凝土 ", "混凝土"), ("", "")):
        assert one(spark, D.material(F.col("t")), t=raw) == want
    for raw, want in (("06-14", "2001-06-14"), ("06-15", "2001-06-15"), ("06-16", "2000-06-16"), ("1999-01-02", "1999-01-02"), ("x", "x")):
        assert one(spark, D.full_date(F.col("t"), "2001-06-15"), t=raw) == want
    assert one(spark, D.unit(F.col("t")), t="元/m3") == "元/方"
    assert one(spark, D.unit(F.col("t")), t="") == "元/吨"
    ok = lambda m, a, b: one(spark, D.plausible_price(F.lit(m), F.lit(a), F.lit(b)))
    assert ok("水泥", 50.0, 3000.0) and not ok("水泥", 49.0, 60.0) and not ok("铝", 0.0, 1.0) and not ok("铝", 5.0, 4.0)


def test_questions(spark):
    f = lambda col, t: one(spark, col(F.col("t")), t=t)
    assert f(D.query_type, "你好") == "GENERAL" and f(D.query_type, "啥是BIM") == "VAGUE" and f(D.query_type, "梳理一下抗震规范要点") == "BROAD" and f(D.query_type, "C30 混凝土的坍落度要求是多少") == "PRECISE"
    assert f(D.asks_price, "三级钢多少钱") and not f(D.asks_price, "螺纹钢规范")
    assert f(D.asked_material, "三级钢多少钱") == "螺纹钢" and f(D.asked_material, "玻璃价格") == "玻璃" and f(D.asked_market, "合肥和上海的价格") == "上海"
    assert f(D.greeting, "Hello!!") == "hello" and f(D.greeting, "你是谁？") == "identity" and f(D.greeting, "你能做什么") == "capability" and f(D.greeting, "你是谁家的供应商？") is None
    b = f(D.best_intent, "审核合同条款")
    assert b.intent == "contract_review" and b.matched == 3 and math.isclose(b.confidence, min(0.98, 0.58 + 0.3 + min(0.2, b.weight / 100)))
    assert f(D.best_intent, "天气").intent == "general_question"
    r = one(spark, D.route(F.lit("审查标书"), F.lit("bid_query"), F.lit(0.9), F.lit("p"), F.lit(1)))
    assert r.route == "workflow.bid_review" and r.requires_confirmation and r.missing == []
    r = one(spark, D.route(F.lit("建模"), F.lit("bim_command"), F.lit(0.9), F.lit(None).cast("string"), F.lit(0)))
    assert r.route == "clarify" and r.missing == ["artifact_ids", "project_id"]


def test_rules_of_text(spark):
    assert one(spark, D.bid_file_class(F.col("t")), t="施工组织设计.docx") == "技术标"
    hits = one(spark, D.disqualifications(F.col("t")), t="投标函 营业执照 法人授权 保函 资质 法定代表人 报价 12万元")
    assert hits == []
    assert {h.rule for h in one(spark, D.disqualifications(F.col("t")), t="未盖章")} == {"缺失投标函", "缺失营业执照", "缺失授权委托书", "缺失投标保证金", "缺失资质证书", "缺失法定代表人身份证明", "格式性风险", "报价缺失"}
    e = one(spark, D.text_elements(F.col("t")), t="[墙体] 名称: W1; 厚度: 200; 标高: 3.0; 材料: C30\n[桌] 名称: X\n[柱] 名称：K1")
    assert [(x.ifc_type, x.name, x.thickness, x.material) for x in e] == [("IFCWALL", "W1", 200.0, "C30"), ("IFCCOLUMN", "K1", None, None)]
    assert one(spark, D.wall_group(F.col("t")), t="X$0$a-part-s") == "A" and one(spark, D.wall_group(F.col("t")), t="HYDRANT-WALL") is None
    props = F.create_map(F.lit("Reference"), F.lit("砌体墙-200mm"), F.lit("Width"), F.lit("0"))
    assert one(spark, D.wall_thickness(props)) == 200.0


def test_metrics(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<int>")
    assert one(spark, V.recall_at_k(arr(1, 2, 3), none, 2)) == 1.0 and one(spark, V.recall_at_k(arr(1, 2, 3), arr(2, 9), 2)) == 0.5
    assert one(spark, V.reciprocal_rank(arr(5, 6), arr(6))) == 0.5 and one(spark, V.reciprocal_rank(arr(5, 6), arr(7))) == 0.0
    assert one(spark, V.ndcg_at_k(arr(0.0), F.array().cast("array<double>"), 3)) == 1.0
    assert math.isclose(one(spark, V.ndcg_at_k(arr(1.0, 3.0), arr(3.0, 1.0), 2)), (1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert one(spark, V.dot(arr(1.0, 2.0, 3.0), arr(4.0, 5.0))) == 14.0 and one(spark, V.dot(arr(1.0), F.array().cast("array<double>"))) == 0.0
