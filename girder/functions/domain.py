"""Domain tables and the expressions over them: prices, routing of questions, bids, orders and elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girder.functions.text import SPACE, contains_any, first_match, strip

# Standard material -> its aliases, in order.
MATERIAL_ALIASES = {
    "螺纹钢": ("螺纹钢", "钢筋", "HRB400", "HRB400E", "HRB500", "盘螺", "螺纹"),
    "热卷": ("热卷", "热轧卷板", "热轧板卷"),
    "线材": ("线材", "盘条", "高线"),
    "混凝土": ("混凝土", "商砼", "商品混凝土", "C30", "C25", "C35", "C40"),
    "砂石": ("砂石", "河砂", "机制砂", "碎石", "中砂", "粗砂"),
    "水泥": ("水泥", "P.O42.5", "P.O 42.5", "P.C32.5", "散装水泥", "袋装水泥"),
    "铁矿石": ("铁矿石", "铁矿", "矿石"),
    "铜": ("铜", "沪铜", "电解铜"),
}
# Plausible price ranges.
PRICE_LIMITS = {"螺纹钢": (1000, 20000), "热卷": (1000, 20000), "线材": (1000, 20000), "铁矿石": (100, 5000), "铜": (10000, 300000), "水泥": (50, 3000), "混凝土": (50, 3000), "砂石": (10, 2000), "矿渣粉": (50, 2000)}
DEFAULT_LIMIT = (1, 1000000)
# Units.
UNITS = {"元/立方米": "元/方", "元/m³": "元/方", "元/m3": "元/方", "元/吨": "元/吨", "元/方": "元/方", "元/平方米": "元/平米"}
# Words of price questions, materials in them, variants by pattern, markets.
PRICE_WORDS = ("多少钱", "价格", "行情", "报价", "每吨", "一吨", "每方", "一方", "单价", "时价", "今日价", "价格走势", "价格多少")
PRICE_MATERIALS = ("螺纹钢", "钢筋", "钢材", "水泥", "混凝土", "商砼", "砂石", "河砂", "机制砂", "碎石", "热卷", "线材", "铁矿石", "铜", "矿渣粉", "铝", "玻璃", "防水卷材", "保温板", "加气块", "角钢", "槽钢", "工字钢", "H型钢", "钢管", "脚手架")
MATERIAL_VARIANTS = (("HRB400E?|三级钢|二级钢|四级钢|盘螺", "螺纹钢"), ("高线|盘条|盘圆", "线材"), (r"P\.?O\s*42\.?5|42\.?5\s*水泥", "水泥"), ("C3[05]|C25|C40", "混凝土"), ("铝锭|铝合金|铝材", "铝"), ("河沙", "河砂"), ("机制沙", "机制砂"), ("石子|碎石", "碎石"), ("钢化玻璃|中空玻璃", "玻璃"))
MARKETS = ("西安", "上海", "北京", "广州", "深圳", "杭州", "南京", "合肥", "郑州", "成都", "重庆", "武汉", "长沙", "济南", "沈阳", "天津", "昆明", "贵阳", "南宁", "太原", "石家庄", "哈尔滨", "长春", "兰州", "乌鲁木齐", "福州", "厦门", "南昌", "青岛", "大连")
# Words that tell the type of a question.
GENERAL_WORDS = ("你好", "谢谢", "你是谁", "你能做什么", "再见", "今天天气", "今天是几号", "现在几点", "讲个笑话")
VAGUE_WORDS = ("没懂", "不懂", "不太懂", "讲讲", "解释一下", "啥意思", "什么意思", "不了解", "不清楚", "不明白", "啥是", "什么是", "给我讲讲", "介绍一下", "科普", "原理", "机制", "怎么理解", "聊聊")
BROAD_WORDS = ("全面", "系统", "总结", "梳理", "对比", "区别", "有哪些", "全景", "介绍", "概述", "整体", "框架", "体系", "全貌", "所有", "全部", "汇总", "盘点", "要点", "目录")
# Intents in order of priority with their terms, and (route, needs confirmation) of each.
INTENT_TERMS = (
    ("contract_review", ("合同审核", "审核合同", "审合同", "合同条款", "违约条款", "付款条款", "合同")),
    ("bim_command", ("revit", "bim", "建模", "生成模型", "图纸转模型", "墙柱模型")),
    ("bid_query", ("标书", "投标文件", "招标文件", "投标", "响应文件", "商务标", "技术标")),
    ("negotiation_query", ("谈判", "议价", "谈判建议", "谈判纪要", "供应商谈判")),
    ("procurement_query", ("采购", "供应商", "报价", "采购申请", "供应商资质")),
    ("building_standard_query", ("建筑规范", "设计规范", "规范", "国标", "标准", "条文", "规程")),
)
ROUTES = {
    "building_standard_query": ("rag.answer", False), "bid_query": ("bid.search", False), "contract_review": ("workflow.contract_review", True),
    "procurement_query": ("workflow.procurement", True), "negotiation_query": ("workflow.negotiation", True), "bim_command": ("workflow.wall_pipeline", True), "general_question": ("rag.answer", False),
}
# Bid files by name, required materials, words of formal risk.
BID_FILE_RULES = (("技术标", ("技术标", "施工组织", "施工方案", "技术方案", "工艺", "专项方案")), ("商务标", ("商务标", "投标函", "报价", "商务", "价格", "清单", "开标一览表")), ("资质文件", ("资质", "业绩", "证书", "人员", "证件", "营业执照", "授权")))
BID_REQUIRED = (("投标函", ("投标函", "投标书")), ("营业执照", ("营业执照",)), ("授权委托书", ("授权委托书", "法人授权")), ("投标保证金", ("保证金", "投标保函", "保函")), ("资质证书", ("资质证书", "资质等级", "资质")), ("法定代表人身份证明", ("法定代表人", "法人身份")))
BID_FORMAT_RISKS = ("未盖章", "未签字", "未加盖", "无盖章", "无签字")
#: Weight of each review dimension.
BID_WEIGHTS = {"技术方案": 0.30, "商务响应": 0.35, "资质业绩": 0.20, "合规风险": 0.15}
# Greetings answered without a model, and words of slab finishes.
GREETINGS = {
    "hello": ("你好", "您好", "hi", "hello", "hey", "哈喽", "嗨", "在吗", "在不在"),
    "thanks": ("谢谢", "感谢", "多谢", "谢了", "非常感谢", "辛苦了", "太棒了", "好的", "收到", "明白了"),
    "bye": ("再见", "拜拜", "bye", "goodbye", "下次见", "下次再聊"),
}
FINISHING_WORDS = ("地砖", "环氧", "细石", "耐磨", "防水", "找平", "面层", "地坪", "贴砖", "地面")
# Element types in drawing texts.
ELEMENT_TYPES = {"墙": "IFCWALL", "墙体": "IFCWALL", "柱": "IFCCOLUMN", "柱子": "IFCCOLUMN", "梁": "IFCBEAM", "板": "IFCSLAB", "楼板": "IFCSLAB", "门": "IFCDOOR", "窗": "IFCWINDOW", "窗户": "IFCWINDOW", "楼梯": "IFCSTAIR", "屋顶": "IFCROOF", "屋面": "IFCROOF"}


def material(name: Column, aliases: dict[str, tuple[str, ...]] = MATERIAL_ALIASES) -> Column:
    """Exact alias first, then the first alias contained, in order; else the upper-cased name."""
    clean = F.upper(strip(F.coalesce(name, F.lit(""))))
    pairs = [(alias.upper(), standard) for standard, words in aliases.items() for alias in words]
    exact = lookup(dict(reversed(pairs)))
    listed = F.array(*[F.struct(F.lit(alias).alias("alias"), F.lit(standard).alias("standard")) for alias, standard in pairs])
    held = F.get(F.filter(listed, lambda p: F.contains(clean, p["alias"])), F.lit(0))["standard"]
    return F.coalesce(F.try_element_at(exact, clean), held, clean)


def lookup(table: dict) -> Column:
    """A literal map; folded once at planning."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def full_date(text: Column, as_of: str) -> Column:
    """MM-DD gets the year of ``as_of``, or the one before if it lies ahead; anything else stays."""
    clean = strip(F.coalesce(text, F.lit("")))
    year = F.lit(int(as_of[:4]))
    ahead = clean > F.lit(as_of[5:10])
    return F.when(clean.rlike(r"^\d{2}-\d{2}$"), F.concat(F.when(ahead, year - 1).otherwise(year).cast("string"), F.lit("-"), clean)).otherwise(clean)


def unit(text: Column, default: str = "元/吨") -> Column:
    """Mapped, else as given; blank gets the default."""
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, strip(F.coalesce(text, F.lit("")))), F.when(F.coalesce(text, F.lit("")) != "", text), F.lit(default))


def plausible_price(standard: Column, low: Column, high: Column, limits: dict[str, tuple[int, int]] = PRICE_LIMITS, default: tuple[int, int] = DEFAULT_LIMIT) -> Column:
    """Positive, ordered, within the material's range."""
    bound = lambda i: F.coalesce(F.try_element_at(lookup({m: r[i] for m, r in limits.items()}), standard), F.lit(default[i]))
    return F.coalesce((low > 0) & (high >= low) & (low >= bound(0)) & (high <= bound(1)), F.lit(False))


def first_equal(value: Column, pairs, default: Column) -> Column:
    out = None
    for key, result in pairs:
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return default if out is None else out.otherwise(default)


def variant_material(query: Column) -> Column:
    """The standard material of the first spelling variant in the query; null without one."""
    return F.coalesce(*(F.when(query.rlike(p), F.lit(m)) for p, m in MATERIAL_VARIANTS))


def asks_price(query: Column) -> Column:
    """A price word and a material or variant."""
    low = F.lower(query)
    return contains_any(low, PRICE_WORDS) & (contains_any(low, PRICE_MATERIALS) | variant_material(query).isNotNull())


def asked_material(query: Column) -> Column:
    """The variant's material, else the first listed one contained, else blank."""
    return F.coalesce(variant_material(query), first_match(query, [(m, F.lit(m)) for m in PRICE_MATERIALS], F.lit("")))


def asked_market(query: Column) -> Column:
    """P18."""
    return first_match(query, [(m, F.lit(m)) for m in MARKETS], F.lit(""))


def query_type(query: Column, general=GENERAL_WORDS, vague=VAGUE_WORDS, broad=BROAD_WORDS) -> Column:
    """P19."""
    low = F.lower(strip(query))
    return F.when(contains_any(low, general), "GENERAL").when((F.length(low) <= 6) & contains_any(low, vague), "VAGUE").when(contains_any(low, broad), "BROAD").otherwise("PRECISE")


def best_intent(query: Column, terms=INTENT_TERMS) -> Column:
    """P20: struct(intent, confidence, matched, weight): most terms matched, then most characters, then priority."""
    clean = F.regexp_replace(F.lower(query), rf"{SPACE}+", "")
    scored = []
    for i, (intent, words) in enumerate(terms):
        words = ["".join(w.lower().split()) for w in words]
        hit = [F.contains(clean, F.lit(w)) for w in words]
        n = sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))
        weight = sum((F.when(h, len(w)).otherwise(0) for h, w in zip(hit[1:], words[1:], strict=True)), F.when(hit[0], len(words[0])).otherwise(0))
        scored.append(F.struct(n.alias("matched"), weight.alias("weight"), F.lit(-i).alias("order"), F.lit(intent).alias("intent")))
    best = F.array_max(F.array(*scored))
    confidence = F.least(F.lit(0.98), 0.58 + 0.10 * best["matched"] + F.least(F.lit(0.20), best["weight"] / 100))
    found = best["matched"] > 0
    return F.struct(F.when(found, best["intent"]).otherwise("general_question").alias("intent"), F.when(found, confidence).otherwise(0.6).alias("confidence"), best["matched"].alias("matched"), best["weight"].alias("weight"))


def route(query: Column, intent: Column, confidence: Column, project: Column, n_artifacts: Column, review: str = "审查|审核|评审|审一下|审一审") -> Column:
    """struct(route, requires_confirmation, missing): what is asked for but not given leads to clarify."""
    bid_review = (intent == "bid_query") & query.rlike(review)
    no_project = F.coalesce(project, F.lit("")) == ""
    missing = F.array_compact(F.array(
        F.when((bid_review | intent.isin("contract_review", "bim_command")) & (n_artifacts == 0), F.lit("artifact_ids")),
        F.when(intent.isin("bid_query", "bim_command") & no_project, F.lit("project_id"))))
    plain = first_equal(intent, [(k, F.lit(v[0])) for k, v in ROUTES.items()], F.lit("rag.answer"))
    confirm = first_equal(intent, [(k, F.lit(v[1])) for k, v in ROUTES.items()], F.lit(False))
    chosen = F.when((confidence < 0.55) | (F.size(missing) > 0), "clarify").when(bid_review, "workflow.bid_review").otherwise(plain)
    return F.struct(chosen.alias("route"), (bid_review | confirm).alias("requires_confirmation"), missing.alias("missing"))


def greeting(text: Column) -> Column:
    """The kind of small talk a text is as a whole, else null."""
    clean = strip(text)
    low = F.regexp_replace(F.lower(clean), rf"(?:{SPACE}|[!！?？。~～,.，])+$", "")
    out = None
    for kind, words in GREETINGS.items():
        out = F.when(low.isin(*words), kind) if out is None else out.when(low.isin(*words), kind)
    tail = rf"(?:{SPACE}|[!！?？。~～,.，啊呀呢吧吗])*"
    identity = rf"^(?:(?:你|您)(?:是谁|叫什么名字|叫什么|叫啥|是什么){tail}|请?(?:你|您)?介绍(?:一下)?(?:你|您)?自己{tail}|自我介绍{tail})$"
    ability = rf"^(?:(?:你|您)(?:能|可以|会)(?:做|帮|干)(?:什么|啥|忙)?{tail}|(?:你|您)有(?:什么|哪些)(?:功能|用途|能力)?{tail}|怎么(?:用|使用)(?:你|您)?{tail})$"
    return out.when(clean.rlike(identity), "identity").when(clean.rlike(ability), "capability")


def bid_file_class(filename: Column, rules=BID_FILE_RULES, default: str = "通用") -> Column:
    """P25."""
    low = F.lower(F.coalesce(filename, F.lit("")))
    return first_match(low, [(w, F.lit(kind)) for kind, words in rules for w in words], F.lit(default))


def disqualifications(text: Column, required=BID_REQUIRED, risks=BID_FORMAT_RISKS, amount: str = r"\d+(?:\.\d+)?\s*(?:万元|元)") -> Column:
    """Array of struct(rule, severity) that a bid's whole text hits."""
    hit = lambda name, severity: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))
    tests = [F.when(~contains_any(text, words), hit(f"缺失{name}", "critical")) for name, words in required]
    tests += [F.when(contains_any(text, risks), hit("格式性风险", "critical")), F.when(~text.rlike(amount), hit("报价缺失", "high"))]
    return F.array_compact(F.array(*tests))


def bid_verdict(score: Column, critical: Column) -> Column:
    """struct(verdict, risk_level)."""
    verdict = F.when(critical, "rejected").when(score >= 80, "approved").when(score >= 60, "review").otherwise("rejected")
    return F.struct(verdict.alias("verdict"), F.when(critical | (score < 60), "high").when(score < 75, "medium").otherwise("low").alias("risk_level"))


def issue_priority(score: Column) -> Column:
    """A35."""
    return F.when(score < 60, "high").when(score < 75, "medium").otherwise("low")


def item_issues(name: Column, quantity: Column, price: Column, item_unit: Column, market: Column, market_unit: Column, *, big: float = 100_000.0, red_line: float = 5_000.0, deviation: float = 0.30) -> Column:
    """Codes of what an order item fails."""
    amount, usable = quantity * price, market.isNotNull() & (market > 0)
    plain_unit = F.replace(F.coalesce(market_unit, F.lit("")), F.lit("元/"), F.lit(""))
    other_unit = (plain_unit != "") & (item_unit != plain_unit)
    return F.array_compact(F.array(
        F.when(F.coalesce(strip(name), F.lit("")) == "", F.lit("name_missing")), F.when(quantity <= 0, F.lit("quantity")), F.when(price <= 0, F.lit("price")), F.when(amount >= big, F.lit("large_amount")),
        F.when(usable & other_unit, F.lit("unit_differs")), F.when(usable & ~other_unit & (F.abs((price - market) / market) > deviation), F.lit("price_deviates")), F.when(market.isNull() & (price >= red_line), F.lit("red_line"))))


def call_cost(input_chars: Column, output_chars: Column) -> Column:
    """struct(tokens in, tokens out, cost): 1.5 characters a token, 0.5 and 2.0 a million."""
    t_in, t_out = (input_chars / 1.5).cast("long"), (output_chars / 1.5).cast("long")
    return F.struct(t_in.alias("tokens_in"), t_out.alias("tokens_out"), F.round((t_in * 0.5 + t_out * 2.0) / 1e6, 6).alias("cost"))


def slab_class(name: Column, mat: Column, predefined: Column) -> Column:
    """P57."""
    return F.when(predefined == "LANDING", "landing").when(contains_any(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(mat, F.lit(""))), FINISHING_WORDS), "finishing").otherwise("structural")


def wall_thickness(props: Column) -> Column:
    """The first positive of four keys, else millimetres in Reference."""
    get = lambda k: F.try_element_at(props, F.lit(k))
    number = lambda c: strip(c).try_cast("double")
    found = [F.when(number(get(k)) > 0, number(get(k))) for k in ("Thickness", "Width", "厚度", "NominalWidth")]
    reference = F.regexp_extract(get("Reference"), r"(\d+(?:\.\d+)?)\s*mm", 1).try_cast("double")
    return F.coalesce(*found, F.when(reference > 0, reference))


def wall_group(layer: Column) -> Column:
    """S or A from the leaf of a nested layer name, else null."""
    leaf = F.substring_index(F.upper(strip(F.coalesce(layer, F.lit("")))), "$0$", -1)
    return F.when(leaf == "S-WALL", "S").when(leaf.isin("A-WALL", "A-WALL-S", "A-PART", "A-PART-S", "A-后砌", "A-MASONRY", "WALL"), "A")


def layer_family(layers: Column) -> Column:
    """By the ending of any layer."""
    ends = lambda suffix: F.exists(layers, lambda x: F.endswith(F.upper(x), F.lit(suffix)))
    return F.when(ends("S-WALL"), "S-WALL").when(ends("A-WALL-CONC"), "A-WALL-CONC").otherwise("partition")


def layer_matches(layer: Column, includes: list[str], excludes: list[str]) -> Column:
    """case-insensitive patterns; no include pattern means all."""
    any_of = lambda ps: F.coalesce(*[F.when(layer.rlike(f"(?i){p}"), F.lit(True)) for p in ps], F.lit(False)) if ps else F.lit(False)
    return (any_of(includes) if includes else F.lit(True)) & ~any_of(excludes)


def normal_value(value: Column) -> Column:
    """Numeric strings compare as numbers, others stripped; a comparable string."""
    clean = strip(value)
    return F.coalesce(clean.try_cast("double").cast("string"), clean)


def with_defaults(kind: Column, width: Column, depth: Column) -> Column:
    """Plausible sizes where absent: beam 300 x 600, wall 200, slab 120."""
    return F.struct(F.coalesce(width, F.when(kind == "beam", 300.0).when(kind == "wall", 200.0).when(kind == "slab", 120.0)).alias("width"), F.coalesce(depth, F.when(kind == "beam", 600.0)).alias("depth"))


def text_elements(text: Column) -> Column:
    """Array of struct(ifc_type, name, thickness, elevation, material, confidence, element_key) of the component lines in a drawing's text.

    Unknown types are skipped.  element_key is a hash of the line; sources.drawings.line_id gives a name-based UUID instead.
    """
    line = r"\[[^\]]+\]\s*名称\s*[:：]\s*[^;；\n]+(?:\s*[;；]\s*厚度\s*[:：]\s*[^;；\n]+)?(?:\s*[;；]\s*标高\s*[:：]\s*[^;；\n]+)?(?:\s*[;；]\s*材料\s*[:：]\s*[^;；\n]+)?"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(line), F.lit(0))
    types = F.create_map(*(F.lit(x) for kv in ELEMENT_TYPES.items() for x in kv))
    part = lambda s, key: F.nullif(strip(F.regexp_extract(s, rf"[;；]\s*{key}\s*[:：]\s*([^;；\n]+)", 1)), F.lit(""))
    rows = F.transform(found, lambda s: F.struct(
        F.try_element_at(types, strip(F.regexp_extract(s, r"^\[([^\]]+)\]", 1))).alias("ifc_type"), strip(F.regexp_extract(s, r"名称\s*[:：]\s*([^;；\n]+)", 1)).alias("name"),
        part(s, "厚度").try_cast("double").alias("thickness"), part(s, "标高").try_cast("double").alias("elevation"), part(s, "材料").alias("material"), F.lit(0.85).alias("confidence"), F.substring(F.sha1(strip(s).cast("binary")), 1, 12).alias("element_key")))
    return F.filter(rows, lambda r: r["ifc_type"].isNotNull())
