"""Rule registries over rows: elements, orders, bids; violation roll-ups and verdict ladders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import domain as D

SEVERITY = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Rule:
    """An id, what it says of a row, and the predicate that a violating row meets."""

    rule_id: str
    severity: str
    description: str
    hits: Callable[[], Column]


def _prop(*keys: str) -> Column:
    """The first non-blank property of several."""
    return F.coalesce(*[F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")) for k in keys])


def _modelled() -> Column:
    """Geometry read from a model speaks for itself."""
    return F.coalesce(F.col("has_geometry"), F.lit(False)) & (F.col("source") == "ifc_parse")


def _is(*kinds: str) -> Column:
    return F.col("ifc_type").isin(*kinds)


def _sized(*kinds: str, skip: str | None = None) -> Column:
    out = _is(*kinds) & ~_modelled() & _prop("Width", "宽度").isNull() & _prop("Height", "高度").isNull()
    return out & (F.coalesce(F.col("element_category"), F.lit("")) != skip) if skip else out


_structural_slab = lambda: _is("IFCSLAB") & (F.coalesce(F.col("element_category"), F.lit("")) != "finishing") & ~_modelled()

#: F11 in the order of registration.
HARD_RULES = (
    Rule("HR-001", "critical", "wall thickness missing or zero", lambda: _is("IFCWALL") & ~_modelled() & D.wall_thickness(F.col("properties")).isNull()),
    Rule("HR-002", "warning", "slab elevation missing", lambda: _structural_slab() & _prop("Elevation", "Offset", "标高").isNull()),
    Rule("HR-005", "warning", "slab thinner than 100 mm", lambda: _structural_slab() & (D.wall_thickness(F.col("properties")) < 100.0)),
    Rule("HR-006", "warning", "column section missing", lambda: _sized("IFCCOLUMN")),
    Rule("HR-007", "warning", "beam section missing", lambda: _sized("IFCBEAM", "IFCMEMBER", skip="non_structural")),
    Rule("HR-003", "warning", "element without a name", lambda: F.coalesce(F.col("name"), F.lit("")).isin("", "未命名")),
    Rule("HR-004", "warning", "material and type missing", lambda: _is("IFCWALL", "IFCCOLUMN", "IFCBEAM") & _prop("Material", "material", "材料", "Grade", "grade", "TypeName", "ObjectType").isNull()),
)


def check_rules(rows: DataFrame, rules: tuple[Rule, ...] = HARD_RULES, *, model_input: bool = True, model_only: tuple[str, ...] = ("HR-004",)) -> DataFrame:
    """a row per hit with rule_id, severity, description and rule_ord; one pass over the rows."""
    active = [r for r in rules if model_input or r.rule_id not in model_only]
    hits = [F.when(F.coalesce(r.hits(), F.lit(False)), F.struct(F.lit(i).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"))) for i, r in enumerate(active)]
    return rows.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select("*", "_hit.*").drop("_hit")


def group_violations(violations: DataFrame, examples: int = 5) -> DataFrame:
    """Per (rule, description) the count, the place of the first, and the first ids that are not blank."""
    shown = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("element_id"), F.lit("")) != "", F.struct("ord", "element_id"))))
    # Only the smallest few matter: a first reduction per slice bounds what a hot rule gathers.
    sliced = violations.withColumn("_slice", F.pmod(F.xxhash64("ord"), F.lit(64)))
    part = sliced.groupBy("rule_id", "description", "_slice").agg(F.first("severity").alias("severity"), F.count("*").alias("affected"), F.min("ord").alias("first_ord"), F.slice(shown, 1, examples).alias("shown"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("shown"))), 1, examples)
    out = part.groupBy("rule_id", "description").agg(F.first("severity").alias("severity"), F.sum("affected").alias("affected"), F.min("first_ord").alias("first_ord"), F.transform(merged, lambda x: x["element_id"]).alias("examples"))
    return out


def severity_rank(severity: Column) -> Column:
    return D.first_equal(severity, [(k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(9))


def merge_reports(findings: DataFrame, group: str = "report_id", low_confidence: float = 0.6) -> DataFrame:
    """Findings (group, track hard or soft, severity, confidence) to counts, risk and verdict per report."""
    hard, soft = F.col("track") == "hard", F.col("track") == "soft"
    n = lambda cond: F.count(F.when(cond, 1))
    out = findings.groupBy(group).agg(
        n(hard).alias("hard_count"), n(soft).alias("soft_count"), n(hard & (F.col("severity") == "critical")).alias("hard_critical_count"),
        n(soft & (F.coalesce(F.col("confidence"), F.lit(1.0)) < low_confidence)).alias("low_confidence_count"), n(F.col("severity") == "warning").alias("warnings"))
    risk = F.when(F.col("hard_critical_count") > 0, "high").when(F.col("warnings") > 0, "medium").otherwise("low")
    return out.withColumn("risk_level", risk).withColumn("verdict", F.when((F.col("hard_count") > 0) | (F.col("low_confidence_count") > 0), "review").otherwise("pass")).drop("warnings")


def ordered_findings(findings: DataFrame, group: str = "report_id", order: str = "ord") -> DataFrame:
    """Hard before soft, by severity, stable; place from 1."""
    w = Window.partitionBy(group).orderBy(F.when(F.col("track") == "hard", 0).otherwise(1), severity_rank(F.col("severity")), order)
    return findings.withColumn("place", F.row_number().over(w))


def review_items(items: DataFrame) -> DataFrame:
    """Issues, amount and verdict of each order item."""
    issues = D.item_issues(F.col("material_name"), F.col("quantity"), F.col("unit_price"), F.col("unit"), F.col("market_price"), F.col("market_unit"))
    return items.withColumn("amount", F.col("quantity") * F.col("unit_price")).withColumn("issues", issues).withColumn("verdict", F.when(F.size("issues") > 0, "review").otherwise("pass"))


def review_orders(items: DataFrame, order_key: str = "order_no") -> DataFrame:
    """Total, any review, item count per order."""
    return items.groupBy(order_key).agg(F.sum("amount").alias("total_amount"), F.bool_or(F.col("verdict") == "review").alias("any_review"), F.count("*").alias("n_items"), F.max("amount").alias("largest"), F.sum(F.size("issues")).alias("n_issues"))


def approval_tier(orders: DataFrame, low: float = 10_000.0) -> DataFrame:
    """Approved without a person if every item passes and is below the limit, whatever a model says."""
    fast = ~F.col("any_review") & (F.col("largest") < low)
    return orders.withColumn("tier", F.when(fast, "auto_approved").otherwise("waiting_human"))


def merged_verdict(rule: Column, model: Column) -> Column:
    """Review beats reject beats pass."""
    return F.when((rule == "review") | (model == "review"), "review").when((rule == "reject") | (model == "reject"), "reject").otherwise("pass")


def first_issues(rule_issues: Column, model_issues: Column, n: int = 10) -> Column:
    """The rules' issues, then the model's, at most n."""
    return F.slice(F.concat(rule_issues, model_issues), 1, n)


def weighted_scores(scores: DataFrame, group: str = "bid_id", weights: dict[str, float] = D.BID_WEIGHTS) -> DataFrame:
    """Sum of score times the dimension's weight, rounded to 2 places."""
    w = D.first_equal(F.col("dimension"), [(k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    return scores.groupBy(group).agg(F.round(F.sum(F.col("score") * w), 2).alias("weighted_score"))


def bid_issues(scores: DataFrame, group: str = "bid_id", issues: str = "issues") -> DataFrame:
    """Issues by priority of their dimension's score, stable; place from 1."""
    rows = scores.select(group, "ord", "dimension", D.issue_priority(F.col("score")).alias("priority"), F.posexplode(issues).alias("pos", "description"))
    rank = D.first_equal(F.col("priority"), [("high", F.lit(0)), ("medium", F.lit(1))], F.lit(2))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(rank, "ord", "pos")))


def review_bids(files: DataFrame) -> DataFrame:
    """Per bid the classes of its files and the disqualifications of its whole text."""
    whole = files.groupBy("bid_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("raw_text", F.lit("")).alias("t")))).alias("parts"), F.array_sort(F.collect_set(D.bid_file_class(F.col("filename")))).alias("classes"))
    text = F.array_join(F.transform("parts", lambda p: p["t"]), "\n")
    return whole.select("bid_id", "classes", D.disqualifications(text).alias("hits")).withColumn("critical", F.exists("hits", lambda h: h["severity"] == "critical"))


def model_checks(model: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named boolean checks as a map, and whether all hold."""
    named = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*(F.coalesce(c, F.lit(False)) for c in checks.values())))
    return model.withColumn("checks", named).withColumn("passed", F.forall(F.map_values("checks"), lambda v: v))


def access_allowed(calls: DataFrame, acl: DataFrame, fallback: str = "user") -> DataFrame:
    """calls (tool, role) against acl (role, tool): no role passes, an unknown role falls back, * allows all."""
    known = acl.select("role").distinct().withColumn("_known", F.lit(True))
    roles = calls.join(known, "role", "left").withColumn("_role", F.when(F.col("_known"), F.col("role")).otherwise(fallback))
    grants = acl.groupBy(F.col("role").alias("_role")).agg(F.collect_set("tool").alias("_tools"))
    tools = F.coalesce("_tools", F.array().cast("array<string>"))
    return roles.join(grants, "_role", "left").withColumn("allowed", F.col("role").isNull() | F.array_contains(tools, "*") | F.array_contains(tools, F.col("tool"))).drop("_role", "_known", "_tools")
