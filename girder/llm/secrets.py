"""Secret scans in DataFrame functions only, candidates first by a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams, written as clauses: sets of
trigrams that a text holds together.  The index holds, for each trigram of some
clause and each block of rows, the sorted list of rows whose text has it; the lists
of a clause are intersected, the clauses of a rule united.  Only candidates are
verified by the rule's regex; rules without mandatory trigrams scan fully.
Candidates go back to the texts as row numbers: broadcast while there are few,
beyond that through a shuffle join.

Spans come from splitting at a regex and from what it matches: lengths of the
pieces in turn give the places.

Edge cases: null text is empty; texts without a match have empty spans; repeated
rows are scanned alike; a null id is passed through; an empty table gives an empty
result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import fresh, named, stage, table
from girder.llm.trigrams import ANY, clauses, derive


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.  Runs of a class that must be long are written with their
# least length where no shorter match can hide a longer one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the method adds: formats that name themselves.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("url_login", r"[a-z]{3,12}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!*-]{6,64}@", 0, 1),
)
#: Rows of a block of the index have the same number but for so many bits.
BLOCK_BITS = 14
#: Up to so many candidate rows (16 bytes each, and their rules' bits) are broadcast.
FEW = 1 << 20


class TrigramIndex:
    """Posting lists of the trigrams of the rules' queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = {r.kind: derive(r.pattern) for r in rules}
        #: (bit of the rule, trigrams) of each clause; what a rule's clauses leave out need not be posted.
        self.clauses = [(1 << i, c) for i, q in enumerate(self.queries.values()) if q != ANY for c in clauses(q)]
        self.trigrams = sorted(set().union(*(c for _, c in self.clauses)))

    def postings(self, rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
        """(block, trigram, rows): rows is the sorted array of the row numbers that hold the trigram."""
        lowered = F.lower(F.coalesce(named(text_col), F.lit("")))
        every = F.array(*map(F.lit, self.trigrams))
        held = F.transform(F.array(lowered), lambda text: F.filter(every, lambda t: F.contains(text, t)))  # the text is lowered once, not once a trigram
        seen = rows.select(F.col(row_col).alias("row"), F.get(held, F.lit(0)).alias("held"))
        return seen.select("row", F.explode("held").alias("trigram")).groupBy(F.shiftright("row", BLOCK_BITS).alias("block"), "trigram").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(row, rules): for each row that some query leaves, a bit for each such rule by the order of the rules."""
        if not self.clauses:
            return postings.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("rules")).limit(0)
        use = lambda n, bit, c: F.struct(F.lit(n).alias("clause"), F.lit(len(c)).alias("need"), F.lit(bit).cast("long").alias("bit"))
        uses = {t: F.array(*(use(n, bit, c) for n, (bit, c) in enumerate(self.clauses) if t in c)) for t in self.trigrams}
        served = F.create_map(*(x for t, u in uses.items() for x in (F.lit(t), u)))
        lists = postings.select("block", "rows", F.explode(F.try_element_at(served, "trigram")).alias("use")).groupBy("block", "use").agg(F.collect_list("rows").alias("lists")).filter(F.size("lists") == F.col("use.need"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], lambda rows, more: F.array_intersect(rows, more))
        return lists.select("use.bit", F.explode(both).alias("row")).groupBy("row").agg(F.bit_or("bit").alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """array of (start, stop) of the rule's matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    lengths = F.transform(F.split(text, rule.pattern), F.length)
    pieces = F.zip_with(F.zip_with(lengths, hits, lambda gap, hit: F.struct(gap.alias("gap"), F.length(hit).alias("n"))), groups, lambda p, g: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), F.length(g).alias("g")))
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + F.coalesce(p["n"], F.lit(0))).alias("at"),
        F.when(p["g"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["n"]).alias("stop"))))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(pieces, place, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", few: int = FEW) -> DataFrame:
    """docs with ``found`` (an underscore more where docs have that name): array of (kind, start, stop, rank), by start, then the order of the rules."""
    index = TrigramIndex(rules)
    row, bits = fresh("row", docs), fresh("rules", docs)
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "secrets-rows")
    found = stage(index.candidates(index.postings(rows, row, text_col)).select(F.col("row").alias(row), F.col("rules").alias(bits)), "secrets-candidates")
    out = rows.join(F.broadcast(found) if found.count() <= few else found, row, "left")
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")
    text = F.coalesce(named(text_col), F.lit(""))

    def part(rank: int, rule: Rule) -> Column:
        placed = F.transform(spans(text, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))
        candidate = F.lit(True) if index.queries[rule.kind] == ANY else F.coalesce(F.col(bits).bitwiseAND(F.lit(1 << rank).cast("long")) != 0, F.lit(False))
        return F.when(candidate & text.rlike(rule.pattern), placed).otherwise(none)

    return out.select(*(named(c) for c in docs.columns), F.array_sort(F.concat(*(part(rank, rule) for rank, rule in enumerate(rules)))).alias(fresh("found", docs)))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets of every document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    parts, ctes = [], []
    for rank, r in enumerate(BASE + ADDED):
        pattern = r.pattern.replace("'", "''")
        group = f"regexp_extract_all(t, '{pattern}', {r.group})"
        ctes.append(f"""m{rank} AS (SELECT k, regexp_extract_all(t, '{pattern}') AS hits, {group} AS groups, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}'))""")
        parts.append(f"""SELECT k, '{r.kind}' AS kind, {rank} AS rank, list_sum([length(x) FOR x IN gaps[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)::BIGINT AS start, length(hits[i]) AS n, length(groups[i]) AS g FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m{rank}) WHERE length(groups[i]) >= {r.least}""")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),\n" + ",\n".join(ctes) + ",\ns AS (" + "\nUNION ALL ".join(parts) + """),
g AS (SELECT k, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
      string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)"""


ORACLE = _oracle()
