"""Fill-in-middle transformation as relations of units: texts are cut between units into prefix, middle and suffix.

A text's units are exploded with their positions; a window sums their lengths;
cut requests meet the units by ordinal; the offsets of a document's cuts are
aggregated and the text is cut there.  Documents that stay plain ask for no cut,
so their units are not exploded.

A document is known by its content (its id and text hashed together), not by a
row number: nothing depends on how rows fall into tasks, and repeated rows share
their cuts.

Edge cases: null text is empty and stays plain; a null id counts as the empty
string in the hash; texts that hold a control string stay plain; ties do not
arise; an empty table gives an empty result; extra columns pass through,
whatever their names.  A text is one value, and the lengths of its units are
one, so its size is bounded by that of a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.llm.common import fresh, named, stage, table

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CONTROL = "<[PSM]>"
SEED = 42
#: Percent of documents that are cut, and of those that put the suffix first.
RATE, SPM_RATE = 50, 80
#: Units that one task sorts; a partition count follows from the units counted.
TASK_UNITS = 2_000_000


def _text(column: str) -> Column:
    return F.coalesce(named(column), F.lit(""))


def draws(ident: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, ident: Column, seed: int = SEED) -> Column:
    """plain, psm or spm."""
    _, _, h3, h4 = draws(ident, seed)
    plain = (text == "") | text.rlike(CONTROL) | (h3 % 100 >= RATE)
    return F.when(plain, "plain").when(h4 % 100 < SPM_RATE, "spm").otherwise("psm")


def cut_requests(docs: DataFrame, id_col: str, text_col: str, seed: int = SEED) -> DataFrame:
    """key, n, low, high of each distinct document that is cut: its units, and the ordinals of the units that end prefix and middle."""
    text, ident = _text(text_col), named(id_col)
    h1, h2, _, _ = draws(ident, seed)
    rows = docs.filter(form_of(text, ident, seed) != "plain").select(_key(text, ident).alias("key"), _units(text).alias("n"), h1.alias("h1"), h2.alias("h2"))
    ends = F.array_sort(F.array(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)))
    return rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "h1", "h2"))).select("key", "n", ends[0].alias("low"), ends[1].alias("high"))


def _units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def _key(text: Column, ident: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), text).cast("binary")))


def cut_offsets(docs: DataFrame, requests: DataFrame, tasks: int, id_col: str, text_col: str, seed: int = SEED) -> DataFrame:
    """key, low_at, high_at: where in code points the requested units end."""
    text, ident = _text(text_col), named(id_col)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.length)
    cut = docs.filter(form_of(text, ident, seed) != "plain").select(_key(text, ident).alias("key"), lengths.alias("lengths"))
    once = cut.repartition(tasks, "key").groupBy("key").agg(F.first("lengths").alias("lengths"))
    units = once.select("key", F.posexplode("lengths").alias("pos", "length"))
    in_order = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("key", (F.col("pos") + 1).alias("unit"), F.sum("length").over(in_order).alias("at"))
    asked = requests.select("key", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("ordinal"))
    # The ordinals meet as a difference, not as a second key: units stay where the window has put them.
    met = ends.join(asked, (ends["key"] == asked["key"]) & (ends["unit"] - asked["ordinal"] == 0)).select(asked["key"], "low", "high", "ordinal", "at")
    at = lambda end: F.max(F.when(F.col("ordinal") == F.col(end), F.col("at"))).alias(f"{end}_at")
    return met.groupBy("key").agg(at("low"), at("high"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output, exactly: the pieces hold no control string."""
    pieces = F.split(output, CONTROL, 4)
    return F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs with ``fim``: struct of n, form, prefix_chars, middle_chars and output.

    Plain documents stay where they are; only texts to be cut are shuffled to their offsets.
    """
    text, ident, key, fim = _text(text_col), named(id_col), fresh("fim_key", docs), fresh("fim", docs)
    requests = stage(cut_requests(docs, id_col, text_col, seed), "fim-requests")
    n_units = requests.agg(F.sum("n")).first()[0] or 0
    offsets = cut_offsets(docs, requests, max(1, math.ceil(n_units / TASK_UNITS)), id_col, text_col, seed)
    places = stage(requests.join(offsets, "key", "left").select(F.col("key").alias(key), "n", F.coalesce("low_at", F.lit(0)).alias("low_at"), F.coalesce("high_at", F.lit(0)).alias("high_at")), "fim-places")
    form = form_of(text, ident, seed)
    asked = docs.filter(form != "plain").withColumn(key, _key(text, ident)).join(places.select(key, F.struct("n", "low_at", "high_at").alias(fim)).hint("shuffle_hash"), key)
    low, high = F.col(fim)["low_at"], F.col(fim)["high_at"]
    prefix, middle, suffix = F.substr(text, F.lit(1), low), F.substr(text, low + 1, high - low), F.substr(text, high + 1)
    output = F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))

    def done(frame: DataFrame, n: Column, form: Column, prefix_chars: Column, middle_chars: Column, output: Column) -> DataFrame:
        made = F.struct(n.alias("n"), form.alias("form"), prefix_chars.cast("long").alias("prefix_chars"), middle_chars.cast("long").alias("middle_chars"), output.alias("output"))
        return frame.select(*(named(c) for c in docs.columns), made.alias(fim))

    none = F.lit(None)
    return done(asked, F.col(fim)["n"], form, low, high - low, output).unionByName(done(docs.filter(form == "plain"), _units(text), F.lit("plain"), none, none, text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document's cut, with digests of its output and of the text rebuilt from it."""
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS r FROM d),
f AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
