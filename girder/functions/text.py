"""Text expressions: normalisation, chunking, tokens, hashes and small parsers.

White space follows Unicode (with U+3000), which the JVM's \\s does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Words that are no search terms.
STOP_WORDS = ("的", "了", "和", "与", "及", "是", "吗", "嘛", "怎么", "怎样", "什么", "多少", "请问", "可以", "能", "不能", "有", "没有", "一下", "？", "！", "?", "!", "、", "，", ",")
#: Characters that alone make no entity term.
FUNCTIONAL_CHARS = "施工规范资质工程知识问答全流程管理控制"
# Words that point back to an earlier question.
REFERENTIAL = ("它", "这个", "那个", "上述", "刚才", "上次", "继续", "还有", "那么", "那价格", "那规范")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_match(text: Column, pairs, default: Column) -> Column:
    """The value of the first (word, value) whose word the text contains."""
    out = None
    for word, value in pairs:
        out = F.when(F.contains(text, F.lit(word)), value) if out is None else out.when(F.contains(text, F.lit(word)), value)
    return default if out is None else out.otherwise(default)


def normalize_text(text: Column) -> Column:
    """LF line ends, single spaces, at most one blank line, stripped."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def windows(text: Column, size: int, stride: int) -> Column:
    """Pieces of ``size`` characters at offsets 0, stride, 2 * stride, ... below the length."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.substring(text, s + 1, size))


def split_text(text: Column, max_chars: int = 1200, overlap: int = 150) -> Column:
    """Paragraphs packed into chunks; a fold over paragraphs, so it stays in the JVM.

    A paragraph that does not fit starts a new chunk behind its heading and the
    end of the chunk before, and is kept whole; only one that is too long while
    the buffer is empty is cut.
    """
    clean = normalize_text(text)
    paragraphs = F.filter(F.transform(F.split(clean, rf"\n{SPACE}*\n"), strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("chunks"), F.lit("").alias("now"), F.lit("").alias("heading"))

    def step(acc: Column, p: Column) -> Column:
        is_heading = p.rlike(r"^(?:#{1,6}\s+|第[一二三四五六七八九十百]+[章节条])")
        heading = F.when(is_heading, F.substring(F.substring_index(p, "\n", 1), 1, 200)).otherwise(acc["heading"])
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        fits = F.length(joined) <= max_chars
        prefix = F.when((heading != "") & ~F.contains(p, heading), F.concat(heading, F.lit("\n\n"))).otherwise("")
        tail = F.right(acc["now"], F.lit(overlap)) if overlap else F.lit("")
        carried = strip(F.concat(prefix, tail, F.lit("\n\n"), p))
        return F.struct(
            F.when(fits, acc["chunks"]).when(acc["now"] != "", F.concat(acc["chunks"], F.array(acc["now"]))).otherwise(F.concat(acc["chunks"], windows(p, max_chars, max(1, max_chars - overlap)))).alias("chunks"),
            F.when(fits, joined).when(acc["now"] != "", carried).otherwise("").alias("now"), heading.alias("heading"))

    done = F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["chunks"], F.array(acc["now"]))).otherwise(acc["chunks"]))
    return F.filter(done, lambda c: strip(c) != "")


def fixed_windows(text: Column, size: int = 3000, overlap: int = 200) -> Column:
    """One chunk if short, none if blank, else windows."""
    text = F.coalesce(text, F.lit(""))
    short = F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) <= size, short).otherwise(windows(text, size, size - overlap))


def lexical_tokens(text: Column) -> Column:
    """Alphanumeric runs, then 2- and 3-grams of all CJK characters run together; stop words and single characters go."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    cjk = F.array_join(F.regexp_extract_all(low, F.lit("[一-龥]"), F.lit(0)), "")
    grams = lambda n: F.when(F.length(cjk) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(cjk) - (n - 1), F.lit(1))), lambda i: F.substring(cjk, i, n))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(latin, grams(2), grams(3)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def hash_grams(text: Column) -> Column:
    """P03 before counting: 2-grams of each CJK character or alphanumeric run."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[一-龥]|[a-zA-Z0-9]+"), F.lit(0))
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 1)), lambda i: F.substring(t, i, 2))))


def md5_number(text: Column) -> Column:
    """The first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bin(gram: Column, dim: int = 256) -> Column:
    return (md5_number(gram) % dim).cast("int")


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """P03 for short texts: counts of grams in ``dim`` bins, of unit length (documents: operators.retrieval.gram_counts)."""
    bins = F.transform(hash_grams(text), lambda g: hash_bin(g, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bins, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped non-blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def chunk_id(doc: Column, version: Column, index: Column, content: Column) -> Column:
    """P08."""
    return F.sha2(F.concat_ws(":", doc.cast("string"), version.cast("string"), index.cast("string"), content).cast("binary"), 256)


def page_number(chunk: Column, fallback: Column) -> Column:
    """The first "# Page n" line, else the fallback."""
    found = F.regexp_extract(chunk, r"(?m)^# Page (\d+)", 1)
    return F.coalesce(F.try_to_number(F.when(found != "", found), F.lit("9999999999")).cast("int"), fallback)


def token_estimate(text: Column) -> Column:
    """P10."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("int")


def utf8_cut(text: Column, max_bytes: int) -> Column:
    """At most so many bytes of UTF-8, without a broken last character.

    Continuation bytes are 10xxxxxx: the cut moves left until the byte after it starts a character.
    """
    raw = text.cast("binary")
    starts = lambda i: ~F.substring(F.hex(F.substring(raw, i + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    at = F.coalesce(*[F.when(starts(F.lit(max_bytes - k)), F.lit(max_bytes - k)) for k in range(4)], F.lit(max(0, max_bytes - 3)))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.substring(raw, F.lit(1), at).cast("string"))


def follow_up(query: Column, previous: Column) -> Column:
    """Short or referring questions carry the one before."""
    refers = contains_any(query, REFERENTIAL) | (F.length(strip(query)) <= 6)
    joined = F.substring(F.concat(F.substring(previous, 1, 600), F.lit("\n追问："), query), 1, 2000)
    return F.when(previous.isNotNull() & refers, joined).otherwise(query)


def clauses(query: Column) -> Column:
    """P22 splitting: at conjunctions, commas, semicolons and line ends; stripped, blanks dropped."""
    parts = F.split(strip(query), "然后|并且|接着|最后|之后|同时|[，,；;\n]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ \t。！？.!?]+|[ \t。！？.!?]+$", "")), lambda p: p != "")


def layer_token(name: Column) -> Column:
    """P54."""
    return F.substring(F.upper(F.regexp_replace(name, rf"(?:{SPACE}|[_-])+", "")), 1, 80)


def count_band(n: Column) -> Column:
    """Number of digits, 6 at most; 0 for none."""
    return F.when(n <= 0, 0).otherwise(F.least(F.lit(6), F.length(n.cast("string"))))


def event_cursor(value: Column, fallback: Column) -> Column:
    """The larger of the fallback, the parsed cursor and 0."""
    return F.greatest(fallback, F.coalesce(value.try_cast("bigint"), fallback), F.lit(0).cast("long"))


def memory_key(*parts: Column) -> Column:
    """Hash over the parts as a JSON array."""
    return F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256)


def floor_code(value: Column) -> Column:
    """B1, 1F, RF style codes, upper-cased; anything else is an error."""
    code = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), rf"{SPACE}+", ""))
    return F.when(code.rlike(r"^(?:B[1-9]\d*|[1-9]\d*F|RF)$"), code).otherwise(F.raise_error(F.concat(F.lit("invalid floor code: "), F.coalesce(value, F.lit("null")))).cast("string"))


def level_range(value: Column) -> Column:
    """P36: "bottom~top" in metres as struct(bottom, top); an inverted or unreadable one is an error."""
    parts = F.split(value, "~")
    bottom, top = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = (F.size(parts) == 2) & bottom.isNotNull() & top.isNotNull() & (top > bottom)
    return F.when(good, F.struct(bottom.alias("bottom"), top.alias("top"))).otherwise(F.raise_error(F.concat(F.lit("invalid level range: "), F.coalesce(value, F.lit("null")))).cast("struct<bottom:double,top:double>"))


def elevation_value(text: Column) -> Column:
    """A signed number with an optional unit, in metres; mm are converted, ± and blanks are allowed."""
    number = F.regexp_extract(text, r"([+\-±]?\s*\d+(?:\.\d+)?)\s*(mm|m|MM|M)?", 1)
    unit = F.lower(F.regexp_extract(text, r"([+\-±]?\s*\d+(?:\.\d+)?)\s*(mm|m|MM|M)?", 2))
    value = F.regexp_replace(number, r"[±\s+]", "").try_cast("double")
    return F.when(unit == "mm", value / 1000).otherwise(value)


def general_number(value: Column) -> Column:
    """The %g form of a double: six significant digits, without trailing zeros."""
    magnitude = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    plain = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    digits = F.format_string("%s", F.round(value / F.pow(F.lit(10.0), magnitude), 5))
    exponent = F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit("e"), F.when(magnitude < 0, "-").otherwise("+"), F.lpad(F.abs(magnitude).cast("string"), 2, "0"))
    scaled = F.expr("1D")
    for m in range(6):  # six significant digits: m places before the point leave 5 - m behind it
        scaled = F.when(magnitude == m, F.round(value, 5 - m)).otherwise(scaled)
    small = F.regexp_replace(F.format_string("%.5f", scaled), r"\.?0+$", "")
    return F.when(magnitude.between(0, 5), small).when(magnitude < -4, exponent).when(magnitude < 0, plain).otherwise(exponent)


def range_text(low: Column, high: Column) -> Column:
    """P15: "low" or "low-high"; equal bounds collapse."""
    return F.when(low == high, general_number(low)).otherwise(F.concat(general_number(low), F.lit("-"), general_number(high)))
