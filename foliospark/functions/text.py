"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
UUID = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
#: Suffixes that a file name loses when it becomes a title.
SUFFIXES = "pdf|PDF|xlsx|xls|pptx|ppt|docx|jpg|jpeg|png|bmp|md|txt|html"
#: Number words and their values.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "single": 1, "dual": 2, "quad": 4,
}


#: Characters of words in any script.
WORD = r"\p{L}\p{N}_"


def clean_query(text: Column) -> Column:
    """A search string: what is no word character becomes a space, CJK and alphanumeric runs are parted, spaces are single."""
    words = F.regexp_replace(text, rf"[^{WORD}{CJK}]+", " ")
    parted = F.regexp_replace(words, rf"([{CJK}])([A-Za-z0-9_])", "$1 $2")
    parted = F.regexp_replace(parted, rf"([A-Za-z0-9_])([{CJK}])", "$1 $2")
    return F.trim(F.regexp_replace(parted, r"\s+", " "))


def retrieval_query(text: Column) -> Column:
    """A question without punctuation and double spaces; every word stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"[^{WORD}\s{CJK}]", " "), r"\s+", " "))


def _bigrams(word: Column, step: int) -> Column:
    """Two-character pieces of a word, each step characters; the last two characters always end the list."""
    starts = F.sequence(F.lit(1), F.length(word) - 1, F.lit(step))
    pieces = F.transform(starts, lambda i: F.substring(word, i, F.lit(2)))
    if step == 1:
        return pieces
    return F.array_distinct(F.concat(pieces, F.array(F.substring(word, F.length(word) - 1, F.lit(2)))))


def chunk_tokens(text: Column) -> Column:
    """Tokens for chunk search: CJK words of three or more characters as overlapping pairs, all others whole."""
    is_cjk = lambda w: w.rlike(rf"^[{CJK}]+$")
    return F.flatten(F.transform(words_of(clean_query(text)), lambda w: F.when(is_cjk(w) & (F.length(w) >= 3), _bigrams(w, 1)).otherwise(F.array(w))))


def page_tokens(text: Column) -> Column:
    """Tokens for page search: CJK words of more than four characters as pairs side by side, all others whole."""
    is_cjk = lambda w: w.rlike(rf"^[{CJK}]+$")
    return F.flatten(F.transform(words_of(clean_query(text)), lambda w: F.when(is_cjk(w) & (F.length(w) > 4), _bigrams(w, 2)).otherwise(F.array(w))))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def trigram_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$"))


def bigram_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) == 2)


def query_keywords(text: Column, least: int = 2) -> Column:
    """CJK runs of two or more, then ASCII words of `least` or more that aren't digits alone."""
    latin = F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9]{{{least},}}"), 0)
    return F.concat(F.regexp_extract_all(text, F.lit(rf"[{CJK}]{{2,}}"), 0), F.filter(latin, lambda t: ~t.rlike(r"^\d+$")))


def model_tokens(text: Column) -> Column:
    """Identifiers of capitals and digits, like AB1234X, once each in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])[A-Z]+\d{2,}[A-Z]*(?![A-Za-z0-9])"), 0))


#: Words of questions that name no document.
NO_ENTITIES = (
    "公司", "集团", "股份", "有限", "责任", "公司名称", "股票代码",
    "报告", "年度", "季度", "年报", "季报", "年度报告", "季度报告",
    "营业", "收入", "利润", "资产", "负债", "权益", "现金流",
    "营业收入", "净利润", "总资产", "净资产", "每股收益",
    "财务", "指标", "数据", "金额", "数值", "总额", "合计",
    "多少", "什么", "如何", "是否", "哪些", "怎样", "为何", "原因",
    "是多少", "是什么", "怎么样", "有哪些", "为什么", "什么原因",
    "情况", "介绍", "信息", "内容", "问题", "答案", "主要", "业务",
)


def entities(text: Column) -> Column:
    """What a question may name: Latin words in capitals without hyphens, of three characters or with a digit, and CJK runs that aren't common words (J-15)."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])[A-Za-z]+-?[A-Za-z0-9]+(?![A-Za-z0-9])"), 0), lambda w: F.upper(F.replace(w, F.lit("-"), F.lit(""))))
    named = F.filter(latin, lambda w: (F.length(w) >= 3) | w.rlike("[0-9]"))
    groups = F.filter(F.regexp_extract_all(text, F.lit("[\u4e00-\u9fff]{2,12}"), 0), lambda w: ~w.isin(*NO_ENTITIES))
    return F.array_distinct(F.concat(named, groups))


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(20\d\d)"), 1))


def distinct_fold(words: Column) -> Column:
    """The first of each word, case apart."""
    lowered = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)


def fact_keywords(text: Column, entities: Column | None = None) -> Column:
    """Latin tokens of a question and the entities that are named with it, once each, case apart."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9.\-]{1,20}"), 0)
    return distinct_fold(F.concat(found, entities) if entities is not None else found)


def expand_terms(keywords: Column, vocabulary: Column, most: int = 24) -> Column:
    """keywords and the words of all vocabulary entries (a map) whose key is a keyword, at most `most`."""
    extra = F.flatten(F.transform(F.filter(F.map_keys(vocabulary), lambda k: F.array_contains(F.transform(keywords, F.lower), F.lower(k))), lambda k: F.element_at(vocabulary, k)))
    return F.slice(distinct_fold(F.concat(keywords, extra)), 1, most)


def sanitize_chars(text: Column) -> Column:
    """Without control characters (but line ends and tabs) and private-use characters."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{E000}-\x{F8FF}]", "")


def clean_title(title: Column) -> Column:
    """A section title without a page number at its end, leader dots and double spaces."""
    cut = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+\d+\s*$", "")
    return F.regexp_replace(F.trim(F.regexp_replace(cut, r"\.{2,}$", "")), r"\s+", " ")


def is_content_title(title: Column) -> Column:
    """False for titles of covers, contents and the like, with a leading underscore, or of digits alone."""
    return ~(F.lower(F.trim(title)).rlike(r"^(cover|contents|table of contents|toc|index|bookmark|copyright|legal notice|revision history|about this document|blank|title page|untitled).*$") | title.rlike(r"^\s*_") | title.rlike(r"^\s*\d*\s*$"))


def heading(line: Column) -> Column:
    """struct(level, path, title) of a line that is a heading, else null: '# x', '1.2 x', 'Chapter 3 x', CJK chapters."""
    none = F.lit(None).cast("struct<level:int,path:string,title:string>")
    made = lambda level, path, title: F.struct(level.cast("int").alias("level"), path.alias("path"), F.trim(title).alias("title"))
    part = lambda pattern, k: F.regexp_extract(line, pattern, k)
    sharp, number, named, cjk = r"^(#{1,6})\s+(.+)", r"^(\d+(?:\.\d+)*)[\s、．.]{1,3}(.+)", r"^((?i:Chapter|Section|Part))\s+(\d+|[A-Z])\s+(.+)", r"^第([一二三四五六七八九十]+)([编章节部篇])\s+(.+)"
    unit = part(cjk, 2)
    return (
        F.when(line.rlike(sharp), made(F.length(part(sharp, 1)), part(sharp, 2), part(sharp, 2)))
        .when(line.rlike(cjk), made(F.when(unit == "章", 2).when(unit == "节", 3).otherwise(1), F.concat_ws(".", part(cjk, 1), unit), part(cjk, 3)))
        .when(line.rlike(number) & (F.length(part(number, 1)) <= 8), made(F.length(part(number, 1)) - F.length(F.replace(part(number, 1), F.lit("."), F.lit(""))) + 1, part(number, 1), part(number, 2)))
        .when(line.rlike(named), made(F.when(F.lower(part(named, 1)) == "section", 2).otherwise(1), F.concat_ws(" ", F.initcap(part(named, 1)), part(named, 2)), part(named, 3)))
        .otherwise(none)
    )


def page_title(text: Column) -> Column:
    """The first of a page's first five lines that isn't blank and has at most 80 characters."""
    # a lambda: F.trim itself would get an element's index as the characters to trim
    lines = F.filter(F.transform(F.slice(F.split(text, "\n", -1), 1, 5), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 80))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def title_end(text: Column, title: Column) -> Column:
    """The place after the first occurrence of a title, case apart; 0 if there is none."""
    at = F.position(F.lower(title), F.lower(text))
    return F.when(at > 0, at + F.length(title) - 1).otherwise(0)


def title_keywords(title: Column) -> Column:
    """The first five words of a title, joined by commas."""
    return F.array_join(F.slice(F.regexp_extract_all(title, F.lit(rf"[{CJK}]{{2,}}|[A-Za-z][A-Za-z0-9\-_]+"), 0), 1, 5), ", ")


def filename_title(name: Column) -> Column:
    """A file name as a title: without a leading UUID and the suffix, with spaces for _ and -."""
    cut = F.regexp_replace(F.regexp_replace(name, rf"^{UUID}_", ""), rf"\.({SUFFIXES})$", "")
    spaced = F.trim(F.translate(cut, "_-", "  "))
    return F.when(spaced == "", name).otherwise(spaced)


def is_uuid_like(text: Column) -> Column:
    bare = F.regexp_replace(text, "[ -]", "")
    return ((F.length(bare) == 32) & bare.rlike("^[a-f0-9]+$")) | ((F.length(text) >= 30) & text.rlike(r"^[a-f0-9\s\-]+$"))


def page_summary(text: Column, stop: str = "。") -> Column:
    """100 characters of a short text, else its first three sentences, at most 200 characters and an ellipsis."""
    three = F.substring_index(text, stop, 3)
    return F.when(F.length(text) < 200, F.substring(text, 1, 100)).when(F.length(three) > 200, F.concat(F.substring(three, 1, 200), F.lit("..."))).otherwise(three)


def product_model(name: Column) -> Column:
    return F.regexp_extract(name, r"([A-Z]{2,}\d{3,}[A-Z0-9]*)", 1)


def contains_loosely(text: Column, part: Column) -> Column:
    """Whether part occurs, white space and case apart; an empty part does not."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return (bare(part) != "") & F.contains(bare(text), bare(part))


def strip_generated(text: Column) -> Column:
    """Text before the first block that a model has added to a page."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?si)(?:---\s*#{0,3}\s*Page Visual Analysis \(VLM\)|===\s*Page Chart Content Analysis\s*===).*", "")


def clean_value(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^[ \t\r\n:;,.]+|[ \t\r\n:;,.]+$", "")


def number_value(word: Column) -> Column:
    """The integer that a number word or digits stand for, else null."""
    known = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    low = F.lower(F.trim(word))
    return F.coalesce(F.try_element_at(known, low), low.try_cast("int"))


def version_tokens(text: Column, family: str) -> Column:
    """Versions of a family (PCIe3.1, PCIe 2.0, ...) in a text, without spaces, once each, case apart."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b({family}\s?\d+(?:\.\d+)?)"), 1)
    return distinct_fold(F.transform(found, lambda v: F.regexp_replace(v, r"\s+", "")))


def trim_verbatim(text: Column, most: int) -> Column:
    """At most `most` characters, ended at the last sentence end in the second half if there is one."""
    cut = F.substring(text, 1, most)
    ended = F.regexp_extract(cut, r"(?s)^(.*[.!?;。！？；])", 1)
    return F.when(F.length(text) <= most, text).when(F.length(ended) > most / 2, ended).otherwise(F.concat(cut, F.lit("...")))


def label_paragraphs(text: Column) -> Column:
    """A text of 1000 characters and more than three paragraphs with a numbered mark before each of more than 50 characters."""
    parts = F.split(text, "\n\n", -1)
    marked = F.transform(parts, lambda p, i: F.concat(F.when(F.length(F.trim(p)) > 50, F.concat(F.lit("[Section "), (i + 1).cast("string"), F.lit("]\n"))).otherwise(""), p, F.lit("\n")))
    return F.when((F.length(text) < 1000) | (F.size(parts) <= 3), text).otherwise(F.array_join(marked, "\n"))


def language(text: Column) -> Column:
    return F.when(text.rlike(rf"[{CJK}]"), "zh").otherwise("en")


def is_garbled_answer(text: Column) -> Column:
    """Whether more than 30 % of the characters are question marks."""
    return (F.length(text) > 0) & (F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > 0.3 * F.length(text))


def split_at_markers(text: Column) -> Column:
    """A context cut before each page mark '--- title (Page n) ---'."""
    return F.filter(F.split(text, r"(?m)(?=^--- .* \(Page \d+\) ---$)"), lambda p: F.trim(p) != "")


def json_table(text: Column) -> Column:
    """A JSON object of headers and rows as a Markdown table; null if it isn't one."""
    read = F.from_json(text, "headers array<string>, rows array<array<string>>")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(read["headers"], lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(read["headers"].isNotNull(), F.array_join(F.concat(F.array(line(read["headers"]), rule), F.transform(F.coalesce(read["rows"], F.array()), line)), "\n"))


#: The mark before a table, lines of plain text before it and of numbers among them beyond which that text is the table once more.
TABLE_MARK, PLAIN_LINES, NUMBER_LINES = r"\n\s*\[Table\s*\d+\]\s*\n", 15, 5


def optimize_tables(text: Column) -> Column:
    """A page from its first marked table on, where the plain text before repeats that table (F-13)."""
    before = F.regexp_extract(text, f"(?s)^(.*?){TABLE_MARK}", 1)
    lines = F.split(F.regexp_replace(before, r"^\s+|\s+$", ""), "\n", -1)
    repeats = text.rlike(TABLE_MARK) & (F.size(lines) > PLAIN_LINES) & (F.size(F.filter(lines, lambda x: x.rlike(r"\d{3,}"))) > NUMBER_LINES)
    rest = F.regexp_replace(F.substring(text, F.length(before) + 1, F.length(text)), r"^\s*\[Table\s*\d+\]\s*\n", "")
    return F.when(repeats, F.regexp_replace(rest, r"^\s+|\s+$", "")).otherwise(text)


def latex_score(text: Column) -> Column:
    """From 0 to 1: balanced braces .4, a command .3, an operator .2, no replacement character .1."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    some = lambda yes, x: F.when(yes, x).otherwise(0.0)
    return F.round(some(count("{") == count("}"), 0.4) + some(text.rlike(r"\\[A-Za-z]+"), 0.3) + some(text.rlike(r"[=+\-*/^_]"), 0.2) + some(~text.contains("�"), 0.1), 6)


#: Words that name a kind of chart, in the order of precedence.
CHART_WORDS = (("bar", ("bar chart", "histogram", "column chart")), ("line", ("line chart", "curve", "trend")), ("pie", ("pie chart", "donut")), ("flow", ("flowchart", "flow chart", "block diagram")), ("table", ("table",)), ("photo", ("photo", "picture")))


def chart_type(text: Column) -> Column:
    low, out = F.lower(text), None
    for kind, some in CHART_WORDS:
        hit = F.lit(False)
        for word in some:
            hit = hit | low.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def drop_noise_lines(text: Column, least: int = 2, head: int = 120, tail: int = 40) -> Column:
    """Lines with a letter or digit, once each in order; of too many, the first `head` and the last `tail`."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) >= least) & x.rlike(r"[\p{L}\p{N}]")))
    return F.array_join(F.when(F.size(lines) > head + tail, F.concat(F.slice(lines, 1, head), F.slice(lines, -tail, tail))).otherwise(lines), "\n")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def term_hit(text: Column, term: Column) -> Column:
    """Whether an ASCII term occurs as a word, or any other as a substring; case apart."""
    low, word = F.lower(text), F.lower(term)
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), word, F.lit(r"\E(?![a-z0-9])"))
    return F.when(word.rlike(r"^[\x00-\x7f]+$"), F.regexp_like(low, quoted)).otherwise(F.contains(low, word))


def precise_match(text: Column, term: Column) -> Column:
    """A term of three or more characters anywhere, a shorter one as a word; case apart."""
    return F.when(F.length(term) >= 3, F.contains(F.lower(text), F.lower(term))).otherwise(term_hit(text, term))


def count_of(text: Column, part: Column | str) -> Column:
    """Occurrences side by side of a part that isn't empty."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


#: White space, and boxes, replacement and stray control characters, as characters to be taken out of a text.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21)]))
_GARBLED = "\u25a1\ufffd\u25a0\u201a\u0192" + "".join(map(chr, [0x00, *range(0x10, 0x1C)]))


def garbled_ratio(text: Column) -> Column:
    """The share of boxes, replacement and stray control characters among characters that aren't white space; 1 of none."""
    without = lambda some: F.length(F.translate(text, some, ""))
    total = without(_SPACES)
    return F.when(total > 0, (F.length(text) - without(_GARBLED)) / total).otherwise(1.0)


def paragraph_score(text: Column) -> Column:
    """The mean of the share of lines of 6 to 199 characters and, from three lines on, of lines that aren't cut short; .5 below two lines."""
    sizes = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.length(F.trim(x))), lambda n: n > 0)
    fair = F.size(F.filter(sizes, lambda n: (n > 5) & (n < 200))) / F.size(sizes)
    short = F.filter(sizes, lambda n, i: (n < 5) & (F.coalesce(F.try_element_at(sizes, i + 2), F.lit(0)) > 50))
    both = (fair + 1 - F.size(short) / F.size(sizes)) / 2
    return F.when(~text.contains("\n"), 0.5).when(F.size(sizes) == 0, 0.5).when(F.size(sizes) >= 3, both).otherwise(fair)


def dictionary_rate(text: Column, terms: tuple[str, ...] = ()) -> Column:
    """The share of CJK groups among known terms; without CJK a tenth for each Latin word, at most 1."""
    groups = F.regexp_extract_all(text, F.lit(rf"[{CJK}]{{2,3}}"), 0)
    known = F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() as array<string>)")
    hits = F.size(F.filter(groups, lambda g: F.array_contains(known, g)))
    return F.when(F.size(groups) > 0, hits / F.size(groups)).otherwise(F.least(F.regexp_count(text, F.lit("[a-zA-Z]{2,}")) / 10, F.lit(1.0)))


def text_quality(docs: DataFrame, text: str = "text", terms: tuple[str, ...] = (), garbled_most: float = 0.05) -> DataFrame:
    """docs with garbled, dictionary, paragraph, score and level: PASS, SUSPICIOUS or FAIL.

    The three shares are columns before anything is made of them, so a text is looked through once for each.
    """
    t = F.trim(F.col(text))
    short = F.col(text).isNull() | (F.length(t) < 10)
    share = lambda of_short, value: F.when(short, of_short).otherwise(value)
    shares = {"garbled": share(1.0, garbled_ratio(t)), "dictionary": share(0.0, dictionary_rate(t, terms)), "paragraph": share(0.0, paragraph_score(t)), "_short": short}
    measured = docs.withColumns(shares)
    score = F.when(F.col("_short"), 0.0).otherwise((1 - F.col("garbled")) * 0.4 + F.col("dictionary") * 0.3 + F.col("paragraph") * 0.3)
    scored = measured.withColumn("score", score)
    readable = F.col("garbled") <= garbled_most
    level = F.when(F.col("_short"), "FAIL").when((F.col("score") >= 0.7) & readable & (F.col("dictionary") >= 0.3), "PASS").when((F.col("score") >= 0.4) & readable, "SUSPICIOUS").otherwise("FAIL")
    return scored.withColumn("level", level).drop("_short")


def confidence(answer: Column, context: Column, units: str = "mm|mhz|ghz|v|ma", terms: str = "interface|protocol|page") -> Column:
    """none, low, medium or high, from how specific an answer is and whether it says that nothing was found."""
    low = F.lower(answer)
    missing = low.rlike("not found|no relevant|no information|does not contain|does not mention")
    specific = F.regexp_count(low, F.lit(rf"\d+[.\d]*\s*(?:{units})")) + F.regexp_count(low, F.lit(rf"\b(?:{terms})\b")) + count_of(low, "\n- ") + count_of(low, "\n* ") + F.floor(count_of(low, "\n|") / 2)
    cut = F.contains(context, F.lit("[CONTENT TRUNCATED")) | F.contains(context, F.lit("[TRUNCATED"))
    size = F.length(answer)
    return (
        F.when(answer.isNull() | (F.length(F.trim(answer)) < 10), "none")
        .when(missing & (specific >= 3), "medium").when(missing, "low")
        .when((specific >= 8) & (size > 500) & ~cut, "high")
        .when(((specific >= 8) & (size > 500)) | ((specific >= 4) & (size > 200)) | ((specific >= 2) & (size > 100)), "medium")
        .otherwise("low")
    )


def content_cap(score: Column) -> Column:
    from ..config import CONTENT_TIERS, LAST_TIER

    out = None
    for least, size in CONTENT_TIERS:
        out = F.when(score >= least, size) if out is None else out.when(score >= least, size)
    return out.otherwise(LAST_TIER)


def max_results(n_entities: Column, base: int = 20) -> Column:
    return F.least(F.greatest(F.lit(base), 15 * n_entities), F.lit(500))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, u: s + u)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
