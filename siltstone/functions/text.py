"""Text functions as columns: everything here stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists whose results must be kept.
CJK = r"\x{4e00}-\x{9fff}"
ACTION_WORDS = (
    "notify", "document", "review", "prepare", "update", "check", "verify", "send", "align", "fix", "monitor",
    "draft", "complete", "triage", "follow up", "communicate", "confirm", "must", "should", "need to",
)
HIGH_PRIORITY = ("urgent", "critical", "security", "immediately", "deadline", "blocker", "sla")
MEDIUM_PRIORITY = ("must", "should", "review", "notify", "prepare", "update", "verify")
RISK_WORDS = ("risk", "blocker", "delay", "issue", "failure", "missing", "conflict", "uncertain")
ARTICLE_PATTERN = (
    "第[一二三四五六七八九十百千万亿零〇两0-9]+条"
    "(?:之[一二三四五六七八九十百千万亿零〇两0-9]+)?"
    "(?:[（(][一二三四五六七八九十百千万亿零〇两0-9]+[）)])?"
)
CLAUSE_PATTERN = r"(?:条款全称|章节|小节|标题)[:：]\s*([^\n\r]{2,180})"
STRUCTURAL_PUNCTUATION = r"[，。；：、,.!?！？;:()（）\[\]【】\"'《》<>〈〉#]+"


def text(value: Column | str) -> Column:
    """Null as empty text: the two are equal for every function of this module."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(value: Column | str) -> Column:
    """Case folding: lower case, and sharp s as two letters."""
    return F.replace(F.lower(text(value)), F.lit("ß"), F.lit("ss"))


def squeeze(value: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(value), r"(?U)\s+", " "))


def plain(value: Column | str) -> Column:
    """Without NUL characters and carriage returns, blanks squeezed, no more than two line ends in a row, trimmed."""
    out = F.regexp_replace(F.regexp_replace(text(value), "\u0000", ""), "\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cut(value: Column | str, limit: int) -> Column:
    """Squeezed, at most limit characters, null if empty."""
    short = F.rtrim(F.substring(squeeze(value), 1, limit))
    return F.when(short != "", short)


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def search_tokens(value: Column | str) -> Column:
    """[a-z0-9]+ runs; a CJK run of up to 4 characters as itself, and every CJK run's 2-, 3- and 4-grams."""
    runs = F.regexp_extract_all(fold(value), F.lit(f"([a-z0-9]+|[{CJK}]+)"), 1)

    def expand(run: Column) -> Column:
        own = F.when(F.length(run) <= 4, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[a-z0-9]"), F.array(run)).otherwise(F.concat(own, _grams(run, 2), _grams(run, 3), _grams(run, 4)))

    return F.flatten(F.transform(runs, expand))


def token_estimate(value: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text(value)) / 4)).cast("int")


def structural_key(value: Column | str) -> Column:
    """Folded, without white space and listed punctuation."""
    return F.regexp_replace(F.regexp_replace(fold(value), r"(?U)\s+", ""), STRUCTURAL_PUNCTUATION, "")


def article_number(*values: Column) -> Column:
    """The first article number of the first value that has one."""
    found = [F.regexp_extract(text(v), f"({ARTICLE_PATTERN})", 1) for v in values]
    return F.coalesce(*[cut(F.when(f != "", f), 64) for f in found])


def clause_name(value: Column | str) -> Column:
    return cut(F.nullif(F.regexp_extract(text(value), CLAUSE_PATTERN, 1), F.lit("")), 255)


def chunk_type(content: Column, section: Column, clause: Column, article: Column) -> Column:
    body = F.trim(text(content))
    return (
        F.when(F.startswith(body, F.lit("Table row:")), "table")
        .when(clause.isNotNull() | article.isNotNull(), "article")
        .when(section.isNotNull(), "section")
        .when(body.rlike(r"^#{1,6}\s+\S"), "heading")
        .otherwise("paragraph")
    )


#: ASCII without lower-case letters and digits.
_MARKS = "".join(c for c in map(chr, range(128)) if not (c.islower() or c.isdigit()))


def compact(value: Column | str) -> Column:
    """Folded, Latin letters, digits and CJK only. A table takes out what is ASCII; only texts with other characters meet the pattern, which is far slower."""
    rest = F.translate(fold(value), _MARKS, "")
    return F.when(F.octet_length(rest) == F.length(rest), rest).otherwise(F.regexp_replace(rest, f"[^a-z0-9{CJK}]+", ""))


def match_text(value: Column | str) -> Column:
    """Folded, without white space, punctuation and symbols."""
    return F.regexp_replace(fold(value), r"[\p{P}\p{S}\s]+", "")


def sentences(value: Column | str) -> Column:
    """Pieces after . ! ? 。 ； ; with white space, or between lines; stripped of blanks and dashes."""
    parts = F.split(text(value), r"(?<=[.!?。；;])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \-\t]+|[ \-\t]+$", "")), lambda p: p != "")


def _any_of(words: tuple[str, ...], whole: bool = False) -> str:
    return rf"\b({'|'.join(words)})\b" if whole else f"({'|'.join(words)})"


def is_actionable(value: Column | str) -> Column:
    return F.lower(text(value)).rlike(_any_of(ACTION_WORDS, whole=True))


def is_risk(value: Column | str) -> Column:
    return F.lower(text(value)).rlike(_any_of(RISK_WORDS))


def priority(value: Column | str) -> Column:
    low = F.lower(text(value))
    return F.when(low.rlike(_any_of(HIGH_PRIORITY)), "high").when(low.rlike(_any_of(MEDIUM_PRIORITY)), "medium").otherwise("low")


def shorten(value: Column | str, limit: int = 220) -> Column:
    """Squeezed; over limit characters, cut with three dots."""
    flat = squeeze(value)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def task_title(value: Column | str, limit: int = 100) -> Column:
    """Shortened, without a leading must/should/need to, first letter upper case; "Follow up" if empty."""
    flat = F.regexp_replace(shorten(value, limit), r"(?i)^(must|should|need to)\s+", "")
    return F.when(flat == "", "Follow up").otherwise(F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1_000_000)))


def shingles(value: Column | str, size: int) -> Column:
    """Distinct character shingles; a shorter text has none."""
    t = text(value)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - size + 1), lambda i: F.substring(t, i, F.lit(size))))
    return F.when(F.length(t) < size, F.array().cast("array<string>")).otherwise(many)


def table_row_fields(value: Column | str) -> Column:
    """ "Table row: k=v; k=v." as a map; the first of repeated keys counts."""
    body = F.regexp_replace(F.trim(text(value)), r"^Table row:\s*|[.。]\s*$", "")
    pairs = F.filter(F.split(body, r"[;；]\s*"), lambda p: F.contains(p, F.lit("=")))
    items = F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    keys = F.transform(items, lambda x: x.k)
    firsts = F.filter(items, lambda x, i: (F.array_position(keys, x.k) == i + 1) & (x.k != ""))
    return F.map_from_entries(firsts)


def cjk_density(value: Column | str) -> Column:
    """CJK characters over CJK characters, Latin letters and digits; 0 without any."""
    cjk = F.length(F.regexp_replace(text(value), f"[^{CJK}]+", ""))
    rest = F.translate(text(value), _MARKS.translate({c: None for c in range(ord("A"), ord("Z") + 1)}), "")
    both = F.when(F.octet_length(rest) == F.length(rest), F.length(rest)).otherwise(F.length(F.regexp_replace(rest, f"[^A-Za-z0-9{CJK}]+", "")))
    return F.when(both > 0, cjk / both).otherwise(0.0)


def clamp(value: Column, digits: int = 4) -> Column:
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), digits)


#: Words of a question that its answer does not repeat; fixed values.
QUESTION_WORDS = ("什么", "怎么", "如何", "哪些", "多少", "多久", "是否", "可以", "需要", "要求", "请问")


def query_terms_of(value: Column | str) -> Column:
    """Terms of a question for matching sentences: CJK runs between function words, with 2- to 5-grams of those of more than four characters, and Latin words of three characters or more, distinct."""
    runs = F.flatten(F.transform(F.regexp_extract_all(text(value), F.lit(f"([{CJK}]+)"), 1), lambda r: F.filter(F.split(r, "的|了|和|与|及|或|在|对|中|里|为|是"), lambda p: F.length(p) >= 2)))
    parts = F.filter(runs, lambda p: ~p.isin(*QUESTION_WORDS))
    grams = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 4, F.concat(F.array(p), *[_grams(p, n) for n in (2, 3, 4, 5)])).otherwise(F.array(p))))
    return F.array_distinct(F.concat(F.filter(grams, lambda g: ~g.isin(*QUESTION_WORDS)), F.regexp_extract_all(F.lower(text(value)), F.lit("([a-z0-9]{3,})"), 1)))


def focus_terms(value: Column | str) -> Column:
    """Tokens of two characters or more, and 4-, 5- and 6-grams of those of more than six."""
    tokens = F.filter(F.regexp_extract_all(fold(value), F.lit(f"([a-z0-9]+|[{CJK}]+)"), 1), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.when(F.length(t) > 6, F.concat(F.array(t), *[_grams(t, n) for n in (4, 5, 6)])).otherwise(F.array(t)))))


def around(value: Column | str, hint: Column, limit: int = 260) -> Column:
    """The sentences of a text that touch a hint, found without case and white space, from the sentence that it begins in; null where it is not."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text(value), "([。！？!?；;]|\\n)", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")
    flat = lambda c: F.regexp_replace(fold(c), r"(?U)\s+", "")
    # Where each sentence ends in the flattened text, and where the hint lies.
    ends = F.transform(parts, lambda s, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(flat(x))))
    at = F.instr(F.aggregate(parts, F.lit(""), lambda a, x: F.concat(a, flat(x))), flat(hint))
    touched = F.filter(parts, lambda s, i: (F.get(ends, i) >= at) & (F.get(ends, i) - F.length(flat(s)) < at + F.length(flat(hint)) - 1))
    return F.when((at > 0) & (flat(hint) != ""), shorten(F.array_join(touched, ""), limit))


def vector_literal(values: Column, digits: int = 8) -> Column:
    """[a,b] with ``digits`` places."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def table_quote(value: Column | str, least: int = 2, most: int = 6) -> Column:
    """The clean key=value cells of a table row, the first ``most``, joined; null with fewer than ``least``. Cells without a key or value, and column placeholders, don't count."""
    cells = F.filter(F.transform(F.split(text(value), "[;；]"), squeeze), lambda c: F.contains(c, F.lit("=")))
    key = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.split_part(c, F.lit("="), F.lit(1))), r"(?i)^(?:table|表|column|col|列)\s*[0-9]+[.．、]?\s*", ""), "^[ ：:，。；;、]+|[ ：:，。；;、]+$", "")
    val = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, "^[^=]*=", "")), "^[ ：:，。；;、]+|[ ：:，。；;、]+$", "")
    pairs = F.filter(F.transform(cells, lambda c: F.when((key(c) != "") & (val(c) != "") & ~F.lower(key(c)).isin("table", "column", "项目"), F.concat(key(c), F.lit("="), val(c)))), lambda p: p.isNotNull())
    return F.when(F.size(pairs) >= least, F.array_join(F.slice(pairs, 1, most), "; "))
