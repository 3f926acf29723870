"""Text, personal-data, hash and address expressions. All take and return Columns; a missing text is ''."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import pack_zh as zh

CJK = "一-龥"


def blank(c: Column) -> Column:
    """'' for null, blank and the text nan, else the trimmed text."""
    t = strip(c)
    return F.when(t.isNull() | (t == "nan"), "").otherwise(t)


def filled(c: Column) -> Column:
    """The text, or null if it is null or blank."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first of the texts that isn't blank, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use refers to it.

    Long rule chains stand in such a lambda so that generated code stays small.
    """
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(words: Sequence[str]) -> str:
    """A pattern for any of the words, longer ones first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def has_any(c: Column, words: Sequence[str]) -> Column:
    return c.rlike(any_of(words))


def holds_any(c: Column, words: Sequence[str]) -> Column:
    """has_any by plain searches: faster in a long text, but each word is a part of the plan."""
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words[1:], F.contains(c, F.lit(words[0]))) if words else F.lit(False)


def has_chinese(c: Column) -> Column:
    """Whether a rule that needs a Chinese sign can find anything."""
    return F.coalesce(c.rlike(f"[{CJK}]"), F.lit(False))


def first_found(*columns: Column) -> Column:
    """first_filled of costly columns: each is worked out once, and only if those before are blank."""
    return F.coalesce(*[let(c, lambda x: F.when(x != "", x)) for c in columns], F.lit(""))


#: Texts that Python holds as strings at once; a batch is kept as bytes.
AT_ONCE = 32


@F.arrow_udf(StringType())
def _nfkc(c: pa.Array) -> pa.Array:
    some = lambda i: pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in c.slice(i, AT_ONCE).to_pylist()], c.type)
    return pa.concat_arrays([some(i) for i in range(0, len(c), AT_ONCE)] or [c])


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Spark has no built-in function for it. Texts of ASCII alone, as many bytes as signs, don't go to Python."""
    return F.coalesce(_nfkc(F.when(F.octet_length(c) > F.length(c), c)), c)


def fold_fullwidth(c: Column) -> Column:
    """U+FF01 to U+FF5E as ASCII, and U+3000 as a space; other signs stay."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def strip_noise(c: Column) -> Column:
    """URLs and all but Chinese signs, letters, digits and spaces as spaces; runs collapsed, ends trimmed."""
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", " ")
    c = F.regexp_replace(c, rf"[^{CJK}A-Za-z0-9\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Tags and entities out, full-width ASCII folded, repeated marks, blank lines and spaces collapsed, lines trimmed."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    c = fold_fullwidth(F.regexp_replace(c, "&[a-zA-Z#0-9]+;", " "))
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), "\r\n|\r", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\n{2,}", "\n"), " {2,}", " ")
    # the search for equal marks goes back at each mark, so it is left to texts that have two beside each other
    c = let(c, lambda x: F.when(x.rlike("[!？。，、；：]{2}"), F.regexp_replace(x, r"([!？。，、；：])\1+", "$1")).otherwise(x))
    return F.trim(F.regexp_replace(c, " *\n *", "\n"), F.lit(" \n"))


def remove_boilerplate(c: Column, phrases: Sequence[str] = tuple(zh.BOILERPLATE)) -> Column:
    return F.regexp_replace(c, any_of(phrases), "")


def apply_synonyms(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Replace in turn; later pairs see what earlier ones made."""
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def normalize_text(c: Column, pairs: Sequence[tuple[str, str]] = ()) -> Column:
    return apply_synonyms(strip_noise(nfkc(c)), pairs)


def clean_title(c: Column) -> Column:
    """Without a leading （tag） of up to 15 signs and leading words like 再次反映."""
    c = F.regexp_replace(strip(c), r"^[（(][^（）()]{1,15}[）)]\s*", "")
    return strip(F.regexp_replace(c, rf"^(?:{'|'.join(zh.TITLE_ACTIONS)})+\s*", ""))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…")))


def mask_pii(c: Column) -> Column:
    """Identity numbers first, then mobile numbers and names before a title."""
    c = F.regexp_replace(c, r"(?<!\d)(\d{6})\d{8}(\d{3}[\dXx])(?!\d)", "$1********$2")
    c = F.regexp_replace(c, r"(?<!\d)(1[3-9]\d)\d{6}(\d{2})(?!\d)", "$1****$2")
    return F.regexp_replace(c, rf"([{CJK}])(?:先生|女士|同志|小姐|同学)", "$1*")


def clean_phone(c: Column) -> Column:
    """struct<normalized, masked, raw, confidence> of a phone field."""
    return let(c, lambda x: let(F.regexp_replace(x, r"[^0-9]", ""), lambda d: _phone(x, d)))


def _phone(c: Column, d: Column) -> Column:
    mobile, line = d.rlike(r"^1[3-9]\d{9}$"), F.length(d).between(7, 8)
    return F.struct(
        F.when(mobile | line, d).otherwise("").alias("normalized"),
        F.when(mobile, F.concat(F.substring(d, 1, 3), F.lit("****"), F.substring(d, 8, 4))).when(line, F.concat(F.substring(d, 1, 3), F.lit("****"))).otherwise("").alias("masked"),
        strip(c).alias("raw"),
        F.when(mobile, 1.0).when(line, 0.4).otherwise(0.0).alias("confidence"),
    )


def extract_phone(c: Column) -> Column:
    """clean_phone of the first mobile number in a text, however it is spaced."""
    return clean_phone(F.regexp_extract(c, r"1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}", 0))


def clean_caller_name(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"(?:{any_of(list(zh.CALLER_TITLES))})$", "女士")


def clean_ticket_no(c: Column) -> Column:
    return F.upper(strip(c))


def normalize_request(c: Column) -> Column:
    """Trimmed, four Chinese marks as ASCII, white space collapsed, marks at the end gone, lower case."""
    c = F.translate(strip(c), "，。！？", ",.!?")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[.,!?;；]+$", "")
    return F.lower(c)


def content_hash(no: Column, content: Column, title: Column) -> Column:
    return F.md5(F.concat_ws("|", no, content, title))


def text_fingerprint(content: Column) -> Column:
    """Hash of the cleaned text alone, so that it matches across ticket numbers."""
    return F.md5(clean_text(content))


def fmt_seen(ts: Column, missing: str = "") -> Column:
    day = (F.hour(ts) == 0) & (F.minute(ts) == 0)
    text = F.when(day, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    return F.coalesce(text, F.lit(missing))


def normalize_address(*parts: Column) -> Column:
    return F.concat_ws("", *[F.nullif(p, F.lit("")) for p in parts])


def semantic_content(subject: Column, address: Column, kind: Column, detail: Column, request: Column, start: Column, pattern: Column) -> Column:
    """主体：…；地点：…；事件：…；诉求：…；时间：…, without the empty ones."""
    event = F.when((detail != "") & (kind != "") & ~F.contains(detail, kind), F.concat(kind, F.lit("("), detail, F.lit(")"))).otherwise(first_filled(detail, kind))
    parts = (("主体：", subject), ("地点：", address), ("事件：", event), ("诉求：", request), ("时间：", first_filled(F.substring(start, 1, 16), pattern)))
    return F.concat_ws("；", *[F.when(c != "", F.concat(F.lit(name), c)) for name, c in parts])


def has_landmark(c: Column) -> Column:
    return has_any(F.replace(c, F.lit("街道"), F.lit("")), zh.PLACE_LANDMARKS)


def addr_contains(a: Column, b: Column) -> Column:
    """Whether one address without digits holds the other, which has five signs and a landmark. Symmetric."""
    ca, cb = (F.regexp_replace(x, "[0-9０-９]", "") for x in (a, b))
    short, long = F.when(F.length(ca) <= F.length(cb), ca).otherwise(cb), F.when(F.length(ca) <= F.length(cb), cb).otherwise(ca)
    return F.coalesce((a != "") & (b != "") & (F.length(short) >= 5) & F.contains(long, short) & has_landmark(short), F.lit(False))


def norm_subject(c: Column) -> Column:
    s = blank(c)
    return F.when((F.length(s) >= 4) & ~s.isin(zh.GENERIC_SUBJECTS), s).otherwise("")


def event_name(subject: Column, kind: Column) -> Column:
    alone = (subject == "") | subject.startswith("（") | subject.startswith("多主体聚合")
    return F.when(alone, kind).otherwise(F.concat(subject, F.lit(" · "), kind))


def weighted_text(content: Column, subject: Column, event: Column, area: Column, weights: tuple[int, int, int] = (1, 3, 2)) -> Column:
    parts = [content, *[c for c, n in zip((subject, event, area), weights, strict=True) for _ in range(n)]]
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def flatten_rich_cell(c: Column) -> Column:
    """Text of a JSON cell: null as '', a list's items' text or name (or plain value) joined, an object's text or name or itself."""
    named = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.name"), F.when(x.startswith("{"), x).otherwise(F.regexp_replace(x, '^"|"$', "")))
    items = F.from_json(c, "array<string>")
    return F.when(c.isNull() | (F.trim(c) == "null"), "").when(F.trim(c).startswith("["), F.array_join(F.transform(items, named), "")).otherwise(named(F.trim(c)))


def char_ngrams(c: Column) -> Column:
    """Single signs and pairs of each run of Chinese signs, letters and digits, in order of runs."""
    runs = F.filter(F.split(F.lower(c), rf"[^{CJK}a-z0-9]+"), lambda r: r != "")
    ones = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(1)))
    twos = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array())
    return F.flatten(F.transform(runs, lambda r: F.concat(ones(r), twos(r))))


def split_keys(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
