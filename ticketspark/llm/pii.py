"""Personal data: validated numbers and dates permuted within their format by a keyed Feistel network, in Spark expressions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session's setting that holds the key of the pseudonyms.
KEY_SETTING = "spark.ticketspark.pii.key"

#: Letters beside A-Z that names in addresses are written with, as (first code point, letters, step): Latin, Greek, Cyrillic, Armenian,
#: Hebrew and Arabic. A letter moves within its row; the rows of small and capital letters of one alphabet are equally long.
LETTERS = [
    *((0xC0, 23, 1), (0xE0, 23, 1), (0xD8, 7, 1), (0xF8, 7, 1), (0xDF, 2, 32)),
    *((0x100, 28, 2), (0x101, 28, 2), (0x139, 8, 2), (0x13A, 8, 2), (0x14A, 23, 2), (0x14B, 23, 2)),
    *((0x391, 17, 1), (0x3B1, 17, 1), (0x3A3, 7, 1), (0x3C3, 7, 1), (0x3C2, 1, 1)),
    *((0x410, 32, 1), (0x430, 32, 1), (0x400, 16, 1), (0x450, 16, 1)),
    *((0x531, 38, 1), (0x561, 38, 1), (0x5D0, 27, 1), (0x621, 26, 1), (0x641, 10, 1)),
]
# the alphabets of LETTERS in few ranges, as a pattern tries each of them at every sign. Their other signs stay, combining accents among them;
# other letters end an address as spaces do, for texts in Han, Kana and Thai have no spaces there
_ALPHA = r"A-Za-z\u00C0-\u0386\u0388-\u0559\u0561-\u0587\u05D0-\u05EA\u0620-\u064A"
_LETTER = _ALPHA + "0-9"
_LOCAL = _LETTER + "._%+-"

#: What may be personal data, first match first. Each is validated before it is changed.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[{_LETTER}-]++(?:\.[{_LETTER}-]++)*\.[{_ALPHA}]{{2,}}+(?![{_LETTER}])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?=T\d{2}:?\d{2})|(?!\w|[./-]\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    # +1 or brackets mark a number with any area code, others need one that is in use; an extension may follow and stays
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|(?:1[ .-]?)?(?:\(\d{3}\)[ .-]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4})(?:(?!\w|-\d)|(?=(?:x|ext\.?) ?\d{1,6}(?!\w)))",
    # unbroken up to 15 digits, else up to 13, so that the next number seldom counts as a part
    "international": r"(?<![\w+])\+[2-9](?:\d{7,14}|(?:[ .-]?\d){7,12})(?:(?!\w|-\d)|(?=(?:x|ext\.?) ?\d{1,6}(?!\w)))",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
}
# only the pattern of dates has groups, so their numbers hold in the alternation too
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NO_EMAIL = "|".join(f"(?:{p})" for name, p in PATTERNS.items() if name != "email")

#: Usual shapes of card numbers, of equal beginnings the longest first. One with a right Luhn sum is a card whatever numbers stand beside it.
CARDS = [
    *(rf"\d{{4}}(?:{sep}\d{{4}}){{3}}{more}" for sep in " -" for more in (rf"{sep}\d{{3}}", "")),
    *(rf"\d{{4}}{sep}\d{{6}}{sep}\d{{{n}}}" for sep in " -" for n in (5, 4)),
    r"(?<!-)\d{13,19}(?!-\d)",
]
#: A whole run of 13 to 19 digits in any groups.
RUN = r"(?<![\w-])(?<!\d )\d(?:[ -]?\d){12,18}(?![ -]?\d)(?!\w)"

#: The first day of the permuted range of dates, and its length as 270 * 271 days: to 2100-05-02.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)
#: Times a date is permuted again while it is on the other side of the 12th; that it never gets back has a chance of 10**-26.
WALKS = 64


def session_key(spark: SparkSession) -> str:
    """The key in the setting KEY_SETTING. A session without one draws a key of its own: pseudonyms then agree within that session alone."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, found)
    return found


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, tweak: Column, key: str) -> Column:
    """struct<l, r>: a keyed permutation of (left, right) below (n_left, n_right): each half in turn moves by a hash of the other."""
    move = lambda i, x: F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda acc, i: F.when(i % 2 == 1, F.struct(F.pmod(acc["l"] + move(i, acc["r"]), n_left.cast("long")).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + move(i, acc["l"]), n_right.cast("long")).alias("r"))
        ),
    )


def _permute_digits(d: Column, tweak: str, key: str) -> Column:
    """Digits of any number, as many again."""
    a = F.floor(F.length(d) / 2).cast("int")
    b = F.length(d) - a
    out = feistel(_number(F.substr(d, F.lit(1), a)), _number(F.substr(d, a + 1)), _pow10(a), _pow10(b), F.concat(F.lit(tweak), F.length(d)), key)
    return F.concat(_pad(out["l"], a), _pad(out["r"], b))


def _refill(shape: Column, d: Column) -> Column:
    """shape with its digits replaced by those of d in turn."""
    at = lambda i: F.substr(shape, i, F.lit(1))
    one = lambda i: F.when(at(i).rlike("[0-9]"), F.substr(d, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(at(i))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of digits, the last one counted once."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    payload = _permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
    check = F.pmod(10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10, F.lit(10))
    return F.when(luhn_sum(d) % 10 == 0, _refill(m, F.concat(payload, check.cast("string"))))


def _phone(m: Column, key: str) -> Column:
    d = F.right(_digits(m), F.lit(10))
    area = _number(F.substr(d, F.lit(1), F.lit(3)))
    # area codes from 200 move among themselves, and so do those below, so each number still matches where it stands
    first, codes = F.when(area < 200, 0).otherwise(200), F.when(area < 200, 200).otherwise(800)
    out = feistel(area - first, _number(F.substr(d, F.lit(4))), codes, F.lit(10_000_000), F.lit("phone"), key)
    country = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _refill(m, F.concat(country, _pad(out["l"] + first, 3), _pad(out["r"], 7)))


def _international(m: Column, key: str) -> Column:
    """The first two digits stay, as the country; the rest are permuted."""
    d = _digits(m)
    return F.when(F.length(d).between(8, 15), _refill(m, F.concat(F.substr(d, F.lit(1), F.lit(2)), _permute_digits(F.substr(d, F.lit(3)), "international", key))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_number(F.split_part(m, F.lit("-"), F.lit(i))) for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    area = F.when(out["l"] < 665, out["l"] + 1).otherwise(out["l"] + 2)
    return F.when(valid, F.concat_ws("-", _pad(area, 3), _pad(F.floor(out["r"] / 9999) + 1, 2), _pad(out["r"] % 9999 + 1, 4)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: _number(p))
    o = [F.get(parts, i) for i in range(4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
    octets = [F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256]
    return F.when(F.array_max(parts) < 256, F.concat_ws(".", *[x.cast("string") for x in octets]))


def _date(m: Column, key: str) -> Column:
    """Year first or last. With the year last and slashes, a first field up to 12 is the month, else the day.

    Days after the 12th move among themselves, and so do the others: so a slashed
    date with its day first still shows that it has, and different dates stay different.
    """
    sep = F.regexp_extract(m, r"[-/.]", 0)
    field = lambda i: F.get(F.split(m, r"[-/.]"), i)
    year_first = F.length(field(0)) == 4
    month_first = ~year_first & (sep == "/") & (_number(field(0)) <= 12)
    y, mo, d = F.when(year_first, field(0)).otherwise(field(2)), F.when(month_first, field(0)).otherwise(field(1)), F.when(year_first, field(2)).when(month_first, field(1)).otherwise(field(0))
    day = F.datediff(F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-M-d"), F.lit(FIRST_DAY).cast("date"))

    def moved(n: Column) -> Column:
        out = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
        return (out["l"] * DAYS[1] + out["r"]).cast("int")

    on = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    late = _number(d) > 12
    new = on(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), moved(day), lambda n, _: F.when((F.day(on(n)) > 12) == late, n).otherwise(moved(n))))
    wide = (F.length(mo) == 2) & (F.length(d) == 2)
    y, mo, d = F.year(new).cast("string"), F.when(wide, _pad(F.month(new), 2)).otherwise(F.month(new).cast("string")), F.when(wide, _pad(F.day(new), 2)).otherwise(F.day(new).cast("string"))
    text = F.when(year_first, F.concat(y, sep, mo, sep, d)).when(month_first, F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))
    return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), text)


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay, digits after the check digits are permuted, and the check digits are made anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, own = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    rest = lambda x: F.aggregate(
        F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    )
    digits = _permute_digits(_digits(own), "iban", key)
    moved = _refill(own, digits)
    check = _pad(98 - rest(F.concat(moved, country, F.lit("00"))), 2)
    valid = (rest(F.concat(own, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1) & (F.length(_digits(own)) >= 2)
    return F.when(valid, _refill(m, F.concat(check, digits)))


def _email(m: Column, key: str) -> Column:
    """Letters and digits before the @ move within their class, other alphabets' as LETTERS says; the domain and other signs stay."""
    local, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    half = F.floor(F.length(local) / 2).cast("int")

    def move(text: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), domain, i.cast("string"), F.lower(other)), 512)
        moved = lambda c, at, first, n, step=1: first + step * F.pmod(F.floor((F.ascii(c) - first) / step).cast("int") + F.conv(F.substr(stream, 3 * (at % 42) + 1, F.lit(3)), 16, 10).cast("int"), F.lit(n))
        sign = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

        def one(c: Column, at: Column) -> Column:
            code, foreign = F.ascii(c), c
            for first, n, step in LETTERS:
                inside = code.between(first, first + (n - 1) * step) & ((code - first) % step == 0)
                foreign = F.when(inside, sign(moved(c, at, first, n, step))).otherwise(foreign)
            for kind, first, n in (("[0-9]", 48, 10), ("[A-Z]", 65, 26), ("[a-z]", 97, 26)):
                foreign = F.when(c.rlike(kind), F.char(moved(c, at, first, n))).otherwise(foreign)
            return foreign

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    out = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1).alias("r")),
        lambda acc, i: F.when(i % 2 == 0, F.struct(move(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), move(acc["r"], acc["l"], i).alias("r"))),
    )
    return F.concat(out["l"], out["r"], F.substr(m, F.length(local) + 1))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match of any pattern, or null if the match isn't valid."""
    kinds = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "international": _international, "iban": _iban}
    out = F.lit(None).cast("string")
    for name in reversed(kinds):
        out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), kinds[name](m, key)).otherwise(out)
    return out


def _same(text: Column) -> Column:
    return F.struct(text.alias("old"), F.lit(None).cast("string").alias("new"))


def _moved(text: Column, new: Column) -> Column:
    return F.struct(text.alias("old"), new.alias("new"))


def _between(rest: Column, found: Column) -> Column:
    """What stands between, and what was found after each."""
    return F.flatten(F.zip_with(rest, found, lambda p, x: F.array(_same(p), F.coalesce(x, _same(F.lit(""))))))


def _cut_out(text: Column, cards: Column, key: str) -> Column:
    """text in parts, with the cards, which are digits, spaces and hyphens alone and so a pattern themselves, replaced."""
    card = F.concat(F.lit(r"(?<!\w)(?:"), F.array_join(cards, "|"), F.lit(r")(?!\w)"))
    return _between(F.split(text, card, -1), F.transform(F.regexp_extract_all(text, card, F.lit(0)), lambda m: _moved(m, _card(m, key))))


def _further(parts: Column, cut) -> Column:
    """Parts that are not replaced yet, cut into further ones."""
    return F.flatten(F.transform(parts, lambda p: F.when(p["new"].isNotNull(), F.array(p)).otherwise(cut(p["old"]))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace personal data in the column text of docs; n_pii counts the replacements. All other columns stay.

    Found are e-mail addresses, IPv4 addresses, dates, phone numbers, US social
    security numbers, IBANs and card numbers. A match counts only if it is valid:
    octets below 256, a real date from 1900-01-01 to 2100-05-02, a right check sum
    of cards and IBANs, and so on; other numbers are left alone. Phone numbers with
    +1 or a bracketed area code may have any area code, others one from 200.
    Cards of a usual shape are found first, also between other numbers; then the
    other kinds; then, in what is left, whole runs of 13 to 19 digits in other
    groups. So no run of digits hides what stands in it. Each is replaced by a
    value of its own format, permuted by a Feistel network under key: equal
    values get equal pseudonyms in all documents, different values different
    ones, however a number's digits are separated. A card's or an IBAN's new
    number has a right check sum too. Addresses may have letters of LETTERS
    before the @ and in the domain; the domain, and the extension after a phone
    number (x12, ext. 12), stay as they are. Left alone are names, dates with
    two-digit years or month names, IPv6 addresses, numbers that begin with 00,
    numbers of ten digits without any separator, other long numbers and secrets.
    The key is part of the plan, so keep
    plans and event logs as private as the key.

    A null text stays null, with n_pii 0; other columns may hold nulls, rows may
    repeat, and texts are read whole. A column named n_pii is replaced. An empty
    table stays empty.
    """
    text = F.col("text").cast("string")
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    valid = lambda found: F.array_distinct(F.filter(found, lambda m: luhn_sum(_digits(m)) % 10 == 0))
    shaped = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rf"(?<!\w)(?=({p})(?!\w))"), F.lit(1)) for p in CARDS]))
    held = docs.withColumn("__cards", F.when(some & text.rlike("|".join(CARDS)), valid(shaped)))
    parts = F.when(F.size("__cards") > 0, _cut_out(text, F.col("__cards"), key)).when(some, F.array(_same(text)))

    def runs(s: Column) -> Column:
        cards = valid(F.regexp_extract_all(s, F.lit(RUN), F.lit(0)))
        # a lambda's argument, so that the runs are looked for once
        return F.when(s.rlike(RUN), F.flatten(F.transform(F.array(cards), lambda x: F.when(F.size(x) > 0, _cut_out(s, x, key)).otherwise(F.array(_same(s)))))).otherwise(F.array(_same(s)))

    # addresses are looked for where there is an @ alone
    kinds = lambda s: F.when(s.contains("@"), _ANY).otherwise(_NO_EMAIL)
    rest = lambda s: _between(F.split(s, kinds(s), -1), F.transform(F.regexp_extract_all(s, kinds(s), F.lit(0)), lambda m: _moved(m, pseudonym(m, key))))
    held = held.withColumn("__parts", _further(_further(parts, rest), runs))
    count = F.coalesce(F.size(F.filter("__parts", lambda x: x["new"].isNotNull())), F.lit(0)).cast("long")
    whole = F.array_join(F.transform("__parts", lambda x: F.coalesce(x["new"], x["old"])), "")
    n_pii = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(count).cast("long")
    return held.withColumns({"n_pii": n_pii, "text": F.when(n_pii > 0, whole).otherwise(text)}).drop("__cards", "__parts")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", "n_pii")
