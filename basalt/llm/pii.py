"""Personal data replaced by format-preserving Feistel pseudonyms, with DataFrame functions only.

One regular expression finds candidates; each is validated (Luhn, mod 97, octets, calendar, number
plan) and permuted within its format under a key, so equal values get equal pseudonyms in every
document and different values different ones:
  * digits and letters (e-mail local parts, phones, cards, IBANs, secrets): an additive Feistel
    network over the two halves of the value, each character shifted within its own class;
  * dates, social security numbers and IPv4 addresses: a numeric Feistel network over two radices,
    cycle-walked into the valid range. Check digits are computed anew.
Everything stays in the JVM, one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._names import column, free, replaced

ROUNDS = 8
#: Characters that one permutation of a text covers: two halves of 64, one byte of the key stream for each.
BLOCK = 128
#: Candidate patterns, tried in this order at each position. The text around must not go on with a word.
PATTERNS = {
    "secret": r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?)[A-Za-z0-9_\-]{8,}+|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)|\+\d{8,15}(?!\d)",
    "card": r"\d(?:[ \-]?\d){12,18}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])",
}
BEFORE = r"(?<![A-Za-z0-9._%+\-])"
FINDER = BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")"
#: First and number of days that a date may be permuted to (1900-01-01 to 2099-12-31).
FIRST_DAY, DAYS = "1900-01-01", 73049

_chars = lambda s: F.split(s, "")
_digits = lambda s: F.regexp_replace(s, r"\D", "")


def _prf(key: str, kind: str | Column, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, turn.cast("string"), value, F.lit(key)), 512)


def permute_text(value: Column, key: str, kind: str | Column, letters: Column | None = None) -> Column:
    """Permutes letters and digits of strings of up to 128 characters, each within its class.

    ``letters`` (6 or 26) is the size of the letters' alphabet; 6 for hexadecimal values.
    """
    size = F.lit(26) if letters is None else letters

    def shifted(text: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            v = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda base, n: F.chr((F.pmod(F.ascii(c) - base + v, n) + base).cast("long"))
            lower, upper = F.ascii(c) - 97, F.ascii(c) - 65
            return F.when(c.between("0", "9"), turn(48, F.lit(10))).when((lower >= 0) & (lower < size), turn(97, size)).when((upper >= 0) & (upper < size), turn(65, size)).otherwise(c)

        return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(_chars(text), one), ""))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    step = lambda s, r: F.struct(s["b"].alias("a"), shifted(s["a"], _prf(key, kind, r, s["b"])).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.transform(F.array(done), lambda s: F.concat(s["a"], s["b"]))[0]


def permute_long(value: Column, key: str, kind: str, letters: Column | None = None) -> Column:
    """``permute_text`` of strings of any length, in blocks of BLOCK characters; each block has its own key."""
    more = F.sequence(F.lit(1), F.floor((F.length(value) - 1) / BLOCK).cast("int"))
    block = lambda i: permute_text(F.substring(value, i * BLOCK + 1, F.lit(BLOCK)), key, F.concat(F.lit(f"{kind}-"), i.cast("string")), letters)
    first = permute_text(F.substring(value, F.lit(1), F.lit(BLOCK)), key, kind, letters)
    return F.when(F.length(value) <= BLOCK, first).otherwise(F.concat(first, F.array_join(F.transform(more, block), "")))


def permute_number(value: Column, low: int, high: int, count: int, key: str, kind: str, inside=None, turns: int = 40) -> Column:
    """A keyed permutation of 0 .. count - 1 (count <= low * high), walked on until it is back in the range and,
    if given, ``inside(number)`` holds, as it does for ``value``; so it permutes those numbers among themselves."""

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / high).cast("long").alias("a"), F.pmod(x, F.lit(high)).cast("long").alias("b"), F.lit(low).cast("long").alias("m"), F.lit(high).cast("long").alias("n"))

        def step(s: Column, r: Column) -> Column:
            f = F.conv(F.substring(_prf(key, kind, r, s["b"].cast("string")), 1, 14), 16, 10).cast("long")
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f, s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
        return F.transform(F.array(done), lambda s: s["a"] * high + s["b"])[0]

    # Outside the range at most 1 - count / (low * high) of the time; 40 steps leave nothing there.
    outside = lambda x: (x >= count) if inside is None else (x >= count) | ~inside(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), F.lit(-1).cast("long"), lambda acc, r: F.when((r == 1), once(value)).when(outside(acc), once(acc)).otherwise(acc))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; the digits at positions of parity ``odd`` from the right are doubled."""
    value = lambda c, i: F.when(i % 2 == odd, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of a string of letters (A = 10 ..) and digits read as one number."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _refill(layout: Column, characters: Column, kind: str = r"[0-9]") -> Column:
    """``layout`` with its characters of ``kind`` replaced, in order, by those of ``characters``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(characters, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(hit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(_chars(layout), start, step)["out"]


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.pmod(10 - _luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
    return F.when(_luhn_sum(d, 1) % 10 == 0, _refill(m, F.concat(body, check)))


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country, rest = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    new = permute_text(rest, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = F.length(s).between(15, 34) & (_mod97(F.concat(rest, country, F.substring(s, 3, 2))) == 1)
    return F.when(valid, _refill(m, F.concat(country, check, new), "[A-Z0-9]"))


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    part = lambda i: F.split(m, "/")[i].cast("int")
    # Day and month as the month-first reading has them, if that is a date, else day first.
    first = F.when(part(0) <= 12, F.lit("m")).otherwise(F.lit("d"))
    month, day = F.when(first == "m", part(0)).otherwise(part(1)), F.when(first == "m", part(1)).otherwise(part(0))
    there = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.concat_ws("-", part(2).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))
    start = F.to_date(F.lit(FIRST_DAY))
    at = F.date_diff(there, start).cast("long")
    widths = [F.length(F.split(m, "/")[i]) for i in (0, 1)]
    # A part of one digit stays one digit, and a date that is read day first still can be read in no other way.
    wide = {"month": F.when(first == "m", widths[0]).otherwise(widths[1]), "day": F.when(first == "m", widths[1]).otherwise(widths[0])}

    def inside(n: Column) -> Column:
        day = F.date_add(start, n.cast("int"))
        return ((wide["month"] == 2) | (F.month(day) <= 9)) & ((wide["day"] == 2) | (F.day(day) <= 9)) & ((first == "m") | (F.day(day) > 12))

    whole = (first == "m") & (F.least(*widths) == 2)
    number = F.when(iso | whole, permute_number(at, 271, 270, DAYS, key, "date")).otherwise(permute_number(at, 271, 270, DAYS, key, "date", inside, 600))
    new = F.date_add(start, number.cast("int"))
    shown = lambda part, n: F.lpad(part(new).cast("string"), n, "0") if isinstance(n, int) else F.when(n == 1, part(new).cast("string")).otherwise(F.lpad(part(new).cast("string"), 2, "0"))
    month, day = shown(F.month, wide["month"]), shown(F.day, wide["day"])
    slashed = F.concat_ws("/", F.when(first == "m", month).otherwise(day), F.when(first == "m", day).otherwise(month), shown(F.year, 4))
    return F.when(at.between(0, DAYS - 1), F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(slashed))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    index = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    new = permute_number(index, 29815, 29816, 898 * 99 * 9999, key, "ssn")
    a, g, s = F.floor(new / (99 * 9999)), F.floor(new / 9999) % 99 + 1, new % 9999 + 1
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(F.when(a >= 665, a + 2).otherwise(a + 1), 3), pad(g, 2), pad(s, 4)))


def _ip(m: Column, key: str) -> Column:
    o = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    new = permute_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, 1 << 32, key, "ip")
    return F.when(F.greatest(*o) < 256, F.concat_ws(".", *(F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))


def _phone(m: Column, key: str) -> Column:
    # The country code and the first digits of area and exchange (which a number plan restricts) stay.
    d = _digits(m)
    n = F.length(d)
    lead = F.substring(d, F.lit(1), n - 10)
    last = F.substring(d, n - 9, F.lit(10))
    new = permute_text(F.concat(F.substring(last, 2, 2), F.substring(last, 5, 6)), key, "phone")
    plan = F.concat(lead, F.substring(last, 1, 1), F.substring(new, 1, 2), F.substring(last, 4, 1), F.substring(new, 3, 6))
    short = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), n), key, "phone"))
    return _refill(m, F.when(n >= 10, plan).otherwise(short))


def _email(m: Column, key: str) -> Column:
    local, domain = F.split(m, "@")[0], F.lower(F.split(m, "@")[1])
    # The last label of the domain stays, so the value is still an address.
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"\.[^.]*$", 0)
    return F.when(top.rlike(r"^\.[a-z]{2,}$"), F.concat(permute_text(local, key, "local"), F.lit("@"), permute_long(host, key, "domain"), top))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"^(?:AKIA)?.*?([A-Za-z0-9_\-]+)$", 1)
    name = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(name, permute_long(value, key, "secret", F.when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), F.lit(6)).otherwise(F.lit(26))))


KINDS = {"secret": _secret, "email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found: str = "found") -> DataFrame:
    """``docs``, all rows and columns, with the text's personal data replaced and, last, the column ``found``:
    an array of (kind, count) of what was replaced, in alphabetical order. A column of that name gives way.

    A null text stays null with an empty ``found``; so does one without candidates. Candidates that
    fail validation stay as they are. Rows are independent, so repeated rows are treated alike and there
    are no ties. An empty table gives an empty result.
    """
    text = column(text_col).cast("string")
    done_col, tally_col = free(docs, "_done", "_tally")
    done = F.col(done_col)

    def treat(m: Column) -> Column:
        kind = F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()))
        new = F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), KINDS[k](m, key)) for k, p in PATTERNS.items()))
        return F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("new"))

    some = text.rlike("[0-9@=:]|AKIA") & text.rlike(FINDER)
    marked = docs.withColumn(done_col, F.when(some, F.transform(F.regexp_extract_all(text, F.lit(FINDER), F.lit(0)), treat)))
    between = F.split(text, FINDER, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(between, done, lambda p, d: F.array(F.coalesce(p, F.lit("")), F.coalesce(d["new"], F.lit(""))))), "")
    kinds = F.filter(F.transform(F.coalesce(done, F.array().cast("array<struct<kind:string,new:string>>")), lambda d: d["kind"]), lambda k: k.isNotNull())
    tally = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias("count")))
    new = F.when(done.isNotNull(), rebuilt).otherwise(column(text_col))
    out = marked.select(*(new.alias(c) if c == text_col else column(c) for c in docs.columns), tally.alias(tally_col))
    return replaced(out, **{found: tally_col})
