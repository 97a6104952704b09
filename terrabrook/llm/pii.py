"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found and validated: payment cards (13 to 19 digits, plain or in groups, first digit 2 to 6, Luhn), IBANs (mod 97), social
security numbers (areas, groups and serials that are given out), telephone numbers (international with +, or ten digits in
groups), IPv4 addresses, dates of 1900 to 2099 and the local parts of e-mail addresses. A value's digits, the 32 bits of
an address, the day within its century or the letters and digits of a local part go through eight rounds of a keyed Feistel
network over exactly that domain, so the pseudonym has the same format and stays valid (check digits are made anew), different values
stay different, and equal values get equal pseudonyms in every document, however they are punctuated. What doesn't
validate stays as it is, and so does all other text.

Every place where a shape begins is tried, also within a match that didn't validate, and the first valid one of two that overlap is taken.
What follows a value isn't taken with it: an international number has the digits of its calling code's plan (`PLANS`; of other codes as many
groups as 15 digits and the next value allow), an IBAN its country's length (`IBANS`), or else the longest run of its groups that validates.

Repeats of unbounded length are possessive, so that no text, however long or odd, makes the matcher recurse or try again.

Null text stays null, with 0 replaced; texts are taken whole at any length; rows are independent, so repeated rows give repeated
results; an empty table gives no rows; all columns are kept, whatever their names, `replaced` is new (an old one of just that name goes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NO_WORD, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Digits behind the calling codes with plans of (nearly) one length.
PLANS = {
    "8": "45|47|53|65|216|356|357|370|371|373|374|382|852|853|965|968|973|974",
    "9": "27|31|33|34|40|41|48|56|61|93|94|212|218|254|255|256|351|380|420|421|966|994|995|996|998",
    "10": "1|7|20|30|52|58|90|91|92|98",
    "11": "86",
    "7,8": "372",
    "8,9": "32|36|213|359|385|886|972",
    "9,10": "44|60|81|84",
    "10,11": "54|55",
}
#: Characters of an IBAN by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: What begins another value, so that no number goes on there, and the next digit of a number, in groups of two digits at least.
_OTHER = rf"(?:{_OCTET}\.){{3}}|[0-9]{{4}}[\-/.][0-9]{{2}}[\-/.][0-9]{{2}}{_END}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}{_END}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}|(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}{_END}|[0-9]{{13}}|(?:[0-9]{{4}}[ \-]){{3}}[0-9]{{4}}{_END}(?![ \-][0-9]{{4}}{_END})|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}{_END}|[\p{{L}}\p{{N}}._%+\-]++@"
_NEXT = r"(?:[0-9]|(?:\)[ .\-]?\(?|[ .\-]\(?|\()[0-9](?=[0-9]))"
_FREE = rf"(?:(?! (?:{_OTHER})){_NEXT}){{7,14}}{_END}|[0-9]{_NEXT}{{7,14}}"
_PLANNED = "|".join(f"(?:{codes}){_NEXT}{{{n}}}{_END}" for n, codes in PLANS.items())
#: The shapes of what may be personal, by kind.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "date": rf"{_NO_WORD}(?:(?:19|20)[0-9]{{2}}(?<day>[\-/.])(?:0[1-9]|1[0-2])\k<day>(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{{2}}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{{2}}){_END}",
    "ssn": rf"(?<![\p{{L}}\p{{N}}\-])(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?![\p{{L}}\p{{N}}]|-[0-9])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+(?:{_PLANNED}|[0-9]{_FREE})|(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}){_END}",
    "iban": rf"{_NO_WORD}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_END}",
    "card": rf"{_NO_WORD}(?:[0-9]{{13,19}}|[0-9]{{4}}(?<four>[ \-])[0-9]{{4}}\k<four>[0-9]{{4}}\k<four>[0-9]{{4}}|[0-9]{{4}}(?<six>[ \-])[0-9]{{6}}\k<six>[0-9]{{5}}){_END}",
}
PATTERN = "|".join(SHAPES.values())
#: Matches folded at once: a step copies the list of what its block has put out.
BLOCK = 256
#: First day and days of a century as a product, which the two halves of a date number.
CENTURIES = {"19": ("1900-01-01", 92, 397), "20": ("2000-01-01", 75, 487)}


def _prf(key: str, kind: str, size: Column, r: Column, other: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), r.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: str, size: Column, a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """A permutation of the pairs (a, b) with a < ma and b < mb, as a struct."""
    step = lambda s, r: F.struct(s["b"].alias("a"), F.pmod(s["a"] + _prf(key, kind, size, r, s["b"]), F.when(r % 2 == 0, ma).otherwise(mb)).alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _zeros(number: Column, n: Column | int) -> Column:
    return F.call_function("lpad", number, n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _right(text: Column, n: Column) -> Column:
    return F.substring(text, F.length(text) - n + 1, n)


def _permuted(key: str, kind: str, digits: Column) -> Column:
    """A string of 1 to 30 digits as another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left = F.when(u > 0, F.substring(digits, F.lit(1), u)).otherwise("0").cast("long")
    done = _feistel(key, kind, n, left, F.substring(digits, u + 1, n - u).cast("long"), power(u), power(n - u))
    return _once(done, lambda d: F.concat(F.when(u > 0, _zeros(d["a"].cast("string"), u)).otherwise(""), _zeros(d["b"].cast("string"), n - u)))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _put(text: Column, digits: Column) -> Column:
    """text with its digits replaced in order."""
    place = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(text, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, "(?!$)"), place), "")


def _luhn(digits: Column) -> Column:
    """The check digit behind digits."""
    each = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.pmod(10 - F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10, F.lit(10)).cast("string")


def _mod97(code: Column) -> Column:
    """The remainder of an IBAN whose first four characters went to the end."""
    values = F.transform(F.split(code, "(?!$)"), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = F.substring(d, F.lit(1), n - 1)
    valid = d.rlike("^[2-6]") & (_luhn(body) == _right(d, F.lit(1)))
    new = _once(F.concat(F.substring(d, 1, 1), _permuted(key, "card", F.substring(d, F.lit(2), n - 2))), lambda b: F.concat(b, _luhn(b)))
    return F.when(valid, _once(new, lambda x: _put(m, x))).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    tail = F.when(n > 10, 10).when(m.startswith("+"), n - 1).otherwise(n)
    valid = n.between(8, 15)
    return F.when(valid, _once(F.concat(F.substring(d, F.lit(1), n - tail), _permuted(key, "phone", _right(d, tail))), lambda x: _put(m, x))).otherwise(m)


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999 are numbered without gaps."""
    p = F.split(m, "-")
    area = p[0].cast("long") - F.when(p[0].cast("long") > 666, 2).otherwise(1)
    low = (p[1].cast("long") - 1) * 9999 + p[2].cast("long") - 1
    done = _feistel(key, "ssn", F.lit(9), area, low, F.lit(898), F.lit(99 * 9999))
    first = lambda d: d["a"] + F.when(d["a"] + 1 >= 666, 2).otherwise(1)
    pad = lambda x, n: _zeros(x.cast("string"), n)
    return _once(done, lambda d: F.concat_ws("-", pad(first(d), 3), pad(F.floor(d["b"] / 9999) + 1, 2), pad(d["b"] % 9999 + 1, 4)))


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    done = _feistel(key, "ip", F.lit(32), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return _once(done, lambda d: F.concat_ws(".", *(x.cast("string") for h in "ab" for x in (F.floor(d[h] / 256), d[h] % 256))))


def _date(key: str, m: Column) -> Column:
    """Year first; day, month, year with dots; month, day, year with slashes."""
    first = m.rlike("^[0-9]{4}")
    dots = F.substring(m, 3, 1) == "."
    part = lambda a, n: F.substring(m, a, n).cast("int")
    year = F.when(first, part(1, 4)).otherwise(part(7, 4))
    month = F.when(first, part(6, 2)).when(dots, part(4, 2)).otherwise(part(1, 2))
    day = F.when(first, part(9, 2)).when(dots, part(1, 2)).otherwise(part(4, 2))
    sep = F.substring(m, 5, 1)

    def shown(t: Column) -> Column:
        iso = F.call_function("concat_ws", sep, F.date_format(t, "yyyy"), F.date_format(t, "MM"), F.date_format(t, "dd"))
        return F.when(first, iso).when(dots, F.date_format(t, "dd.MM.yyyy")).otherwise(F.date_format(t, "MM/dd/yyyy"))

    def moved(century: str, start: str, ma: int, mb: int) -> Column:
        begin = F.lit(start).cast("date")
        days = F.date_diff(F.make_date(year, month, F.lit(1)), begin) + day - 1
        done = _feistel(key, "date", F.lit(int(century)), F.floor(days / mb), days % mb, F.lit(ma), F.lit(mb))
        return _once(_once(done, lambda d: F.date_add(begin, (d["a"] * mb + d["b"]).cast("int"))), shown)

    out = m
    for century, parts in CENTURIES.items():
        out = F.when(F.floor(year / 100) == int(century), moved(century, *parts)).otherwise(out)
    return F.when(day <= F.day(F.last_day(F.make_date(year, month, F.lit(1)))), out).otherwise(m)


def _iban_valid(code: Column) -> Column:
    return _mod97(F.concat(F.substring(code, F.lit(5), F.length(code) - 4), F.substring(code, 1, 4))) == 1


def _iban_part(m: Column) -> Column:
    """The first groups of m that are an IBAN: of its country's length, or else as many as validate; m if none do."""
    groups = F.split(m, " ")
    starts = F.transform(F.sequence(F.size(groups), F.least(F.size(groups), F.lit(3)), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    good = F.filter(starts, lambda p: _iban_valid(F.regexp_replace(p, " ", "")))
    usual = F.filter(good, lambda p: F.regexp_replace(p, " ", "").rlike("^(?:" + "|".join(f"(?:{c}).{{{n - 2}}}" for n, c in IBANS.items()) + ")$"))
    return F.coalesce(F.get(usual, F.lit(0)), F.get(good, F.lit(0)), m)


def _iban(key: str, m: Column) -> Column:
    code = F.regexp_replace(m, " ", "")
    body = F.substring(code, F.lit(5), F.length(code) - 4)
    d = _digits(body)
    new = F.when(F.length(d) > 0, _once(_permuted(key, "iban", d), lambda x: _put(body, x))).otherwise(body)
    check = lambda b: _zeros((98 - _mod97(F.concat(b, F.substring(code, 1, 2), F.lit("00")))).cast("string"), 2)
    whole = _once(new, lambda b: F.concat(check(b), b))
    chars = lambda w: F.array_join(F.transform(F.split(m, "(?!$)"), lambda c, i: F.when(c == " ", c).otherwise(F.substring(F.concat(F.substring(code, 1, 2), w), F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    return F.when(_iban_valid(code), _once(whole, chars)).otherwise(m)


def _email(key: str, m: Column) -> Column:
    """The halves of the local part shift each other's letters and digits, each within its kind."""
    local = F.substring_index(m, "@", 1)
    n = F.length(local)
    half = F.floor(n / 2).cast("int")

    def shifted(text: Column, r: Column, other: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), n.cast("string"), r.cast("string"), other), 256)

        def one(c: Column, i: Column) -> Column:
            h = F.conv(F.substring(stream, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for low, size in ((48, 10), (65, 26), (97, 26)):
                out = F.when(F.ascii(c).between(low, low + size - 1), F.char(F.lit(low) + (F.ascii(c) - low + h) % size)).otherwise(out)
            return out

        return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, "(?!$)"), one), "")).otherwise("")

    begin = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, n - half).alias("b"))
    done = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), begin, lambda s, r: F.struct(s["b"].alias("a"), shifted(s["a"], r, s["b"]).alias("b")))
    return _once(done, lambda d: F.concat(d["a"], d["b"], F.substring(m, n + 1, F.length(m) - n)))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match of PATTERN."""
    whole = lambda kind: m.rlike("^(?:" + SHAPES[kind] + ")$")
    return F.when(F.contains(m, F.lit("@")), _email(key, m)).when(whole("ip"), _ip(key, m)).when(whole("date"), _date(key, m)).when(whole("ssn"), _ssn(key, m)).when(whole("phone"), _phone(key, m)).when(m.rlike("^[A-Z]"), _iban(key, m)).otherwise(_card(key, m))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with personal values in `text` replaced by pseudonyms under `key`, and `replaced`, how many were."""
    column = F.col(f"`{text}`")
    names = [c for c in docs.columns if c != "replaced"]
    found = F.when(column.rlike("[0-9@]"), F.regexp_extract_all(column, F.lit(f"(?=({PATTERN}))"), F.lit(1)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), found.alias("_found"))  # the caller's names stay apart from those below
    column = F.col(f"_row.`{text}`")
    part = lambda m: F.when(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), _iban_part(m)).otherwise(m)
    tried = lambda m: _once(part(m), lambda p: F.struct(p.alias("old"), pseudonym(key, p).alias("new")))
    rows = rows.withColumn("_tried", F.when(F.size("_found") > 0, F.transform("_found", tried)))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(column, f"(?={PATTERN})", -1)))
    ahead = F.size("_gaps") - F.size("_tried")  # 1 if there is text before the first match
    each = F.zip_with(F.slice("_gaps", ahead + 1, F.size("_tried")), "_tried", lambda g, t: F.struct(g.alias("gap"), t["old"].alias("old"), t["new"].alias("new")))

    def step(s: Column, x: Column) -> Column:
        """left: characters of the value taken last that are still to come in the text; a match among them isn't looked at."""
        taken = (s["left"] == 0) & (x["new"] != x["old"])
        left = F.when(taken, F.length(x["old"])).otherwise(s["left"])
        shown = F.concat(F.when(taken, x["new"]).otherwise(""), F.substring(x["gap"], left + 1, F.length(x["gap"])))
        return F.struct(F.greatest(left - F.length(x["gap"]), F.lit(0)).alias("left"), F.concat(s["out"], F.array(shown)).alias("out"), (s["n"] + taken.cast("int")).alias("n"))

    def block(s: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(s["left"].alias("left"), none.alias("out"), s["n"].alias("n")), step)
        return _once(done, lambda d: F.struct(d["left"].alias("left"), F.concat(s["out"], F.array(F.array_join(d["out"], ""))).alias("out"), d["n"].alias("n")))

    none = F.array().cast("array<string>")
    rows = rows.withColumn("_each", each)
    blocks = F.transform(F.sequence(F.lit(1), F.size("_each"), F.lit(BLOCK)), lambda i: F.slice("_each", i, F.lit(BLOCK)))
    begin = F.struct(F.lit(0).alias("left"), F.when(ahead > 0, F.slice("_gaps", 1, 1)).otherwise(none).alias("out"), F.lit(0).alias("n"))
    rows = rows.withColumn("_done", F.when(F.size("_found") > 0, F.aggregate(blocks, begin, block)))
    shown = F.when(F.col("_done").isNotNull(), F.array_join("_done.out", "")).otherwise(column)
    return rows.select(*(shown.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names), F.coalesce("_done.n", F.lit(0)).alias("replaced"))
