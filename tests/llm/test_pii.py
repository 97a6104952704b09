import datetime
import hashlib
import random
import re

from terrabrook.llm import pii

KEY = "test key"


def prf(kind, size, r, other):
    return int(hashlib.sha256(f"{KEY}|{kind}|{size}|{r}|{other}".encode()).hexdigest()[:15], 16)


def feistel(kind, size, a, b, ma, mb):
    for r in range(8):
        a, b = b, (a + prf(kind, size, r, b)) % (mb if r % 2 else ma)
    return a, b


def permuted(kind, d):
    n, u = len(d), len(d) // 2
    a, b = feistel(kind, n, int(d[:u] or 0), int(d[u:]), 10**u, 10 ** (n - u))
    return (f"{a:0{u}d}" if u else "") + f"{b:0{n - u}d}"


def luhn(d):
    s = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
    return str((10 - s % 10) % 10)


def put(text, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def card(m):
    d = re.sub(r"\D", "", m)
    if d[0] not in "23456" or luhn(d[:-1]) != d[-1]:
        return m
    b = d[0] + permuted("card", d[1:-1])
    return put(m, b + luhn(b))


def ip(m):
    o = [int(x) for x in m.split(".")]
    a, b = feistel("ip", 32, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def phone(m):
    d = re.sub(r"\D", "", m)
    k = 10 if len(d) > 10 else len(d) - 1 if m[0] == "+" else len(d)
    return put(m, d[: len(d) - k] + permuted("phone", d[len(d) - k :]))


def date(m):
    t = datetime.date.fromisoformat(m)
    start, ma, mb = (datetime.date(1900, 1, 1), 92, 397) if t.year < 2000 else (datetime.date(2000, 1, 1), 75, 487)
    a, b = feistel("date", t.year // 100, *divmod((t - start).days, mb), ma, mb)
    return (start + datetime.timedelta(a * mb + b)).isoformat()


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, replaced string")
    return {r["doc_id"]: (r["text"], r["replaced"]) for r in pii.pseudonymise(df, KEY).collect()}


def test_values_against_python(spark):
    rng = random.Random(2)
    cards = [b + luhn(b) for b in ("4" + "".join(rng.choices("0123456789", k=k)) for k in (11, 14, 14, 17))]
    cards += ["-".join(re.findall("....", cards[1])), "9" + cards[1][1:], cards[1][:-1] + str((int(cards[1][-1]) + 1) % 10)]
    values = [(c, card(c)) for c in cards] + [(x, ip(x)) for x in ("97.51.17.173", "255.255.255.255", "0.0.0.0")] + [(x, phone(x)) for x in ("+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+44 20 7183 8750", "+12025550123")] + [(x, date(x)) for x in ("1999-12-31", "2000-01-01", "2024-02-29", "1900-01-01", "2099-12-31")]
    got = run(spark, [shape.format(value) for value, _ in values for shape in ("é {} end", "{}", "({})!!")])
    for k, (value, want) in enumerate(values):
        assert [got[3 * k + i][0] for i in range(3)] == [f"é {want} end", want, f"({want})!!"], value
        assert got[3 * k][1] == (value != want)
    assert re.sub(r"\D", "", got[12][0]) == re.sub(r"\D", "", got[3][0])


def test_validity_links_and_the_rest(spark):
    plain = ["", None, "no numbers", "9807915762804491", 'TOKEN = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "1.2.3.4.5", "256.1.1.1", "2023-02-30", "000-12-3456", "12345", "a@b", "x" * 200_000, "1" * 50_000]
    got = run(spark, plain)
    assert [got[i] for i in range(len(plain))] == [(t, 0) for t in plain]
    private = "mail réeux.55@mail4.example.com. DE89 3704 0044 0532 0130 00; DE89370400440532013000, 123-45-6789 31.12.1999 12/31/1999 1999/12/31 4111111111111111 4111111111111111"
    both = run(spark, [private, private])
    out, n = both[1]
    assert both[0][0] == out and n == 9
    words, old = out.split(" "), private.split(" ")
    assert len(words) == len(old) and not {x for x in old if x != "mail"} & set(words) - {"DE89"}
    assert words[1].endswith("@mail4.example.com.") and re.match(r"^[a-z]é[a-z]{3}\.\d\d@", words[1])
    spaced = " ".join(words[2:8])[:-1]
    assert spaced.replace(" ", "") == words[8][:-1]
    value = int("".join(str(int(c, 36)) for c in words[8][4:-1] + words[8][:4]))
    assert value % 97 == 1
    area, group, serial = words[9].split("-")
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    day = datetime.date.fromisoformat(date("1999-12-31"))
    assert words[10:13] == [day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), day.strftime("%Y/%m/%d")]
    assert words[13] == words[14] == card("4111111111111111")
    assert run(spark, []) == {}


def test_is_a_permutation(spark):
    texts = [f"{i // 256}.{i % 256}.0.7" for i in range(300)] + [(datetime.date(2000, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(300)]
    got = run(spark, texts)
    assert len({t for t, _ in got.values()}) == len(texts)


def test_every_ordered_pair(spark):
    values = ["réeux.55@mail4.example.com", "190.137.223.204", "1999-12-31", "31.12.1999", "123-45-6789", "+1 (826) 555-4081", "+44 20 7183 8750", "+999 26 555 4081", "(826) 555-4081", "826-555-4081"]
    values += ["DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "4111111111111111", "4111 1111 1111 1111", "5105-1051-0510-5100", "3782 822463 10005"]
    alone = dict(zip(values, (t for _, (t, _) in sorted(run(spark, values).items()))))
    assert all(v != new for v, new in alone.items())
    plain = ["2024", "7", "AB", "A1", "WXYZ", "end"]
    pairs = [(a, b) for a in values + plain for b in values + plain if {a, b} & set(values)]
    pairs = [p for p in pairs if p != ("+999 26 555 4081", "2024")]  # of unknown plans the longest number counts
    got = run(spark, [f"{a} {b}" for a, b in pairs])
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (f"{alone.get(a, a)} {alone.get(b, b)}", (a in alone) + (b in alone)), (a, b)


def test_many_values_in_a_text(spark):
    many = [f"10.{i // 256}.{i % 256}.9" for i in range(3000)]
    text, n = run(spark, ["x " + " 2024 ".join(many) + " y"])[0]
    assert n == 3000 and text == "x " + " 2024 ".join(map(ip, many)) + " y"


def test_long_and_odd_texts(spark):
    """Nothing recurses: dotted, dashed and spaced runs of any length."""
    plain = ["x" + "." * 100_000, "1-" * 50_000, "1 " * 50_000, "+1" + "-2" * 50_000, "AB12" + " WXYZ" * 30_000, "a@" * 40_000, "%+" * 50_000 + "@", ("a" * 60 + ".") * 2000, "(1" * 50_000]
    got = run(spark, plain)
    assert [got[i][0] for i in range(len(plain)) if i not in (3, 4)] == [t for i, t in enumerate(plain) if i not in (3, 4)]
    assert all(len(got[i][0]) == len(t) for i, t in enumerate(plain))
    text, n = run(spark, ["x@" + "a." * 60_000 + "b 97.51.17.173"])[0]
    assert n == 2 and text.endswith("@" + "a." * 60_000 + "b " + ip("97.51.17.173"))
