import hashlib
import re
from datetime import date, timedelta

from parlance.llm import pii

KEY = "k"


def prf(kind, k, other, i=0):
    return int(hashlib.sha256(f"{KEY}|{kind}|{k}|{i}|{other}".encode()).hexdigest()[:12], 16)


def shift(a, b, k, kind, letters):
    out = ""
    for i, c in enumerate(a, 1):
        n = prf(kind, k, b, i)
        for first, size in (("0", 10), ("a", letters), ("A", letters), ("à", 23), ("À", 23)):
            last = {"0": "9", "a": "z", "A": "Z", "à": "ö", "À": "Ö"}[first]
            if first <= c <= last:
                c = chr(ord(first) + (ord(c) - ord(first) + n) % size)
                break
        out += c
    return out


def feistel(s, kind, letters=26):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for k in range(pii.ROUNDS):
        a, b = (shift(a, b, k, kind, letters), b) if k % 2 == 0 else (a, shift(b, a, k, kind, letters))
    return a + b


def pair(n, x, y, kind):
    a, b = divmod(n, y)
    for k in range(pii.ROUNDS):
        a, b = ((a + prf(kind, k, b)) % x, b) if k % 2 == 0 else (a, (b + prf(kind, k, a)) % y)
    return a * y + b


def luhn(d):
    return sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1], 1)) % 10


def run(spark, *texts):
    return [r.text for r in pii.pseudonymize(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), KEY).orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    got = run(spark, "a 4465758382889437, b", "x été.19@mail5.example.com!", "on 8.196.197.208 and", "born 2024-02-29.", "s 1eb9c654e721b4f812088970e66a6345cee33dd6")
    p = feistel("446575838288943", "card")
    want = p + str((10 - luhn(p + "0")) % 10)
    assert got[0] == f"a {want}, b" and luhn(want) == 0
    assert got[1] == f"x {feistel('été.19', 'email')}@mail5.example.com!"
    n = pair(8 << 24 | 196 << 16 | 197 << 8 | 208, 65536, 65536, "ip")
    assert got[2] == f"on {'.'.join(str(n >> s & 255) for s in (24, 16, 8, 0))} and"
    first = date(1800, 1, 1)
    assert got[3] == f"born {first + timedelta(pair((date(2024, 2, 29) - first).days, pii.DAY_A, pii.DAY_B, 'date'))}."
    assert got[4] == "s " + feistel("1eb9c654e721b4f812088970e66a6345cee33dd6", "secret", 6) and re.fullmatch("s [0-9a-f]{40}", got[4])


def test_permutations():
    assert len({feistel(f"{i:03}", "x") for i in range(1000)}) == 1000
    assert sorted(pair(i, 7, 11, "x") for i in range(77)) == list(range(77))


def test_format_link_and_validation(spark):
    text = "+1 (743) 555-3824 then 1-2 4465 7583 8288 9437 DE89 3704 0044 0532 0130 00 and 31/12/1999"
    a, b, c = run(spark, text, "again +1 (743) 555-3824", "4465758382889438 2024-13-01 DE88 3704 0044 0532 0130 00 999.1.1.1 1234567890")
    assert re.sub(r"\d", "9", a).replace("/", "") == re.sub(r"\d", "9", text).replace("/", "") and a != text
    assert re.search(r"\+1 \(\d+\) [\d-]+", a)[0] == re.search(r"\+1 \(\d+\) [\d-]+", b)[0]
    iban = re.search(r"DE[\d ]+\d", a)[0].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert c == "4465758382889438 2024-13-01 DE88 3704 0044 0532 0130 00 999.1.1.1 1234567890"


def test_edges(spark):
    assert run(spark, None, "", "plain " * 50_000) == [None, "", "plain " * 50_000]
    empty = spark.createDataFrame([], "text string, other int")
    assert pii.pseudonymize(empty, KEY).columns == ["text", "other", "n_replaced"] and pii.pseudonymize(empty, KEY).isEmpty()
    twice = pii.pseudonymize(spark.createDataFrame([("8.8.8.8", 1)] * 2, "text string, other int"), KEY).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_replaced == 1


def test_valid_numbers_stay_valid(spark):
    import random

    r = random.Random(1)
    ssn = [f"{a:03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}" for a in r.sample([x for x in range(1, 900) if x != 666], 300)]
    phone = [f"{r.randint(2, 9)}{r.randint(0, 99):02}-{r.randint(2, 9)}{r.randint(0, 99):02}-{r.randint(0, 9999):04}" for _ in range(200)] + ["(123) 155-0000"]
    got = run(spark, *ssn, *phone)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got[:300]) and len(set(got[:300])) == 300
    assert all(re.fullmatch(r"[2-9]\d\d-[2-9]\d\d-\d{4}", x) for x in got[300:500]) and not re.fullmatch(r"\([2-9]\d\d\) [2-9].*", got[500])
    assert len(set(got[300:500])) == len(set(phone[:200])) and sum(a != b for a, b in zip(got, ssn + phone, strict=True)) >= 499


def test_key_from_configuration(spark):
    df = spark.createDataFrame([("8.8.8.8",)], "text string")
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        out = pii.pseudonymize(df)
        assert out.first().text == pii.pseudonymize(df, "one").first().text != pii.pseudonymize(df, "two").first().text
        assert '"one"' not in out._jdf.queryExecution().toString() and "'one'" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_dates_of_every_shape_keep_it_and_never_meet(spark):
    days = [date(1996, 1, 1) + timedelta(i) for i in range(0, 1461)]
    shapes = {f"{d.day:0{a}}.{d.month:0{b}}.{d.year}" for d in days[::3] for a in (1, 2) for b in (1, 2)}
    shapes |= {f"{d.month:0{a}}/{d.day:0{b}}/{d.year}" for d in days[::3] for a in (1, 2) for b in (1, 2)}
    shapes |= {f"{d.day}/{d.month:0{b}}/{d.year}" for d in days for b in (1, 2) if d.day > 12} | {d.isoformat() for d in days}
    texts = sorted(shapes) + ["20/03/1990", "11/02/1995"]
    got = run(spark, *texts)
    new = dict(zip(texts, got, strict=True))
    assert len(set(new.values())) == len(new)
    for old, made in new.items():
        assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", made)  # widths and separators
        first, second, *_ = map(int, re.split(r"[-/.]", made))
        was = int(re.split(r"[-/.]", old)[0])
        if "/" in old:
            assert (first > 12) == (was > 12)
        d, m, y = (second, first, 0) if "/" in made and first <= 12 else (first, second, 0)
        y = int(re.split(r"[-/.]", made)[2 if "-" not in made else 0])
        assert ("-" in made and date.fromisoformat(made)) or date(y, m, d)
    assert new["1996-02-29"] == "-".join(reversed(new["29.02.1996"].split("."))) if "29.02.1996" in new else True
