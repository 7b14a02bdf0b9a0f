"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Found values are validated (Luhn for cards, mod 97 for IBANs, octet and calendar ranges, SSN areas) and then mapped by a
keyed Feistel network that permutes the set of values of their format. Equal values get equal pseudonyms in every
document; different values never collide within a format; a number that fails its validation is left as it is. Where not all
strings of a format are valid and no check digit mends them (SSN, North American phone numbers, dates), the network is walked again until
its value is valid as the first one was, which keeps it a permutation.

The key comes from the setting KEY_SETTING (whose name Spark redacts in logs and pages) and reaches the expressions as a scalar
subquery over a one-row table, so that it stands in no SQL text, plan or event log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import reserve, table

ROUNDS = 8
#: Walks of a cycle at most; a value that is still invalid then, one in 10 ** 12 at the worst format, stays so.
WALKS = 64
#: The same for dates, of which the rarest shape (day and month of one digit) is two in nine.
DATE_WALKS = 256
KEY_SETTING, DEMO_KEY = "spark.parlance.pii.secret", "demonstration only"
_SSN, _NANP = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$", "^[2-9][0-9]{2}[2-9][0-9]{6}$"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Java patterns by kind; the first that matches at a place wins. All are bounded, so the scan is linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([.\-])\d{3}\1\d{4})(?!\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "date": r"(?<![\d\-/.])(?:(?:1[89]|2[01])\d\d-\d\d-\d\d|\d{1,2}/\d{1,2}/(?:1[89]|2[01])\d\d|\d{1,2}\.\d{1,2}\.(?:1[89]|2[01])\d\d)(?![\d\-/]|\.\d)",
    "card": r"(?<!\d)(?:\d{4}([ \-])\d{4}\2\d{4}\2\d{4}|\d{4}([ \-])\d{6}\3\d{5}|\d{13,19})(?!\d)",
}
PATTERN = "|".join(PATTERNS.values())
#: 1800-01-01 to 2199-12-31: 400 Gregorian years are 146,097 days = 27 * 5,411, the two halves of the date network.
DAY_0, DAY_A, DAY_B = "1800-01-01", 27, 5411


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, kind: str, k: str, other: str, i: str = "0") -> str:
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {k}, {i}, {other}), 256), 1, 12), 16, 10) as bigint)"


def _shift(a: str, b: str, k: str, key: str, kind: str, letters: int) -> str:
    """a with each character moved within its own class by an amount that depends on the key, the round and b."""
    n = _prf(key, kind, k, b, "i")
    move = lambda first, size: f"char(ascii('{first}') + (ascii(c) - ascii('{first}') + {n}) % {size})"
    wide = lambda first: f"decode(unhex(concat('C3', hex({first} + (ascii(c) - 64 - {first} + {n}) % 23))), 'UTF-8')"
    return (
        f"if(length({a}) = 0, '', array_join(transform(sequence(1, length({a})), i -> transform(array(substr({a}, i, 1)), c -> case "
        f"when c between '0' and '9' then {move('0', 10)} when c between 'a' and 'z' then {move('a', letters)} when c between 'A' and 'Z' then {move('A', letters)} "
        f"when c between 'à' and 'ö' then {wide(160)} when c between 'À' and 'Ö' then {wide(128)} else c end)[0]), ''))"
    )


def feistel(s: str, key: str, kind: str, letters: int = 26) -> str:
    """SQL for the keyed permutation of the strings with the character classes of s."""
    step = f"if(k % 2 = 0, named_struct('l', {_shift('z.l', 'z.r', 'k', key, kind, letters)}, 'r', z.r), named_struct('l', z.l, 'r', {_shift('z.r', 'z.l', 'k', key, kind, letters)}))"
    return (
        f"transform(array({s}), s -> aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr(s, 1, length(s) div 2), 'r', substr(s, length(s) div 2 + 1)), "
        f"(z, k) -> {step}, z -> concat(z.l, z.r)))[0]"
    )


def _walked(o: str, key: str, kind: str, valid: str) -> str:
    """SQL for the permutation of digit strings that keeps valid ones (a pattern) valid, and the others not."""
    return f"transform(array({o}), o -> aggregate(sequence(1, {WALKS}), {feistel('o', key, kind)}, (p, w) -> if((p rlike {_q(valid)}) = (o rlike {_q(valid)}), p, {feistel('p', key, kind)})))[0]"


def _pair(x: str, a: int, b: int, key: str, kind: str) -> str:
    """SQL for the keyed permutation of 0 .. a * b - 1, as two digits of base a and b."""
    step = f"if(k % 2 = 0, named_struct('l', pmod(z.l + {_prf(key, kind, 'k', 'z.r')}, {a}L), 'r', z.r), named_struct('l', z.l, 'r', pmod(z.r + {_prf(key, kind, 'k', 'z.l')}, {b}L)))"
    return (
        f"transform(array(cast({x} as bigint)), n -> aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', n div {b}L, 'r', n % {b}L), "
        f"(z, k) -> {step}, z -> z.l * {b}L + z.r))[0]"
    )


_DIGITS = "regexp_replace(x, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Sum modulo 10 with the last digit at weight one."""
    return (
        f"aggregate(transform(sequence(1, length({d})), i -> transform(array(cast(substr({d}, length({d}) - i + 1, 1) as int)), "
        "t -> if(i % 2 = 0, if(t > 4, t * 2 - 9, t * 2), t))[0]), 0, (u, v) -> u + v) % 10"
    )


def _refill(digits: str, alnum: bool = False) -> str:
    """x with its digits (or letters and digits) replaced, in order, by those given."""
    keep, one = ("[^0-9A-Za-z]", "[0-9A-Za-z]") if alnum else ("[^0-9]", "[0-9]")
    return (
        f"transform(array({digits}), d -> array_join(transform(sequence(1, length(x)), j -> if(substr(x, j, 1) rlike '{one}', "
        f"substr(d, length(regexp_replace(substr(x, 1, j), '{keep}', '')), 1), substr(x, j, 1))), ''))[0]"
    )


def _mod97(s: str) -> str:
    return f"aggregate(split({s}, ''), 0, (u, c) -> if(c between '0' and '9', (u * 10 + ascii(c) - 48) % 97, if(c = '', u, (u * 100 + ascii(c) - 55) % 97)))"


def _card(key: str) -> str:
    body = feistel(f"substr({_DIGITS}, 1, length({_DIGITS}) - 1)", key, "card")
    done = f"transform(array({body}), p -> concat(p, cast((10 - ({_luhn('concat(p, 0)')})) % 10 as string)))[0]"
    return f"if(({_luhn(_DIGITS)}) = 0, {_refill(done)}, x)"


def _iban(key: str) -> str:
    plain = "replace(x, ' ', '')"
    body = feistel(f"substr({plain}, 5)", key, "iban")
    done = f"transform(array({body}), p -> concat(substr(x, 1, 2), lpad(cast(98 - {_mod97('concat(p, substr(x, 1, 2), 0, 0)')} as string), 2, '0'), p))[0]"
    return f"if({_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1, {_refill(done, True)}, x)"


def _ip(key: str) -> str:
    n = "aggregate(split(x, '[.]'), 0L, (u, v) -> u * 256 + cast(v as bigint))"
    return f"transform(array({_pair(n, 65536, 65536, key, 'ip')}), p -> concat_ws('.', p div 16777216, p div 65536 % 256, p div 256 % 256, p % 256))[0]"


def _date(key: str) -> str:
    """ISO; day.month.year; month/day/year, or day/month/year where the first number is above 12.

    Days and months keep their number of digits, and day-first strings stay day-first (a day above 12): the network over all days is
    walked until its day can be written so. Strings of one shape are permuted among themselves, so different ones never meet.
    """
    at = (
        "transform(array(transform(array(split(x, '[-/.]')), f -> named_struct('a', cast(f[0] as int), 'b', cast(f[1] as int), 'c', cast(f[2] as int), 'la', length(f[0]), 'lb', length(f[1]), "
        "'form', case when x like '%-%' then 'iso' when x like '%.%' then 'dot' when cast(f[0] as int) > 12 then 'day' else 'month' end))[0]), t -> "
    )
    day = "case t.form when 'iso' then try_to_date(concat_ws('-', t.a, t.b, t.c), 'y-M-d') when 'month' then try_to_date(concat_ws('-', t.c, t.a, t.b), 'y-M-d') else try_to_date(concat_ws('-', t.c, t.b, t.a), 'y-M-d') end"
    date = lambda n: f"date_add(date'{DAY_0}', cast({n} as int))"
    day_first = "(t.la = 2 or day(v) < 10) and (t.lb = 2 or month(v) < 10) and (t.form = 'dot' or day(v) > 12)"
    fits = f"transform(array({date('p')}), v -> case t.form when 'iso' then true when 'month' then (t.la = 2 or month(v) < 10) and (t.lb = 2 or day(v) < 10) else {day_first} end)[0]"
    walked = f"aggregate(sequence(1, {DATE_WALKS}), {_pair(f"datediff(e, date'{DAY_0}')", DAY_A, DAY_B, key, 'date')}, (p, k0) -> if({fits}, p, {_pair('p', DAY_A, DAY_B, key, 'date')}))"
    two = lambda first, second, sep: f"concat(lpad(cast({first}(w) as string), t.la, '0'), '{sep}', lpad(cast({second}(w) as string), t.lb, '0'), '{sep}', year(w))"
    form = f"case t.form when 'iso' then date_format(w, 'yyyy-MM-dd') when 'dot' then {two('day', 'month', '.')} when 'day' then {two('day', 'month', '/')} else {two('month', 'day', '/')} end"
    return f"{at} transform(array({day}), e -> if(e is null, x, transform(array({date(walked)}), w -> {form})[0]))[0])[0]"


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of x, a match of PATTERN; x itself where the value does not validate. key: a column."""
    full = {k: _q(f"^(?:{p})$").replace("\\\\2", "\\\\1").replace("\\\\3", "\\\\2") if k == "card" else _q(f"^(?:{p})$") for k, p in PATTERNS.items()}
    before = lambda n: f"substr({_DIGITS}, 1, length({_DIGITS}) - {n})"
    far, near = feistel(f"right({_DIGITS}, 6)", key, "phone"), _walked(f"right({_DIGITS}, 10)", key, "phone", _NANP)
    phone = f"if(x like '+%' and x not like '+1%', concat({before(6)}, {far}), concat({before(10)}, {near}))"  # the country stays
    how = {
        "email": f"concat({feistel("substring_index(x, '@', 1)", key, 'email')}, '@', substring_index(x, '@', -1))",
        "secret": f"if(x rlike '[A-Fa-f]' and x rlike '[0-9]', {feistel('x', key, 'secret', 6)}, x)",
        "iban": _iban(key),
        "ip": _ip(key),
        "phone": _refill(phone),
        "ssn": _refill(_walked(_DIGITS, key, "ssn", _SSN)),
        "date": _date(key),
        "card": _card(key),
    }
    return "case " + " ".join(f"when x rlike {full[k]} then {how[k]}" for k in PATTERNS) + " else x end"


def configured_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; DEMO_KEY, which protects nothing, where it is unset, as in tests."""
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING) or DEMO_KEY


def pseudonymize(df: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """df with personal data in `column` replaced, and n_replaced (bigint): how many values changed.

    No shuffle and no Python: one scan finds texts that hold a candidate, the rest pass untouched.
    Null text stays null with n_replaced 0; empty text stays empty; texts of any length are read whole, in one pass; repeated rows and
    extra columns are kept as they are, so there are no ties; an empty table gives an empty result; an input column n_replaced,
    __key, __found or __new is an error. Without a key the configured one counts. Local parts of mail addresses without letters of Latin-1 keep those characters.
    """
    reserve(df, "n_replaced", "__key", "__found", "__new")
    spark = df.sparkSession
    secret = spark.createDataFrame([(key or configured_key(spark),)], "key string")
    t = F.col(f"`{column}`")
    found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    with_found = df.withColumn("__key", secret.scalar()).withColumn("__found", F.when(t.rlike(r"[0-9@]"), found).otherwise(F.array().cast("array<string>")))
    new = F.expr(f"transform(__found, x -> {pseudonym('__key')})")
    both = with_found.withColumn("__new", F.when(F.size("__found") > 0, new).otherwise(F.array().cast("array<string>")))
    gaps = F.split(t, PATTERN, -1)
    woven: Column = F.array_join(F.flatten(F.zip_with(gaps, F.col("__new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.when(F.size("__found") > 0, F.size(F.filter(F.arrays_zip("__found", "__new"), lambda z: z["__found"] != z["__new"])))
    names = [woven_or(c, column, woven) for c in df.columns]
    return both.select(*names, F.coalesce(changed, F.lit(0)).cast("bigint").alias("n_replaced"))


def woven_or(c: str, column: str, woven: Column) -> Column:
    plain = F.col(f"`{c}`")
    return F.when(F.size("__found") > 0, woven).otherwise(plain).alias(c) if c == column else plain


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text pseudonymised: doc_id, text, n_replaced."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
