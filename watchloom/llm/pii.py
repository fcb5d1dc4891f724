"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Method
------
One pattern finds candidates; each is validated by its kind: payment card (13 to
19 digits, Luhn), US social security number (issued ranges), phone (``+1`` or
``(ddd)`` form of ten digits, or another ``+`` number of 8 to 15), IPv4 address (octets without leading zeros), numeric IBAN
(mod 97), date (real calendar day of 1800 to 2199) and e-mail address.  Numbers and
dates are mapped to a point of ``Z_a x Z_b`` and permuted by an alternating Feistel
network of eight keyed rounds (``L += F(R) mod a``, ``R += F(L) mod b``; F from
SHA-256 of key, kind, format, round and the other half), which is a bijection for
any two moduli (dates that can only be read day first are cycle-walked among themselves); the result is written back into the format of the original:
separators stay, check digits are recomputed, dates stay dates.  So equal values
get equal pseudonyms in every document, different ones different pseudonyms, and
whoever has the key can invert them.  E-mail addresses are text: their parts become
keyed digests under ``example.invalid``.

Only texts that match pay for more than the search; the rest pass unchanged.
There is no shuffle, and no Python runs on the executors.

Defined results: null stays null, empty stays empty, each with no finds.  Rows that
repeat a doc_id are rewritten each on its own.  All other columns of the input are
passed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"  # one run for the domain: a repeated group would use the stack for each label
IBAN = r"[A-Z]{2}\d{2}(?:\x20?\d{4}){2,6}(?:\x20?\d{1,4})?"
DATE_ISO, DATE_DOT, DATE_SLASH = r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}/\d{2}/\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
PHONE_US = r"(?:\+?1[\x20.\-]?)?\(\d{3}\)\x20?\d{3}[\x20.\-]?\d{4}|\+1[\x20.\-]?\d{3}[\x20.\-]\d{3}[\x20.\-]?\d{4}|\d{3}-\d{3}-\d{4}"
PHONE_OTHER = r"\+[1-9]\d{0,2}(?:[\x20.\-]?\d{2,4}){2,5}"
CARD = r"\d{4}(?:[\x20\-]?\d{4}){2}[\x20\-]?\d{1,7}|\d{4}[\x20\-]?\d{6}[\x20\-]?\d{5}"
#: A digit or letter beside a find would make it part of something longer.
BEFORE, AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
FOUND = f"(?<![A-Za-z0-9._%+\\-]){EMAIL}|{BEFORE}(?:{IBAN}|{PHONE_OTHER}|{PHONE_US}|{CARD}|{SSN}|{DATE_ISO}|{DATE_DOT}|{DATE_SLASH}){AFTER}|(?<![A-Za-z0-9.]){IPV4}(?![A-Za-z0-9]|\\.\\d)"
#: What any find holds: an at sign or two digits with at most two other characters between.
MAYBE = r"@|\d[^A-Za-z0-9]{0,2}\d"
ROUNDS = 8
#: Days of 1800-01-01 to 2199-12-31 are 27 x 5411.
DAY_A, DAY_B = 27, 5411


def prf(key: str, label: Column, turn: Column, half: Column) -> Column:
    """60 bits of SHA-256 as a number: a round function."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), label, turn.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, label: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the keyed permutation of (left, right) in Z_a x Z_b."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(s["l"] + F.pmod(prf(key, label, i, s["r"]), a), a)).otherwise(s["l"])  # noqa: E741
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(prf(key, label, i, s["l"]), b), b))
        return F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("bigint")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """The digits permuted among all digit strings of their length (2 to 36)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    s = feistel(key, F.concat(F.lit(f"{kind}:"), n.cast("string")), digits.substr(F.lit(1), u), digits.substr(u + 1, n - u), power10(u), power10(n - u))
    return F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0"))


def laid_out(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), start, put)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def whole(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def iban_remainder(country: Column, check: Column, bban: Column) -> Column:
    """(BBAN, country, check) mod 97, letters as numbers; the BBAN, of up to 28 digits, in two parts."""
    at = lambda i: (F.ascii(country.substr(i, 1)) - 55).cast("string")
    tail = F.concat(at(1), at(2), check)
    step = lambda head, s: (F.concat(head.cast("string"), s).cast("decimal(38,0)") % 97).cast("int")
    return step(step(F.lit(0), bban), tail)


def date_of(m: Column) -> Column:
    iso = F.when(whole(m, DATE_ISO), m).when(whole(m, DATE_DOT), F.concat_ws("-", m.substr(7, 4), m.substr(4, 2), m.substr(1, 2)))
    iso = iso.when(whole(m, DATE_SLASH), F.concat_ws("-", m.substr(7, 4), F.when(m.substr(1, 2).cast("int") > 12, m.substr(4, 2)).otherwise(m.substr(1, 2)), F.when(m.substr(1, 2).cast("int") > 12, m.substr(1, 2)).otherwise(m.substr(4, 2))))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    d = digits_of(m)
    # an octet with a leading zero may be meant as octal: no address
    octets = F.transform(F.split(m, r"\."), lambda c: (c.cast("int") <= 255) & (c == c.cast("int").cast("string")))
    area, group, serial = m.substr(1, 3).cast("int"), m.substr(5, 2).cast("int"), m.substr(8, 4).cast("int")
    day = date_of(m)
    bare = F.regexp_replace(m, " ", "")
    return (
        F.when(F.instr(m, "@") > 0, "email")
        .when(whole(m, IBAN) & (iban_remainder(bare.substr(1, 2), bare.substr(3, 2), bare.substr(F.lit(5), F.length(bare) - 4)) == 1), "iban")
        .when(whole(m, CARD) & F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), "card")
        .when(whole(m, SSN) & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), "ssn")
        .when(whole(m, PHONE_US) | (whole(m, PHONE_OTHER) & F.length(d).between(8, 15)), "phone")
        .when(whole(m, IPV4) & F.forall(octets, lambda x: x), "ip")
        .when(day.isNotNull() & F.year(day).between(1800, 2199), "date")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The keyed pseudonym of a valid find, in its own format."""
    d = digits_of(m)
    n = F.length(d)
    body = permuted_digits(key, "card", d.substr(F.lit(1), n - 1))
    card = F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    # SSN: area (898 of them, 666 is never issued) and group against serial
    area = m.substr(1, 3).cast("int")
    s = feistel(key, F.lit("ssn"), (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + m.substr(5, 2).cast("int") - 1, m.substr(8, 4).cast("int") - 1, F.lit(898 * 99), F.lit(9999))
    new_area = F.floor(s["l"] / 99).cast("int") + 1
    ssn = F.format_string("%03d-%02d-%04d", F.when(new_area >= 666, new_area + 1).otherwise(new_area), (s["l"] % 99 + 1).cast("int"), (s["r"] + 1).cast("int"))
    # phone: the country code and the first digit of the number stay, so lengths and leading digits remain valid
    fixed = F.when(whole(m, PHONE_US), n - 9).otherwise(F.lit(3)).cast("int")
    phone = F.concat(d.substr(F.lit(1), fixed), permuted_digits(key, "phone", d.substr(fixed + 1, n - fixed)))
    octet = [F.element_at(F.split(m, r"\."), i + 1).cast("int") for i in range(4)]
    p = feistel(key, F.lit("ip"), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536))
    ip = F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string"))
    since = F.datediff(date_of(m), F.lit("1800-01-01").cast("date"))
    q = feistel(key, F.lit("date"), F.floor(since / DAY_B), since % DAY_B, F.lit(DAY_A), F.lit(DAY_B))
    day_of = lambda s: F.date_add(F.lit("1800-01-01").cast("date"), (s["l"] * DAY_B + s["r"]).cast("int"))
    day = day_of(q)
    # with slashes the month is first, unless that can't be: such dates are permuted among themselves, as the
    # permutation is repeated until the day can't be a month either
    day_first = m.substr(1, 2).cast("int") > 12
    again = lambda s, i: F.when(F.dayofmonth(day_of(s)) > 12, s).otherwise(feistel(key, F.lit("date"), s["l"], s["r"], F.lit(DAY_A), F.lit(DAY_B)))
    walked = day_of(F.aggregate(F.sequence(F.lit(1), F.lit(60)), q, again))
    date = F.when(whole(m, DATE_ISO), F.date_format(day, "yyyy-MM-dd")).when(whole(m, DATE_DOT), F.date_format(day, "dd.MM.yyyy")).when(day_first, F.date_format(walked, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    bare = F.regexp_replace(m, " ", "")
    bban = permuted_digits(key, "iban", bare.substr(F.lit(5), F.length(bare) - 4))
    check = F.lpad((98 - iban_remainder(bare.substr(1, 2), F.lit("00"), bban)).cast("string"), 2, "0")
    mail = F.lower(m)
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), mail), 256), 1, 16), F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(mail, "@", -1)), 256), 1, 8), F.lit(".example.invalid"))
    out = {"email": email, "iban": laid_out(m, F.concat(check, bban)), "card": laid_out(m, card), "ssn": ssn, "phone": laid_out(m, phone), "ip": ip, "date": date}
    chain = None
    for name, value in out.items():
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return F.coalesce(chain, m)


def pseudonymise(docs: DataFrame, key: str = "development key", column: str = "text", finds: str | None = None) -> DataFrame:
    """docs with column rewritten; finds names a further column array<struct<kind, original_sha, pseudonym>>.

    The originals themselves are not kept: original_sha is a keyed digest.
    """
    text = F.col(f"`{column}`")
    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # a find's kind and pseudonym are computed once, in the struct
    one = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), pseudonym(x["m"], x["kind"], key)).otherwise(x["m"]).alias("new")))
    taken = {c.lower() for c in docs.columns}
    tmp, n = "found", 0
    while tmp in taken:
        n, tmp = n + 1, f"found_{n}"
    gaps = F.split(text, FOUND, -1)
    got = F.col(tmp)
    rebuilt = F.concat(gaps[0], F.array_join(F.zip_with(F.transform(got, lambda x: x["new"]), F.slice(gaps, 2, F.greatest(F.size(got), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    new = F.when(F.size(got) > 0, rebuilt).otherwise(text)
    valid = F.transform(F.filter(got, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), F.sha2(F.concat_ws("|", F.lit(key), F.lit("original"), x["kind"], x["m"]), 256).alias("original_sha"), x["new"].alias("pseudonym")))
    out = docs.withColumn(tmp, one).withColumn(column, new)
    if finds:
        out = out.withColumn(finds, F.coalesce(valid, F.array()))
    return out if finds == tmp else out.drop(tmp)
