r"""Format-preserving pseudonyms for validated numbers and dates (DataFrame functions only).

Every value is validated, taken apart into two numbers a and b of a product
Z_m x Z_n that holds exactly the valid values of its format, and permuted by an alternating
Feistel network whose round function is a keyed SHA-256. Equal values get equal pseudonyms in every
document; different ones stay different; the result is valid again.

| kind | valid if | domain |
| card | 13-19 digits with a correct Luhn digit, whole blocks of a longer run too | the digits before the check digit, which is computed anew |
| iban | correct mod-97 check digits, also in blocks parted by blanks | the digits of the account part, check digits computed anew |
| ssn | area 001-899 but 666, group and serial not zero | 898 x (99 * 9999) |
| phone | North American, area and exchange from 200 | 800 x 8,000,000, separators stay |
| ipv4 | four octets without leading zeros | 65536 x 65536 |
| date | a calendar day from 1900-01-01 to 2100-05-01 (73,170 days), as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy | 270 x 271 |
| email | local part of letters, digits and . _ % + - | the letters and digits in base 36, in blocks of 22 |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: Fixed formats. Order matters where two could start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?=@[A-Za-z0-9-]{1,63}\.[A-Za-z])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/]|[.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: Blocks of digits, or of capitals and digits after the head of an IBAN, parted by single blanks or hyphens. Cards and printed
#: IBANs are looked for inside; a run ends where a value of a fixed format begins.
_OTHER = "(?!" + "|".join(PATTERNS.values()) + ")"
PATTERNS["run"] = (rf"(?<!\d)\d(?:\d|[ -]{_OTHER}\d){{12,}}+"
                   rf"|(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?=(?:[ -]?[A-Z0-9]){{11}})(?:[ -]{_OTHER}[A-Z0-9]++(?![a-z]))++"
                   r"|(?<!\d)\d(?:[ -]?\d){12,18}(?=@)")
CARD = r"^\d(?:[ -]?\d){12,18}[ -]?$"
PRINTED_IBAN = r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}[ -]?$"
#: What follows a mailbox name, and no other value.
AFTER_EMAIL = r"^@[A-Za-z0-9-]{1,63}\.[A-Za-z]"
ANY = "|".join(PATTERNS.values())
DATE_FORMS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}\.": "dd.MM.yyyy", r"^\d{2}/": "MM/dd/yyyy"}
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271


class Cipher:
    """The keyed permutation; ``sign`` -1 undoes it."""

    def __init__(self, key: str, sign: int = 1):
        self.key, self.sign = key, sign

    def pair(self, a: Column, b: Column, m, n, tweak) -> Column:
        """(a, b) of Z_m x Z_n permuted. m, n and tweak may be numbers, text or columns; m and n at most 10**18."""
        m, n, tweak = (x if isinstance(x, Column) else F.lit(x) for x in (m, n, tweak))
        m, n = m.cast("long"), n.cast("long")

        def f(i, x):
            digest = F.sha2(F.concat_ws("|", F.lit(self.key), tweak, i.cast("string"), x.cast("string"), F.lit(self.key)), 256)
            return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

        def turn(s, step):
            i = step if self.sign > 0 else F.lit(ROUNDS - 1) - step
            a_next = F.pmod(s["a"] + self.sign * F.pmod(f(i, s["b"]), m), m)
            b_next = F.pmod(s["b"] + self.sign * F.pmod(f(i, s["a"]), n), n)
            even = i % 2 == 0
            return F.struct(F.when(even, a_next).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(b_next).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)

    def string(self, s: Column, base: int, tweak: str) -> Column:
        """A string of digits of ``base`` (10 or 36, lower case) permuted among those of its length."""
        block = 18 if base == 10 else 22
        starts = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / block).cast("int"))

        def one(i):
            part = F.substr(s, i * block + 1, F.lit(block))
            n = F.length(part)
            left = F.floor(n / 2).cast("int")
            number = lambda x: F.when(F.length(x) > 0, F.conv(x, base, 10)).otherwise("0").cast("long")
            size = lambda k: F.element_at(F.array(*(F.lit(base**e).cast("long") for e in range(block // 2 + 1))), (k + 1).cast("int"))
            got = self.pair(number(F.substr(part, F.lit(1), left)), number(F.substr(part, left + 1, n)), size(left), size(n - left),
                            F.concat_ws("|", F.lit(tweak), n.cast("string"), i.cast("string")))
            text = lambda x, k: F.when(k > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, "0")).otherwise("")
            joined = F.transform(F.array(got), lambda g: F.concat(text(g["a"], left), text(g["b"], n - left)))
            return joined[0]
        return F.array_join(F.transform(starts, one), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit has weight one."""
    n = F.length(digits)

    def add(total, p):
        d = F.substr(digits, n - p + 1, F.lit(1)).cast("int")
        return total + F.when(p % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN whose first four characters were moved to the end, letters as 10 to 35."""
    def add(r, i):
        v = F.conv(F.substr(s, i, F.lit(1)), 36, 10).cast("int")
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _put_back(shape: Column, new: Column, kind: str) -> Column:
    """``shape`` with its characters of the class ``kind`` replaced, in order, by those of ``new``."""
    def one(p):
        c = F.substr(shape, p, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(shape, F.lit(1), p), f"[^{kind}]", ""))
        return F.when(c.rlike(f"[{kind}]"), F.substr(new, at, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _card(m: Column, c: Cipher) -> Column:
    def known(d):
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        body = _let(c.string(payload, 10, "card"), lambda x: F.concat(
            x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _let(body, lambda x: _put_back(m, x, "0-9"))).otherwise(m)
    return _let(_digits(m), known)


def _iban(m: Column, c: Cipher) -> Column:
    country, bban = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    ok = mod97(F.concat(bban, F.substr(m, F.lit(1), F.lit(4)))) == 1

    def checked(b):
        check = 98 - mod97(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)
    new = _let(_digits(bban), lambda d: F.when(F.length(d) > 0, _let(c.string(d, 10, "iban"), lambda x: _put_back(bban, x, "0-9")))
               .otherwise(bban))
    return F.when(ok, _let(new, checked)).otherwise(m)


def _text(toks: Column, start, n) -> Column:
    return F.array_join(F.slice(toks, start, n), "")


def _tokens(m: Column) -> Column:
    """The digits and the capitals of a run, each with the separator after it."""
    return F.regexp_extract_all(m, F.lit(r"((?:\d+|[A-Z]+)[ -]?)"), F.lit(1))


def _found_in(toks: Column) -> Column:
    """Disjoint (size, at, n) ranges of tokens that are valid IBANs (first) or cards, the longest first, in their order."""
    def ranges(tok, i):
        at = i + 1
        digits = tok.rlike(r"^\d")
        starts = digits | (tok.rlike("^[A-Z]{2}$") & ((i == 0) | F.get(toks, i - 1).rlike("[ -]$")))
        most = F.least(F.when(digits, 19).otherwise(34), F.size(toks) - i)

        def one(n):
            def known(x):
                bare = F.regexp_replace(x, "[ -]", "")
                ends = (at + n > F.size(toks)) | x.rlike("[ -]$")
                iban = F.when(x.rlike(PRINTED_IBAN) & ends, mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(
                    bare, F.lit(1), F.lit(4)))) == 1).otherwise(False)
                card = F.when(x.rlike(CARD), luhn_sum(bare) % 10 == 0).otherwise(False)
                # an IBAN is before every card
                size = F.when(iban, -100 - F.length(bare)).when(card, -F.length(bare)).otherwise(0)
                return F.struct(size.alias("size"), at.alias("at"), n.alias("n"))
            return _let(_text(toks, at, n), known)
        none = F.array().cast("array<struct<size: int, at: int, n: int>>")
        return F.when(starts, F.filter(F.transform(F.sequence(F.lit(1), most), one), lambda r: r["size"] < 0)).otherwise(none)

    def pick(done, r):
        clash = F.exists(done, lambda d: (r["at"] < d["at"] + d["n"]) & (d["at"] < r["at"] + r["n"]))
        return F.when(clash, done).otherwise(F.concat(done, F.array(F.struct(r["at"].alias("at"), r["n"].alias("n"), r["size"].alias("size")))))
    none = F.array().cast("array<struct<at: int, n: int, size: int>>")
    return F.array_sort(F.aggregate(F.array_sort(F.flatten(F.transform(toks, ranges))), none, pick))


def _run(m: Column, found: Column, c: Cipher) -> Column:
    """A run with the values found in it replaced."""
    def known(toks):
        def add(done, r):
            def new(x):
                bare = F.regexp_replace(x, "[ -]", "")
                return F.when(r["size"] < -100, _let(_iban(bare, c), lambda y: _put_back(x, y, "A-Z0-9"))).otherwise(_card(x, c))
            gap = _text(toks, done["at"], r["at"] - done["at"])
            return F.struct((r["at"] + r["n"]).alias("at"), F.concat(done["out"], gap, _let(_text(toks, r["at"], r["n"]), new)).alias("out"))
        whole = F.aggregate(found, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), add)
        return _let(whole, lambda w: F.concat(w["out"], _text(toks, w["at"], F.size(toks))))
    return F.when(F.size(found) > 0, _let(_tokens(m), known)).otherwise(m)


def _ssn(m: Column, c: Cipher) -> Column:
    part = lambda p, n: F.substr(m, F.lit(p), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    ok = (area >= 1) & (area <= 899) & (area != 666) & (group > 0) & (serial > 0)
    got = c.pair(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(ok, _let(got, lambda g: F.concat_ws(
        "-", pad(g["a"] + 1 + (g["a"] >= 665).cast("int"), 3), pad(F.floor(g["b"] / 9999) + 1, 2), pad(g["b"] % 9999 + 1, 4)))).otherwise(m)


def _phone(m: Column, c: Cipher) -> Column:
    def known(d):
        local = F.substr(d, F.length(d) - 9, F.lit(10))
        head = F.substr(d, F.lit(1), F.length(d) - 10)
        num = lambda p, n: F.substr(local, F.lit(p), F.lit(n)).cast("int")
        got = c.pair(num(1, 3) - 200, (num(4, 3) - 200) * 10000 + num(7, 4), 800, 8_000_000, "phone")
        return _let(got, lambda g: _let(F.concat(head, (g["a"] + 200).cast("string"), (F.floor(g["b"] / 10000) + 200).cast("string"),
                                                 F.lpad((g["b"] % 10000).cast("string"), 4, "0")), lambda x: _put_back(m, x, "0-9")))
    return _let(_digits(m), known)


def _ipv4(m: Column, c: Cipher) -> Column:
    def known(o):
        num = lambda i: o[i].cast("int")
        got = c.pair(num(0) * 256 + num(1), num(2) * 256 + num(3), 65536, 65536, "ipv4")
        return _let(got, lambda g: F.concat_ws(".", *(x.cast("string") for x in (
            F.floor(g["a"] / 256), g["a"] % 256, F.floor(g["b"] / 256), g["b"] % 256))))
    return _let(F.split(m, r"\."), known)


def _moved_day(m: Column, day: Column, form: str, c: Cipher) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    n = F.datediff(day, first)
    got = c.pair(F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B, "date")
    new = _let(got, lambda g: F.date_format(F.date_add(first, (g["a"] * DAYS_B + g["b"]).cast("int")), form))
    return F.when(day.isNotNull() & (n >= 0) & (n < DAYS_A * DAYS_B), new).otherwise(m)


def _date(m: Column, c: Cipher) -> Column:
    out = m
    for start, form in DATE_FORMS.items():
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        out = F.when(m.rlike(start), _moved_day(m, day, form, c)).otherwise(out)
    return out


def _email(m: Column, c: Cipher) -> Column:
    return _let(F.lower(m), lambda low: _let(F.regexp_replace(low, "[^a-z0-9]", ""), lambda s: _let(
        c.string(s, 36, "email"), lambda x: _put_back(low, x, "a-z0-9"))))


_KINDS = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "iban": _iban}


def _is(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def _in_run(m: Column, is_email: Column) -> Column:
    """The values in a hit that is a run; null if it is one value of a fixed format."""
    fixed = is_email
    for kind in list(_KINDS)[1:]:
        fixed = fixed | _is(m, kind)
    return F.when(~fixed, _let(_tokens(m), _found_in))


def pseudonym(m: Column, found: Column, is_email: Column, cipher: Cipher) -> Column:
    """The pseudonym of one hit, ``found`` by ``_in_run``; what is not valid in its format stays."""
    out = m
    for kind in reversed(list(_KINDS)[1:]):
        out = F.when(_is(m, kind), _KINDS[kind](m, cipher)).otherwise(out)
    return F.when(is_email, _email(m, cipher)).when(found.isNotNull(), _run(m, found, cipher)).otherwise(out)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", sign: int = 1) -> DataFrame:
    """``docs`` with every valid value in the text replaced by its pseudonym, and pii_found (values replaced).

    The key is a secret of at least one character: who has it can undo the permutation (``sign`` -1). All other
    columns pass unchanged; a column pii_found is replaced. In a run of blocks every start and end is tried, and where valid
    values overlap, an IBAN and then the longest card is taken; a pseudonym may there form a longer valid number with its
    neighbours, so only such a run may not be undone exactly. A null text stays null with 0 found; an empty one
    stays empty. Whole texts are read in place: no shuffle, no Python.
    """
    if not key:
        raise ValueError("the key must not be empty")
    docs = docs.drop("pii_found", "pii_gaps", "pii_hits", "pii_new")
    text = F.col(f"`{text_col}`")
    cols = docs.columns
    cipher = Cipher(key, sign)
    found = text.rlike(ANY)
    out = docs.withColumn("pii_gaps", F.when(found, F.split(text, ANY, -1)))
    out = out.withColumn("pii_hits", F.when(found, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))))
    # a mailbox name has no blank, and its domain follows in the next gap
    hits = F.transform("pii_hits", lambda m, i: F.struct(m.alias("m"), (
        F.get("pii_gaps", i + 1).rlike(AFTER_EMAIL) & ~m.contains(" ")).alias("is_email")))
    hits = F.transform(hits, lambda h: F.struct(h["m"].alias("m"), h["is_email"].alias("is_email"), _in_run(h["m"], h["is_email"]).alias("found")))
    out = out.withColumn("pii_hits", hits)
    out = out.withColumn("pii_new", F.transform("pii_hits", lambda h: pseudonym(h["m"], h["found"], h["is_email"], cipher)))
    pieces = F.zip_with("pii_gaps", F.concat("pii_new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new))
    changed = F.aggregate(F.zip_with("pii_hits", "pii_new", lambda h, new: F.when(h["m"] == new, 0).when(
        h["found"].isNotNull(), F.size(h["found"])).otherwise(1)), F.lit(0), lambda n, x: n + x)
    out = out.withColumn("pii_found", F.when(F.col("pii_new").isNotNull(), changed).otherwise(0))
    out = out.withColumn(text_col, F.when(F.col("pii_new").isNotNull(), F.array_join(pieces, "")).otherwise(text))
    return out.select(*(F.col(f"`{c}`") for c in cols), "pii_found")
