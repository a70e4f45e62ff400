"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Candidates are found by pattern and then validated; each kind is permuted by a keyed Feistel network
within its own format, so that equal values have equal pseudonyms in every document and different
values stay different:

- payment card numbers of 13 to 19 digits that pass the Luhn test: all digits but the last are permuted,
  the last is computed again, so the pseudonym passes too;
- other runs of 13 to 19 digits (account-like numbers): all digits are permuted;
- telephone numbers (+country and seven more digits at least, or ddd ddd dddd): digits after the country code;
- US social security numbers (not 000, 666 or 9xx; no group of zeros), permuted among valid ones;
- IPv4 addresses with parts of at most 255, permuted as 32 bits;
- dates (yyyy-mm-dd, dd/mm/yyyy and dd.mm.yyyy) that exist, between 1900 and 2099, permuted as days;
- e-mail addresses: letters and digits of the local part are permuted in their own classes.

Separators, lengths and the text around stay as they are. Networks over odd sizes walk the cycle until the value is
in the format again (at most 64 steps; the expected number is below 2). Null stays null, an empty text
stays empty; repeated rows get the same text; texts of any length are handled whole by one expression.
Other columns are passed on; names that this module adds are made unlike any of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.llm.storage import fresh

ROUNDS, WALK = 8, 64
FIRST_YEAR, LAST_YEAR = 1900, 2099
_DAYS = 73_049  # days of these years
_SIDE = 271  # the least whole number whose square is at least that

# every pattern starts only where no longer run can start, so long runs of digits or letters cost linear time
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
NUMBER = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"
)
ANY = "|".join((EMAIL, DATE, IPV4, SSN, NUMBER, PHONE))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _number(digest: Column, at: Column | int) -> Column:
    """Four hexadecimal digits of a digest as a number."""
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(4)), 16, 10).cast("int")


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _shift_char(c: Column, by: Column) -> Column:
    """The character moved by ``by`` places around its own class; signs stay."""
    code = F.ascii(c)
    moved = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed Feistel network over the characters: in turn each half is moved by a digest of the other,
    each character within its class (digits, small and capital letters). One-to-one for each pattern of classes."""
    def moved(half: Column, other: Column, turn: Column) -> Column:
        return _let(_digest(key, kind, turn, other), lambda d: F.array_join(F.transform(
            F.split(half, ""), lambda c, k: _shift_char(c, _number(d, 1 + (k % 16) * 4))), ""))

    middle = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), middle).alias("l"), F.substr(s, middle + 1, F.length(s)).alias("r"))
    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return _let(
        F.aggregate(turns, start, lambda h, t: F.when(t % 2 == 1, F.struct(moved(h["l"], h["r"], t).alias("l"), h["r"].alias("r"))).otherwise(
            F.struct(h["l"].alias("l"), moved(h["r"], h["l"], t).alias("r")))),
        lambda h: F.concat(h["l"], h["r"]))


def permute_pair(n: Column, side: int, key: str, kind: str) -> Column:
    """A keyed Feistel network over the numbers below ``side * side``."""
    def moved(half: Column, other: Column, turn: Column) -> Column:
        return F.pmod(half + _number(_digest(key, kind, turn, other), 1), F.lit(side)).cast("long")

    start = F.struct(F.floor(n / side).cast("long").alias("a"), (n % side).cast("long").alias("b"))
    return _let(
        F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda h, t: F.when(t % 2 == 1, F.struct(moved(h["a"], h["b"], t).alias("a"), h["b"].alias("b"))).otherwise(
            F.struct(h["a"].alias("a"), moved(h["b"], h["a"], t).alias("b")))),
        lambda h: h["a"] * side + h["b"])


def _walk(value: Column, step, valid) -> Column:
    """``step`` once, and again as long as the result is not in the format."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(pattern: Column, chars: Column, keep: str = "[^0-9]") -> Column:
    """``pattern`` with its characters that ``keep`` doesn't match replaced by ``chars`` in turn."""
    return F.array_join(F.transform(F.split(pattern, ""), lambda c, k: F.when(c.rlike(keep), c).otherwise(
        F.substr(chars, F.length(F.regexp_replace(F.substr(pattern, F.lit(1), k + 1), keep, "")), F.lit(1)))), "")


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """Luhn sum modulo 10; with ``shift`` 1, as if one more digit followed."""
    def part(c: Column, k: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((k + shift) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, b: a + b) % 10


def _account(s: Column, key: str) -> Column:
    def luhn(d: Column) -> Column:
        return _let(permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: F.concat(p, ((10 - luhn_sum(p, 1)) % 10).cast("string")))

    other = lambda d: _walk(d, lambda v: permute_text(v, key, "account"), lambda v: luhn_sum(v) != 0)
    return _let(_digits(s), lambda d: _refill(s, F.when(luhn_sum(d) == 0, luhn(d)).otherwise(other(d))))


def _phone(s: Column, key: str) -> Column:
    country = F.regexp_extract(s, r"^(\+[0-9]{1,3}(?=[^0-9])|\+[0-9])", 1)
    return _let(F.substr(s, F.length(country) + 1, F.length(s)), lambda rest: F.concat(country, _refill(rest, permute_text(_digits(rest), key, "phone"))))


def _ssn_valid(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)|^...00|0000$")


def _ssn(s: Column, key: str) -> Column:
    return _let(_digits(s), lambda d: F.when(_ssn_valid(d), _refill(s, _walk(d, lambda v: permute_text(v, key, "ssn"), _ssn_valid))).otherwise(s))


def _ipv4(s: Column, key: str) -> Column:
    parts = F.split(s, "\\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ~p.rlike("^0."))
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    return F.when(valid, _let(permute_pair(whole, 1 << 16, key, "ipv4"), lambda n: F.concat_ws(
        ".", *[F.pmod(F.floor(n / (1 << b)), F.lit(256)).cast("string") for b in (24, 16, 8, 0)]))).otherwise(s)


def _date(s: Column, key: str) -> Column:
    """Dates as days since the first year; dd/mm is tried before mm/dd, which keeps days above 12."""
    number = lambda a, n: F.substr(s, F.lit(a), F.lit(n)).cast("int")

    def exists(y: Column, m: Column, d: Column) -> Column:
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= longest)

    first = F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1))
    day = lambda n: F.date_add(first, n.cast("int"))

    def moved(y: Column, m: Column, d: Column, kind: str, fmt: str, only_late: bool = False) -> Column:
        start = F.datediff(F.make_date(y, m, d), first).cast("long")
        inside = lambda n: (n < _DAYS) & ((F.dayofmonth(day(n)) > 12) if only_late else F.lit(True))
        return F.date_format(day(_walk(start, lambda n: permute_pair(n, _SIDE, key, kind), inside)), fmt)

    iso, late = (number(1, 4), number(6, 2), number(9, 2)), (number(7, 4), number(4, 2), number(1, 2))
    us = (number(7, 4), number(1, 2), number(4, 2))
    return (
        F.when(s.rlike("^[0-9]{4}-"), F.when(exists(*iso), moved(*iso, "date", "yyyy-MM-dd")).otherwise(s))
        .when(s.contains("."), F.when(exists(*late), moved(*late, "date", "dd.MM.yyyy")).otherwise(s))
        .when(exists(*late), moved(*late, "date", "dd/MM/yyyy"))
        .when(exists(*us), moved(*us, "date-us", "MM/dd/yyyy", only_late=True)).otherwise(s)
    )


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    keep = "[^A-Za-z0-9]"
    return _let(local, lambda x: F.concat(_refill(x, permute_text(F.regexp_replace(x, keep, ""), key, "email"), keep), F.substr(s, F.length(x) + 1, F.length(s))))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; values that aren't valid stay."""
    whole = lambda pattern: f"^(?:{pattern})$"
    return (
        F.when(value.contains("@"), _email(value, key)).when(value.rlike(whole(DATE)), _date(value, key))
        .when(value.rlike(whole(IPV4)), _ipv4(value, key)).when(value.rlike(whole(SSN)), _ssn(value, key))
        .when(value.rlike(whole(NUMBER)), _account(value, key)).otherwise(_phone(value, key))
    )


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with personal values in the text replaced, and the number of values that changed."""
    name = fresh(docs, "_found")
    if count_col.lower() in [c.lower() for c in docs.columns]:
        count_col = fresh(docs, count_col)
    text = F.col(text_col)
    # most texts have nothing to look at
    found = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new"))))
    marked = docs.withColumn(name, found)
    gaps = F.split(text, ANY, -1)
    joined = F.concat(gaps[0], F.array_join(F.transform(name, lambda v, k: F.concat(v["new"], gaps[k + 1])), ""))
    changed = F.size(F.filter(name, lambda v: v["new"] != v["old"]))
    return marked.withColumn(count_col, F.when(F.size(name) > 0, changed).otherwise(0).cast("long")) \
        .withColumn(text_col, F.when(F.size(name) > 0, joined).otherwise(text)).drop(name)
