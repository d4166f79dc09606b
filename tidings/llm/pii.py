"""Personal data: format-preserving Feistel pseudonyms.

Validated values (cards by their check digit, phone numbers by their plan, IPv4
addresses, US social security numbers, IBANs modulo 97, dates by the
calendar) and the characters of e-mail addresses and secrets are replaced by a
keyed permutation within their format: a value becomes a list of symbols, each
with its own base, split in two halves; in every round one half is shifted by
a keyed SHA-256 of the other, symbol by symbol modulo its base.  Each kind has
its key, so equal values become equal pseudonyms in all documents and however
they are written, different ones stay different, and the pseudonym is valid
again.  Validity is kept by the choice of bases (an area code begins with 2 to
9), and check digits are computed anew.

All of it is DataFrame functions: one pattern finds the candidates, a text
without any is passed on as it is, and only the found values go through the
rounds; a secret has any length, with the parts that single dots join.  A candidate that fails validation can hide a value: a text with one is
searched again from every place where a candidate can begin, each place by all
kinds and by an IBAN's shorter forms, and the first valid value from the left
counts.  No shuffle, no Python.  Quantifiers are bounded or possessive where
classes overlap, so texts of any length and shape take linear time.

Not supported, so left: dates with month names, one-digit days or months, two-digit
years, day before month between slashes, year first with slashes or dots, or no
separators; the time of a time stamp; phone numbers without a country code other
than North American ones, or with 00 for the plus sign; IBANs in small letters
or joined to other letters or digits; cards right before another number.

Defined cases: a null text stays null with no finds; an empty one stays empty;
values that fail validation stay, but for valid ones within them; an IBAN has
its country's length or, with another length or an unknown country, the check
digits alone decide; dates outside 1900 to 2099 stay; repeated
rows and null ids are returned as they come; an empty table gives no rows; other
columns are passed over (``query``) or kept (``pseudonymise``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, fresh_names

ROUNDS = 8
#: The key of the registered query; deployments pass their own secret.
KEY = "public-test-key"
#: Dates from 1900-01-01 on, as many as 229 x 319 days.
_DAYS = (229, 319)

_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK ST TN VG",
    25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_form(groups: str, rest: str) -> str:
    return r"[0-9]{2}(?: ?[0-9A-Z]{4})" + groups + rest + _RIGHT


_KNOWN = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")"
_BY_COUNTRY = "(?:" + "|".join(
    "(?:" + c.replace(" ", "|") + ")" + _iban_form(f"{{{n // 4 - 1}}}", f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "")
    for n, c in IBAN_LENGTHS.items()) + ")"
_ANY_LENGTH = "[A-Z]{2}" + _iban_form("{2,7}", "(?: ?[0-9A-Z]{1,3})?")
#: What is tried at a place in turn: the country's length, the longest, and for unknown countries all shorter ones.
IBAN_FORMS = [_LEFT + _BY_COUNTRY, _LEFT + _ANY_LENGTH] + [
    _LEFT + "(?!" + _KNOWN + ")[A-Z]{2}" + _iban_form(f"{{{n}}}", rest)
    for n in range(7, 1, -1) for rest in (" ?[0-9A-Z]{1,3}", "")]
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _RIGHT,
    "secret": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}" + _RIGHT
              + r"|(?i:(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)"
                r"[0-9A-Za-z_+/-]{8,}+(?:\.[0-9A-Za-z_+/-]++)*+",
    "phone": r"(?<![0-9A-Za-z+])\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?(?:[0-9][ .-])?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
             r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:(?:[ .-][0-9](?=[ .-]))?[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
             r"|(?<![0-9A-Za-z])\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z.-])[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z])",
    "iban": _LEFT + "(?=[A-Z]{2}[0-9]{2})(?:" + _BY_COUNTRY + "|" + _ANY_LENGTH + ")",
    "card": _LEFT + r"[0-9]{13,19}" + _RIGHT
            + r"|(?<![0-9A-Za-z])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![ -]?[0-9]|[A-Za-z])"
              r"|(?<![0-9A-Za-z])[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}(?![ -]?[0-9]|[A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-2][0-9](?::?[0-5][0-9]|[Zz]?(?![0-9A-Za-z])))|(?![0-9A-Za-z-]))"
            r"|(?<![0-9A-Za-z./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
            r"|(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])",
}
KINDS = tuple(PATTERNS)
#: No kind begins after a letter, and none but a secret's key word after a digit: that is tested once, before the kinds
#: are tried.
ANY = (r"(?<![A-Za-z])(?:(?<![0-9])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "secret")
       + f")|(?:{PATTERNS['secret']}))")
#: Every kind has one of these; texts without any are not searched further.
SIGN = r"[0-9@=:]|AKIA"
#: The place before a candidate; group 3 is what it can be: kinds without validation whole, of others more than their longest.
PLACE = f"(?={ANY})"
PLACE_VIEW = PLACE + f"(?=({PATTERNS['email']}|{PATTERNS['secret']}|[\\s\\S]{{1,80}}))"
#: Places are gone through in runs of so many, so that no long array is copied for each.
RUN = 64


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _bind(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def feistel(values: Column, bases: Column, key: str, kind: str) -> Column:
    """The keyed permutation of ``values`` (``0 <= values[i] < bases[i]``, both
    int arrays).  A half longer than 32 symbols uses its hash again."""
    half = (F.size(values) / F.lit(2)).cast("int")
    rest = F.size(values) - half
    start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, rest).alias("r"),
                     F.slice(bases, F.lit(1), half).alias("lb"), F.slice(bases, half + 1, rest).alias("rb"))

    def step(acc: Column, i: Column) -> Column:
        seed = F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), F.size(acc["l"]).cast("string"),
                        F.lit("|"), F.array_join(acc["r"].cast("array<string>"), ","))
        stream = F.sha2(seed.cast("binary"), 256)
        shifted = _bind(F.concat(stream, stream), lambda twice: F.transform(acc["l"], lambda v, p: F.pmod(
            v + F.conv(F.substring(twice, ((p % 32) * 2 + 1).cast("int"), F.lit(6)), 16, 10).cast("int"),
            F.element_at(acc["lb"], p + 1))))
        return F.struct(acc["r"].alias("l"), shifted.alias("r"), acc["rb"].alias("lb"), acc["lb"].alias("rb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def _digits(s: Column) -> Column:
    return F.transform(_chars(s), lambda c: c.cast("int"))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    return F.array_join(F.transform(_chars(shape), lambda c, p: F.when(
        c.between("0", "9"), F.substring(digits, F.length(F.regexp_replace(
            F.substring(shape, F.lit(1), p + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")


def _tens(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(10))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; the last digit counts double when a check digit is to follow."""
    odd = F.lit(0 if double_last else 1)
    values = F.transform(F.reverse(_digits(digits)), lambda v, p: F.when(
        (p + odd) % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _card(s: Column, key: str) -> Column:
    d = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(d)
    body = F.substring(d, F.lit(1), n - 1)
    new = F.array_join(feistel(_digits(body), _tens(n - 1), key, "card"), "")
    check = F.pmod(-_luhn_sum(new, True), F.lit(10)).cast("string")
    return F.when(_luhn_sum(d, False) % 10 == 0, _refill(s, F.concat(new, check)))


def _phone(s: Column, key: str) -> Column:
    """North American numbers keep +1 and stay dialable; others keep the first
    two digits (country code) and permute the rest, whatever their number:
    digits that run on behind a phone number are permuted with it."""
    d = F.regexp_replace(s, "[^0-9]", "")
    ten = F.substring(d, F.length(d) - 9, F.lit(10))
    american = d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & (~s.startswith("+") | s.startswith("+1"))
    v = F.transform(_digits(ten), lambda x, p: F.when((p == 0) | (p == 3), x - 2).otherwise(x))
    got = feistel(v, _ints(8, 10, 10, 8, 10, 10, 10, 10, 10, 10), key, "phone")
    local = F.array_join(F.transform(got, lambda x, p: F.when((p == 0) | (p == 3), x + 2).otherwise(x)), "")
    us = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), local)
    keep = F.when(F.length(d) > 9, 2).otherwise(1)
    tail = F.substring(d, keep + 1, F.length(d) - keep)
    other = F.concat(F.substring(d, F.lit(1), keep), F.array_join(
        feistel(_digits(tail), _tens(F.length(tail)), key, "phone"), ""))
    return F.when(F.length(d) >= 7, _refill(s, F.when(american, us).otherwise(other)))


def _ip(s: Column, key: str) -> Column:
    v = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    return F.array_join(feistel(v, _ints(256, 256, 256, 256), key, "ip"), ".")


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    v = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
    got = feistel(v, _ints(898, 99, 9999), key, "ssn")
    area = got[0] + 1 + F.when(got[0] >= 665, 1).otherwise(0)
    return F.when(valid, F.format_string("%03d-%02d-%04d", area, got[1] + 1, got[2] + 1))


def _date(s: Column, key: str) -> Column:
    iso = (F.when(s.contains("-"), s)
           .when(s.contains("."), F.concat_ws("-", s.substr(7, 4), s.substr(4, 2), s.substr(1, 2)))
           .otherwise(F.concat_ws("-", s.substr(7, 4), s.substr(1, 2), s.substr(4, 2))))
    day = F.datediff(iso.try_cast("date"), F.lit("1900-01-01").cast("date"))
    got = feistel(F.array((day / F.lit(_DAYS[1])).cast("int"), day % _DAYS[1]), _ints(*_DAYS), key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), got[0] * _DAYS[1] + got[1])
    written = (F.when(s.contains("-"), F.date_format(new, "yyyy-MM-dd"))
               .when(s.contains("."), F.date_format(new, "dd.MM.yyyy"))
               .otherwise(F.date_format(new, "MM/dd/yyyy")))
    return F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), written)


def _by_class(s: Column, key: str, kind: str) -> Column:
    """Every letter and digit permuted within its class, the rest left."""
    code = F.transform(_chars(s), lambda c: F.ascii(c))
    base = F.transform(code, lambda a: F.when(a.between(48, 57), 10).when(
        a.between(65, 90) | a.between(97, 122), 26).otherwise(1))
    zero = lambda a: F.when(a.between(48, 57), 48).when(a.between(65, 90), 65).when(a.between(97, 122), 97).otherwise(a)  # noqa: E731,E501
    got = feistel(F.transform(code, lambda a: a - zero(a)), base, key, kind)
    return F.array_join(F.zip_with(code, got, lambda a, v: F.char(zero(a) + v)), "")


def _iban(s: Column, key: str) -> Column:
    compact = F.replace(s, F.lit(" "), F.lit(""))
    number = lambda t: F.array_join(F.transform(_chars(t), lambda c: F.when(
        c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    mod97 = lambda t: F.aggregate(_digits(number(t)), F.lit(0), lambda a, v: (a * 10 + v) % 97)
    country, body = F.substring(compact, 1, 2), F.substring(compact, F.lit(5), F.length(compact) - 4)
    new = _by_class(body, key, "iban")
    check = F.format_string("%02d", F.lit(98) - mod97(F.concat(new, country, F.lit("00"))))
    out = F.concat(country, check, new)
    spaced = F.array_join(F.transform(_chars(s), lambda c, p: F.when(c == " ", c).otherwise(F.substring(
        out, F.length(F.replace(F.substring(s, F.lit(1), p + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.when(mod97(F.concat(body, F.substring(compact, 1, 4))) == 1, spaced)


def _email(s: Column, key: str) -> Column:
    """The top-level domain stays."""
    top = F.regexp_extract(s, r"\.[A-Za-z]{2,24}$", 0)
    return F.concat(_by_class(F.substring(s, F.lit(1), F.length(s) - F.length(top)), key, "email"), top)


def _secret(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, r"^(AKIA(?=[0-9A-Z]{16}$)|.*[=: \t\"'])", 0)
    return F.concat(head, _by_class(F.substring(s, F.length(head) + 1, F.length(s)), key, "secret"))


_PSEUDONYM = {"email": _email, "secret": _secret, "phone": _phone, "iban": _iban, "card": _card, "ip": _ip,
              "ssn": _ssn, "date": _date}


def kind_of(match: Column) -> Column:
    """The first kind whose pattern the whole match has."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _value(kind: Column, match: Column, key: str) -> Column:
    """The pseudonym; null for a value that fails validation."""
    value = F.lit(None).cast("string")
    for k in reversed(KINDS):
        value = F.when(kind == k, _PSEUDONYM[k](match, key)).otherwise(value)
    return value


def pseudonym(match: Column, key: str) -> Column:
    """``(kind, value)``; kind is null for a value that fails validation."""
    kind = kind_of(match)
    value = _value(kind, match, key)
    return F.transform(F.array(F.struct(kind.alias("kind"), value.alias("value"))), lambda x: F.struct(
        F.when(x["value"].isNotNull(), x["kind"]).alias("kind"), F.coalesce(x["value"], match).alias("value")))[0]


def _at_place(view: Column, key: str) -> Column:
    """``(kind, n, value)`` of the first valid value right behind the first
    character of ``view``, ``n`` characters long; null if there is none."""
    form = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(
        view, r"(?<=\A[\s\S])(?:" + p + ")", 0).alias("match"))
    before, after = ([form(k, PATTERNS[k]) for k in ks] for ks in (
        KINDS[:KINDS.index("iban")], KINDS[KINDS.index("iban") + 1:]))
    forms = F.concat(F.array(*before), F.when(view.rlike(r"\A[\s\S][A-Z]{2}[0-9]{2}"), F.array(
        *[form("iban", p) for p in IBAN_FORMS])).otherwise(F.array().cast("array<struct<kind:string,match:string>>")),
        F.array(*after))
    tried = F.transform(F.filter(forms, lambda x: x["match"] != ""), lambda x: F.struct(
        x["kind"].alias("kind"), F.length(x["match"]).alias("n"), _value(x["kind"], x["match"], key).alias("value")))
    return F.get(F.filter(tried, lambda x: x["value"].isNotNull()), F.lit(0))


def _search_again(pieces: Column, views: Column, key: str) -> Column:
    """``(text, kind)`` per piece.  ``pieces`` is a text cut at its places, with
    one character and the text up to the first place before them, and ``views``
    is what each place can be.  A value covers pieces or their beginnings."""
    n = F.size(views)
    before = F.transform(F.slice(pieces, F.lit(1), n), lambda p: F.right(p, F.lit(1)))
    places = F.zip_with(F.slice(pieces, F.lit(2), n), F.zip_with(before, views, lambda a, b: F.concat(a, b)),
                        lambda p, v: F.struct(p.alias("piece"), v.alias("view")))
    runs = _bind(places, lambda ps: F.transform(F.sequence(F.lit(0), ((n - 1) / F.lit(RUN)).cast("int")),
                                                lambda i: F.slice(ps, i * RUN + 1, F.lit(RUN))))
    out = "array<struct<text:string,kind:string>>"
    state = lambda covered, texts: F.struct(covered.cast("int").alias("covered"), texts.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        found = F.when(acc["covered"] == 0, _at_place(x["view"], key))
        return _bind(found, lambda f: _bind(F.coalesce(f["n"], acc["covered"]), lambda over: state(
            F.greatest(F.lit(0), over - F.length(x["piece"])), F.concat(acc["out"], F.array(F.struct(
                F.concat(F.coalesce(f["value"], F.lit("")), F.substring(x["piece"], over + 1, F.length(x["piece"])))
                .alias("text"), f["kind"].alias("kind")))))))

    def run(acc: Column, xs: Column) -> Column:
        part = F.aggregate(xs, state(acc["covered"], F.array().cast(out)), step)
        return _bind(part, lambda p: state(p["covered"], F.concat(acc["out"], F.array(p["out"]))))

    head = F.array(F.struct(F.substring(pieces[0], F.lit(2), F.length(pieces[0])).alias("text"),
                            F.lit(None).cast("string").alias("kind")))
    return F.concat(head, F.flatten(F.aggregate(runs, state(F.lit(0), F.array().cast(f"array<{out}>")), run,
                                                lambda acc: acc["out"])))


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", finds_col: str = "finds") -> DataFrame:
    """``docs`` with pseudonyms in its text and, as ``finds``, the kinds found
    in order (existing columns of that name are replaced)."""
    found, pieces, views, again = fresh_names(docs, "_found", "_pieces", "_views", "_again")
    text = F.col(text_col).cast("string")
    has = F.coalesce(text.rlike(SIGN) & text.rlike(ANY), F.lit(False))
    matches = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn(found, F.transform(matches, lambda m: pseudonym(m, key)))
    # a place at the very beginning would give no piece before it
    lead = F.concat(F.lit("\n"), text)
    failed = F.exists(F.col(found), lambda x: x["kind"].isNull())
    marked = marked.withColumns({pieces: F.when(failed, F.split(lead, PLACE, -1)),
                                 views: F.when(failed, F.regexp_extract_all(lead, F.lit(PLACE_VIEW), F.lit(3)))})
    marked = marked.withColumn(again, F.when(F.col(pieces).isNotNull(), _search_again(F.col(pieces), F.col(views), key)))
    rebuilt = F.array_join(F.flatten(F.zip_with(
        F.split(text, ANY, -1), F.concat(F.transform(F.col(found), lambda x: x["value"]), F.array(F.lit(""))),
        lambda a, b: F.array(a, b))), "")
    kinds = F.coalesce(F.transform(F.col(again), lambda x: x["kind"]), F.transform(F.col(found), lambda x: x["kind"]))
    return marked.withColumns({
        text_col: F.when(F.col(found).isNull(), text).when(F.col(again).isNotNull(), F.array_join(F.transform(
            F.col(again), lambda x: x["text"]), "")).otherwise(rebuilt),
        finds_col: F.coalesce(F.filter(kinds, lambda k: k.isNotNull()), F.array().cast("array<string>"))}).drop(
            found, pieces, views, again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", F.size("finds").cast("long").alias("n_found"),
                                     F.array_join(F.array_distinct("finds"), ",").alias("kinds"))
