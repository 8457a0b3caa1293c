"""Personal data: format-preserving Feistel pseudonyms.

Validated values are replaced by values of the same format under a keyed
permutation, so that equal values stay linked across documents and no two values
fall together:

* ``card``: 13 to 19 digits (single blanks or hyphens between them allowed) that
  pass the Luhn test; of numbers in a row one that passes alone counts, else the
  longest row that passes, from each number on.  The digits before the check digit are permuted within their
  number and the check digit is computed anew; separators stay.
* ``phone``: ``+`` and 8 to 15 digits with separators (11 after country code 1), up to
  an address, date or grouped card that follows; all digits are permuted.  Another
  number behind a phone can't be told from its end, except after country code 1.
* ``ip``: four numbers up to 255; the 32 bits are permuted.
* ``date``: a date that exists, 1900 to 2099, written ``y-m-d``, ``y/m/d``, ``d.m.y``, ``d/m/y``
  or, if it is none, ``m/d/y``; it is permuted among the dates that are written with as many
  digits for day and month.  All 73,049 days are one set where both have two digits;
  in the other forms days from 29 on are permuted among themselves, likewise
  29 February.
* ``email``: a name made of the address's keyed hash at ``example.invalid``; this one
  is no permutation, but equal addresses stay equal.  An address ends at its last dot with
  two letters behind it.

The permutations are balanced Feistel networks of ``ROUNDS`` rounds on pairs of
residues: for d digits on Z(10^a) x Z(10^b) with a + b = d, for addresses on
Z(2^16) x Z(2^16), for days on Z(319) x Z(229), whose product is the number of days, for
dates of other forms on years x (months x days).
Round functions are SHA-256 of key, kind, round and half.

All of it is DataFrame functions in one map over the rows; nothing is shuffled.
Defined results: null texts stay null; empty texts stay empty; texts are scanned
whole; values that fail validation stay as they are; rows that repeat give equal
results; an empty table gives no rows; further columns stay, one named ``found`` as
``found_input``.  Patterns are linear in the text: no part is tried from every place of a
run, and repeated groups never give back what they took, so neither long runs nor
many matches exhaust the stack.  The key is a literal of the plan; a session that
shows plans to others should redact it (``spark.sql.redaction.string.regex``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import BLOCK, apart, sums_before

ROUNDS = 8
#: Key of the registered query, which works on invented data; a run on real data passes its own.
_QUERY_KEY = "a key for tests only"

# The patterns that find each kind; a match is then validated by ``kind_of``.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: An address in a match of ``EMAIL``; what follows its last dot with two letters is none of it.
ADDRESS = r"^[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
# A value that a phone or card before it must not swallow.
_OCTET, _DAY, _MONTH, _YEAR = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_OWN = (
    rf"(?:{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
    rf"|(?:{_YEAR}(?:-{_MONTH}-|/{_MONTH}/){_DAY}|{_DAY}(?:\.{_MONTH}\.|/{_MONTH}/){_YEAR})(?![0-9]|[./-][0-9]))"
)
_GROUPED = r"(?:[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9])"
_NEXT = rf"(?:(?![ .()-]?[ ()]{_OWN})[ .()-]{{0,2}}[0-9])"
_PLAIN = _NEXT.replace("(?![", rf"(?![ .()-]?[ ()]{_GROUPED})(?![", 1)
#: Numbers of country code 1 have 11 digits.
PHONE = rf"(?<![0-9+])(?:\+1{_NEXT}{{10}}(?![0-9])|\+[0-9]{_NEXT}{{7}}{_PLAIN}{{0,7}}(?![0-9]))"
#: Numbers in a row, with 13 digits or more at its start; ``cards_in`` finds the cards among them.
CARD = rf"(?<![0-9+])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:(?:-| (?!{_OWN}))[0-9]++)*+"
ANY = "|".join([EMAIL, IP, DATE, PHONE, CARD])
KINDS = ["email", "ip", "date", "phone", "card"]
_DAYS = (319, 229)  # 1900-01-01 to 2099-12-31


def _round(key: Column, kind: str, number: int, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit(number), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)").cast("long"), modulus)


def _nest(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (Catalyst would repeat it in every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(key: Column, kind: str, r: int):
    def go(s: Column) -> Column:
        if r % 2:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + _round(key, kind, r, s["l"], s["b"]), s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b"))
        return F.struct(F.pmod(s["l"] + _round(key, kind, r, s["r"], s["a"]), s["a"]).alias("l"), s["r"].alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    return go


def permute(key: Column, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of Z(a) x Z(b): a struct with l and r."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return reduce(lambda s, r: _nest(s, _step(key, kind, r)), range(ROUNDS), state)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double")).cast("long")


def permuted_digits(key: Column, kind: str, digits: Column) -> Column:
    """Another digit string of the same length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    cut = F.struct(F.substring(digits, F.lit(1), half).cast("long").alias("x"), F.substring(digits, half + 1, rest).cast("long").alias("y"))
    done = permute(key, kind, cut["x"], cut["y"], _power(half), _power(rest))
    return _nest(done, lambda s: F.concat(
        F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")
    ))


def _luhn_sum(payload: Column, doubled_first_from_right: int) -> Column:
    digits = F.transform(F.reverse(F.split(payload, "")), lambda d: d.cast("int"))
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when((i + doubled_first_from_right) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
        F.lit(0), lambda s, d: s + d,
    )


def luhn(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def permuted_card(key: Column, digits: Column) -> Column:
    payload = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    return _nest(payload, lambda p: F.concat(p, ((10 - _luhn_sum(p, 1) % 10) % 10).cast("string")))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``; other characters stay."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    return F.aggregate(
        F.split(shape, ""), start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("out")))
        .otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"],
    )


def permuted_ip(key: Column, ip: Column) -> Column:
    o = [F.get(F.split(ip, r"\."), F.lit(k)).cast("long") for k in range(4)]
    done = permute(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return _nest(done, lambda s: F.concat_ws(
        ".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256
    ))


def _date_of(m: Column) -> Column:
    """(year, month, day, order, month's and day's digits) of a date that exists, or null."""
    part = F.split(m, "[-./]")
    get = lambda k: F.get(part, F.lit(k))
    ymd = F.length(get(0)) == 4

    def read(order: str, y: int, a: int, b: int) -> Column:
        year, month, day = get(y).cast("int"), get(a).cast("int"), get(b).cast("int")
        exists = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNotNull()
        one = F.struct(
            year.alias("y"), month.alias("m"), day.alias("d"), F.lit(order).alias("order"),
            F.length(get(a)).alias("mw"), F.length(get(b)).alias("dw"),
        )
        return F.when(year.between(1900, 2099) & exists, one)

    slash = F.instr(m, "/") > 0
    return F.when(ymd, read("ymd", 0, 1, 2)).otherwise(F.coalesce(read("dmy", 2, 1, 0), F.when(slash, read("mdy", 2, 0, 1))))


#: Pairs of month and day from the 29th on that every year has, beside those of February.
_LATE = [(m, d) for m in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) for d in (29, 30, 31) if d < 31 or m in (1, 3, 5, 7, 8, 10, 12)]


def permuted_date(key: Column, m: Column) -> Column:
    def written(t: Column, y: Column, month: Column, day: Column) -> Column:
        mark = F.regexp_extract(m, "[-./]", 0)
        year, month, day = y.cast("string"), F.lpad(month.cast("string"), t["mw"], "0"), F.lpad(day.cast("string"), t["dw"], "0")
        return F.when(t["order"] == "ymd", F.concat(year, mark, month, mark, day)).when(
            t["order"] == "dmy", F.concat(day, mark, month, mark, year)
        ).otherwise(F.concat(month, mark, day, mark, year))

    def moved(t: Column) -> Column:
        form = F.concat_ws(":", F.lit("date"), F.when(t["order"] == "mdy", "mdy").otherwise("day"), t["mw"], t["dw"])
        secret = F.concat_ws("|", key, form)
        years = lambda left: (left + 1900)
        # both of two digits: all days
        n = F.datediff(F.make_date(t["y"], t["m"], t["d"]), F.lit("1900-01-01").cast("date")).cast("long")
        whole = _nest(
            permute(key, "date", F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1])),
            lambda s: _nest(F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")), lambda x: written(t, F.year(x), F.month(x), F.dayofmonth(x))),
        )
        # months and days up to the 28th that the digits, and the order, can say
        months = F.when(t["mw"] == 1, 9).otherwise(12)
        first = F.when(t["order"] == "mdy", 13).otherwise(1)
        days = F.when(t["dw"] == 1, 9).otherwise(28) - first + 1
        early = _nest(
            permute(secret, "date", t["y"] - 1900, (t["m"] - 1) * days + t["d"] - first, F.lit(200), months * days),
            lambda s: written(t, years(s["l"]), F.floor(s["r"] / days) + 1, s["r"] % days + first),
        )
        pairs = F.filter(F.array(*[F.struct(F.lit(x).alias("m"), F.lit(y).alias("d")) for x, y in _LATE]), lambda p: (t["mw"] == 2) | (p["m"] < 10))
        place = F.array_position(F.transform(pairs, lambda p: p["m"] * 100 + p["d"]), t["m"] * 100 + t["d"]) - 1
        late = _nest(
            permute(secret, "late", t["y"] - 1900, place, F.lit(200), F.size(pairs)),
            lambda s: _nest(F.element_at(pairs, (s["r"] + 1).cast("int")), lambda p: written(t, years(s["l"]), p["m"], p["d"])),
        )
        leap = _nest(
            permute(secret, "leap", F.floor((t["y"] - 1904) / 4 / 7), F.floor((t["y"] - 1904) / 4) % 7, F.lit(7), F.lit(7)),
            lambda s: written(t, 1904 + 4 * (s["l"] * 7 + s["r"]), t["m"], t["d"]),
        )
        return (
            F.when((t["mw"] == 2) & (t["dw"] == 2) & (t["order"] != "mdy"), whole)
            .when(t["d"] <= 28, early).when(t["m"] == 2, leap).otherwise(late)
        )

    return _nest(_date_of(m), moved)


def kind_of(m: Column) -> Column:
    """The validated kind of a match, or null."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.split(m, r"\.")
    return (
        F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(m.rlike(r"^[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}$"), F.when(_date_of(m).isNotNull(), "date"))
        .when(F.substring(m, 1, 1) == "+", "phone")
        .when(F.length(digits).between(13, 19) & luhn(digits), "card")
    )


def cards_in(gap: Column, row: Column) -> Column:
    """The cards of a row of numbers: from each number on itself or the longest that validates, then on behind it; the last entry is what follows."""
    valid = lambda digits: F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    number = lambda token: F.regexp_replace(token, "^[ -]", "")

    def count(ahead: Column) -> Column:
        """How many of the numbers ahead, 19 at most, are a card from the first one on; 0 for none."""
        ends = F.sequence(F.lit(1), F.size(ahead))

        def card(n: Column) -> Column:  # a later number that is a card by itself is none's end
            digits = F.array_join(F.transform(F.slice(ahead, 1, n), number), "")
            return valid(digits) & ((n == 1) | ~valid(number(F.element_at(ahead, n))))

        return F.when(card(F.lit(1)), F.lit(1)).otherwise(F.coalesce(F.array_max(F.filter(ends, card)), F.lit(0)))

    def chosen(x: Column) -> Column:
        """Places of the cards, from 1 on: the numbers are gone through in blocks, so that little is copied at a step."""
        none = F.array().cast("array<int>")

        def step(s, k):
            n = F.element_at(x["n"], k)
            return F.when((k < s["free"]) | (n == 0), s).otherwise(F.struct((k + n).alias("free"), F.concat(s["out"], F.array(k)).alias("out")))

        def block(s, b):
            last = F.least(b + BLOCK - 1, F.size(x["n"]))
            done = F.aggregate(F.sequence(b, last), F.struct(s["free"].alias("free"), none.alias("out")), step)
            return _nest(done, lambda d: F.struct(d["free"].alias("free"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        begin = F.struct(F.lit(1).alias("free"), F.array().cast("array<array<int>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(x["n"]), F.lit(BLOCK)), begin, block, lambda s: s["out"]))

    def pieces(x: Column) -> Column:
        tokens, at = x["tokens"], x["at"]
        behind = lambda k: F.element_at(at, k) + F.element_at(x["n"], F.element_at(at, k))  # noqa: E731  the place behind card k
        said = lambda a, b: F.array_join(F.slice(tokens, a, b - a), "")
        one = lambda k: _nest(
            F.struct(F.when(k == 1, 1).otherwise(behind(F.greatest(k - 1, F.lit(1)))).alias("from"), F.element_at(at, k).alias("at"), said(F.element_at(at, k), behind(k)).alias("m")),
            lambda y: F.struct(
                F.concat(F.when(k == 1, gap).otherwise(""), said(y["from"], y["at"]), F.regexp_extract(y["m"], "^[ -]?", 0)).alias("gap"),
                number(y["m"]).alias("m"), F.lit("card").alias("kind"),
            ),
        )
        size = F.size(at)
        rest = F.when(size == 0, F.concat(gap, said(F.lit(1), F.size(tokens) + 1))).otherwise(said(behind(F.greatest(size, F.lit(1))), F.size(tokens) + 1))
        last = F.struct(rest.alias("gap"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("kind"))
        return F.when(size == 0, F.array(last)).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), one), F.array(last)))

    tokens = F.regexp_extract_all(row, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _nest(tokens, lambda t: _nest(
        F.transform(t, lambda _, k: count(F.slice(t, k + 1, F.lit(19)))), lambda n: _nest(
            chosen(F.struct(n.alias("n"))), lambda at: pieces(F.struct(t.alias("tokens"), n.alias("n"), at.alias("at")))
        )
    ))


def pseudonym(key: Column, kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256)
    return (
        F.when(kind == "email", F.concat(F.lit("user-"), F.substring(name, 1, 16), F.lit("@example.invalid")))
        .when(kind == "ip", permuted_ip(key, m))
        .when(kind == "date", permuted_date(key, m))
        .when(kind == "phone", _refill(m, permuted_digits(key, "phone", digits)))
        .when(kind == "card", _refill(m, permuted_card(key, digits)))
        .otherwise(m)
    )


def find(text: Column) -> Column:
    """array<struct<gap, m, kind>>: the text cut at every match; the last entry has no match."""
    gaps = F.split(text, ANY, -1)
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    one = lambda g, m, kind: F.struct(g.alias("gap"), m.alias("m"), kind.alias("kind"))
    null = F.lit(None).cast("string")

    def mail(g: Column, m: Column) -> Column:
        return _nest(F.regexp_extract(m, ADDRESS, 0), lambda a: F.when(a == "", F.array(one(F.concat(g, m), null, null))).otherwise(
            F.array(one(g, a, F.lit("email")), one(F.substr(m, F.length(a) + 1), null, null))
        ))

    pieces = F.zip_with(gaps, hits, lambda g, m: F.when(m.rlike("^[0-9][0-9 -]*+$") & ~m.rlike(f"^(?:{DATE})$"), cards_in(g, m)).when(
        F.instr(m, "@") > 0, mail(g, m)
    ).otherwise(F.array(one(g, m, kind_of(m)))))
    return F.flatten(pieces)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and ``found``: (kind, start, end) of each value in the original text."""
    docs = apart(docs, ["found"], own=[text_col])
    secret = F.lit(key)
    text = F.col(text_col)
    cut = docs.withColumn("__cut", F.when(text.rlike(ANY), find(text)))
    rebuilt = F.array_join(F.transform("__cut", lambda x: F.concat(x["gap"], F.coalesce(pseudonym(secret, x["kind"], x["m"]), F.lit("")))), "")
    sizes = F.transform("__cut", lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    ends = F.transform(F.arrays_zip(F.col("__cut").alias("x"), sums_before(sizes).alias("b")), lambda y: F.struct(
        y["x"]["kind"].alias("kind"), (y["b"] + F.length(y["x"]["gap"])).alias("s"),
        (y["b"] + F.length(y["x"]["gap"]) + F.coalesce(F.length(y["x"]["m"]), F.lit(0))).alias("e"),
    ))
    spans = F.filter(ends, lambda y: y["kind"].isNotNull())
    return cut.withColumns({
        "found": F.when(F.col("__cut").isNotNull(), spans).otherwise(F.array().cast("array<struct<kind:string,s:int,e:int>>")),
        text_col: F.when(F.col("__cut").isNotNull(), rebuilt).otherwise(text),
    }).drop("__cut")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, _QUERY_KEY)
    count = [F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    return done.select("doc_id", *count, spans.alias("spans"), "text")
