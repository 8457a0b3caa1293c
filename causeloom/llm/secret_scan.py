"""Secret scanning: fixed patterns, and a battery of randomness tests.

Patterns.  ``assign`` is a password-like name with a value of 12 or more
characters, ``access`` an access key of 18 or more, ``hex`` a run of 16 or more
lower-case hexadecimal digits.  Matches are leftmost and do not overlap within a
kind; spans are code points, the end exclusive, of the whole match.

Battery.  Every run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a digit
and a letter is a candidate; strings of letters or of digits alone are words and numbers
too often and are not tested.  Its encoding is inferred from its characters (hex, base32, base64 ...) and gives the alphabet that a random string would use.  Three
tests follow, all against "drawn at random from the alphabet":

* chi-squared: are the alphabet's symbols used alike, over all its symbols;
* runs: do symbols of the lower and the upper half alternate as often as by chance;
* serial correlation: are neighbouring symbols uncorrelated.

Each gives a normal score that is low for an ordinary, structured string; their
sum over its spread is the candidate's z, near a standard normal for random
strings.

False discovery is controlled by length.  The z of each class of length and encoding
are a mixture of random strings (standard normal) and structured ones, a normal whose
mean is ``APART`` or lower and which is fitted, with both shares, to the whole class
and not to the accepted tail.  Its first guess is that of all classes together, which
also counts as ``PRIOR`` strings, so that a small class borrows it.  A class whose
random share does not raise the likelihood by ``GAIN`` over structured strings alone
accepts nothing.  Of what a cut accepts, the structured normal's tail is estimated to
be false; the lowest cut on a fixed grid whose false share is at most ``rate`` is taken.
The counts are over the whole corpus; a table of at most classes x bins rows (some
4,300) comes to the driver, and one of a row for each class goes back by broadcast.

All but the fit is DataFrame functions.  Defined results: a null or empty text has no
spans; repeated rows are scanned each; an empty table gives no rows; texts are
scanned whole, in time almost linear in their matches; further columns stay, those named ``base`` or ``spans``
as ``base_input`` and ``spans_input``.
"""

from __future__ import annotations

from math import erfc

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import apart, fixed, sums_before
from .staging import stage

# The base patterns, in the order in which kinds are listed.
ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

KINDS = ["assign", "access", "hex", "random"]
#: Share of the accepted candidates of a class that may be false.
RATE = 0.05
#: Upper bounds of the length classes.
LENGTHS = [20, 24, 32, 48, 64, 128]
#: Spread of the sum of the three scores for random strings: 1 + 2 * 1.25^2 * (1 - 2 / pi), rooted.
UNIT = 1.461
#: Cuts on the z scale.
CUTS = [c / 4 for c in range(-12, 9)]
#: Bins of the fit, a quarter wide; lower and higher z fall in the outer ones.
LOWEST, HIGHEST = -12.0, 3.0
#: Highest mean, least and greatest spread of structured strings, strings that the common fit counts as, and least gain in likelihood.
APART, NARROW, WIDE, PRIOR, GAIN = -1.5, 0.5, 4.0, 5.0, 4.0


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the matches for which ``keep(match)`` holds, from the gaps between all matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.struct(hits.alias("hits"), gaps.alias("gaps"))

    def placed(x: Column) -> Column:
        before = sums_before(F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: F.length(h) + g))
        spans = F.transform(
            F.arrays_zip(x["hits"].alias("m"), before.alias("b"), F.slice(x["gaps"], 1, F.size(x["hits"])).alias("g")),
            lambda y: F.struct(F.lit(kind).alias("kind"), (y["b"] + y["g"]).alias("s"), (y["b"] + y["g"] + F.length(y["m"])).alias("e"), y["m"].alias("m")),
        )
        return F.filter(spans, lambda y: keep(y["m"]))

    return F.element_at(F.transform(F.array(both), placed), 1)


def _empty() -> Column:
    return F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")


def _if_any(text: Column, probe: str, spans: Column) -> Column:
    """Few texts have any match: only those pay for the spans."""
    return F.when(text.rlike(probe), spans).otherwise(_empty())


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    return {
        "assign": _if_any(text, ASSIGN, _spans(text, ASSIGN, "assign", value)),
        "access": _if_any(text, r"AKIA[A-Z0-9]{14}", _spans(text, ACCESS, "access", lambda m: F.length(m) >= 18)),
        "hex": _if_any(text, r"[0-9a-f]{16}", _spans(text, r"[0-9a-f]{16,}", "hex", lambda m: F.lit(True))),
    }


def candidate_spans(text: Column) -> Column:
    keep = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return _if_any(text, CANDIDATE, _spans(text, CANDIDATE, "random", keep))


# Inferred encodings, the characters that show them, their alphabets in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("upper36", r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("lower36", r"^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base62", r"^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
]
_OTHER = ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_=")


def encoding_of(m: Column) -> Column:
    out = F.lit(_OTHER[0])
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(m.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _alphabet(encoding: Column) -> Column:
    out = F.lit(_OTHER[1])
    for name, _, alphabet in ENCODINGS:
        out = F.when(encoding == name, F.lit(alphabet)).otherwise(out)
    return out


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, the three scores and z to candidates with a match ``m``."""
    c = fixed(candidates, encoding=encoding_of(F.col("m")), body=F.rtrim("m", F.lit("=")))
    c = fixed(c, alphabet=_alphabet(F.col("encoding")))
    symbols = F.filter(
        F.transform(F.split("body", ""), lambda ch: F.position(ch, F.col("alphabet")).cast("double")), lambda p: p > 0
    )
    c = fixed(c, size=F.length("alphabet").cast("double"), x=symbols)
    c = c.withColumn("n", F.size("x").cast("double")).where("n >= 8")
    mean = (F.col("size") + 1) / 2
    variance = (F.col("size") * F.col("size") - 1) / 12
    # the squares of the symbols' counts, summed over the sorted symbols
    run = F.struct(F.lit(-1.0).alias("p"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    squares = F.aggregate(
        F.array_sort("x"), run,
        lambda r, p: F.when(r["p"] == p, F.struct(p.alias("p"), (r["k"] + 1).alias("k"), (r["sum"] + 2 * r["k"] + 1).alias("sum")))
        .otherwise(F.struct(p.alias("p"), F.lit(1.0).alias("k"), (r["sum"] + 1).alias("sum"))), lambda r: r["sum"],
    )
    chi, free = F.col("size") * squares / F.col("n") - F.col("n"), F.col("size") - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    c = c.withColumn("z_chi", (1 - 2 / (9 * free) - F.pow(chi / free, F.lit(1 / 3))) / F.sqrt(2 / (9 * free)))
    c = fixed(c, half=F.transform("x", lambda p: F.when(p > mean, 1.0).otherwise(0.0)))
    c = c.withColumn("above", _sum(F.col("half")))
    changes = _sum(F.zip_with(
        F.slice("half", 2, F.size("half") - 1), F.slice("half", 1, F.size("half") - 1), lambda a, b: F.abs(a - b)
    ))
    up = F.col("above") * (F.col("n") - F.col("above"))
    runs_mean = 2 * up / F.col("n") + 1
    runs_var = F.greatest(2 * up * (2 * up - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)), F.lit(0.05))
    c = c.withColumn("z_runs", 1.0 - F.abs((changes + 1 - runs_mean) / F.sqrt(runs_var)) * 1.25)
    products = _sum(F.zip_with(
        F.slice("x", 2, F.size("x") - 1), F.slice("x", 1, F.size("x") - 1), lambda a, b: (a - mean) * (b - mean)
    ))
    serial = products / (F.sqrt(F.col("n") - 1) * variance)
    c = c.withColumn("z_serial", 1.0 - F.abs(serial) * 1.25)
    # two-sided scores: 1 - 1.25 |z| has mean 0 for random strings and falls with any departure
    return c.withColumn("z", (F.col("z_chi") + F.col("z_runs") + F.col("z_serial")) / UNIT).drop(
        "alphabet", "body", "size", "x", "n", "half", "above"
    )


def length_class(m: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(F.length(m) < LENGTHS[k], F.lit(k)).otherwise(out)
    return out


def _tail(z: np.ndarray, mean: float = 0.0, spread: float = 1.0) -> np.ndarray:
    """The share of a normal above each ``z``."""
    return np.array([0.5 * erfc((x - mean) / spread / 2**0.5) for x in z])


def _fit(counts: np.ndarray, share: float, mean: float, spread: float, random: bool) -> tuple[float, float, float, float]:
    """Random share, structured mean and spread by EM on binned z, from the guess on, and the logarithm of the likelihood."""
    edges = np.arange(LOWEST, HIGHEST + 0.25, 0.25)
    middle = edges + 0.125
    within = lambda m, d: np.maximum(-np.diff(np.concatenate([[1.0], _tail(edges[1:], m, d), [0.0]])), 1e-12)
    noise, guess, share = within(0.0, 1.0), (mean, spread), share if random else 0.0
    for _ in range(200):
        structured = within(mean, spread)
        density = share * noise + (1 - share) * structured
        mine = counts * (1 - share) * structured / density
        share = float(np.clip(1 - mine.sum() / counts.sum(), 0.0, 1.0)) if random else 0.0
        whole = mine.sum() + PRIOR
        mean = min(APART, float((mine @ middle + PRIOR * guess[0]) / whole))
        spread = float(np.clip(((mine @ (middle - mean) ** 2 + PRIOR * (guess[1] ** 2 + (guess[0] - mean) ** 2)) / whole) ** 0.5, NARROW, WIDE))
    return share, mean, spread, float(counts @ np.log(share * noise + (1 - share) * within(mean, spread)))


def cut_of(counts: np.ndarray, guess: tuple[float, float], rate: float = RATE) -> float | None:
    """The lowest cut at which at most ``rate`` of a class is estimated to be structured; ``counts`` by bin from LOWEST on."""
    _, _, _, alone = _fit(counts, 0.0, *guess, False)
    share, mean, spread, both = _fit(counts, 0.5, *guess, True)
    if both - alone < GAIN:
        return None
    false = counts.sum() * (1 - share) * _tail(np.array(CUTS), mean, spread)
    for cut, wrong in zip(CUTS, false.tolist()):
        accepted = counts[round((cut - LOWEST) * 4) :].sum()
        if accepted and wrong <= rate * accepted:
            return cut
    return None


def thresholds(scored: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, class, cut) of each class that accepts anything; over all candidates of the corpus."""
    place = F.least(F.greatest(F.floor((F.col("z") - LOWEST) * 4), F.lit(0)), F.lit(int((HIGHEST - LOWEST) * 4))).cast("int")
    classes: dict = {}
    for encoding, length, k, n in scored.groupBy("encoding", "class", place.alias("bin")).count().collect():  # at most classes x bins rows
        classes.setdefault((encoding, length), np.zeros(int((HIGHEST - LOWEST) * 4) + 1))[k] += n
    found = []
    if classes:
        _, mean, spread, _ = _fit(sum(classes.values()), 0.5, -4.0, 2.0, True)
        found = [(*c, cut) for c, counts in sorted(classes.items()) if (cut := cut_of(counts, (mean, spread), rate)) is not None]
    return scored.sparkSession.createDataFrame(found, "encoding string, class int, cut double")


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` (without the text) and ``spans`` array<struct<kind,s,e>>, ordered by start and kind.

    The scan is staged once with the raw spans, a few bytes for each row; the
    corpus-wide thresholds are then joined back to it.
    """
    docs = apart(docs, ["base", "spans"], own=[text_col])
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    raw = docs.select(
        *others, F.concat(*base.values()).alias("__base"), candidate_spans(text).alias("__candidates")
    )
    raw = stage(raw.select(F.monotonically_increasing_id().alias("__row"), *others, F.expr(
        "transform(__base, b -> named_struct('kind', b.kind, 's', b.s, 'e', b.e))").alias("__base"), "__candidates"), "secret-spans")
    scored = battery(
        raw.where(F.size("__candidates") > 0)
        .select("__row", F.explode("__candidates").alias("c")).select("__row", "c.s", "c.e", "c.m")
    ).withColumn("class", length_class(F.col("m"))).select("__row", "s", "e", "encoding", "class", "z")
    scored = stage(scored, "secret-scores")  # read twice: for the thresholds and by them
    accepted = scored.join(F.broadcast(thresholds(scored, rate)), ["encoding", "class"]).where("z >= cut")
    added = accepted.groupBy("__row").agg(
        F.collect_list(F.struct(F.lit("random").alias("kind"), "s", "e")).alias("__added")  # of one text
    )
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(v) for k, i in rank.items() for v in (k, i)])
    joined = raw.join(added, "__row", "left")
    every = F.concat("__base", F.coalesce("__added", F.array().cast("array<struct<kind:string,s:int,e:int>>")))

    def arranged(spans):
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), order[x["kind"]].alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
        return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    return joined.select(*others, arranged(F.col("__base")).alias("base"), arranged(every).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
