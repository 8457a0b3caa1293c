"""Pseudonyms and secrets against brute force, hostile texts, edge cases."""

import datetime
import hashlib
import math
import random
import re
import string

from causeloom.llm import pseudonyms, secret_scan


def feistel(key, kind, left, right, a, b):
    def number(r, half, modulus):
        return int(hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()[:15], 16) % modulus

    for r in range(pseudonyms.ROUNDS):
        if r % 2:
            right = (right + number(r, left, b)) % b
        else:
            left = (left + number(r, right, a)) % a
    return left, right


def digits_of(key, kind, digits):
    half = len(digits) // 2
    x, y = feistel(key, kind, int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half))
    return f"{x:0{half}d}{y:0{len(digits) - half}d}"


def one_by_one(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(docs, key).collect()}


def test_feistel_against_brute_force(spark):
    draw = random.Random(2)
    phones = ["+1" + "".join(draw.choices(string.digits, k=10)) for _ in range(20)]
    ips = [".".join(str(draw.randint(0, 255)) for _ in range(4)) for _ in range(20)]
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(draw.randrange(73049)) for _ in range(20)]
    got = one_by_one(spark, phones + ips + [d.isoformat() for d in days])
    for k, phone in enumerate(phones):
        assert got[k].text == "+" + digits_of("k", "phone", phone[1:])
    for k, ip in enumerate(ips, 20):
        o = [int(x) for x in ip.split(".")]
        x, y = feistel("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        assert got[k].text == f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    for k, day in enumerate(days, 40):
        n = (day - datetime.date(1900, 1, 1)).days
        x, y = feistel("k", "date", n // 229, n % 229, 319, 229)
        assert got[k].text == (datetime.date(1900, 1, 1) + datetime.timedelta(x * 229 + y)).isoformat()


def test_dates_keep_their_form_and_stay_apart(spark):
    texts = [f"{d}/{m}/{y}" for y in (1999, 2024) for m in range(1, 13) for d in range(1, 32)]
    texts += [f"{m}/{d}/2024" for m in range(1, 13) for d in range(13, 32)] + [f"0{m}/{d}/2023" for m in range(1, 10) for d in range(13, 32)]
    texts += [f"{y}-{m}-{d}" for y in (1901, 2020) for m in (1, 2, 12) for d in (1, 9, 10, 28, 29, 31)]
    texts = sorted(set(texts + ["01/02/2024", "1/2/2024", "29.2.2024", "29.02.2024", "2/29/2000", "12/31/1999"]))
    got = one_by_one(spark, texts)

    def date_of(text):
        p = [int(x) for x in re.split("[-./]", text)]
        for y, m, d in [p] if p[0] > 999 else [(p[2], p[1], p[0])] + [(p[2], p[0], p[1])] * ("/" in text):
            try:
                return datetime.date(y, m, d)
            except ValueError:
                pass

    real = [k for k, t in enumerate(texts) if date_of(t)]
    assert all(got[k].text == t and got[k].found == [] for k, t in enumerate(texts) if not date_of(t))
    for k in real:
        assert re.sub("[0-9]", "9", got[k].text) == re.sub("[0-9]", "9", texts[k]) and date_of(got[k].text), texts[k]
        assert [(f.kind, f.s, f.e) for f in got[k].found] == [("date", 0, len(texts[k]))]
    assert len({got[k].text for k in real}) == len(real)  # no two fall together


def test_hostile_texts_end(spark):
    many = 20_000
    texts = [
        "a@" + "b." * many + "com", "x" * 300_000, "a." * many + "@", "1 " * many, "4111111111111111 " * 2000, "1.2.3.4, " * many,
        "me@x.org.1 and a@b..com", "1" * 100_000, "+1" * many, "@" * many,
    ]
    got = one_by_one(spark, texts)
    assert len(got[0].found) == 1 and got[0].text.startswith("user-") and got[1].text == texts[1] and got[2].found == []
    assert got[3].found == [] and len(got[4].found) == 2000 and len(set(got[4].text.split())) == 1
    assert len(got[5].found) == many and got[5].found[-1].s == 9 * (many - 1)
    assert re.fullmatch(r"user-[0-9a-f]{16}@example\.invalid\.1 and a@b\.\.com", got[6].text)
    docs = spark.createDataFrame([(1, "token=" + "ab1_" * 50_000 + " " + "password: abcdefgh1234567 " * 5_000)], "doc_id long, text string")
    found = secret_scan.scan(docs).head()
    assert len(found.base) == 5_001 and [b.s for b in found.base[:2]] == [0, 200_007]


def test_clashing_names_repeats_and_empty_tables(spark):
    rows = [(1, "ip 10.0.0.1", "f", "b", 3), (1, "ip 10.0.0.1", "f", "b", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, base string, spans int")
    done = pseudonyms.pseudonymise(docs, "k")
    assert done.columns == ["doc_id", "text", "found_input", "base", "spans", "found"] and pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0
    got = done.orderBy("doc_id").collect()
    assert got[0].text is None and got[1] == got[2] and got[1].found_input == "f"
    scanned = secret_scan.scan(docs)
    assert scanned.columns == ["doc_id", "found", "base_input", "spans_input", "base", "spans"]
    assert scanned.count() == 3 and secret_scan.scan(docs.limit(0)).collect() == []


def battery(text, alphabet):
    x = [alphabet.index(c) + 1 for c in text if c in alphabet]
    n, size = len(x), len(alphabet)
    chi = size / n * sum(x.count(p) ** 2 for p in set(x)) - n
    free = size - 1
    z = (1 - 2 / (9 * free) - (chi / free) ** (1 / 3)) / math.sqrt(2 / (9 * free))
    half = [p > (size + 1) / 2 for p in x]
    runs = 1 + sum(a != b for a, b in zip(half, half[1:]))
    up = sum(half) * (n - sum(half))
    mean = 2 * up / n + 1
    variance = max(2 * up * (2 * up - n) / (n * n * (n - 1)), 0.05)
    z += 1 - abs((runs - mean) / math.sqrt(variance)) * 1.25
    middle = (size + 1) / 2
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / (math.sqrt(n - 1) * (size * size - 1) / 12)
    return (z + 1 - abs(serial) * 1.25) / secret_scan.UNIT


def test_added_spans_against_brute_force(spark):
    draw = random.Random(8)
    alphabet = secret_scan._UPPER + secret_scan._LOWER + secret_scan._DIGITS
    secrets = ["".join(draw.choices(alphabet, k=40)) for _ in range(400)]
    secrets = [s for s in secrets if re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)]
    plain = [f"page{draw.randint(1, 99)}Of{'Abcdefgh' * 4}{draw.randint(1, 9)}"[:40].ljust(40, "a") for _ in range(1200)]
    texts = [f"see {s} é" for s in secrets] + [f"see {p} é" for p in plain]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in secrets[:50] + plain[:50]], "m string")
    for got in secret_scan.battery(words).collect():
        assert abs(got.z - battery(got.m, dict((e[0], e[2]) for e in secret_scan.ENCODINGS)[got.encoding])) < 1e-9, got.m
    cut = {}
    for got in secret_scan.scan(docs).collect():
        added = [s for s in got.spans if s.kind == "random"]
        z = battery(texts[got.doc_id][4:44], alphabet)
        cut.setdefault(bool(added), []).append(z)
        if added:
            assert [(s.s, s.e) for s in added] == [(4, 44)]
            assert got.doc_id < len(secrets)  # no structured string is taken
    assert min(cut[True]) >= max(z for z in cut[False] if z < min(cut[True])) and len(cut[True]) > 0.9 * len(secrets)
