"""What surrogates keep and what they hide: names of any length, coreference, case, scripts, clashing columns."""

import re

from pyspark.sql import functions as F

from strandloom.llm import op03_surrogates as o3

from .test_operators import docs_of


def replaced(spark, texts, key="k"):
    return {r.doc_id: r.text for r in o3.with_surrogates(docs_of(spark, texts), key).collect()}


def test_names_of_any_length_and_without_title(spark):
    texts = ["Mr Juan Carlos Garc\u00eda L\u00f3pez met Ivan Smith and Mr Ivan Smith.", "Dr Ivan Smith, then Mrs SMITH.", "Herr Jan van der Berg-O'Neil Jr", "Ivan Smith alone", "Mrs Alex Stone saw Mr Alex Stone"]
    got = replaced(spark, texts)
    for word in ("Juan", "Carlos", "Garc", "pez", "Ivan", "Smith", "SMITH"):
        assert word not in got[0] + got[1], (word, got)
    m = re.fullmatch(r"Mr (\w+ \w+ \w+ \w+) met (\w+) (\w+) and Mr (\w+) (\w+)\.", got[0])
    assert m and m[2] == m[4] and m[3] == m[5]
    d = re.fullmatch(r"Dr (\w+) (\w+), then Mrs (\w+)\.", got[1])
    assert d and (d[1], d[2]) == (m[2], m[3]) and d[3] == m[3].upper()  # the neutral title, too
    assert m[2][-2:] in o3.SCRIPTS["latin"][2]
    assert "Berg" not in got[2] and "Neil" not in got[2] and got[3] == texts[3]
    both = re.fullmatch(r"Mrs (\w+) (\w+) saw Mr (\w+) (\w+)", got[4])
    assert both[1] == both[3] and both[2] == both[4]


def test_case_scripts_and_addresses(spark):
    texts = ["Bob@Example.com bob@example.com amy@example.com amy@other.org", "2001:DB8:0:1:1:1:1:1 and fe80:0::1ff, at 12:30:15 std::vector", "\u738b\u5c0f\u660e\u5148\u751f\uff0c\u674e\u56db\u5973\u58eb", "\u0627\u0644\u0633\u064a\u062f \u0645\u062d\u0645\u062f \u062d\u0633\u0646"]
    got = replaced(spark, texts)
    a, b, c, d = got[0].split()
    assert a.lower() == b and a[0].isupper() and a.split("@")[1][0].isupper() and b.split("@")[1] == c.split("@")[1] != d.split("@")[1]
    assert "bob" not in got[0].lower() and "example" not in got[0].lower()
    assert re.fullmatch(r"[0-9]{4}:[A-F]{2}[0-9]:[0-9]:[0-9](:[0-9]){4} and [a-f]{2}[0-9]{2}:[0-9]::[0-9][a-f]{2}, at 12:30:15 std::vector", got[1]) and got[1] != texts[1]
    han = re.fullmatch("(..)(.)\u5148\u751f\uff0c(.)(.)\u5973\u58eb", got[2])
    assert han and han[1][0] in o3.HAN[0] and {han[1][1], han[2]} <= set(o3.HAN[1]) and han[4] in o3.HAN[2]
    title, given, surname = got[3].split(" ")
    assert title == texts[3].split(" ")[0] and given != texts[3].split(" ")[1] and set(given + surname) <= set("".join(o3.SCRIPTS["arabic"][0:2]) + "".join(map("".join, o3.SCRIPTS["arabic"][2:])))


def test_small_spaces_grow(spark):
    """Mailboxes of one letter, all distinct over two domains: more than there are letters of that length."""
    letters = [chr(c) for c in (*range(97, 123), *range(224, 246))]
    texts = [f"{c}@x.com {c}@y.com" for c in letters]
    got = replaced(spark, texts)
    found = [a for t in got.values() for a in t.split()]
    assert len(set(found)) == len(found) == 2 * len(letters) and all(re.fullmatch(r"\S+@\S+\.com", a) for a in found)
    assert len({a.split("@")[1] for a in found}) == 2


def test_odd_tables(spark):
    texts = ["Mr Ivan Smith", "Dr Ivan Smith", "", None, "x" * 200_000 + " bob@mail.com"]
    df = docs_of(spark, texts, ids=[None, 5, 5, None, 5])
    for c in ("_e", "_k", "_u", "_s", "_r", "_p", "_attempts", "_id", "entities", "e", "u", "known", "pattern", "id", "told"):
        df = df.withColumn(c, F.lit("mine"))
    out = o3.with_surrogates(df, "k")
    assert out.columns == [*df.columns, "n_replaced"] and all(set(r[5:-1]) == {"mine"} for r in out.collect())
    rows = sorted((r.n_replaced, r.text or "") for r in out.collect())
    assert [n for n, _ in rows] == [0, 0, 1, 1, 1] and rows[2][1][3:] == rows[3][1][3:]
    assert not o3.with_surrogates(df.limit(0), "k").collect()
    assert o3.session_key(spark) == o3.session_key(spark) != "change me"


def test_whole_table_stays_distinct(spark):
    """Every entity of the small table has one surrogate, no two share one, and none is an entity itself."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    new = {r.doc_id: r.text for r in o3.with_surrogates(docs, "k").collect()}
    pattern = re.compile(r"[\w.%+-]+@[\w.-]+\.[a-z]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
    pairs = {(a, b) for r in docs.collect() for a, b in zip(pattern.findall(r.text or ""), pattern.findall(new[r.doc_id] or ""), strict=True)}
    old, made = {a for a, _ in pairs}, {b for _, b in pairs}
    assert len(pairs) == len(old) == len(made) > 0 and not old & made


def test_full_spaces_are_permuted(spark):
    """All phone numbers of four free digits, all one-digit addresses, cards of 13 digits that share nine: every one has a surrogate of its own."""
    phones = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(10_000)]
    hosts = [f"{a}::{b}" for a in range(10) for b in range(10)]
    texts = [" , ".join(phones[i : i + 500]) for i in range(0, 10_000, 500)] + [" , ".join(hosts)]
    rows = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = [r.text for r in o3.with_surrogates(rows, "k").collect()]
    made = sorted({x for t in got for x in t.split(" , ")})
    assert made == sorted(phones + hosts)  # a full space: the surrogates are all of it
    twice = sorted(got)
    assert twice[::2] == twice[1::2]
    changed = sum(a != b for t, g in zip(texts, (o for o in got[: len(texts)]), strict=True) for a, b in zip(t.split(" , "), g.split(" , "), strict=True))
    assert changed > 9_000


def test_permutation_keeps_forms_and_check_digits(spark):
    import random

    rng = random.Random(2)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = [("card", "4" + digits(15)) for _ in range(300)] + [("ssn", digits(9)) for _ in range(50)] + [("ipv4", f"{a}.0.255.{b}") for a in (0, 9) for b in range(256)]
    rows += [("phone2", "49" + digits(6)) for _ in range(50)] + [("ipv6", f"{a}:{b}::1f") for a in "09af" for b in "19bc"] + [("iban", "DE" + digits(18)) for _ in range(50)]
    rows = sorted(set(rows))
    out = spark.createDataFrame(rows, "kind string, canon string").withColumn("s", o3._settled(F.col("kind"), F.col("canon"), "k")).collect()
    assert len({(r.kind, r.s) for r in out}) == len(rows) and sum(r.s != r.canon for r in out) > 0.9 * len(rows)
    shape = lambda x: re.sub("[a-z]", "a", re.sub("[0-9]", "0", x))
    luhn = lambda x: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10
    for r in out:
        if r.kind == "ipv4":
            assert all(0 <= int(o) <= 255 for o in r.s.split(".")) and r.s.count(".") == 3
        else:
            assert shape(r.s) == shape(r.canon) and r.s[0] == (r.canon[0] if r.kind in ("card", "phone2", "iban") else r.s[0])
        assert r.kind != "card" or luhn(r.s) == luhn(r.canon)


def test_long_secret_in_time(spark):
    import time

    docs_of(spark, ["token=abcdefgh"]).transform(lambda d: o3.with_surrogates(d, "k")).collect()
    began = time.time()
    texts = ["token=" + "aB3" * 350_000, "mail a@b.com " + "word " * 10]
    got = replaced(spark, texts)
    assert time.time() - began < 60 and len(got[0]) == len(texts[0]) and got[0] != texts[0] and re.fullmatch("token=[a-zA-Z0-9]+", got[0])


def test_short_addresses_and_credentials(spark):
    kept = ["std::vector a[::2] x[1::3] add::face 12:30 b::c at 10:20:30", "ask-me-anything-you-want risk-"]
    texts = ["fe80::1 and ::1 and 2001:db8:: or http://[::1]:80/ .", "sk-abcdefghij0123456789ABCD ghp_0123456789abcdefghijABCDEFGHIJ012345", "Authorization: Bearer abc.def-0123456789_XYZ~", *kept]
    got = replaced(spark, texts)
    m = re.fullmatch(r"([a-f]{2}\d\d::\d) and (::\d) and (\d{4}:[a-f]{2}\d::) or http://\[(::\d)\]:80/ \.", got[0])
    assert m and m[1] != "fe80::1" and m[2] == m[4] != "::1"
    assert re.fullmatch(r"sk-[a-z]{10}\d{10}[A-Z]{4} ghp_\d{10}[a-z]{10}[A-Z]{10}\d{6}", got[1]) and "abcdefghij" not in got[1]
    assert got[2].startswith("Authorization: Bearer ") and "0123456789" not in got[2]
    assert [got[3], got[4]] == kept


def test_many_changed_units_over_rows_without_id(spark, monkeypatch):
    """More units than one map may tell of, in rows that share an id or have none: each row gets its own map."""
    monkeypatch.setattr(o3, "TOLD_UNITS", 3)
    texts = [f"Mr Ivan{chr(97 + i // 26)}{chr(97 + i % 26)} Smith and Mrs Ivan{chr(97 + i // 26)}{chr(97 + i % 26)} Stone" for i in range(60)]
    df = docs_of(spark, texts, ids=[None] * 40 + [1] * 20).drop("doc_id")
    got = [r.text for r in o3.with_surrogates(df, "k").collect()]
    names = [re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+)", t) for t in got]
    assert all(m and m[1] == m[3] for m in names) and len({m[1] for m in names}) == 60 and len({(m[2], m[4]) for m in names}) == 1
