"""Filter audit, fill-in-the-middle and main texts against brute force; odd tables."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandloom.llm import op11_filter_audit as o11
from strandloom.llm import op12_fill_in_middle as o12
from strandloom.llm import op13_html as o13

from .test_operators import DOCS, WORD, docs_of, prose

TINY = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"


def audited(rows, labels):
    """Each order applied row by row. rows: (doc_id, part, text)."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    failed = []
    for i, part, t in rows:
        words = WORD.findall(t)
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        failed.append((i, part, bad))
    found = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, bad) for i, p, bad in failed if p == part]
        for order in permutations("ABCDE"):
            kept = own
            for step, f in enumerate(order):
                gone = [(i, bad) for i, bad in kept if bad[f]]
                late = [1 for i, bad in own if bad[f] and any(bad[x] for x in order[:step])]
                kept = [(i, bad) for i, bad in kept if not bad[f]]
                of = lambda k, gone=gone: sum(labels.get(i, (0, 0))[k] == 1 for i, _ in gone)
                found[part, "".join(order), step + 1] = [len(kept), len(gone), len(late), sum(bad[f] and sum(bad.values()) == 1 for _, bad in own), of(0), of(1)]
    total = {}
    for (part, order, step), row in found.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, total[k[0], k[1][k[2] - 1]]) for k, row in found.items()}


def test_audit_applies_every_order(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([5, 49, 50, 51, 80])) for _ in range(60)]
    texts += [prose(rng, 20) + "\x1c " + prose(rng, 40).upper(), "a " * 60, "x" * 300_000, "# é & |", "Ab\u00a0c", "\t\n "] + texts[:20] + [texts[0]] * 30
    rows = [(rng.choice([i, i % 7, None]), t, "en", rng.choice(["a", "b", "", None]), 1) for i, t in enumerate(texts)]
    rows += [(3, None, None, None, None), (2, "", "en", "a", 0), (None, None, None, "b", 0), rows[5], rows[5]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    best = {}
    for i, *two in labels:
        if i is not None:
            best[i] = tuple(max(x or 0, y) for x, y in zip(two, best.get(i, (0, 0)), strict=True))
    df = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("clash")).withColumn("first", F.lit(1)).withColumn("mask", F.lit(2))
    got = o11.interactions(o11.cells(df, spark.createDataFrame(labels, LABELS))).collect()
    want = audited([(i, s or "", t or "") for i, t, _, s, _ in rows], best)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want) == 3 * 600


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert not o11.interactions(o11.cells(none, labels)).collect()
    one = o11.interactions(o11.cells(docs_of(spark, ["short"]), labels)).collect()
    assert len(one) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in one)


def middled(i, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = random.Random(11)
    pool = "abzAZ<>PSM /-_0é漢😀\u0301\n\t\x00\x1c\u00a0"
    made = ["".join(rng.choices(pool, k=rng.randrange(0, 40))) for _ in range(400)]
    return [*made, "", None, "<", "<P", "<P>", "a<S>b", "P>", "<P", ">", "<S", "<", "S>", "", "", "ab" * 200_000 + "<é>", "<<S<M", "x<Q>y"]


def test_middles_by_brute_force(spark, monkeypatch):
    texts = odd_texts()
    ids = [None if i % 50 == 7 else i * 7919 - 500 for i in range(len(texts))]
    df = docs_of(spark, texts, ids=ids).withColumn("n", F.lit("clash")).withColumn("form", F.lit("clash")).withColumn("output", F.lit(1))
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = sorted(((i, *middled(i, t or "")) for i, t in zip(ids, texts, strict=True)), key=key)
    for limit in (o12.BATCH_BYTES, 64):
        monkeypatch.setattr(o12, "BATCH_BYTES", limit)
        made = o12.fill_in_middle(df)
        assert sorted(map(tuple, made.collect()), key=key) == want
    back = made.select("doc_id", o12.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in zip(ids, texts, strict=True))
    assert {r[2] for r in want} == {"plain", "psm", "spm"} and not o12.fill_in_middle(df.limit(0)).collect()


@pytest.mark.parametrize("cut", [0, 3])
def test_kernel_on_slices_of_arrays(cut):
    import pyarrow as pa

    texts = odd_texts()[:60]
    for kind in (pa.string(), pa.large_string()):
        got = o12.transformed(pa.array(texts, kind)[cut:], list(range(cut, 60))).to_pylist()
        assert [tuple(r.values()) for r in got] == [middled(i, texts[i] or "") for i in range(cut, 60)]


ARTICLE = "<h1>Head &amp; tail</h1><p>One  two\n<b>th</b>ree.</p><p>Four&nbsp;&lt;b&gt; <a href='x'>five</a>.<p>Six<br>seven"
TEXT = "Head & tail\n\nOne two three.\n\nFour <b> five.\n\nSix seven"
AROUND = [
    "<html><head><title>No &lt;p&gt;</title><style>p{{}}</style><script>var x = '<p>no</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><article>{}</article><footer>&copy; no</footer></body></html>",
    "<!DOCTYPE html><!-- <p>no</p> --><body><header><h2>Site</h2></header><div class='cookie-notice'>We use cookies</div><main><article class='post'>{}</article><section id=comments><h2>Comments</h2><article class=comment><p>First!</p></article></section></main><aside>Side</aside>",
    "<body><div class='page has-sidebar'><div id='sidebar'>Side <p>bar</p></div><div role=main>{}</div></div><div id=ad-top>Buy</div></body>",
    "<body><form id=aspnet><div class=header><a href=/>Logo</a></div><div id=nav><a href=a>A</a><a href=b>B</a></div><div class=story>{}</div><form><label>no</label></form><div class='Comments'>Reader: no</div></body>",
    "<article><header class=entry-header>{}</p></header><div class='adSlot banner'>no</div><div class=related><p>More</p></div><aside>no</aside><form><input><button>Go</button></form><footer>By me</footer></article>",
    "<main>{}<noscript>no</noscript><svg><text>no</text></svg><div hidden>no</div><p style='display: none'>no</p><div aria-hidden=true>no</div><textarea><p>no</textarea></main>",
    "<p><ARTICLE itemprop='articleBody' title='a > b' data-x=\"<p>\">{}</ARTICLE><section class='reader-comments'><p>no</p></section>",
]


@pytest.mark.parametrize("around", AROUND)
def test_articles_of_many_shapes(around):
    assert "\n\n".join(o13.Page(around.format(ARTICLE)).blocks()) == TEXT


def test_odd_markup():
    text = lambda html: "\n\n".join(o13.Page(html).blocks())
    assert text("") == text("<")[1:] == text("<article></article>") == text("<!-- <p>x") == text("<script>x") == ""
    assert text("a < b <c d") == "a < b"
    assert text("<p>a<div>b</p>c</div>d") == "a\n\nb\n\nc\n\nd"
    assert text("<b>x<div>y</b>z</div>w") == "x\n\nyz\n\nw"
    assert text("<p>caf&eacute; &#x1F600;&#65; &ampx &unknown; &am") == "café 😀A &x &unknown; &am"
    assert text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert text("<table><tr><td>a<td>b<tr><th>c</table>") == "a b\n\nc"
    assert text("<p>x" + "<a \"b" * 50_000) == "x" and text("<p>y" + "<div>" * 50_000 + "z") == "y\n\nz"
    assert text("<article>" + "<p>long " * 30_000) == "\n\n".join(["long"] * 30_000)


def test_pages_against_plain_patterns(spark):
    """The given pages hold one article each, of h1 and p; repeats, nulls, clashing columns; more pages than one template."""
    from html import unescape

    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    rows = pages.collect()
    odd = spark.createDataFrame([(10**6, None, "<p>x"), (None, "no host", None), (10**6 + 1, "a://", "")], PAGES)
    got = o13.main_texts(pages.union(pages).union(odd).withColumn("site", F.lit(1)).withColumn("subtrees", F.lit(1)).withColumn("text", F.lit(1))).collect()
    assert len(got) == 2 * len(rows) + 3
    want = {10**6: "x", None: "", 10**6 + 1: ""}
    for r in rows:
        parts = re.split(r"</?(?:h1|p|br|b)>", re.search("<article>(.*)</article>", r.html, re.S)[1])
        want[r.page_id] = "\n\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)
    assert all((r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])) for r in got)
    assert not o13.main_texts(pages.limit(0)).collect()


def site_pages():
    """Pages of divs only: a head and a foot that the site repeats, articles that differ but for copies and a common line."""
    rng, rows = random.Random(5), []
    for site in range(3):
        copied = prose(rng, 30)
        for i in range(20):
            body = copied if i % 3 == 0 else prose(rng, 30)
            html = f"<div><div>Site {site}<p>slogan</p></div><div><p>{body}</p><p>{'A common line.' if i % 3 else prose(rng, 5)}</p><div>Read on</div></div><div>Foot {i} <i>of {site}</i></div></div>"
            rows.append((100 * site + i, f"http://S{site}.org/{i}", html, body, i % 3))
    return rows


def test_template_of_a_site_by_counting(spark, monkeypatch):
    """What stands on over half of the host's different pages goes, by plain counts of the pieces; copies of pages don't count."""
    rows = site_pages()
    copies = [(1000 + i, "http://s0.org/copy", rows[0][2]) for i in range(200)]
    df = spark.createDataFrame([r[:3] for r in rows] + copies, PAGES)
    for bound in (o13.BROADCAST_ROWS, 0):
        monkeypatch.setattr(o13, "BROADCAST_ROWS", bound)
        got = {r.page_id: r.text for r in o13.main_texts(df).collect()}
        for i, _, html, body, kind in rows:
            blocks = [" ".join(re.sub("<[^>]*>", "", t).split()) for t in re.split("</?(?:div|p)>", html)]
            again = lambda t, i=i: sum(f">{t}<" in h and i // 100 == j // 100 for j, _, h, _, _ in rows)
            want = [t for t in blocks if t and not 2 * again(t) > 20]
            assert got[i].split("\n\n") == [t for t in want if t != f"Site {i // 100}"] and body in got[i]
            assert ("A common line." in got[i]) == (kind != 0 and 2 * again("A common line.") <= 20)
        assert all(got[1000 + i] == got[0] for i in range(200))


def test_copies_within_articles_stay(spark):
    """Of 30 articles of one host 14 are near copies; a box in all of them, not in so many copies of one text, goes."""
    rng = random.Random(6)
    one = [prose(rng, 20) for _ in range(4)]
    texts = [[*one[:3], prose(rng, 9)] if i < 14 else [prose(rng, 20) for _ in range(4)] for i in range(30)]
    pages = [(i, "http://x.com/", f"<nav>{i}</nav><article><div>Get our app</div>{''.join(f'<p>{p}</p>' for p in t)}</article>") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in o13.main_texts(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {i: "\n\n".join(t) for i, t in enumerate(texts)}


def test_parity_bits_never_rule_out_a_similar_pair():
    import numpy as np

    from strandloom.llm import op08_simhash as o8

    rng = np.random.RandomState(3)
    ruled = 0
    for _ in range(300):
        n = int(rng.choice([0, 1, 5, 40, 700, 5000]))
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) > rng.choice([0, 0.05, 0.3])], rng.randint(0, 2**62, rng.randint(0, n // 3 + 2)).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        found = o8.differ(o8.odd_bits(a), o8.odd_bits(b))
        assert found <= differ and found == o8.differ(o8.odd_bits(b), o8.odd_bits(a))
        both = len(np.intersect1d(a, b))
        ruled += found > (len(a) + len(b)) * 0.2 / 1.8 + 1e-6
        assert both < 0.8 * (len(a) + len(b) - both) or found <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6
    assert ruled > 50


def test_shingle_frequent_over_batches_only(spark, monkeypatch):
    """A passage stands once in each of many batches, so no batch tells that it is frequent; links are those of brute force all the same."""
    from strandloom.llm import op08_simhash as o8

    monkeypatch.setattr(o8, "CROWDED", 20)
    rng = random.Random(9)
    passage = prose(rng, 12, 9000)
    texts = [f"{passage} {prose(rng, 40, 9000)}" for _ in range(60)]
    texts += [t + " and more" for t in texts[::7]]
    df = docs_of(spark, texts)
    told = []
    real = o8.frequent_shingles
    monkeypatch.setattr(o8, "frequent_shingles", lambda counts: told.append(real(counts)) or told[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: r.component_id for r in o8.similar_documents(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want[i] = want[j]
                break
    assert got == want and len(told) == 2 and len(told[0][0]) == 0 < len(told[1][0])
