"""The tree of path templates against a version in plain Python that holds all pages at once."""

import math
import random
import re
from collections import defaultdict

from strandloom.llm import op05_urls as o5

SF = "/root/testdata/sf0.01"


def lexical(path):
    out = []
    for s in filter(None, path.split("/")):
        if re.fullmatch(r"[0-9]+", s):
            s = "<n>"
        elif m := re.fullmatch(r"[0-9]+[.]([A-Za-z]{1,5})", s):
            s = "<n>." + m[1]
        elif re.fullmatch(r"[0-9a-fA-F-]{8,}", s):
            s = "<x>"
        elif re.search(r"[0-9]", s):
            s = "<m>"
        elif s[0] in "<*~":
            s = "~" + s
        out.append(s)
    return tuple(out)


def brute(pages, threshold=o5.REJECT_AT):
    """(template, purity, verdict of the method) of each page of (host, path, label or None)."""
    general = {(h, p): list(lexical(p)) for h, p, _ in pages}
    for level in range(max(map(len, general.values()))):
        children = defaultdict(set)
        for (h, _), g in general.items():
            if len(g) > level:
                children[h, tuple(g[:level])].add(g[level])
        for (h, _), g in general.items():
            if len(g) > level and len(children[h, tuple(g[:level])]) > o5.MAX_CHILDREN:
                g[level] = "*"
    count, anywhere, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for h, p, label in pages:
        if label is not None:
            g = general[h, p]
            for node in [(h, tuple(g[:d])) for d in range(len(g) + 1)]:
                for t in (count[node], anywhere[node[1]]):
                    t[0] += 1
                    t[1] += label
            total = [total[0] + 1, total[1] + label]
    below = defaultdict(set)
    for (h, _), g in general.items():
        for d in range(1, len(g) + 1):
            below[h, tuple(g[: d - 1])].add((h, tuple(g[:d])))
    kept = {}
    for parent, nodes in below.items():
        merged = set()
        for x in nodes:
            n, b = count[x]
            on, ob = (sum(count[y][i] for y in nodes if y != x) for i in (0, 1))
            if n and on:
                pooled = (b + ob) / (n + on)
                if abs(b / n - ob / on) <= o5.SIMILAR_Z * math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / on)):
                    merged.add(x)
        for x in nodes:
            kept[x] = [sum(count[y][i] for y in merged) for i in (0, 1)] if x in merged else count[x]
    out = []
    for h, p, _ in pages:
        g, purity, w = general[h, p], (total[1] + 1) / (total[0] + 2), o5.PRIOR_WEIGHT
        for d in range(len(g) + 1):
            n, b = kept.get((h, tuple(g[:d])), count[h, tuple(g[:d])])
            an, ab = anywhere[tuple(g[:d])]
            purity = (b + w * (ab + purity * w) / (an + w)) / (n + w)
        out.append(("/".join(g), purity, "block" if total[0] and purity >= threshold else "allow"))
    return out


def held(rows, pages):
    for r, (template, purity, verdict) in zip(sorted(rows, key=lambda r: r.page_id), brute(pages), strict=True):
        assert r.template == template and math.isclose(r.purity, purity, rel_tol=1e-9)
        if abs(purity - o5.REJECT_AT) > 1e-9 and r.rule is None:
            assert r.verdict == verdict


def test_given_pages(spark):
    rows = o5.judge(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("page_id").collect()
    held(rows, [(r.host, r.path, None if r.rule is None else int(r.verdict == "block")) for r in rows])


def test_random_trees(spark):
    """Fan-out above and below the limit at several levels, paths of up to 40 segments, repeats, unlabelled hosts."""
    pick = random.Random(5)
    words = ["".join(pick.choices("abcdefghij", k=4)) for _ in range(60)]
    pages = []
    for i in range(1500):
        host = pick.choice(["a.net", "b.net", "c.net"])
        path = [pick.choice(("shop", "blog", "spam")), pick.choice(words), pick.choice(words[:3]), *pick.choices(words[:1], k=pick.choice((0, 0, 1, 6, 20, 37)))]
        path = path[: pick.randint(0, 40)] + pick.choice(([], ["7"], ["x7"], ["*"], ["<n>"]))
        spam = path[:1] == ["spam"] or len(path) > 12 and path[2] == words[1]
        pages.append((host, "/" + "/".join(path), None if host == "c.net" or pick.random() < 0.3 else int(spam != (pick.random() < 0.1))))
    df = spark.createDataFrame([(i, f"x://{h}{p}", s) for i, (h, p, s) in enumerate(pages)], "page_id long, url string, spam int")
    rows = o5.judge(df, (), "spam").collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
    held(rows, pages)


def test_what_tells_deep_paths_apart_is_seen(spark):
    """Paths that differ in their twentieth segment only, and one of 3,000 segments."""
    urls = [(i, "x://h/" + "p/" * 19 + ("bad", "good")[i % 2] + f"/{i}", 1 - i % 2) for i in range(40)] + [(40, "x://h/" + "q/" * 3000, None)]
    rows = {r.page_id: r for r in o5.judge(spark.createDataFrame(urls, "page_id long, url string, spam int"), (), "spam").collect()}
    assert all(rows[i].verdict == ("block", "allow")[i % 2] for i in range(40))
    assert rows[40].template.count("/") == 2999 and rows[40].verdict in ("allow", "block")
