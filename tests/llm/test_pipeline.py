import corpus_pipeline as p

TINY = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    kept = spark.read.parquet(f"{TINY}/documents.parquet")
    counts = []
    for name, stage in p.STAGES:
        out = stage(spark, kept, TINY)
        if name != p.STAGES[-1][0]:
            assert out.columns == kept.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        counts.append(kept.count())
    assert counts[0] >= counts[1] == counts[2] > 0 and counts[3] == counts[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    first = {r.doc_id for r in spark.read.parquet(str(tmp_path / p.STAGES[0][0])).collect()}
    assert all(i in first for i, q in labels.items() if q == 1)
    stage2 = [r.text for r in spark.read.parquet(str(tmp_path / p.STAGES[1][0])).collect()]
    assert len(stage2) == len(set(stage2))
    stage3 = spark.read.parquet(str(tmp_path / p.STAGES[2][0]))
    assert stage3.where("n_chars <> length(text)").count() == 0
    size = stage3.selectExpr("sum(n_chars)").first()[0]
    mixed = spark.read.parquet(str(tmp_path / p.STAGES[3][0])).selectExpr("sum(n_chars)").first()[0]
    assert 1.2 * size < mixed < 1.8 * size


def test_run_agrees_with_stages(spark):
    a = p.run(spark, TINY).selectExpr("count(*)", "sum(n_tokens)", "sum(crc32(ids_sha256))").first()
    assert a == p.run(spark, TINY).selectExpr("count(*)", "sum(n_tokens)", "sum(crc32(ids_sha256))").first() and a[0] > 0


def odd_rows(spark, tmp_path):
    """Ids that repeat or are missing, in a file as between stages: (doc_id, text)."""
    prose = lambda s, n=30: " ".join(f"w{s}x{i}" for i in range(n))
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(3)), (7, prose(4)), (8, prose(4)), (None, prose(5)), (9, prose(5))]
    rows += [(11, prose(100 + i)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "odd"))
    return rows, spark.read.parquet(str(tmp_path / "odd"))


def test_near_dedup_keeps_one_row_of_each_group(spark, tmp_path):
    rows, docs = odd_rows(spark, tmp_path)
    got = p.simhash_near_dedup(spark, docs, TINY).collect()
    want = {}
    for i, t in rows:
        want[t] = min(want.get(t, (True, 0)), (i is None, i or 0))
    assert sorted((r.text, (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(want.items())


def test_mix_takes_rows_not_ids(spark, tmp_path):
    rows, docs = odd_rows(spark, tmp_path)
    got = p.weighted_mix(spark, docs, TINY).collect()
    most = {}
    for r in rows:
        most[r] = most.get(r, 0) + 2
    seen = {}
    for r in got:
        seen[r.doc_id, r.text] = seen.get((r.doc_id, r.text), 0) + 1
    assert all(n <= most[r] for r, n in seen.items()) and set(seen) == set(most)
    assert len(got) == int(1.5 * len(rows))
