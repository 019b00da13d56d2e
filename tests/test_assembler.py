import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import edges as E
from strandloom.operators import kmers as K
from strandloom.operators import paths as P
from strandloom.operators import vertices as V
from strandloom.plans.assemble import assemble, graph, main
from strandloom.sources import reads as R
from strandloom.sources import sinks as S

from .walker import canon, count, rc, unitigs


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "rid long, seq string")


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def shred(text, r=20, step=3):
    return [text[i : i + r] for i in range(0, len(text) - r + 1, step)]


CASES = {
    "one read": ["ACGTTGCA"],
    "both strands": ["ACGTTGCATT", rc("ACGTTGCATT")],
    "bubble": ["AACCTGATTGC", "AACCTCATTGC"],
    "branch": shred(genome(60, 1)) + shred(genome(60, 1)[:30] + genome(40, 2)),
    "homopolymer": ["AAAAAAAAAA", "CAAAAAAG"],
    "circle": shred(genome(40, 3) + genome(40, 3)[:22], 20, 1),
    "many copies": ["ACGTTGCATTCG"] * 300,
    "k only": ["ACGTA"],
    "random": shred(genome(300, 5)) + [rc(x) for x in shred(genome(300, 6))],
}


@pytest.mark.parametrize("name", CASES)
def test_unitigs_as_walked(spark, name):
    got = [r.seq for r in assemble(frame(spark, CASES[name]), 5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == unitigs(CASES[name], 5)


def test_cutoff_and_strings_beyond_packed_keys(spark):
    reads = CASES["random"] * 2 + shred(genome(80, 9))
    assert {r.seq for r in assemble(frame(spark, reads), 7, 2).collect()} == unitigs(reads, 7, 2)
    long_reads = shred(genome(200, 4), 60, 5)
    assert {r.seq for r in assemble(frame(spark, long_reads), 35).collect()} == unitigs(long_reads, 35)


def test_canonical_forms_agree(spark):
    df = frame(spark, CASES["random"])
    a = {r.seq for r in assemble(df, 9, 1, "lex").collect()}
    assert a == {r.seq for r in assemble(df, 9, 1, "murmur3").collect()}
    flipped = frame(spark, [rc(s) for s in reversed(CASES["random"])])
    assert a == {r.seq for r in assemble(flipped, 9).collect()}


def test_counts_and_big_counters(spark):
    for reads in (CASES["branch"], CASES["many copies"]):
        want = count(reads, 5)
        got = {r.kmer: r for r in V.edge_counts(K.kmer_occurrences(frame(spark, reads).select("seq"), 5)).collect()}
        assert got.keys() == want.keys()
        for x, slots in want.items():
            for s, side in enumerate("oi"):
                for b in "ACGT":
                    assert got[x][f"{side}{b}"] == slots.get((s, b), 0)


def murmur3(data, seed):
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_scalars(spark):
    words = [genome(n, n) for n in (1, 5, 15, 21, 31, 33, 63)] + ["ACGT"]
    rows = frame(spark, words).select("seq", dna.reverse_complement(F.col("seq")).alias("rc"), dna.canonical(F.col("seq")).alias("c"), dna.murmur3(F.col("seq")).alias("m")).collect()
    for r in rows:
        assert r.rc == rc(r.seq) and r.c == canon(r.seq)
        bits = "".join(f"{'ACGT'.index(b):02b}" for b in r.seq).ljust(128, "0")
        data = b"".join(int(bits[i : i + 32], 2).to_bytes(4, "little") for i in range(0, 128, 32))
        assert r.m == murmur3(data, dna.MURMUR_SEED)
    packed = frame(spark, words[:5]).select("seq", *[dna.unpack(dna.pack(F.col("seq")), n).alias(f"u{n}") for n in (1, 5, 15, 21, 31)]).collect()
    assert all(r[f"u{len(r.seq)}"] == r.seq for r in packed)
    x = frame(spark, ["ACGTTGCATTCGA"]).select(dna.minimizer(F.col("seq"), 4).alias("a"), dna.minimizer_of(F.col("seq"), dna.reverse_complement(F.col("seq")), 13, 4).alias("b"), dna.partition_id(F.lit("ACGT"), 4, 1000).alias("p")).first()
    assert x.a == x.b and x.p == ((3 * 3 + 2) * 3 + 1) * 3 + 0


def test_read_filter_and_formats(spark, tmp_path):
    lines = ["acgtacgt", "ACGTNNNNN"[:8], "NNNNNNAC", "ACG", "", ">header", "ACGTRCGT"]
    (tmp_path / "lines").write_text("\n".join(lines))
    assert sorted(r.seq for r in R.read_lines(spark, str(tmp_path / "lines"), 8).collect()) == ["ACGTAAAA", "ACGTACGT"]
    assert len(R.read_lines(spark, str(tmp_path / "lines"), 8, "as_a").collect()) == 3
    (tmp_path / "x.fa").write_text(">a one\nACGT\nACGT\n>b\nTTTTTTTT\n")
    assert {(r.name, r.seq) for r in R.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {("a one", "ACGTACGT"), ("b", "TTTTTTTT")}
    (tmp_path / "x.fq").write_text("@a\nACGTACGT\n+\n@IIIIIII\n@b\nTTTTTTTT\n+b\nIIIIIIII\n")
    assert {(r.name, r.seq) for r in R.read_fastq(spark, str(tmp_path / "x.fq")).collect()} == {("a", "ACGTACGT"), ("b", "TTTTTTTT")}


def test_formats_with_carriage_returns_long_records_and_small_splits(spark, tmp_path):
    """Records of several lines, of any line end, across splits of a kilobyte, in files without a last line end."""
    rng = random.Random(12)
    reads = {f"r{i} x": genome(rng.choice([5, 60, 61, 400]), 100 + i) for i in range(120)}
    wrap = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for end in ("\n", "\r\n"):
            for last in ("", end, end * 2):
                fasta = end.join(line for name, s in reads.items() for line in (f">{name}", *wrap(s, 60)))
                (tmp_path / "x.fa").write_bytes((fasta + last).encode())
                got = R.read_fasta(spark, str(tmp_path / "x.fa"))
                assert {(r.name, r.seq) for r in got.collect()} == set(reads.items()) and got.count() == len(reads) and got.rdd.getNumPartitions() > 5
                for width in (60, 10_000):
                    fastq = []
                    for i, (name, s) in enumerate(reads.items()):
                        q = [("@" if (i + j) % 3 else "+") + "".join(rng.choices("IJ#+@5", k=len(line) - 1)) for j, line in enumerate(wrap(s, width))]
                        fastq += [f"@{name}", *wrap(s, width), "+" if i % 2 else f"+{name}", *q]
                    (tmp_path / "x.fq").write_bytes((end.join(fastq) + last).encode())
                    got = R.read_fastq(spark, str(tmp_path / "x.fq"))
                    assert {(r.name, r.seq) for r in got.collect()} == set(reads.items()) and got.count() == len(reads)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sliding_minimum():
    import numpy as np

    rng = random.Random(1)
    for width in (1, 2, 3, 7, 8, 11, 60):
        values = [rng.randrange(100) for _ in range(40)]
        assert K.sliding_minimum(np.array(values), width).tolist() == [min(values[i : i + width]) for i in range(40)]


@pytest.mark.parametrize("k,p", [(9, 4), (5, 5), (21, 11), (40, 31), (3, 1)])
def test_runs_by_the_expressions_of_each_kmer(spark, monkeypatch, k, p):
    """Partitions of all k-mers one by one, in reads of many lengths, some too short, some alone in a batch of the kernel."""
    monkeypatch.setattr(K, "KERNEL_BASES", 100)
    rng = random.Random(k)
    reads = [genome(rng.choice([0, 1, k - 1, k, k + 1, 50, 300]), i) for i in range(40)] + ["A" * 70, "ACGT" * 20]
    df = frame(spark, reads)
    got = sorted((r.rid, r.start, r.n_kmers, r.pid) for r in K.superkmers(df, k, p, 17).collect())
    each = K.kmer_occurrences(df, k).select("rid", "i", dna.partition_id(dna.minimizer(F.col("kmer"), p), p, 17).alias("pid")).collect()
    want, before = [], None
    for rid, i, pid in sorted(map(tuple, each)):
        if before and before == (rid, i - 1, pid):
            want[-1][2] += 1
        else:
            want.append([rid, i, 1, pid])
        before = (rid, i, pid)
    assert got == [tuple(w) for w in want]


def test_superkmers_cover_every_kmer_once(spark):
    reads = frame(spark, CASES["random"])
    runs = K.superkmers(reads, 9, 4, 7)
    by_read = {}
    for r in runs.collect():
        by_read.setdefault(r.rid, []).append((r.start, r.n_kmers, r.pid))
    for rid, pieces in by_read.items():
        pieces.sort()
        assert [p[0] for p in pieces] == [1 + sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n, _ in pieces) == len(CASES["random"][rid]) - 8
        assert all(a[2] != b[2] for a, b in zip(pieces, pieces[1:], strict=False))
    for r in K.superkmer_sequences(runs, 9).collect():
        inner = rc(r.piece) if r.reversed else r.piece
        left = int(r.has_right if r.reversed else r.has_left)
        at = CASES["random"][r.rid][r.start - 1 :]
        assert inner[left:].startswith(at[: r.n_kmers + 8])


def test_even_k_prunes_and_ids_are_dense(spark):
    with pytest.warns(UserWarning):
        g = graph(frame(spark, ["ACGTACGTTA", "TTACGTAA"]), 4)
    assert g.count()
    g = graph(frame(spark, CASES["random"]), 9).persist()
    assert E.reciprocal_edges(g).count() == E.edges(g).count()
    ids = V.vertex_ids(g, 9, 5, 4).collect()
    assert sorted(r.gid for r in ids) == list(range(len(ids)))
    nb = E.neighbour_ids(E.edges(g), V.vertex_ids(g, 9, 5, 4))
    assert nb.count() == E.edges(g).count() and E.neighbour_array(nb).count() == len(ids)
    stats = V.statistics(g).first()
    assert stats.vertices == len(ids) == stats.junctions + stats.linear


def test_cycles_and_half_paths(spark):
    g = graph(frame(spark, CASES["circle"]), 5).persist()
    cycles = {r.kmer for r in P.cycle_vertices(g, 5).collect()}
    inside = Counter()
    for u in unitigs(CASES["circle"], 5):
        inside.update(canon(u[i : i + 5]) for i in range(1, len(u) - 5))
    assert not cycles & inside.keys()
    halves = P.half_paths(g, 5).count()
    units = [r.seq for r in P.unitigs(g, 5).collect()]
    assert halves >= len(units)


def test_sinks_and_command_line(spark, tmp_path):
    reads = CASES["random"]
    (tmp_path / "reads").write_text("\n".join(reads))
    assert main([str(tmp_path / "reads"), str(tmp_path / "out"), "-k", "9", "-r", "20", "--graph", "--cycles", "--cores", "2", "-n", "16"]) == 0
    text = spark.read.text(str(tmp_path / "out/unitigs")).collect()
    heads = [r.value for r in text if r.value.startswith(">")]
    assert {r.value for r in text if not r.value.startswith(">")} == unitigs(reads, 9)  # noqa: SIM300
    assert len({h.split()[0] for h in heads}) == len(heads) and all(h.endswith("cvg_1_tip_0") for h in heads)
    v, e = S.read_graph(spark, str(tmp_path / "out/graph"))
    whole = graph(frame(spark, reads), 9)
    rows = lambda df, like: sorted(map(tuple, df.select(*like.columns).collect()))
    assert rows(v, whole) == rows(whole, whole) and rows(e, E.edges(whole)) == rows(E.edges(whole), E.edges(whole))
    some = [S.read_graph(spark, str(tmp_path / "out/graph"), i)[0] for i in (r.pid for r in v.select("pid").distinct().limit(3).collect())]
    assert all(0 < s.count() < v.count() and s.select("pid").distinct().count() == 1 for s in some)
    pieces = K.superkmer_sequences(K.superkmers(frame(spark, reads), 9, 4, 3), 9)
    S.write_superkmers(pieces, str(tmp_path / "sk"))
    again = K.unpacked_pieces(S.read_superkmers(spark, str(tmp_path / "sk")))
    assert rows(again, again) == rows(pieces, again)
    counted = V.count_pieces(S.read_superkmers(spark, str(tmp_path / "sk")), 9).drop("pid")
    assert rows(counted, counted) == rows(V.edge_counts(K.kmer_occurrences(frame(spark, reads).select("seq"), 9)), counted)
    assert {r.pid for r in S.read_superkmers(spark, str(tmp_path / "sk"), 1).collect()} == {1}
    few = ["-k", "9", "-r", "20", "-n", "3", "-p", "4", "--cores", "2"]
    assert main([str(tmp_path / "reads"), str(tmp_path / "out2"), *few]) == 0
    assert {r.value for r in spark.read.text(str(tmp_path / "out2/unitigs")).collect() if r.value[0] != ">"} == unitigs(reads, 9)  # noqa: SIM300


@pytest.mark.parametrize("mode", ["lex", "murmur3"])
def test_ways_of_counting_agree(spark, mode):
    """Occurrences, numbers and super-k-mers, for odd and even k, k above what a number holds, reads shorter than k."""
    reads = frame(spark, [*CASES["random"], "ACGT", "A" * 70, "ACGTTGCAACGT" * 6])
    for k in (2, 5, 8, 31, 33):
        want = V.edge_counts(K.kmer_occurrences(reads.select("seq"), k), mode)
        rows = lambda df, want=want: sorted(map(tuple, df.select(*want.columns).collect()))
        assert rows(V.count_reads(reads, k, mode)) == rows(want)
        if mode == "lex":
            assert rows(V.count_superkmers(reads, k, min(3, k), 7)) == rows(want)


def test_chains():
    import numpy as np

    nodes, after = np.array([5, 3, 9, 7, 1, 2, 8]), np.array([3, 9, 100, 1, 7, 2, 5])
    last, steps, ends = P.chains(nodes, after)
    assert [(int(nodes[j]), int(n)) for j, n, e in zip(last, steps, ends, strict=True) if e] == [(9, 2), (9, 1), (9, 0), (9, 3)]
    assert ends.tolist() == [True, True, True, False, False, False, True]
    assert len(P.chains(nodes[:0], after[:0])[0]) == 0


@pytest.mark.parametrize("name", ["superkmer_files", "pruned_even", "murmur_values", "graph_files_edges", "sorted_order", "line_reads", "fastq_reads", "list_rank"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from strandloom.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(str, want)) and want


def test_filter_vertices_returns_every_vertex(spark):
    from strandloom.plans.queries import KMER, QUERIES, reads

    sf_dir = "/root/testdata/sf0.001"
    want = {x: sum(e.values()) for x, e in count(reads(spark, sf_dir).select("seq").toArrow()["seq"].to_pylist(), KMER).items()}
    got = QUERIES["filter_vertices"](spark, sf_dir)
    assert got.columns == ["kmer", *V.SLOTS, "cov"]
    rows = got.select("kmer", "cov").toArrow()
    assert dict(zip(*(c.to_pylist() for c in rows.columns), strict=True)) == {x: n for x, n in want.items() if n >= 3} and rows.num_rows == 137_019


def test_even_k_has_edges_to_remove(spark):
    g = V.classify(V.count_reads(frame(spark, ["ACGTACGGTTCAACCGTACGTTTACGT", "TTGCAACGTTGCATTGCAA"]), 4))
    assert E.reciprocal_edges(g).count() < E.edges(g).count()


def test_bad_k(spark):
    with pytest.raises(ValueError):
        K.kmer_occurrences(frame(spark, ["ACGT"]), 1)
    with pytest.raises(ValueError):
        dna.is_canonical(F.col("x"), "other")


def test_counts_of_a_stream(spark, tmp_path):
    from strandloom.streaming.counts import stream_edge_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("\n".join(CASES["branch"][:5]))
    (tmp_path / "in/b").write_text("\n".join(CASES["branch"][5:]))
    stream = stream_edge_counts(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), 5)
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.kmer: r.cov for r in spark.table("counts").collect()}
    assert got == {x: sum(e.values()) for x, e in count(CASES["branch"], 5).items()}
