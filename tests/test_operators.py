"""Edge fixtures and properties of the operators that the SQL oracles do not reach."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake import fixtures
from strandlake.__main__ import main
from strandlake.functions.scalars import bit_length, kept_length, last_kept, run_estimate
from strandlake.operators import deltas, overlap, profile, quality_coding, runs, sizes, title_coding, titles, transforms
from strandlake.operators.huffman import codes, decode, huffman
from strandlake.plans import registry
from strandlake.sources import archive, coded, fastq
from strandlake.streaming import superblocks

READS = "rec_no long, title string, seq string, plus string, quality string"


def reads(spark, rows):
    return spark.createDataFrame([(i, f"@r.{i}", s, "+", q) for i, (s, q) in enumerate(rows)], READS)


def test_scalars(spark):
    rows = [(v,) for v in (0, 1, 2, 3, 255, 256, 2**31, 2**40)]
    got = [r[0] for r in spark.createDataFrame(rows, "v long").select(bit_length(F.col("v"))).collect()]
    assert got == [0, 1, 2, 2, 8, 9, 32, 41]
    q = spark.createDataFrame([("IIF##",), ("##",), ("#",), ("IIII",)], "q string").select(kept_length(F.col("q")), last_kept(F.col("q")), run_estimate(F.col("q")))
    assert [tuple(r) for r in q.collect()] == [(3, 2, 2), (1, 0, 0), (1, 0, 0), (4, 3, 1)]


def test_empty_tables(spark):
    none = reads(spark, [])
    for df in (
        profile.base_composition(none), profile.read_lengths(none), profile.quality_method(none), profile.superblock_header(none), runs.quality_runs(none),
        titles.field_schema(none.select("rec_no", "title")), titles.block_constants(none.select("rec_no", "title")), overlap.best_overlaps(none), sizes.size_report(none), archive.block_index(none),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("seq", ["", "N", "NNN", "NACGT", "ACGTN", "AnNa", "ACGT", "ANNCNGT"])
def test_n_transfer(spark, seq):
    df = reads(spark, [(seq, "I" * len(seq))])
    out = transforms.n_transfer(df)
    assert out.first().seq == seq.replace("N", "")
    assert transforms.n_restore(out).select(*df.columns).collect() == df.collect()


def test_long_runs_split_at_the_cap_and_cross_records(spark):
    df = reads(spark, [("A" * 300, "I" * 300), ("A" * 400, "I" * 400), ("AC", "#F")] + [("A", "F")] * 32)
    got = [(r.block_id, r.symbol, r.run_len) for r in runs.quality_runs(df).orderBy("block_id", "run_no").collect()]
    assert got == [(0, "I", 255), (0, "I", 255), (0, "I", 190), (0, "#", 1), (0, "F", 30), (1, "F", 3)]
    back = runs.quality_restore(runs.quality_runs(df), df.select("rec_no", F.length("quality").alias("len")))
    assert sorted(back.collect()) == sorted(df.select("rec_no", "quality").collect())


@pytest.mark.parametrize("n", [1, 31, 32, 33, 512, 513])
def test_block_borders(spark, n):
    df = reads(spark, [("ACGT", "IIF#")] * n)
    assert profile.read_lengths(df, 512).agg(F.sum("records"), F.sum("blocks")).first()[:] == (n, -(-n // 32))
    assert runs.quality_runs(df).agg(F.sum("run_len")).first()[0] == 4 * n


def test_colors_round_trip(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGT") for _ in range(n)), "I" * n) for n in (0, 1, 2, 3, 50, 301)]
    df = reads(spark, rows)
    assert sorted(transforms.color_decode(transforms.color_encode(df)).collect()) == sorted(df.collect())
    assert [r.seq for r in transforms.color_encode(reads(spark, [("ACGT", "IIII")])).collect()] == ["T3131"]


def test_packing(spark):
    df = reads(spark, [(s, "I" * len(s)) for s in ("", "A", "ACGT", "TTTTT", "GATTACA" * 30)])
    packed = transforms.pack_bases(df)
    assert [len(r.packed) for r in packed.orderBy("rec_no").collect()] == [0, 1, 1, 2, 53]
    assert bytes(packed.where("rec_no = 2").first().packed) == bytes([0b00011011])
    assert sorted(transforms.unpack_bases(packed.drop("seq")).select(*df.columns).collect()) == sorted(df.collect())


def brute_overlap(rows, k=36, step=12):
    out = {}
    for i, a in enumerate(rows):
        best = None
        for p in range(min(step, len(a) - k + 1)):
            for j in range(i):
                for off in range(0, len(rows[j]) - k, step):
                    if off >= p and rows[j][off : off + k] == a[p : p + k]:
                        b, n = rows[j][off - p :], 0
                        while n < min(len(a), len(b), 291) and a[n] == b[n]:
                            n += 1
                        if n >= k and (best is None or n > best[0]):
                            best = (n, j, off - p)
        if best:
            out[i] = best
    return out


def test_overlaps(spark):
    rng = random.Random(2)
    source = "".join(rng.choice("ACGT") for _ in range(700))
    rows = [source[:400], source[30:80], source[30:66], source[17:63], source[17:64], source[5:40], source[5:396], source[100:391] + "A", source[200:292] + "CCCC", source[350:400]]
    got = {r.rec_no: (r.match_len, r.ref_rec_no, r.ref_off) for r in overlap.best_overlaps(reads(spark, [(s, "I" * len(s)) for s in rows])).collect()}
    assert got == brute_overlap(rows)
    poor = reads(spark, [(s, "!" * len(s)) for s in rows])
    assert overlap.best_overlaps(poor).collect() == []
    with_n = [source[:100], source[:60] + "N" + source[61:100]]
    assert [r.match_len for r in overlap.best_overlaps(reads(spark, [(s, "I" * 100) for s in with_n])).collect()] == [60]


def test_anchor_cap(spark):
    df = reads(spark, [("A" * 60, "I" * 60)] * 9)
    assert overlap.anchors(df).count() == 12


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40))
def test_huffman_properties(counts):
    made = codes(counts)
    used = [c for c in made if c]
    if len(used) > 1:
        assert sum(2.0 ** -len(c) for c in used) == 1.0
    assert not any(a != b and b.startswith(a) for a in used for b in used)
    positive = [c for c in counts if c]
    if len(positive) > 1:
        bits = sum(n * len(c) for n, c in zip(counts, made))
        assert bits <= sum(counts) * max(1, (len(positive) - 1).bit_length())


def test_huffman_ties_and_lone_symbols(spark):
    assert codes([5]) == [""] and codes([1, 1]) == ["0", "1"] and codes([0, 0, 0, 7]) == ["", "", "0", "1"]
    assert codes([1, 1, 1, 1]) == ["00", "01", "10", "11"]
    assert sorted(map(len, codes([1, 1, 2, 3, 5]))) == [1, 2, 3, 4, 4]
    df = spark.createDataFrame([("m", 0, "c", s, n) for s, n in (("b", 1), ("a", 1), ("c", 2))], "model string, sb_id long, context string, symbol string, n long")
    assert {r.symbol: r.code for r in huffman(df).collect()} == {"c": "0", "a": "10", "b": "11"}


def test_titles_that_do_not_conform(spark):
    rows = [(0, "@A.1 x:5/1"), (1, "@A.2 y:5/2"), (2, "@A.3 only"), (3, "@A.4 a.b:c:6/1")]
    df = spark.createDataFrame(rows, "rec_no long, title string")
    got = {}
    for r in titles.split_expected(df).orderBy("rec_no", "field_no").collect():
        got.setdefault(r.rec_no, []).append(r.txt)
    assert got == {0: ["@A", "1", "x", "5", "1"], 1: ["@A", "2", "y", "5", "2"], 3: ["@A", "4", "a.b", "c:6", "1"]}
    assert titles.conformity(df).first()[:] == (0, 4, 3, False)
    assert sorted(r.title for r in titles.rejoin(df).collect()) == sorted(t for i, t in rows if i != 2)


def test_every_title_is_restored(spark, tmp_path):
    docs = [(0, "some text", "zh-cn", 9), (1, "more text", "en", 9), (2, "other text", None, 10), (3, "a text", "pt-br", 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(r.rec_no, r.title) for r in fixtures.reads(spark, str(tmp_path)).collect()]
    got = [(r.rec_no, r.title) for r in registry.QUERIES["title_rejoin"](spark, str(tmp_path)).collect()]
    assert len(got) == 4 and sorted(got, key=str) == sorted(want, key=str)


def test_value_ranges_and_ties(spark):
    def coding(values):
        df = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(values)], "sb_id long, field_no int, rec_no long, value long")
        return titles.value_or_delta(df).first()[2:]

    assert coding([0, 1, 3]) == ("delta", 1, True)
    assert coding([5, 9, 5, 9]) == ("value", 3, True)
    assert coding([7]) == ("delta", 0, True)
    assert coding([(i * 7919) % 513 for i in range(513)])[2] is False


def test_delta_round_trip(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, -3, 2**40, 0, 7])], "rec_no long, value long")
    assert sorted(deltas.restore(deltas.deltas(df, 2)).collect()) == sorted(df.collect())


GOOD = "@a b\nACGT\n+\nIIII\n"


@pytest.mark.parametrize(
    ("text", "n", "clean"),
    [
        ("", 0, True), (GOOD, 1, True), (GOOD * 2, 2, True), (GOOD[:-1], 1, True), (GOOD.replace("\n", "\r\n"), 1, True), ("\n\n" + GOOD + "\n\n", 1, True),
        ("@a\nAC\nGT\n+\nII\nII\n" + GOOD, 2, True), ("@a\nACGT\n+a\n@+I@\n" + GOOD, 2, True), (GOOD + "a\nACGT\n+\nIIII\n", 1, False), (GOOD + "@a\nACGT\n+\nIII", 1, False),
        ("@a\nACGT\n+\nIIIII\n" + GOOD, 1, False), ("@a\n+\n\n", 0, False), ("@a\nACGT\n", 0, False),
    ],
)
def test_fastq_text(text, n, clean):
    records, ended = fastq.parse(text)
    assert (len(records), ended) == (n, clean)
    assert all(len(s) == len(q) and t.startswith("@") for t, s, _, q in records)


def test_fastq_files(spark, tmp_path):
    df = reads(spark, [("ACGT" * (i % 9 + 1), "IF#!" * (i % 9 + 1)) for i in range(200)])
    fastq.write(df, str(tmp_path / "out"))
    back = fastq.read_lines(spark, str(tmp_path / "out"))
    assert sorted(back.select("title", "seq", "plus", "quality").collect()) == sorted(df.select("title", "seq", "plus", "quality").collect())
    whole = fastq.read_whole(spark, str(tmp_path / "out"))
    assert sorted(whole.select("title", "seq", "plus", "quality").collect()) == sorted(df.select("title", "seq", "plus", "quality").collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        (tmp_path / "one.fq").write_text("".join(f"@{i}\nACGT\n+\nIIII\n" for i in range(500)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
        rows = fastq.read_lines(spark, str(tmp_path / "one.fq")).orderBy("rec_no").collect()
        assert [r.title for r in rows] == [f"@{i}" for i in range(500)] and [r.rec_no for r in rows] == list(range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "bad.fq").write_text(GOOD + "oops")
    assert fastq.read_whole(spark, str(tmp_path / "bad.fq")).count() == 1
    with pytest.raises(Exception, match="malformed"):
        fastq.read_whole(spark, str(tmp_path / "bad.fq"), "FAILFAST").count()


def test_archive(spark, tmp_path):
    df = reads(spark, [("ACGT", "IIII")] * 100)
    path = str(tmp_path / "a")
    archive.write(df, path)
    assert sorted(archive.read(spark, path).collect()) == sorted(df.collect())
    for n in (0, 31, 32, 99):
        assert [r.rec_no for r in archive.lookup(spark, path, n).collect()] == [n]
    assert archive.lookup(spark, path, 100).collect() == []
    assert "PushedFilters: [IsNotNull(rec_no), EqualTo(rec_no,7)]" in archive.lookup(spark, path, 7)._jdf.queryExecution().toString()
    archive.append(df.withColumn("rec_no", F.col("rec_no") + 100), path)
    assert archive.read(spark, path).count() == 200


def test_stream(spark, tmp_path):
    df = reads(spark, [("ACGTN" * (i % 5 + 1), "IIII#" * (i % 5 + 1)) for i in range(100)])
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    superblocks.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), 32).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "out"))
    want = superblocks.facts(df, 32)
    assert sorted(superblocks.merge(parts).select(*want.columns).collect()) == sorted(want.collect())
    assert parts.count() > want.count()


def test_title_coding_of_odd_titles(spark):
    rows = [(i, f"@X{i % 3}.{100 + i // 2} ab{'cd'[i % 2]}{'z' * (i % 4)}:7/{i % 2 + 1}") for i in range(100)] + [(100, "@odd"), (101, "@X1.0150 abc:7/1"), (102, "@X1.9 q:8/2")]
    df = spark.createDataFrame(rows, "rec_no long, title string")
    for size in (64, 16384):
        assert sorted(title_coding.decode(title_coding.encode(df, size), df, size).collect()) == sorted(df.collect())


def test_decode_bits():
    table = {"a": "0", "b": "10", "c": "11"}
    assert decode("010110", table) == ["a", "b", "c", "a"]
    with pytest.raises(ValueError, match="inside"):
        decode("01", table)


def test_command_line(spark, tmp_path, capsys):
    good = "".join(f"@{i} x\nACGT\n+\nII#{'!'}\n\n" for i in range(50))
    (tmp_path / "in.fq").write_text(good + "bad\nAC\n+\nII\n" + good)
    read = lambda n: sorted(r.value for r in spark.read.text(str(tmp_path / n)).collect())
    want = sorted(x for x in good.split("\n") if x)
    for flags in ([], ["--plain"], ["-l", "--wrapped", "-m", "1"]):
        name = "a" + "".join(flags)
        main(["e", *flags, str(tmp_path / "in.fq"), str(tmp_path / name)])
        main(["d", str(tmp_path / name), str(tmp_path / f"out{name}")])
        main(["d", "-r", "7", str(tmp_path / name), str(tmp_path / f"one{name}")])
        assert read(f"out{name}") == want and read(f"one{name}") == sorted(["@7 x", "ACGT", "+", "II#!"])
    assert "MB/s, ratio" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["e", "--mode", "FAILFAST", str(tmp_path / "in.fq"), str(tmp_path / "b")])


def test_overlap_chain_lookup(spark):
    rng = random.Random(3)
    source = "".join(rng.choice("ACGT") for _ in range(300))
    df = reads(spark, [(s, "I" * len(s)) for s in (source[:200], source[24:224], source[36:236])])
    stripped = overlap.strip(df, overlap.best_overlaps(df)).cache()
    assert stripped.where("ref_rec_no is not null").count() == 2
    for i, r in enumerate(df.orderBy("rec_no").collect()):
        assert overlap.lookup(stripped, i).first().seq == r.seq
    assert overlap.lookup(stripped, 9).collect() == []
    assert sorted(overlap.restore(stripped).collect()) == sorted(df.select("rec_no", "seq").collect())


def test_other_letters_survive(spark):
    rows = ["ACGNRY", "", "N", "acgt", "TTN.", "ACGT" * 70 + "R", "éA"]
    df = spark.createDataFrame([(i, s, "I" * len(s)) for i, s in enumerate(rows)] + [(99, None, None)], "rec_no long, seq string, quality string")
    want = sorted((r.rec_no, r.seq) for r in df.collect())
    back = transforms.unpack_bases(transforms.pack_bases(df).drop("seq"))
    assert sorted((r.rec_no, r.seq) for r in back.collect()) == want
    assert sorted((r.rec_no, r.seq) for r in transforms.color_decode(transforms.color_encode(df)).collect()) == want
    with pytest.raises(Exception, match="colors already"):
        transforms.color_encode(df.withColumn("seq", F.lit("A01"))).collect()


@pytest.mark.parametrize("method", ["plain", "truncate", "rle"])
def test_quality_bits(spark, method):
    rng = random.Random(4)
    rows = [("A" * n, "".join(rng.choice("IIIF#!~") for _ in range(n))) for n in (1, 5, 33, 90)] * 20 + [("A" * 600, "I" * 600), ("AA", "##"), ("A", "#")]
    df = reads(spark, rows)
    methods = spark.range(0, 2).selectExpr("id AS sb_id", f"'{method}' AS method")
    codes = huffman(quality_coding.models(df, methods, 64))
    blocks, sizes_ = quality_coding.encode(df, methods, codes, 64), quality_coding.lengths(df, methods, 64)
    assert sorted(quality_coding.decode(sizes_, blocks, codes).select("rec_no", "quality").collect()) == sorted(df.select("rec_no", "quality").collect())
    coded_bits = codes.agg(F.sum(F.col("n") * F.col("bits"))).first()[0]
    assert coded_bits == blocks.agg(F.sum("n_bits")).first()[0]
    lone = reads(spark, [("A" * 40, "I" * 40)] * 3)
    codes = huffman(quality_coding.models(lone, methods, 64))
    back = quality_coding.decode(quality_coding.lengths(lone, methods, 64), quality_coding.encode(lone, methods, codes, 64), codes)
    assert sorted(back.select("rec_no", "quality").collect()) == sorted(lone.select("rec_no", "quality").collect())


def test_coded_archive(spark, tmp_path):
    rng = random.Random(6)
    source = "".join(rng.choice("ACGT") for _ in range(500))
    rows = [(i, f"@r.{i} x:{i % 3}" if i % 9 else "@odd", source[i : i + 60 + i % 40].replace("G", "N" if i % 7 == 0 else "G"), ("+", "+other", f"+r.{i} x:{i % 3}")[i % 3], None) for i in range(100)]
    rows = [(*r[:4], "".join(rng.choice("IIIIF") for _ in r[2][3:]) + "###") for r in rows]
    colors = [(i, f"@c.{i}", "T" + "".join(rng.choice("0123.") for _ in range(50)), "+", "!" + "I" * 50) for i in range(128, 150)]
    df = spark.createDataFrame(rows + colors, READS)
    for mode in ("depth1", None):
        path = str(tmp_path / str(mode))
        coded.write(df, path, 64, mode)
        assert [tuple(r) for r in coded.read(spark, path).collect()] == sorted(rows + colors)
    tables = {t: spark.read.parquet(f"{tmp_path}/depth1/{t}") for t in coded.TABLES}
    assert tables["records"].where("ref_rec_no is not null").count() > 20 and {r.in_colors for r in tables["header"].collect()} == {True, False}
    assert tables["trailer"].first()["records"] == 122 and tables["index"].count() == 5
    for n in (0, 33, 99, 130):
        assert [tuple(r) for r in coded.lookup(spark, str(tmp_path / "depth1"), n).collect()] == [r for r in rows + colors if r[0] == n]
    assert coded.lookup(spark, str(tmp_path / "depth1"), 700).collect() == []
    coded.write(df.where("false"), str(tmp_path / "none"), 64)
    assert coded.read(spark, str(tmp_path / "none")).collect() == []


def test_depth_one(spark):
    rng = random.Random(3)
    source = "".join(rng.choice("ACGT") for _ in range(400))
    df = reads(spark, [(s, "I" * len(s)) for s in (source[i : i + 150] for i in range(0, 240, 12))])
    best = overlap.best_overlaps(df, mode="depth1").collect()
    matched = {r.rec_no for r in best}
    assert matched and not matched & {r.ref_rec_no for r in best}
    every = {(r.rec_no, r.ref_rec_no) for r in overlap.candidates(df).collect()}
    sources = set()
    for i in range(20):  # one read after the other
        if not any((i, j) in every for j in sources):
            sources.add(i)
    assert matched == set(range(20)) - sources


def test_size_report_adds_up(spark):
    rng = random.Random(8)
    df = reads(spark, [("".join(rng.choice("ACGTN") for _ in range(50)), "".join(rng.choice("IF#") for _ in range(50))) for _ in range(100)])
    got = {r.stream: r.bits for r in sizes.size_report(df, 128).collect()}
    plain = "".join(r.seq for r in df.collect())
    assert got["bases"] == 2 * len(plain.replace("N", "")) and got["n"] == 6 * plain.count("N") and "lengths" not in got and "plus" not in got
    methods = profile.quality_method(df, 128)
    codes = huffman(quality_coding.models(df, methods, 128))
    assert got["quality"] == quality_coding.encode(df, methods, codes, 128).agg(F.sum("n_bits")).first()[0]
    ratio = sizes.compression(df, 128).first()
    assert ratio.coded_bytes == -(-sum(got.values()) // 8) and ratio.input_bytes == sum(len(r.title) + len(r.seq) * 2 + 5 for r in df.collect())


def test_scan_ends_at_the_first_malformed_record(spark, tmp_path):
    (tmp_path / "a.fq").write_text("\n" + GOOD + "\r\n" + GOOD + "x\nAC\n+\nII\n" + GOOD)
    (tmp_path / "b.fq").write_text(GOOD * 3)
    got = fastq.numbered(fastq.accepted(fastq.read_lines(spark, str(tmp_path)))).orderBy("rec_no").collect()
    assert [r.rec_no for r in got] == list(range(5)) and {r.seq for r in got} == {"ACGT"}
    assert fastq.read_whole(spark, str(tmp_path)).count() == 5
    with pytest.raises(ValueError, match="malformed record 2"):
        fastq.accepted(fastq.read_lines(spark, str(tmp_path)), "FAILFAST")
