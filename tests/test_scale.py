"""What keeps memory and shuffles in proportion to the input: kernels by pieces, one row per block, results stored once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import fixtures
from strandlake.functions import batches
from strandlake.operators import huffman, overlap, profile, quality_coding, runs, transforms
from strandlake.plans import registry

READS = "rec_no long, title string, seq string, plus string, quality string"
DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_hold_whole_groups():
    rng = random.Random(1)
    keys = np.sort([rng.randrange(40) for _ in range(500)])
    words = ["x" * rng.randrange(60) for _ in keys]
    table = pa.table({"k": keys, "w": words})
    made = list(batches.whole_groups(iter(table.to_batches(max_chunksize=33)), "k", 400))
    assert pa.Table.from_batches(made).to_pydict() == table.to_pydict() and len(made) > 10
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(made, made[1:]))
    parts = list(batches.sliced(table.to_batches()[0], 400))
    assert sum(p.num_rows for p in parts) == 500 and max(p.nbytes for p in parts) <= 800


def test_runs_by_block(spark, monkeypatch):
    monkeypatch.setattr(batches, "PIECE", 64)
    rng = random.Random(2)
    lines = ["I" * 300, "", None, "é#é", "I" * 600] + ["".join(rng.choice("IF#") for _ in range(rng.randrange(50))) for _ in range(200)]
    df = spark.createDataFrame([(i, "", "", "+", q) for i, q in enumerate(lines)], READS).repartition(5)
    coded = runs.coded_blocks(df)
    each = runs.quality_runs(df)
    want = {}
    for r in each.orderBy("block_id", "run_no").collect():
        want.setdefault(r.block_id, []).append((r.symbol, r.run_len))
    assert {r.block_id: list(zip(r.symbols, r.lens)) for r in coded.collect()} == want
    back = runs.restored(coded, df.select("rec_no", F.length("quality").alias("len")))
    assert sorted(map(tuple, back.collect())) == list(enumerate(lines))
    pairs, sizes = {}, {}
    for block, line in want.items():
        for (before, _), (symbol, n) in zip([("", 0), *line], line):
            pairs[block // 2, before, symbol] = pairs.get((block // 2, before, symbol), 0) + 1
            sizes[block // 2, symbol, f"{n:03d}"] = sizes.get((block // 2, symbol, f"{n:03d}"), 0) + 1
    got = {m: {tuple(r)[1:4]: r.n for r in runs.run_models(df, 2).where(F.col("model") == m).collect()} for m in ("run_symbol", "run_length")}
    assert got == {"run_symbol": pairs, "run_length": sizes}
    assert {r.sb_id: r.longest for r in runs.longest_runs(df, 2).collect()} == {b: max(int(n) for (s, _, n) in sizes if s == b) for b in {k[0] for k in sizes}}


def test_runs_are_not_exploded(spark):
    assert "Generate" not in plan(registry.QUERIES["quality_runs_restore"](spark, DIR))
    text = plan(registry.QUERIES["quality_bigrams"](spark, DIR))
    assert "Window" not in text and "Generate" not in text


def test_kernels_see_pieces(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGTNR") for _ in range(n)), "I" * n) for n in (rng.choice([0, 1, 7, 40, 3000]) for _ in range(300))]
    seen = []
    kernel = batches.by_pieces(lambda a: seen.append(a.nbytes) or a)
    column = pa.array([s for s, _ in rows] * 20)
    assert kernel(column).equals(column) and len(seen) > 2 and max(seen) <= 2 * batches.PIECE
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(rows)] + [(999, None, None)], "rec_no long, seq string, quality string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        want = sorted(map(tuple, df.collect()))
        many = df.crossJoin(spark.range(20)).select((F.col("rec_no") + 1000 * F.col("id")).alias("rec_no"), "seq", "quality").coalesce(1)
        for back in (transforms.color_decode(transforms.color_encode(many)), transforms.unpack_bases(transforms.pack_bases(many).drop("seq")).select("rec_no", "seq", "quality")):
            assert sorted(map(tuple, back.where("rec_no < 1000").collect())) == want
            assert back.exceptAll(many).isEmpty() and back.count() == many.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_histogram_of_superblocks_larger_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(profile, "PIECE", 100)
    rng = random.Random(5)
    lines = ["", None, "~" * 700] + ["".join(rng.choice("IF#") for _ in range(rng.randrange(90))) for _ in range(150)]
    df = spark.createDataFrame([(i, "", "", "+", q) for i, q in enumerate(lines)], READS).repartition(4)
    want = {}
    for i, q in enumerate(lines):
        for p, c in enumerate(q or "", 1):
            for at in (0, p):
                want[i // 64, at, c] = want.get((i // 64, at, c), 0) + 1
    hist = profile.quality_histogram(df, 64)
    assert {tuple(r)[:3]: r.n for r in hist.collect()} == want
    assert "HashAggregate" not in plan(hist)


def test_packed_anchors(spark):
    rng = random.Random(6)
    unit = "".join(rng.choice("ACGT") for _ in range(36))
    odd = "R" * 5 + unit
    rows = ["A" * 600] * 5 + [unit * 3, odd * 2, "ac" * 60, unit + "N" + unit * 2]
    df = spark.createDataFrame([(len(rows) - i, s, "I" * len(s)) for i, s in enumerate(rows)], "rec_no long, seq string, quality string").coalesce(1)
    want = {}
    for i, s in sorted((len(rows) - i, s) for i, s in enumerate(rows)):
        for off in range(0, len(s) - 36, 12):
            kmer = s[off : off + 36]
            if "N" not in kmer and len(want.setdefault(kmer, [])) < 12:
                want[kmer].append((i, off))
    got = {}
    for r in overlap.anchors(df).orderBy("rec_no", "off").collect():
        got.setdefault(r.kmer, []).append((r.rec_no, r.off))
    assert got == want
    text = plan(overlap.anchors(df))
    assert text.count("Sort [") == 1 and text.index("Sort [") < text.index("Exchange")  # none before the shuffle


def test_reads_are_those_of_the_sql(spark, tmp_path):
    docs = [(i, t, "en", i) for i, t in enumerate(["", "1 2", "aZé ßİK.b", None, "zzz", "Hello, World " * 50])] + [(-3, "ab", "de", 2), (-4, "", "de", 0), (21, "x y", None, 3), (None, "text", "en", 4), (14, "", "en", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), DIR):
        want = spark.sql(fixtures._reads_sql("{documents}", "string", ""), documents=fixtures.table(spark, folder, "documents"))
        got = fixtures.reads(spark, folder)
        assert [c[:2] for c in got.dtypes] == [c[:2] for c in want.dtypes]
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert "regexp_replace" not in plan(got)


def test_trees_of_groups_over_batches(spark, monkeypatch):
    monkeypatch.setattr(huffman, "ROWS", 50)
    rng = random.Random(7)
    rows = [("m", sb, str(c), f"{s:03d}", rng.randrange(1, 9)) for sb in range(4) for c in range(9) for s in range(rng.choice([1, 2, 3, 3, 70]))]
    names = ["model", "sb_id", "context", "symbol", "n"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    got = pa.Table.from_batches(huffman._build(iter(table.to_batches(max_chunksize=13)))).to_pylist()
    want, groups = [], {}
    for r in rows:
        groups.setdefault(r[:3], []).append(r)
    for group in groups.values():
        want += [(*r, code, len(code)) for r, code in zip(group, huffman.codes([r[4] for r in group]))]
    assert [tuple(r.values()) for r in got] == want


def test_codes_longer_than_the_table(spark, monkeypatch):
    lines = ["".join(chr(40 + k) * (2**k) for k in range(9)) + "I#" * 9] * 3
    df = spark.createDataFrame([(i, "", "", "+", q) for i, q in enumerate(lines)], READS)
    codes = ["1" * k + "0" for k in range(20)] + ["1" * 20]
    table = quality_coding._Table([(c, k) for k, c in enumerate(codes)])
    assert all(table.near[int(c.ljust(12, "0")[:12], 2)] == (k, len(c)) for k, c in enumerate(codes) if len(c) <= 12)
    bits = np.array([int(b) for b in "1" * 15 + "0" + "11"], np.uint8)
    assert table.near[4095] is None and table.late(bits, 0) == (15, 16)
    with pytest.raises(ValueError, match="inside"):
        table.late(bits, 16)
    methods = spark.range(1).selectExpr("id AS sb_id", "'rle' AS method")
    made = huffman.huffman(quality_coding.models(df, methods, 64))
    back = quality_coding.decode(quality_coding.lengths(df, methods, 64), quality_coding.encode(df, methods, made, 64), made)
    assert sorted(r.quality for r in back.collect()) == lines
