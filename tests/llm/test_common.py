import pyarrow as pa
import pytest

from strandlake.llm import common


def test_batches_keep_their_size_and_the_session_its_settings(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    few = common.map_batches(spark.range(0, 20_000, 1, 1), sizes, "n long", 256)
    many = common.map_batches(spark.range(0, 20_000, 1, 1), sizes, "n long", 4096)
    assert max(r.n for r in many.collect()) == 4096 and max(r.n for r in few.collect()) == 256
    assert sum(r.n for r in few.collect()) == 20_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_slices_are_bounded_in_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (i % 7) * 1000 for i in range(100)])], ["t"])
    parts = list(common.sliced(batch, 30, 10_000))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert all(p.num_rows <= 30 and (p.num_rows == 1 or p.nbytes <= 10_000) for p in parts) and len(parts) > 20


def test_sums_before_each_row(spark):
    rows = [(v, i) for i, v in enumerate([3, 1, 2, None, 2, 5])]
    got = common.before(spark.createDataFrame(rows, "v long, i long"), ["v", "i"], {"n": common.F.lit(1), "s": common.F.col("i")}).orderBy("n").collect()
    assert [(r.i, r.n, r.s) for r in got] == [(1, 0, 0), (2, 1, 1), (4, 2, 3), (0, 3, 7), (5, 4, 7), (3, 5, 12)]


class Cluster:
    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
