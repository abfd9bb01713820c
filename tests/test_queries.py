"""Every registered query of the catalog against its SQL in DuckDB, and the shape of some plans."""

import os

import duckdb
import pandas as pd
import pytest

from frameledger.plans import analogs, registry
from frameledger.sources import shared

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def packed_once(spark):
    """Packing the same table is the same; queries of this module share what it gives."""
    made, real = {}, analogs.Packed.of.__func__

    def once(cls, spark, sf_dir, runs=None):
        if runs is not None:
            return real(cls, spark, sf_dir, runs)
        return made.setdefault(sf_dir, None) or made.update({sf_dir: real(cls, spark, sf_dir)}) or made[sf_dir]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(analogs.Packed, "of", classmethod(once))
        yield
    some = shared.held(spark.range(1))
    shared.sweep(spark)
    assert not shared.MADE and not any(os.path.exists(f.removeprefix("file://")) for f in some.inputFiles())


def frame(table):
    out = table.to_pandas(types_mapper=pd.ArrowDtype)
    return out[sorted(out.columns)].astype(str).sort_values(sorted(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, db, name):
    got, want = frame(registry.QUERIES[name](spark, DATA).toArrow()), frame(db.sql(registry.ORACLES[name]).to_arrow_table())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_candidates_beyond_5000(spark):
    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    got = frame(registry.QUERIES["pack_candidates"](spark, d).toArrow())
    assert got["seq"].astype(int).max() > 5000
    pd.testing.assert_frame_equal(got, frame(con.sql(registry.ORACLES["pack_candidates"]).to_arrow_table()))


@pytest.mark.parametrize("odd", [0, 1, 2, 3, 9])
def test_blob_issues_whatever_a_text_ends_in(spark, tmp_path, odd):
    """Null, empty, two bytes and three at the end, a control character; a copy with a smaller number; numbers below zero."""
    texts = [None, "", "é", "no 界", "one\x01", "x", "plain"]
    rows = [(10 * i + odd, text) for i, text in enumerate(texts)] + [(-10 - odd, "plain"), (-20 - odd, "below"), (-30 - odd, "è")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES["verify_blob_hash"](spark, str(tmp_path)).toArrow(), con.sql(registry.ORACLES["verify_blob_hash"]).to_arrow_table()
    pd.testing.assert_frame_equal(frame(got), frame(want))


@pytest.mark.parametrize("name", ["verify_rollup", "verify_constraints"])
def test_partial_keys_are_no_duplicates(spark, tmp_path, name):
    """Two halved keys of one run have the same frame number."""
    rows = [(n, 1, "click" if n < 1000 else "view", 1.0, "{}") for n in (0, 1, 2, 1000, 1001, 1002)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()
    pd.testing.assert_frame_equal(frame(got), frame(want))


def test_conversations_of_any_length(spark, tmp_path):
    rows = [(1, t, f"turn {t} é" * (t % 5)) for t in range(300)] + [(2, 0, "alone")] + [(3, t, "x") for t in range(129)] + [(4, 0, "a"), (4, 1, "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = registry.QUERIES["codec_roundtrip"](spark, str(tmp_path)).toArrow()
    assert got.num_rows == len(rows) and sorted(x.as_py() for x, y in zip(got["segment_id"], got["status"], strict=True) if y.as_py() == "skipped") == ["c-2-0", "c-3-1"]
    pd.testing.assert_frame_equal(frame(got), frame(con.sql(registry.ORACLES["codec_roundtrip"]).to_arrow_table()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_move_rows_once_and_split_a_camera(spark):
    """Rows are exchanged by key and block of frame numbers; what meets by key alone is one row a block."""
    from frameledger.operators import blocks, packing

    rows = spark.range(100).selectExpr("cast(id % 3 as string) as run", "cast(id % 5 as string) as stream", "id as frame_no", "id % 2 as width")
    text = plan(packing.groups(rows, 8))
    assert text.count("Exchange ") <= 4 and "SinglePartition" not in text
    frames = [(n, n // 700 % 2) for n in range(3000) if n % 1000 != 999]
    df = spark.createDataFrame([("r", n, w) for n, w in frames], "run string, frame_no long, width int")
    got = {r.frame_no: (r.isl, r.start) for r in blocks.islands(df, ["run"], "frame_no", ["width"], size=64).collect()}
    want, isl, start, before = {}, 0, None, None
    for n, w in frames:
        if before != (n - 1, w):
            isl, start = isl + 1, n
        want[n], before = (isl, start), (n, w)
    assert got == want
    numbers = {r.frame_no: r.place for r in blocks.numbered(df, ["run"], "frame_no", "place", size=64).collect()}
    assert numbers == {n: i for i, (n, _) in enumerate(frames)}


def test_page_is_a_top_n_with_pushed_filters(spark, tmp_path):
    from frameledger.operators.catalog import page

    spark.range(50).selectExpr("id as seq", "'r' as run").write.parquet(str(tmp_path / "t"))
    text = plan(page(spark.read.parquet(str(tmp_path / "t")), 5, last=40, where={"run": "r"}))
    assert "TakeOrderedAndProject" in text and "LessThan(seq,40)" in text and "EqualTo(run,r)" in text


def test_references_never_plan_a_nested_loop(spark):
    for name in ("prune_candidates", "unreferenced_objects", "cap_active", "expected_present"):
        assert "NestedLoop" not in plan(registry.QUERIES[name](spark, DATA))
