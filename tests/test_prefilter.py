import pytest

from treekin.operators import prefilter


@pytest.mark.parametrize("name", ["text", "_bits", "_word", "_maybe", "chunk", "words", "member", "a.b", "a`b"])
def test_anti_join(spark, monkeypatch, name):
    """Broadcast keys, a bitmap (roomy and crowded), and a join of all rows; columns of any name stay."""
    rows = spark.createDataFrame([(f"t{i}", i if i != 5 else None) for i in range(300)], ["x", "k"]).selectExpr("x", "CAST(k AS LONG) AS k").toDF(name, "k")
    gone = spark.createDataFrame([(i,) for i in [*range(0, 300, 3), None]] * 2, "k long")
    for keys, bits in ((1 << 19, 1 << 27), (0, 1 << 27), (0, 512), (0, 64)):
        monkeypatch.setattr(prefilter, "MOST_KEYS", keys)
        monkeypatch.setattr(prefilter, "MOST_BITS", bits)
        got = prefilter.anti_join(rows, gone, "k")
        assert got.columns == [name, "k"] and sorted(r[0] for r in got.collect()) == sorted(f"t{i}" for i in range(300) if i % 3)
    assert prefilter.anti_join(rows, gone.where("k < 0"), "k").count() == 300 and prefilter.anti_join(rows.where("k < 0"), gone, "k").count() == 0


def test_bitmap_is_as_large_as_its_members_need(spark):
    rows, gone = spark.range(20_000).toDF("k"), spark.range(0, 20_000, 4).toDF("k")
    flagged, maybe = prefilter.maybe_member(rows, "k", gone, 1 << 16)
    assert 5000 <= flagged.where(maybe).count() < 6500
    assert prefilter.bitmap(gone, "k", 1 << 16).count() == (1 << 16) // 64 // prefilter.WORDS
