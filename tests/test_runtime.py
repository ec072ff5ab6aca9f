import os

from corvane import runtime


def test_scratch_removes_what_was_written_within(spark):
    place = lambda df: df.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    before = runtime.durable(spark.range(3), "before")
    with runtime.scratch():
        within, lasting = runtime.durable(spark.range(3), "within"), runtime.durable(spark.range(3), "lasting", True)
        paths = [place(df) for df in (before, within, lasting)]
        assert within.count() == 3 and all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [True, False, True]
