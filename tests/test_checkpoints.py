"""Checkpoints in local folders: written at once, without checksum files, by settings that end with them."""

from pathlib import Path

from zonewise import runtime


def test_checkpoints_leave_no_checksum_files(spark):
    folder = Path(runtime._checkpoint_folder(spark).removeprefix("file:"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    known, settings = set(folder.rglob("*")), {k: conf.get(k) for k in runtime.PLAIN_FILES}
    out = runtime.cut_lineage(spark.range(0, 4000, 1, 40).selectExpr("id", "uuid() AS u"))
    new = {x.name for x in set(folder.rglob("*")) - known}
    assert len([x for x in new if x.startswith("part-")]) == 40 and not any(x.endswith(".crc") for x in new)
    assert {k: conf.get(k) for k in runtime.PLAIN_FILES} == settings
    first = out.collect()
    assert sorted(r["id"] for r in first) == list(range(4000)) and out.collect() == first
