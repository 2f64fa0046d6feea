"""Continuous ingest of a folder."""

from sievewright.plans.engine import Engine
from sievewright.streaming.ingest import watch


def test_files_are_ingested_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Boats moor at the quay.")
    (folder / "b.md").write_text("# Title\n\nStorm warnings close the harbor.")
    (folder / "c.bin").write_text("not read")
    engine = Engine(spark, str(tmp_path / "tables"))
    for _ in range(2):
        watch(engine, str(folder), str(tmp_path / "stream"), rebuild=False, once=True).awaitTermination()
    assert engine.health()["documents"] == 2
    (folder / "d.txt").write_text("A third file.")
    watch(engine, str(folder), str(tmp_path / "stream"), rebuild=False, once=True).awaitTermination()
    assert engine.health()["documents"] == 3
