"""Steps over many packages: what moves, and what must not pass through the driver."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from foliograph.functions import paths
from foliograph.operators import package as operators
from foliograph.plans import inspection, work
from foliograph.sources import decks, fixtures
from foliograph.sources.fixtures import package, rels, text_shape, zipped


def test_large_steps_are_not_broadcast(spark):
    """A step's files are small where its values are alike; its rows are not."""
    rows = spark.range(work.MOST + 1).select((F.col("id") * 0).cast("string").alias("input_key"), F.array(F.struct(*[F.lit("Text").alias(f"c{i}") for i in range(40)])).alias("wide"))
    small = spark.range(20).select(F.col("id").cast("string").alias("input_key"))
    kept, few = work.keep(rows, "wide"), work.keep(small, "few")
    slim = kept.select("input_key").distinct()
    assert "Broadcast" not in kept.join(slim, "input_key")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in kept.join(F.broadcast(few), "input_key")._jdf.queryExecution().executedPlan().toString()
    assert kept.join(slim, "input_key").count() == work.MOST + 1 and kept.join(few, "input_key", "left_semi").count() == work.MOST + 1


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver gets neither the files' names nor a task for every few of them."""
    data = zipped(package(text_shape(2, "Body", (0, 0, 3000000, 1000000))))
    names = [f"decks/{i % 3}/deep/{i}.pptx" for i in range(398)] + ["top.PPTX", "decks/a b%.pptx"]
    for i, name in enumerate(names):
        at = tmp_path / f"part{i % 2}" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    (tmp_path / "part0/notes.txt").write_bytes(data)
    files = decks.scan(spark, str(tmp_path / "part0"), f"file://{tmp_path}/part1")
    assert "presentation_packages" not in files._jdf.queryExecution().executedPlan().toString()
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = files.collect()
    assert sorted(r.file for r in rows) == sorted(names) and {r.source_sha256 for r in rows} == {hashlib.sha256(data).hexdigest()} and {r.size for r in rows} == {len(data)}
    assert [r.file for r in decks.scan(spark, str(tmp_path / "part0/top.PPTX")).collect()] == ["top.PPTX"]
    assert decks.named_entries(files)[0].count() == 400 * 11
    with pytest.raises(FileNotFoundError):
        decks.scan(spark, str(tmp_path / "none"))


def test_unused_facts_are_not_made(spark, monkeypatch):
    """Packages are built once for their files and their entries, and only tables that are asked for are written."""
    seen = []
    for module in (decks, inspection, operators):
        monkeypatch.setattr(module, "keep", lambda df, tag, keep=work.keep: seen.append(tag) or keep(df, tag))
    built = spark.sparkContext.accumulator(0)

    def build(number, size):
        built.add(1)
        return fixtures.generated(number, size)

    rows = spark.range(24).select("id", F.lit(5).alias("size")).repartition(2)
    f = inspection.facts(decks.decks(fixtures.generated_files(rows, build)))
    assert f.files.count() == 24 and f.parts.count() == 24 * 11 - 4
    assert f.edges.where("target_exists").count() > 0 and f.slides.count() == 22 and f.leaves.count() == 22 + 5 * 2
    assert built.value == 24
    assert not {"bodies", "runs", "types", "diagnostics"} & set(seen) and f.leaves is f.leaves
    assert f.runs.count() == 32 and "types" not in seen and f.types.count() > 0 and "types" in seen


def test_walks_of_paths(spark):
    """Paths that are told by two patterns are those that a walk over their segments gives."""
    parts = ("", ".", "..", "a", "...", ".a", "a.", "..a", "b\n")
    every = ["/".join(p) for n in range(1, 6) for p in itertools.product(parts, repeat=n)][:40_000] + ["ppt/slides/../media/x.png", "a/../b/../c", "a\\b/../c$1/../d"]
    rows = spark.createDataFrame([(p,) for p in every], "p string")
    assert rows.where(~paths.folded(F.col("p")).eqNullSafe(paths._walked(F.col("p")))).count() == 0
    assert rows.where(paths.folded(F.col("p")).isNull()).count() > 100


def test_names_alike_and_ids_that_repeat(spark):
    """Packages whose names or ids repeat, beside those in which none does."""
    edge = rels(("rId1", "image", "a.png"), ("rId2", "image", "b.png"), ("rId1", "image", "c.png"))
    plain = zipped(package())
    odd = zipped([*package(), ("PPT/Notes.xml", "<a/>"), ("ppt/notes.xml", "<a/>"), ("ppt/./x.xml", "<a/>"), ("ppt/x.xml", "<a/>"), ("ppt/y/", ""), ("ppt/z/../q.xml", "<a/>"), ("ppt/_rels/q.xml.rels", edge)])
    f = inspection.facts(decks.decks(spark.createDataFrame([("plain.pptx", plain), ("odd.pptx", odd)], "file string, content binary")))
    got = {(r.input_key, r.raw_name): r.alone for r in f.parts.collect()}
    assert all(v for (k, _), v in got.items() if k == "plain.pptx") and len(got) == 11 + 18
    assert sorted(n for (k, n), v in got.items() if k == "odd.pptx" and not v) == ["PPT/Notes.xml", "ppt/./x.xml", "ppt/notes.xml", "ppt/x.xml", "ppt/y/"]
    assert [(r.id, r.target, r.pos) for r in f.edges.where("rels_part = 'ppt/_rels/q.xml.rels'").orderBy("pos").collect()] == [("rId1", "a.png", 0), ("rId2", "b.png", 1)]
    assert {(r.code, r.part, r.rel_id) for r in f.diagnostics.where("code = 'duplicate-relationship-id'").collect()} == {("duplicate-relationship-id", "ppt/_rels/q.xml.rels", "rId1")}
