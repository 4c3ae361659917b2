"""Documents written as files, and the library that is read from them."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from chronotext.plans import queries
from chronotext.sources import bundle, readers
from chronotext.staging import FREED, folder, passing, staged


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_documents_as_files(spark, tmp_path):
    path = str(tmp_path / "library")
    df = spark.createDataFrame([(i, f"T {i}", f"# Title {i}\n\nbody é\n", None if i % 2 else "text\n", "x") for i in range(20)], "source_id long, title string, notes_md string, transcript_txt string, more string").repartition(4)
    bundle.write_documents(df, path)
    want = sorted([f"T_{i}_{i}/notes.md" for i in range(20)] + [f"T_{i}_{i}/transcript.txt" for i in range(0, 20, 2)] + ["_SUCCESS"])
    assert files(path) == want and open(f"{path}/_SUCCESS").read() == "30"
    assert open(f"{path}/T_3_3/notes.md", encoding="utf-8").read() == "# Title 3\n\nbody é\n"
    # A second write replaces what it has and leaves the rest; nothing else remains of it.
    bundle.write_documents(df.filter("source_id = 3").withColumn("notes_md", F.lit("# New\n")), path)
    assert files(path) == want and open(f"{path}/T_3_3/notes.md").read() == "# New\n" and open(f"{path}/_SUCCESS").read() == "1"
    with pytest.raises(Exception, match="no file name"):
        spark.createDataFrame([("..", "x", "y")], "folder string, file string, content string").write.format("document_folders").mode("append").option("path", path).save()
    assert files(path) == [f for f in want if f != "_SUCCESS"] and files(tmp_path) == [f"library/{f}" for f in want if f != "_SUCCESS"]


def test_library_stops_at_depth_two(spark, tmp_path):
    for folder, title in (("", "Top"), ("b", "B"), ("a", "A"), ("a/b", "Deep"), ("a/b/c", "Deeper")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / "notes.md").write_text(f"# {title}\n\ntext\n")
    (tmp_path / "a" / "other.md").write_text("# Other\n")
    rows = readers.scan_library(spark, str(tmp_path)).collect()
    assert [r.title for r in rows] == ["A", "B", "Top"] and rows[0].notes == "# A\n\ntext\n"
    assert readers.scan_library(spark, str(tmp_path / "none")).count() == 0


def test_library_has_no_more_than_its_scan_reads(spark):
    """Notes alone: any file, however short, takes a block of disk, as do the folders."""
    at = f"{folder(spark).removeprefix('file:')}/library-*"
    staged_at = f"{folder(spark).removeprefix('file:')}/chronotext-{spark.sparkContext.applicationId}/*"
    before, tables = set(glob.glob(at)), glob.glob(staged_at)
    rows = queries.QUERIES["a8_library_files"](spark, "/root/testdata/sf0.001").collect()
    (library,) = set(glob.glob(at)) - before
    assert len(rows) > 100 and files(library) == sorted(["_SUCCESS", *(f"{r.out_key}/notes.md" for r in rows)])
    # What the notes are made of is gone.
    assert sorted(glob.glob(staged_at)) == sorted(tables)
    assert all(open(f"{library}/{r.out_key}/notes.md", encoding="utf-8").read() == r.notes for r in rows[:20])


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    def shuffled():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(held.size()) if (name := held.apply(k).getName()).startswith("shuffle_")}

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("source_id")).agg(F.collect_list("id").alias("ids"))
    notes = df.select("source_id", F.lit("T").alias("title"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("notes_md"))
    for write in (lambda: staged(df, "freed"), lambda: bundle.write_documents(notes, str(tmp_path / "freed"))):
        before, set_to = shuffled(), spark.conf.get(FREED, None)
        write()
        end = time.time() + 20
        while (left := {x for x in shuffled() - before if x.endswith(".data")}) and time.time() < end:
            time.sleep(0.2)
        assert not left and spark.conf.get(FREED, None) == set_to


def test_staged_tables_go_with_what_is_made_of_them(spark, tmp_path):
    def there():
        return {os.path.basename(p).split("-")[0] for p in glob.glob(f"{folder(spark).removeprefix('file:')}/chronotext-{spark.sparkContext.applicationId}/passing*")}

    kept = staged(spark.range(3), "passing_kept")
    with passing() as held:
        first = staged(kept, "passing_first")
        with passing():
            assert staged(first, "passing_inner").count() == 3 and there() == {"passing_kept", "passing_first", "passing_inner"}
        second = held.alone(first.filter("id > 0"), "passing_second")
        assert there() == {"passing_kept", "passing_second"} and second.count() == 2
    with pytest.raises(ValueError, match="no more"), passing():
        staged(kept, "passing_third")
        raise ValueError("no more")
    assert there() == {"passing_kept"} and kept.count() == 3
