import json
import os

from palimpsest.operators.session import dedup_search
from palimpsest.streaming import sessions as S


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps({"traj": t, "step": s, "docids": d}) + "\n" for t, s, d in rows))


def test_a_stream_in_two_runs_equals_the_batch(spark, tmp_path):
    rows = [(t, s, [str((s * 3 + i + len(t)) % 17) for i in range(12)]) for t in ("a", "bb") for s in range(6)]
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for part, own in enumerate(([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3])):
        write(source, f"{part}.json", own)
        query = S.write_stream(S.dedup_search_stream(S.read_pools(spark, str(source)), k=4), out, check)
        assert query.awaitTermination(120)
    got = spark.read.schema(S.RESULTS).json(out)
    wanted = dedup_search(spark.createDataFrame(rows, S.POOLS), k=4)
    key = lambda df: sorted((r["traj"], r["step"], r["results"], r["hidden"]) for r in df.collect())
    assert key(got) == key(wanted)


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "ts timestamp, kind string"
    for i, stamps in enumerate((["2024-01-01 00:10:00", "2024-01-01 00:50:00"], ["2024-01-01 05:00:00"], ["2024-01-01 09:00:00"], ["2024-01-01 00:20:00", "2024-01-01 12:00:00"])):
        file = source / f"{i}.json"
        file.write_text("".join(json.dumps({"ts": s, "kind": "view"}) + "\n" for s in stamps))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = S.visit_counts_stream(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.table("counts").selectExpr("cast(start as string) as start", "n").collect()
    assert ("2024-01-01 00:00:00", 2) in [(r["start"], r["n"]) for r in rows], rows
