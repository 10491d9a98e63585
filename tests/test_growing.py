"""Growing log files: what a poll opens, half-written lines, rotation, and ranges of any size."""

import io
import random

import pyarrow as pa
import pytest

from tokenloom.sources.growing import GrowingLines, GrowingReader, lines_ending_in, ranges


def reader(folder, **options):
    return GrowingReader({"path": folder.as_uri(), **options})


def poll(source, before):
    after = source.latestOffset()
    parts = source.partitions(before, after)
    return after, parts, [tuple(r.values()) for p in parts for b in source.read(p) for r in b.to_pylist()]


def test_a_poll_opens_what_changed(tmp_path):
    for i in range(1000):
        (tmp_path / f"{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 7}" / f"{i}.jsonl").write_text(f'{{"n":{i}}}\n')
    source = reader(tmp_path)
    sizes, parts, rows = poll(source, source.initialOffset())
    assert len(parts) == len(rows) == 1000
    with open(tmp_path / "3" / "17.jsonl", "a") as f:
        f.write('{"n":-1}\n{"half":')
    sizes, parts, rows = poll(source, sizes)
    assert [p.path.rsplit("/", 1)[1] for p in parts] == ["17.jsonl"]
    assert [(r[1], r[3]) for r in rows] == [(9, '{"n":-1}')]
    # The rest of the half line brings the whole line.
    with open(tmp_path / "3" / "17.jsonl", "a") as f:
        f.write("1}\n")
    sizes, parts, rows = poll(source, sizes)
    assert len(parts) == 1 and [(r[1], r[2], r[3]) for r in rows] == [(18, 10, '{"half":1}')]
    assert poll(source, sizes)[1:] == ([], [])


def test_rotation_starts_over_and_new_files_come_whole(tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text("1\n22\n333\n")
    source = reader(tmp_path)
    sizes, _, rows = poll(source, {})
    assert [r[3] for r in rows] == ["1", "22", "333"]
    log.write_text("new\n")
    (tmp_path / "b.jsonl").write_text("x\r\n\n  \ny\n")
    (tmp_path / "c.txt").write_text("no log\n")
    _, _, rows = poll(source, sizes)
    assert [(r[1], r[3]) for r in rows] == [(0, "new"), (0, "x"), (7, "y")]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_every_line_comes_once_whatever_the_ranges(size):
    rng = random.Random(size)
    data = b"".join(bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(60)) + b"open"
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    got = [row for p in ranges({}, {"f": len(data)}, size) for row in lines_ending_in(file, p.start, p.end)]
    at, want = 0, []
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_as_a_stream(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    spark.dataSource.register(GrowingLines)

    def run():
        lines = spark.readStream.format("growing_lines").option("path", logs.as_uri()).option("rangeBytes", 64).load()
        writer = lines.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        query = writer.start(out, format="parquet")
        query.awaitTermination()
        assert query.exception() is None

    (logs / "a.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(50)) + '{"n":')
    run()
    assert spark.read.parquet(out).count() == 50
    with open(logs / "a.jsonl", "a") as f:
        f.write('50}\n{"n":51}\n')
    run()
    rows = spark.read.parquet(out).orderBy("byte_offset").collect()
    assert [r["raw"] for r in rows] == [f'{{"n":{i}}}' for i in range(52)]
