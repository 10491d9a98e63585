"""Many sessions: files, tasks and calls to the state grow with the rows alone."""

import glob
import os
from collections import Counter

from tokenloom import bridge
from tokenloom.catalog.endtoend import write_logs
from tokenloom.operators.alerts import AlertSettings
from tokenloom.session import many_files
from tokenloom.sources.lines import read_lines
from tokenloom.streaming.monitor import INPUT, Record, SessionMonitor

COST = "spark.sql.files.openCostInBytes"


def test_logs_are_one_plain_file_a_session(spark):
    rows = [("s1", 2, "b"), ("s1", 1, "é"), ("x/y=1", 1, None), ("x/y=1", 2, "c"), (None, 1, "d"), ("", 1, "e")]
    root = write_logs(spark.createDataFrame(rows, "session_id string, line_no bigint, raw string"))
    found = {}
    for path in glob.glob(f"{root.removeprefix('file:')}/**", recursive=True, include_hidden=True):
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                folder = os.path.basename(os.path.dirname(path))
                found[folder] = found.get(folder, "") + f.read()
            # Nothing beside the log: no checksum, no mark of a finished job.
            assert os.path.basename(path) in ("log.txt", "none.txt")
    nameless = found.pop("session=__HIVE_DEFAULT_PARTITION__")
    assert sorted(nameless.split()) == ["d", "e"]
    assert found == {"session=s1": "é\nb\n", "session=x%2Fy%3D1": "\nc\n"}


def test_small_files_share_a_task(spark, tmp_path):
    for n in range(400):
        (tmp_path / f"{n}.jsonl").write_text("{}\n")
    before = spark.conf.get(COST)
    with many_files(spark):
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() <= 5
        assert lines.count() == 400
    assert spark.conf.get(COST) == before
    assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_logs_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(64).selectExpr(
        "id AS event_id", "timestamp'2026-01-01' AS ts", "id % 3 AS user_id", "'view' AS event_type",
        "1.0D AS value", """'{"k":1}' AS props""",
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert bridge.log_events(spark, str(tmp_path)).rdd.getNumPartitions() >= 4


class Calls:
    """State that is empty and counts what it is asked."""

    def __init__(self, seen: Counter):
        self.seen = seen

    def __getattr__(self, name):
        def call(*args):
            self.seen[name] += 1
            return iter(()) if name in ("iterator",) or name == "get" and len(args) > 0 else None

        return call


class Handle:
    def __init__(self):
        self.seen = Counter()

    def __getattr__(self, name):
        return lambda *args: Calls(self.seen)


def test_a_new_session_reads_no_state_and_writes_each_change_once(spark):
    record = dict.fromkeys(INPUT.fieldNames())
    record |= {"agent": "codex", "session_id": "s", "path": "", "tool": "shell", "label": "l", "char_len": 4}
    kinds = ["tool_call", "tool_result", "context_injection"] * 20
    rows = [
        Record(**{**record, "seq": n, "line_no": n + 1, "kind": kind, "call_id": "c", "is_error": True, "mechanism": "skill"})
        for n, kind in enumerate(kinds)
    ]
    handle, monitor = Handle(), SessionMonitor(AlertSettings(), False)
    monitor.init(handle)
    found = list(monitor.handleInputRows(("codex", "s"), iter(rows), None))
    assert [r.rule for r in found] == ["tool_error_streak"]
    # One look whether the session is known; its sums, one call, one instruction and the checkpoint.
    assert handle.seen == {"get": 1, "update": 2, "updateValue": 2}
