"""Alert rules over a growing log: keyed state in, feed records out.

Normalised events arrive as files; state per session holds what the batch rules
look back for, so a poll costs the new records only.  Eleven of the twelve rules
run here; steps of the residual need a ratio fitted over the whole session, so
they are a batch rule over the sessions that changed.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tokenloom.functions import secrets
from tokenloom.functions.usage import estimate_tokens, prompt_tokens
from tokenloom.operators.alerts import AlertSettings
from tokenloom.operators.instructions import TRACKED
from tokenloom.operators.reconstruct import classify
from tokenloom.operators.turns import occupies_context
from tokenloom.schema import LOW_ENTROPY_BYTES, LOW_ENTROPY_RATIO, RATIO_LINEAR_AGENT, SESSION
from tokenloom.sinks import feed
from tokenloom.streaming.prompt import COPY_STATE, ITEM_STATE, Item, Prompt, Spend, short_name

#: What the monitor needs of an event; nothing wider enters the state operator.
INPUT = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("raw_type", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("trigger", T.StringType()),
        T.StructField("tokens_before", T.LongType()),
        T.StructField("tokens_after", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("window", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("mechanism", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("char_len", T.LongType()),
        # The record as an item of the prompt; NULL tokens where it is none.
        T.StructField("item_id", T.StringType()),
        T.StructField("raw_tokens", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("packed", T.DoubleType()),
        # Credential shapes in the record.
        T.StructField("secret_kinds", T.ArrayType(T.StringType())),
        T.StructField("secret_counts", T.ArrayType(T.LongType())),
        # What a reported request cost, and per category at current prices; NULL without a price.
        T.StructField("micros", T.LongType()),
        T.StructField("current_micros", T.ArrayType(T.LongType())),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)

Record = namedtuple("Record", INPUT.fieldNames())

Finding = Row(*ALERTS.fieldNames())

_CHECKPOINT = (
    "path string, last_seq bigint, turns bigint, last_prompt bigint, band int, window bigint,"
    " error_key string, error_run bigint"
)
BANDS = ["normal", "warning", "critical"]
_SUMS = "raw bigint, opened bigint, observed bigint, unpriced bigint, priced bigint, over boolean, current string"
#: Lists of a prompt that are kept between polls.
_PARTS = ["tail", "system", "large", "poor"]
_KEYS = {"large_contributor": "contributor", "duplicate_context": "duplicate", "low_entropy_content": "entropy"}


def monitor_input(events: DataFrame, ratio: float = RATIO_LINEAR_AGENT) -> DataFrame:
    """Project normalised events of straight logs onto the monitor's columns.

    ``raw`` (the record, scanned for credentials), ``fp``, ``original_bytes``,
    ``compressed_bytes``, ``micros`` and ``current_micros`` are used where
    ``events`` carry them; the rules that need a missing one stay silent.
    """
    report, compacted = F.col("kind") == "token_report", F.col("kind") == "compacted"
    have = set(events.columns)
    given = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    unnamed = F.lit(None).cast("struct<tool:string,target:string>")
    items = classify(events.withColumn("call", unnamed))
    held = occupies_context() & F.col("category").isNotNull()
    line = F.col("line_no").cast("string")
    shrunk = F.try_divide(given("compressed_bytes", "bigint"), given("original_bytes", "bigint"))
    low = (given("original_bytes", "bigint") >= LOW_ENTROPY_BYTES) & (shrunk <= LOW_ENTROPY_RATIO)
    found = F.when(held, secrets.scan(secrets.record_text(F.col("raw")))) if "raw" in have else None
    return items.select(
        *SESSION,
        (F.col("path") if "path" in have else F.lit("")).alias("path"),
        "seq",
        "line_no",
        "kind",
        "raw_type",
        "tool",
        "call_id",
        "target",
        "is_error",
        F.col("compaction.trigger").alias("trigger"),
        F.col("compaction.tokens_before").alias("tokens_before"),
        F.col("compaction.tokens_after").alias("tokens_after"),
        F.when(report, prompt_tokens("usage")).alias("prompt_tokens"),
        F.when(report, F.col("usage.context_window")).alias("window"),
        "role",
        "mechanism",
        F.when(held & (F.col("kind") != "context_injection"), F.col("item_label")).otherwise(F.col("label")).alias("label"),
        "char_len",
        F.concat(F.when(compacted, "codex:compaction:").otherwise("codex:"), line).alias("item_id"),
        F.when(compacted, estimate_tokens(F.col("byte_len"), ratio))
        .when(held, estimate_tokens(F.col("char_len"), ratio))
        .alias("raw_tokens"),
        F.when(held, given("fp", "string")).alias("fp"),
        F.when(held & low, shrunk).alias("packed"),
        (given("secret_kinds", "array<string>") if found is None else found["kind"]).alias("secret_kinds"),
        (given("secret_counts", "array<bigint>") if found is None else found["occurrences"]).alias("secret_counts"),
        F.when(report, given("micros", "bigint")).alias("micros"),
        F.when(report, given("current_micros", "array<bigint>")).alias("current_micros"),
    )


def next_band(previous: int, used: float, s: AlertSettings) -> int:
    """Fullness band with hysteresis: 0 normal, 1 warning, 2 critical."""
    if used >= s.pressure_critical or (previous == 2 and used >= s.pressure_reset_critical):
        return 2
    if used >= s.pressure_warning or (previous == 1 and used >= s.pressure_reset_warning):
        return 1
    return 0


class SessionMonitor(StatefulProcessor):
    """The checkpoint of one session and the rules that read it.

    Every access to the state is a call to another process, so what a poll needs of it is
    read once, what it changes is written once, and a new session reads nothing.
    """

    def __init__(self, settings: AlertSettings, baseline: bool):
        self.settings = settings
        self.baseline = baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.checkpoint = handle.getValueState("checkpoint", _CHECKPOINT)
        self.calls = handle.getMapState("calls", "call_id string", "tool string, target string")
        self.sums = handle.getValueState("sums", _SUMS)
        self.items = handle.getListState("items", f"part string, {ITEM_STATE}")
        self.copies = handle.getMapState("copies", "fp string", COPY_STATE)
        self.instructions = handle.getMapState("instructions", "mechanism string, label string", "char_len bigint")
        self.waiting = handle.getListState("waiting", "seq bigint, line_no bigint, mechanism string, label string, growth bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        news = sorted(map(Record._make, rows), key=lambda r: r.seq)
        state = self.checkpoint.get()
        path = news[-1].path
        silent = state is None and self.baseline
        if state is not None and (state[0] != path or news[0].seq <= state[1]):
            # Another file, or the log was rewritten: take stock, stay quiet.
            state, silent = None, True
            for part in (self.calls, self.sums, self.items, self.copies, self.instructions, self.waiting):
                part.clear()
        out = self._fold(key, news, path, state)
        if not silent:
            for row in out:
                yield Finding(*row)

    def _load(self, known: bool) -> tuple[Prompt, Spend]:
        if not known:
            return Prompt(self.settings), Spend()
        saved = self.sums.get() or (0, None, 0, 0, 0, False, None)
        prompt = Prompt(self.settings, saved[0], saved[1])
        for part, *fields in self.items.get():
            getattr(prompt, part).append(Item(*fields))
        prompt.copies = {k[0]: (v[0], v[1]) for k, v in self.copies.iterator()}
        return prompt, Spend(*saved[2:6], [int(x) for x in saved[6].split()] if saved[6] else None)

    def _save(self, prompt: Prompt, spend: Spend, known: bool) -> None:
        sums = " ".join(map(str, spend.sums))
        self.sums.update((prompt.raw, prompt.opened, spend.observed, spend.unpriced, spend.turns, spend.over, sums))
        rows = [(part, *item) for part in _PARTS for item in getattr(prompt, part)]
        if rows:
            self.items.put(rows)
        elif known:
            self.items.clear()
        if prompt.emptied and known:
            self.copies.clear()
        for fp in prompt.touched:
            self.copies.updateValue((fp,), prompt.copies[fp])

    def _drift(self, r: Record, sizes: dict, known: bool) -> tuple | None:
        """A tracked instruction whose size differs from when it was last injected; ``sizes`` are those of this poll."""
        if r.kind != "context_injection" or r.mechanism not in TRACKED or r.label is None:
            return None
        name = (r.mechanism, r.label)
        size = r.char_len
        before = sizes[name] if name in sizes else (self.instructions.getValue(name) or (None,))[0] if known else None
        sizes[name] = size
        if before is None or size is None or before == size:
            return None
        return r.seq, r.line_no, r.mechanism, r.label, size - before

    def _fold(self, key, news: list[Record], path: str, state) -> list[list]:
        s, (agent, session) = self.settings, key
        _, _, turns, prompt, band, window, error_key, error_run = state or (path, -1, 0, None, 0, None, None, 0)
        out: list[list] = []
        known = state is not None
        held, spend = self._load(known)
        drifts = list(self.waiting.get()) if known else []
        waited = bool(drifts)
        #: Calls and instruction sizes of this poll, ahead of the stored ones.
        calls: dict[str, tuple] = {}
        sizes: dict[tuple, int | None] = {}
        # Records wait for the report that closes their turn.
        pending: list[list] = []

        def alert(rule, severity, name, turn, line, seq, amount, detail):
            if rule not in s.rules_off and s.enabled:
                row = [agent, session, rule, severity, turn, line, seq, name, amount, detail]
                out.append(row)
                return row

        for r in news:
            label = r.label
            drift = self._drift(r, sizes, known)
            if drift is not None:
                drifts.append(drift)
            for kind, times in zip(r.secret_kinds or [], r.secret_counts or []):
                pending.append(alert("secret_exposure", secrets.SEVERITY[kind], f"secret:{session}:{r.line_no}:{kind}", None, r.line_no, r.line_no, times, kind))
            if r.kind == "tool_call" and r.call_id is not None:
                calls[r.call_id] = (r.tool, r.target)
            elif r.kind == "tool_result":
                call = calls.get(r.call_id)
                if call is None and known and r.call_id is not None:
                    call = self.calls.getValue((r.call_id,))
                call = call or (None, None)
                tool = r.tool if r.tool is not None else call[0]
                label = call[1] or tool or label
                if not r.is_error:
                    error_key, error_run = None, 0
                else:
                    failed = "tool" if tool is None else tool + ("" if call[1] is None else "\u0001" + call[1])
                    error_run = error_run + 1 if error_key == failed else 1
                    error_key = failed
                    if error_run == s.error_streak:
                        row = alert("tool_error_streak", "warning", f"tool-errors:{session}:{r.seq}:0", None, r.line_no, r.seq, error_run, tool or "tool")
                        pending.append(row)
            elif r.kind == "compacted":
                told = r.tokens_before is not None and r.tokens_after is not None
                freed = max(r.tokens_before - r.tokens_after, 0) if told else None
                pending.append(alert("compaction", "info", f"compaction:{session}:{r.line_no}", None, r.line_no, r.seq, freed, r.trigger))
            elif r.kind == "unrecognised":
                alert("format_drift", "warning", f"format:{agent}:{r.raw_type}", None, None, r.seq, None, r.raw_type)
            elif r.kind == "token_report":
                turns += 1
                for row in pending:
                    if row is not None:
                        row[4] = turns
                pending = []
                size, own = r.prompt_tokens, r.window
                window = window if window is not None else own
                room = own if own is not None else window
                if size is not None and room:
                    nxt = next_band(band, size / room, s)
                    if nxt > band:
                        alert("context_pressure", "critical" if nxt == 2 else "warning", f"pressure:{session}:{turns}", turns, None, r.seq, size, BANDS[nxt])
                    band = nxt
                if size is not None and prompt is not None and size - prompt >= s.spike_tokens:
                    alert("prompt_spike", "warning", f"spike:{session}:{turns}", turns, None, r.seq, size - prompt, None)
                prompt = size
                for rule, item, name, amount, detail in held.close(r.seq, size):
                    alert(rule, "warning", f"{_KEYS[rule]}:{session}:{turns}:{name}", turns, None, turns if item is None else item.seq, amount, detail)
                for seq, line, mechanism, name, growth in drifts:
                    alert("instruction_drift", "warning", f"instructions:{session}:{mechanism}:{turns}", turns, line, seq, growth, short_name(name))
                drifts = []
                spend.add(r.micros, r.current_micros or None)
                budget = s.cost_budget_micros
                if budget is not None and not spend.over and spend.expected(s.forecast_turns) >= budget:
                    spend.over = True
                    alert("cost_budget", "warning", f"cost:{session}:{budget}", None, None, 0, spend.expected(s.forecast_turns), None)
            item = None
            if r.raw_tokens is not None:
                place = "summary" if r.kind == "compacted" else "system" if r.mechanism == "base_instructions" else "plain"
                item = Item(r.seq, r.item_id, label, r.raw_tokens, place, r.fp, r.packed)
            if r.kind != "token_report":
                held.record(r.kind, r.role, r.seq, item)
        self._save(held, spend, known)
        for call_id, call in calls.items():
            self.calls.updateValue((call_id,), call)
        for name, size in sizes.items():
            self.instructions.updateValue(name, (size,))
        if drifts:
            self.waiting.put(drifts)
        elif waited:
            self.waiting.clear()
        self.checkpoint.update((path, news[-1].seq, turns, prompt, band, window, error_key, error_run))
        return out

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, settings: AlertSettings = AlertSettings(), baseline: bool = False) -> DataFrame:
    """Alert candidates from a stream of monitor input.

    With ``baseline`` the first records seen of a session set its state without
    alerting.  Needs the RocksDB state store provider.
    """
    return events.select(*INPUT.fieldNames()).groupBy(*SESSION).transformWithState(
        statefulProcessor=SessionMonitor(settings, baseline),
        outputStructType=ALERTS,
        outputMode="Append",
        timeMode="None",
    )


def feed_writer(path: str):
    """A ``foreachBatch`` sink that adds each finding to the feed once.

    A batch owns its folders and overwrites them when it is replayed; keys of
    earlier batches keep old findings out, so a replay after a lost executor
    or driver leaves the feed as it was.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        candidates = feed.qualify(batch)
        seen = _earlier_keys(spark, path, batch_id)
        fresh = feed.unseen(candidates, seen) if seen is not None else feed.unseen(candidates, candidates.limit(0))
        # Findings of the very first batch were made while nobody was watching.
        fresh = fresh.withColumn("catch_up", F.lit(batch_id == 0))
        fresh.write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
        written = spark.read.parquet(f"{path}/records/batch={batch_id}")
        written.select("dedupe_key").write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")

    return write


def _earlier_keys(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        keys = spark.read.parquet(f"{path}/keys")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return keys.where(F.col("batch") < batch_id)


def run_monitor(
    spark: SparkSession,
    events_path: str,
    feed_path: str,
    checkpoint: str,
    settings: AlertSettings = AlertSettings(),
    baseline: bool = False,
    trigger: dict | None = None,
):
    """Start the monitor; by default it handles what is there and stops."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source = spark.readStream.schema(INPUT).parquet(events_path)
    return (
        alert_stream(source, settings, baseline)
        .writeStream.foreachBatch(feed_writer(feed_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_feed(spark: SparkSession, feed_path: str) -> DataFrame:
    return spark.read.parquet(f"{feed_path}/records")
