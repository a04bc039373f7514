"""Pages of one output tried one after the other, as a stream that holds the waiting ones.

Events are pages that arrive and outcomes that come back.  Of each output one page runs
at a time: the first by name of those that wait.  A failure lets the next one run; a
success is the end, and all that wait or come later skip.  What waits is kept in state
by output, so nothing is forgotten between micro-batches or by a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "project string, output_name string, file_name string, kind string"
PAGE, SUCCESS, FAILED = "page", "success", "failed"
RUN, SKIP = "run", "skip"
ACTIONS = "project string, output_name string, file_name string, action string"
#: Setting that the state of this stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waves(StatefulProcessor):
    """State of an output: the pages that wait, and in one value the page that runs, whether one succeeded and whether any waits.

    Every use of state is a call to the executor, so what waits is looked at only if there
    is any; an output of one page never has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "file_name string", "held boolean")
        self.state = handle.getValueState("state", "running string, done boolean, held boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        actions: list[tuple[str, str]] = []
        before = self.state.get() or (None, False, False)
        running, done, held = before
        new: set[str] = set()
        for batch in rows:
            for name, kind in zip(batch["file_name"], batch["kind"], strict=True):
                if kind == PAGE:
                    if done:
                        actions.append((name, SKIP))
                    elif name != running:
                        new.add(name)
                elif name == running:
                    running = None
                    done = done or kind == SUCCESS
        if done or running is None:
            old = {k[0] for k in self.waiting.keys()} if held else set()  # noqa: SIM118
            names = sorted(old | new)
            if done:
                actions += [(name, SKIP) for name in names]
                if held:
                    self.waiting.clear()
                new, held = set(), False
            elif names:
                running, held = names[0], len(names) > 1
                actions.append((running, RUN))
                if running in old:
                    self.waiting.removeKey((running,))
                new -= old | {running}
        for name in new:
            self.waiting.updateValue((name,), (True,))
        held = held or bool(new)
        if (running, done, held) != tuple(before):
            self.state.update((running, done, held))
        if actions:
            yield pd.DataFrame([(*key, *a) for a in actions], columns=["project", "output_name", "file_name", "action"])

    def close(self) -> None:
        pass


def wave_actions(events: DataFrame) -> DataFrame:
    """(project, output_name, file_name, action) for a stream of ``EVENTS``: pages to run now, and pages that will not run.

    An outcome counts only for the page that runs, so a repeated one changes nothing; a
    page that failed waits again if its row comes again.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    return events.groupBy("project", "output_name").transformWithStateInPandas(Waves(), ACTIONS, "Append", "None")


def run_waves(pages: DataFrame, apply: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(project, output_name, file_name, status) of all ``pages``, run as such a stream until no page waits.

    ``folder`` holds the events, the state and the statuses; called again with it after a
    crash, the stream goes on where it was.  ``apply`` takes the rows to run and gives
    them back with status; after a crash it may get some again, so let it keep a journal.
    """
    spark = pages.sparkSession
    columns = ["project", "output_name", "file_name"]
    if not _has(spark, f"{folder}/events"):
        pages.selectExpr(*columns, f"'{PAGE}' kind").write.parquet(f"{folder}/events")
    while True:
        ran: list[bool] = []

        def settle(actions: DataFrame, number: int, ran: list[bool] = ran) -> None:
            # Stored first, as every further use of a micro-batch would run its state again, and every use of what is applied the function.
            actions.write.mode("overwrite").parquet(f"{folder}/actions/batch={number}")
            actions = spark.read.parquet(f"{folder}/actions/batch={number}")
            rows = apply(actions.filter(f"action = '{RUN}'").select(*columns)).select(*columns, "status")
            skipped = actions.filter(f"action = '{SKIP}'").selectExpr(*columns, f"'{SKIP}' status")
            rows.unionByName(skipped).write.mode("overwrite").parquet(f"{folder}/statuses/batch={number}")
            written = spark.read.parquet(f"{folder}/statuses/batch={number}").filter(f"status <> '{SKIP}'")
            if not written.isEmpty():
                outcomes = written.selectExpr(*columns, f"CASE WHEN status = '{SUCCESS}' THEN '{SUCCESS}' ELSE '{FAILED}' END kind")
                outcomes.write.mode("append").parquet(f"{folder}/events")
                ran.append(True)

        events = spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
        stream = wave_actions(events).writeStream.foreachBatch(settle).option("checkpointLocation", f"{folder}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
        if not ran:
            return spark.read.parquet(f"{folder}/statuses").drop("batch")


def _has(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
