"""Running searches: row iterators, a bounded stream, cancellation, time budgets and progress."""

from __future__ import annotations

import os
import queue
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def setting(name: str, default: float) -> float:
    """A number of the environment."""
    try:
        return float(os.environ.get(name, default))
    except ValueError:
        raise ValueError(f"{name} is no number: '{os.environ[name]}'") from None


#: Rows that a stream holds at most, and streams that run at once.
CHANNEL_CAPACITY, CONCURRENT = int(setting("QUARRY_CHANNEL", 100)), int(setting("QUARRY_STREAMS", 4))
_slots = threading.BoundedSemaphore(CONCURRENT)
Progress = Callable[[dict], None]


class Cancelled(RuntimeError):
    """The token was cancelled before the rows were all there."""


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def late(deadline: float) -> Column:
    """Whether a deadline, in seconds of the clock, is over when a row's turn comes."""
    now = F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")
    return now > F.lit(int(deadline * 1000))


class Token:
    """Cancels the Spark jobs that run under it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.group, self._set = spark, f"quarry-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        self._set.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    @property
    def cancelled(self) -> bool:
        return self._set.is_set()

    def enter(self) -> None:
        """From now on the thread's jobs belong to the token."""
        if self.cancelled:
            raise Cancelled("cancelled")
        self.spark.sparkContext.setJobGroup(self.group, "search", interruptOnCancel=True)


def rows(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """One partition after the other; a caller that stops early leaves the rest unread."""
    yield from df.toLocalIterator(prefetchPartitions=prefetch)


def within(spark: SparkSession, seconds: float | None, work: Callable[[], object], token: Token | None = None):
    """The result of ``work``; its jobs are cancelled and TimeoutError is raised when the budget is used up."""
    token, late = token or Token(spark), threading.Event()

    def stop() -> None:
        late.set()
        token.cancel()

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    token.enter()
    if timer:
        timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"The search took more than {seconds:g} s") from e
        if token.cancelled:
            raise Cancelled("cancelled") from e
        raise
    finally:
        if timer:
            timer.cancel()


class Stream:
    """Rows made by a thread of its own, at most ``capacity`` ahead of the reader; closing it cancels the jobs."""

    def __init__(self, df: DataFrame, capacity: int = CHANNEL_CAPACITY, progress: Progress | None = None):
        self.token, self._rows, self._tell = Token(df.sparkSession), queue.Queue(capacity), progress or (lambda event: None)
        self._thread = threading.Thread(target=self._run, args=(df,), daemon=True)
        self._thread.start()

    def _put(self, item) -> bool:
        while not self.token.cancelled:
            try:
                self._rows.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def _run(self, df: DataFrame) -> None:
        with _slots:
            n = 0
            try:
                self.token.enter()
                self._tell({"kind": "started"})
                for row in rows(df):
                    n += 1
                    if not self._put(row):
                        break
                    self._tell({"kind": "result", "count": n})
                self._tell({"kind": "finished", "count": n, "cancelled": self.token.cancelled})
                self._put(None)
            except Exception as e:  # noqa: BLE001  handed to the reader
                self._put(e)

    def __iter__(self) -> Iterator[Row]:
        while True:
            item = self._rows.get()
            if item is None:
                return
            if isinstance(item, Exception):
                raise item
            yield item

    def close(self) -> None:
        self.token.cancel()

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_) -> None:
        self.close()
