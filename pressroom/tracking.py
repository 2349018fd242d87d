"""Logs and run tracking. A tracker that fails is switched off with a warning; the run goes on."""

from __future__ import annotations

import json
import logging
import time
from pathlib import Path


def setup_logging(path: str | None = None, name: str = "pressroom") -> logging.Logger:
    """To the console and, if given, to a file. Calling it again adds no second handler."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    if path and not any(isinstance(h, logging.FileHandler) and h.baseFilename == str(Path(path).resolve()) for h in log.handlers):
        log.addHandler(logging.FileHandler(path))
    for h in log.handlers:
        h.setFormatter(form)
    return log


class Tracker:
    """Metrics as JSON lines, or to any sink with a log(dict) method."""

    def __init__(self, sink=None, path: str | None = None, config: dict | None = None):
        self.sink, self.path, self.on = sink, path, True
        self.log(config or {}, kind="config")

    def log(self, values: dict, step: int | None = None, kind: str = "metrics") -> None:
        if not self.on:
            return
        try:
            row = {"time": time.time(), "kind": kind, "step": step, **values}
            if self.sink is not None:
                self.sink.log(row)
            if self.path:
                with open(self.path, "a") as f:
                    f.write(json.dumps(row, default=str) + "\n")
        except Exception as e:  # noqa: BLE001  whatever a sink raises must not end the run
            self.on = False
            logging.getLogger("pressroom").warning("tracking is off: %s", e)

    def listen(self, spark) -> None:
        """Progress of the session's streams, too."""
        from pyspark.sql.streaming import StreamingQueryListener

        tracker = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                tracker.log({"id": str(event.id)}, kind="started")

            def onQueryProgress(self, event):
                tracker.log({"id": str(event.progress.id), "rows": event.progress.numInputRows}, kind="progress")

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                tracker.log({"id": str(event.id), "error": event.exception}, kind="ended")

        spark.streams.addListener(Listener())
