"""Runs that leave a record: a started event, what was read, an ended event and a line in the history.

Nothing here can make a run fail or wait for long: records are written by a thread of their own, and what goes wrong with
them is a diagnostic. These are single small files of the driver, so they are written without Spark; read_history(),
read_recent() and event_stream() read them.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from terseflow.sources.documents import is_sensitive_resolved

PAYLOAD_BYTES = 16 << 10
#: Seconds that a run waits for its records after it has ended.
PATIENCE = 0.25


@dataclass
class Outcome:
    """What a run gives back: sizes are inputBytes, outputBytes and so on."""

    output: str = ""
    changed: bool = False
    stats: dict[str, int] = field(default_factory=dict)
    findings: list[str] = field(default_factory=list)


def shortened(text: str, limit: int = PAYLOAD_BYTES) -> str:
    """The first `limit` bytes, without a character that the limit cuts, and how many are left out."""
    raw = text.encode("utf-8", "replace")
    if limit <= 0 or len(raw) <= limit:
        return text
    return f"{raw[:limit].decode('utf-8', 'ignore')}\n... [truncated {len(raw) - limit} bytes] ..."


def input_payload(paths: Sequence[str], limit: int = PAYLOAD_BYTES) -> tuple[str, str]:
    """(text of the inputs under a line with their names, status). One sensitive path redacts all, one that can't be read makes all unavailable; missing files are passed over."""
    blocks = []
    for path in filter(None, paths):
        if is_sensitive_resolved(path):
            return "", "redacted"
        try:
            with open(path, encoding="utf-8", errors="replace") as file:
                blocks.append(f"=== {path} ===\n{file.read()}")
        except FileNotFoundError:
            continue
        except OSError:
            return "", "unavailable"
    return (shortened("\n\n".join(blocks), limit), "observed") if blocks else ("", "none")


def said_of(outcome: Outcome, error: str) -> str:
    """What a run did, in a line."""
    if error:
        return error
    saved = [outcome.stats.get(f"input{k}", 0) - outcome.stats.get(f"output{k}", 0) for k in ("Bytes", "Words", "ApproxTokens")]
    if outcome.output and not outcome.changed and not any(saved):
        return "output generated without a tracked content delta"
    return "changed={}, saved {} bytes, {} words, {} approx tokens".format(str(outcome.changed).lower(), *saved)


class RunLog:
    """A folder with events/ (a JSON file each), history/ (JSON lines of ended runs) and diagnostics/."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, kind: str, record: dict) -> None:
        folder = os.path.join(self.root, kind)
        os.makedirs(folder, exist_ok=True)
        name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
        staged = os.path.join(folder, f".{name}")
        with open(staged, "w", encoding="utf-8") as file:
            json.dump({k: v for k, v in record.items() if v not in (None, "", [], {})}, file)
            file.write("\n")
        os.replace(staged, os.path.join(folder, name))

    def record(self, kind: str, record: dict) -> None:
        """write(), or else a diagnostic, or else nothing."""
        try:
            self.write(kind, record)
        except Exception as error:  # noqa: BLE001
            try:
                self.write("diagnostics", {"recordedAt": now(), "message": f"{kind} not recorded: {error}"})
            except Exception:  # noqa: BLE001, S110
                pass


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def observe(log: RunLog, command: str, run: Callable[[], Outcome], inputs: Sequence[str] = (), source: str = "") -> Outcome:
    """run()'s outcome, or its error, unchanged; the log gets a started event, the ended run and a finished or failed event."""
    head = {"id": f"{time.time_ns()}-{os.getpid()}", "command": command, "source": source, "startedAt": now()}
    payload: list[str] = ["", "none"]
    ready = threading.Event()
    tail: dict = {}

    def keep_records() -> None:
        try:
            payload[:] = input_payload(inputs)
        except Exception:  # noqa: BLE001
            payload[:] = ["", "unavailable"]
        log.record("events", {"kind": "started", **head, "payloadStatus": payload[1]})
        ready.wait()
        ended = {**head, **tail}
        sizes = {k: v for k, v in ended.items() if k not in ("result", "resultSummary")}
        log.record("history", sizes)
        log.record("events", {"kind": "finished" if tail["success"] else "failed", **ended, "payloadStatus": payload[1], "input": payload[0]})

    recorder = threading.Thread(target=keep_records, daemon=True)
    recorder.start()
    outcome, error = Outcome(), None
    try:
        outcome = run()
    except Exception as raised:  # noqa: BLE001
        error = raised
    text = "" if error is None else str(error) or type(error).__name__
    tail.update(
        finishedAt=now(), success=error is None, changed=outcome.changed, error=text, stats=outcome.stats, resultSummary=said_of(outcome, text),
        result={"command": command, "changed": outcome.changed, "stats": outcome.stats, "producedOutput": bool(outcome.output), "findings": outcome.findings, "output": shortened(outcome.output)},
    )
    ready.set()
    recorder.join(PATIENCE)
    if error is not None:
        raise error
    return outcome
