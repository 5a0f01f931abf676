"""What is refused before work begins, how failures are classed, and facts under a time limit."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

# Classes of failures that are no verdict.
CATEGORIES = "target_unavailable connect_failed runner_not_found fixture_parse unknown_version bad_usage internal".split()
LOOPBACK = ("localhost", "127.0.0.1", "::1")


class ToolError(Exception):
    """A failure that is no verdict, with the class that tells what to mend."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category if category in CATEGORIES else "internal"

    def payload(self) -> str:
        return json.dumps({"kind": "tool_error", "category": self.category, "error": str(self)}, sort_keys=True)


def source_digest(host: str) -> str:
    """A source's name in a published shape: not the host itself."""
    return "sha256:" + hashlib.sha256(host.encode()).hexdigest()


def aliases(host: str) -> list[str]:
    """The spellings of a host: as given, as names are compared, and all of this machine's."""
    plain = host.strip().rstrip(".").lower()
    return list(dict.fromkeys([host, plain, *(LOOPBACK if plain in LOOPBACK else ())]))


def check_host(source: str | None, target: str | None) -> None:
    """Refuses a target that is the source of the shape; nothing is known of an unnamed one."""
    if source and target and any(source_digest(a) == source for a in aliases(target)):
        raise ToolError("bad_usage", "the target is the source of the shape")


def check_write_target(source: str | None, target: str | None, sure: bool = False) -> None:
    """For targets that keep what is written: a shape without a source needs the caller's word."""
    check_host(source, target)
    if not source and not sure:
        raise ToolError("bad_usage", "the shape names no source, so the target may be it")


def check_access(is_superuser: bool, sure: bool = False) -> None:
    if is_superuser and not sure:
        raise ToolError("bad_usage", "profiling as a superuser is refused; connect with a role that can only read")


def within(spark: SparkSession, seconds: float, facts: dict[str, Callable[[], object]]) -> tuple[dict, list[str]]:
    """Each fact under a limit of its own: (facts, names of those that ran out of time and are
    left out).  A fact that fails for another reason raises.  A limit of 0 or less is none."""
    done, late = {}, []
    sc = spark.sparkContext
    for name, fact in facts.items():
        tag, fired = f"fact-{uuid.uuid4().hex}", threading.Event()

        def stop(tag=tag, fired=fired):
            fired.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop) if seconds > 0 else None
        sc.addJobTag(tag)
        if timer:
            timer.start()
        try:
            done[name] = fact()
        except Exception:
            if not fired.is_set():
                raise
            late.append(name)
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)
    return done, late
