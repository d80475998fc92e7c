"""What a run did: times of its stages, and jobs whose state outlives the driver."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from ..sources import files
from .datasets import merge_datasets, subset
from .datasets import convert as convert_dataset


class StageRecorder:
    """Seconds, tasks and bytes by stage; threads may record at once."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._stages: dict[str, dict[str, float]] = {}

    def add(self, name: str, seconds: float, *, tasks: int = 0, input_bytes: int = 0, output_bytes: int = 0) -> None:
        with self._lock:
            stage = self._stages.setdefault(name, {"seconds": 0.0, "tasks": 0, "input_bytes": 0, "output_bytes": 0})
            for key, value in (("seconds", seconds), ("tasks", tasks), ("input_bytes", input_bytes), ("output_bytes", output_bytes)):
                stage[key] += value

    @contextlib.contextmanager
    def measure(self, name: str, **counts: int) -> Iterator[None]:
        """Times what runs within it, also if that fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(name, time.perf_counter() - began, **counts)

    def snapshot(self) -> dict[str, dict[str, float]]:
        with self._lock:
            return {k: dict(v) for k, v in self._stages.items()}


class JobStore:
    """A folder that holds a job's description, the state of its parts, and a lock.

    A part's state is a file of its own, named when whole, so parts that end at
    once do not meet; the lock is a file that only one can create.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, spec: dict[str, Any], parts: list[dict[str, Any]]) -> None:
        if files.exists(self.spark, f"{self.folder}/job.json"):
            raise FileExistsError(self.folder)
        files.write_json(self.spark, f"{self.folder}/job.json", {"spec": spec, "parts": parts})

    def read(self) -> dict[str, Any]:
        return files.read_json(self.spark, f"{self.folder}/job.json")

    def mark(self, part: int, state: str, **more: Any) -> None:
        """Notes a part's state: running, done or failed."""
        made = f"{self.folder}/parts/.{part:06d}.{uuid.uuid4().hex[:8]}"
        target = f"{self.folder}/parts/{part:06d}.json"
        files.write_json(self.spark, made, {"part": part, "state": state, **more})
        if files.exists(self.spark, target):
            files.delete(self.spark, target)
        files.rename(self.spark, made, target)

    def states(self) -> dict[int, dict[str, Any]]:
        if not files.exists(self.spark, f"{self.folder}/parts"):
            return {}
        found = [n for n, _ in files.listing(self.spark, f"{self.folder}/parts") if n.endswith(".json") and not n.startswith(".")]
        return {s["part"]: s for s in (files.read_json(self.spark, f"{self.folder}/parts/{n}") for n in found)}

    @contextlib.contextmanager
    def locked(self) -> Iterator[None]:
        """Only one at a time; who finds the lock taken gets BlockingIOError."""
        path = f"{self.folder}/lock"
        if not files.create_new(self.spark, path, json.dumps({"at": time.time()})):
            raise BlockingIOError(path)
        try:
            yield
        finally:
            files.delete(self.spark, path)

    def status(self) -> dict[str, Any]:
        job, states = self.read(), self.states()
        count = {s: sum(x["state"] == s for x in states.values()) for s in ("running", "done", "failed")}
        return {"parts": len(job["parts"]), **count, "pending": len(job["parts"]) - len(states), "finished": files.exists(self.spark, f"{self.folder}/finished.json")}


def prepare(spark: SparkSession, folder: str, source: str, destination: str, version: str, edges: list[tuple[int, int]]) -> JobStore:
    """A conversion in parts, each a range of episodes, that several drivers may share."""
    store = JobStore(spark, folder)
    store.create({"source": source, "destination": destination, "version": version}, [{"start": a, "stop": b} for a, b in edges])
    return store


def run_part(spark: SparkSession, store: JobStore, part: int) -> None:
    """Converts one range of episodes into the job's folder; a part that is done stays as it is."""
    from ..sources.layouts import open_dataset

    job = store.read()
    if store.states().get(part, {}).get("state") == "done":
        return
    edges, out = job["parts"][part], f"{store.folder}/out/{part:06d}"
    store.mark(part, "running")
    try:
        data = subset(open_dataset(spark, job["spec"]["source"]), edges["start"], edges["stop"])
        done = convert_dataset(spark, data, out, job["spec"]["version"], overwrite=True)
    except Exception as e:
        store.mark(part, "failed", error=str(e)[:500])
        raise
    store.mark(part, "done", episodes=done["episodes"], frames=done["frames"])


def try_finalize(spark: SparkSession, store: JobStore, *, overwrite: bool = False) -> bool:
    """Merges the parts into the destination once all are done; False while any is not, or while another does it."""
    status = store.status()
    if status["finished"]:
        return True
    if status["done"] != status["parts"]:
        return False
    try:
        with store.locked():
            if store.status()["finished"]:
                return True
            job = store.read()
            outs = [f"{store.folder}/out/{k:06d}" for k in range(len(job["parts"]))]
            if len(outs) == 1:
                data_files = files.resolved(spark, outs[0])
                files.make_parents(spark, job["spec"]["destination"])
                if files.exists(spark, job["spec"]["destination"]) and not overwrite:
                    raise FileExistsError(job["spec"]["destination"])
                files.rename(spark, data_files, job["spec"]["destination"])
            else:
                merge_datasets(spark, outs, job["spec"]["destination"], overwrite=overwrite)
            provenance = {"source": job["spec"]["source"], "parts": [store.states()[k] for k in sorted(store.states())], "at": time.time()}
            files.write_json(spark, f"{store.folder}/finished.json", provenance)
    except BlockingIOError:
        return False
    return True
