"""The index as Parquet: a folder for each repository and version, and a pointer file for each repository.

``<root>/<repo_id>/<version>/<table>`` holds the rows, ``<root>/_repos/<repo_id>.json`` names the
current version and is replaced atomically, so that readers see either the old or the new index. The
version before the current one is kept, so that a plan made before a new one came still runs; older
ones go. Repositories are written independently of each other, by threads or processes; one
repository has one writer at a time within a process. All files are reached by Hadoop's file systems.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import threading
import uuid
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloupe.model import SCHEMA_VERSION, TABLES, SchemaMismatchError
from codeloupe.sources import ingest
from codeloupe.sources.files import Files

#: One for each pointer file.
LOCKS: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
#: What a table's rows are sorted by, so that row groups can be skipped.
ORDER = {"files": "path", "symbols": "name", "refs": "callee_name", "imports": "file_path", "postings": "token"}


def config_root() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "codeloupe"


def repo_id(root: str) -> str:
    full = os.path.abspath(root)
    return f"{os.path.basename(full)}-{hashlib.sha256(full.encode()).hexdigest()[:8]}"


def git_head(root: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


class Store:
    """All repositories' indexes below one folder. Reading never writes."""

    def __init__(self, spark: SparkSession, root: str | Path | None = None):
        self.spark, self.root = spark, str(root or config_root() / "indexes").rstrip("/")
        self.files = Files(spark, self.root)

    def pointer(self, repo: str) -> str:
        return f"{self.root}/_repos/{repo}.json"

    def current(self, repo: str, checked: bool = True) -> dict | None:
        """What a repository's pointer says; SchemaMismatchError if another schema version wrote it. No version is accepted."""
        if not self.files.exists(self.pointer(repo)):
            return None
        found = json.loads(self.files.read(self.pointer(repo)))
        if checked and found.get("version", SCHEMA_VERSION) != SCHEMA_VERSION:
            raise SchemaMismatchError(found["version"], SCHEMA_VERSION)
        return found

    def repos(self) -> dict[str, dict]:
        """The pointers of all repositories by id."""
        names = [n.removesuffix(".json") for n in self.files.names(f"{self.root}/_repos") if n.endswith(".json") and not n.startswith(".")]
        return {n: found for n in names if (found := self.current(n))}

    def table(self, name: str, repo: str | None = None) -> DataFrame:
        """A relation of one repository or of all."""
        pointers = self.repos().values() if repo is None else filter(None, [self.current(repo)])
        paths = [f"{self.root}/{p['folder']}/{name}" for p in pointers]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def last_indexed(self, repo: str) -> datetime | None:
        found = self.current(repo)
        return datetime.fromisoformat(found["last_indexed_at"]) if found else None

    def should_refresh(self, repo: str, threshold: timedelta = timedelta(seconds=10), now: datetime | None = None) -> bool:
        """Whether an index is missing or older than the threshold; a negative threshold is zero."""
        last = self.last_indexed(repo)
        return last is None or (now or datetime.now(UTC)) - last > max(threshold, timedelta(0))

    def freshness(self, threshold: timedelta = timedelta(seconds=10), now: datetime | None = None) -> DataFrame:
        """``repo_id, last_indexed, stale`` of every repository."""
        rows = [(r, datetime.fromisoformat(p["last_indexed_at"])) for r, p in self.repos().items()]
        return ingest.staleness(self.spark.createDataFrame(rows, "repo_id string, last_indexed timestamp"), now or datetime.now(UTC), threshold)

    def drop(self, root: str) -> None:
        """Removes a repository's index, also one of another schema version; nothing happens if it has none."""
        with LOCKS[self.pointer(repo_id(root))]:
            self._drop(repo_id(root))

    def _drop(self, repo: str) -> None:
        if self.files.exists(self.pointer(repo)):
            self.files.delete(self.pointer(repo))
            self.files.delete(f"{self.root}/{repo}")

    def index(self, root: str, rebuild: bool = False) -> dict:
        """Brings a repository's index up to date; its counts by status, and the errors by file.

        A file that can't be parsed is reported and keeps its old rows. Files of a new time or size
        are hashed, and parsed only if their hash is new.
        """
        full, repo = os.path.abspath(root), repo_id(root)
        with LOCKS[self.pointer(repo)]:
            if rebuild:
                self._drop(repo)
            before = self.current(repo)
            stored = {t: self.table(t, repo) for t in TABLES}
            listed = ingest.listing(self.spark, full, repo)
            compared = ingest.compare(stored["files"], listed.drop("content")).cache()
            changed = ingest.parsed(ingest.hashed(compared, listed).filter("status <> 'unchanged'")).drop("content").cache()
            try:
                counts = dict.fromkeys(ingest.STATUSES, 0)
                for status, n in compared.groupBy("status").count().collect():
                    counts[status] = n
                failed = F.col("parsed.error").isNotNull()
                read = {(status, bad): n for status, bad, n in changed.groupBy("status", failed.alias("bad")).count().collect()}
                good, bad = ({s: read.get((s, x), 0) for s in ("added", "updated")} for x in (False, True))
                # A candidate that isn't read has its old hash.
                counts["unchanged"] += counts.pop("candidate", 0) - good["updated"] - bad["updated"]
                counts |= good | {"error": sum(bad.values())}
                errors = [{"path": p, "error": e} for p, e in changed.filter(failed).select("path", "parsed.error").orderBy("path").collect()] if counts["error"] else []
                folder = before["folder"] if before else None
                if folder is None or counts["added"] or counts["updated"] or counts["removed"]:
                    fresh_files = changed.filter(F.col("parsed.error").isNull())
                    replaced = fresh_files.select("repo_id", "path").unionByName(compared.filter("status = 'removed'").select("repo_id", "path"))
                    folder = f"{repo}/{uuid.uuid4().hex}"
                    for name, fresh in ingest.relations(fresh_files).items():
                        ingest.upsert(name, stored[name], fresh, replaced).sortWithinPartitions(ORDER[name]).write.parquet(f"{self.root}/{folder}/{name}")
                self._publish(repo, full, folder, before)
                return counts | {"errors": errors}
            finally:
                changed.unpersist()
                compared.unpersist()

    def _publish(self, repo: str, full: str, folder: str, before: dict | None) -> None:
        moved = bool(before) and before["folder"] != folder
        kept = before["folder"] if moved else before.get("kept", "") if before else ""
        now = datetime.now(UTC).replace(microsecond=0)
        pointer = {"version": SCHEMA_VERSION, "root": full, "folder": folder, "kept": kept, "git_head": git_head(full), "last_indexed_at": now.isoformat()}
        self.files.replace(self.pointer(repo), json.dumps(pointer, indent=1), f"{self.root}/_repos/.{repo}.{uuid.uuid4().hex}")
        if moved and before.get("kept"):
            self.files.delete(f"{self.root}/{before['kept']}")

    def refresh(self, root: str, threshold: timedelta = timedelta(seconds=10)) -> bool:
        """Indexes a repository if its index is stale; whether it did."""
        if not self.should_refresh(repo_id(root), threshold):
            return False
        self.index(root)
        return True
