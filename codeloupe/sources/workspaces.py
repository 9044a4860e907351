"""Workspaces: named sets of repositories with declared links between their symbols.

A workspace is a small JSON file on the driver; its tables become DataFrames where they meet
indexes. The active workspace's name is one more JSON file.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codeloupe.model import LINKS, REPOSITORIES, WORKSPACE_VERSION, SchemaMismatchError
from codeloupe.sources.store import config_root, repo_id


def now() -> str:
    return datetime.now(UTC).isoformat()


class Workspaces:
    """All workspaces below one configuration folder."""

    def __init__(self, root: str | Path | None = None):
        self.root = Path(root or config_root())

    def path(self, name: str) -> Path:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no workspace name")
        return self.root / "workspaces" / f"{name}.json"

    def list(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "workspaces").glob("*.json"))

    def current(self) -> str:
        """The active workspace's name, '' if none is set."""
        p = self.root / "config.json"
        return json.loads(p.read_text()).get("current_workspace", "") if p.exists() else ""

    def use(self, name: str) -> None:
        if name and not self.path(name).exists():
            raise LookupError(f"there is no workspace {name!r}")
        _write(self.root / "config.json", {"current_workspace": name})

    def create(self, name: str) -> Workspace:
        if not self.path(name).exists():
            _write(self.path(name), {"version": WORKSPACE_VERSION, "workspace": name, "repositories": [], "links": [], "next": 1})
        return self.open(name)

    def open(self, name: str = "") -> Workspace:
        name = name or self.current()
        if not name:
            raise LookupError("no workspace is active")
        if not self.path(name).exists():
            raise LookupError(f"there is no workspace {name!r}")
        return Workspace(self.path(name))

    def delete(self, name: str) -> None:
        if not self.path(name).exists():
            raise LookupError(f"there is no workspace {name!r}")
        self.path(name).unlink()
        if self.current() == name:
            self.use("")


def _write(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(f".{uuid.uuid4().hex}")
    new.write_text(json.dumps(value, indent=1))
    os.replace(new, path)


class Workspace:
    def __init__(self, path: Path):
        self.file = path
        found = json.loads(path.read_text())
        if found.get("version", WORKSPACE_VERSION) != WORKSPACE_VERSION:
            raise SchemaMismatchError(found["version"], WORKSPACE_VERSION)
        self.data = found

    @property
    def name(self) -> str:
        return self.data["workspace"]

    def save(self) -> None:
        _write(self.file, self.data)

    def add(self, path: str) -> str:
        """Adds a repository, once; its id."""
        full = os.path.abspath(path)
        rid = repo_id(full)
        if all(r["id"] != rid for r in self.data["repositories"]):
            self.data["repositories"].append({"id": rid, "path": full, "added_at": now(), "last_indexed_at": None})
            self.save()
        return rid

    def remove(self, path: str) -> None:
        """Removes a repository and the links that touch it."""
        rid = repo_id(path)
        if all(r["id"] != rid for r in self.data["repositories"]):
            raise LookupError(f"{path!r} is not in workspace {self.name!r}")
        self.data["repositories"] = [r for r in self.data["repositories"] if r["id"] != rid]
        self.data["links"] = [x for x in self.data["links"] if rid not in (x["src_repo_id"], x["dst_repo_id"])]
        self.save()

    def indexed(self, rid: str) -> None:
        for r in self.data["repositories"]:
            if r["id"] == rid:
                r["last_indexed_at"] = now()
        self.save()

    def link(self, src: tuple[str, str, str], dst: tuple[str, str, str], note: str = "", meta: dict[str, str] | None = None) -> int:
        """Links two (repository id, symbol, file); the link's id."""
        known = {r["id"] for r in self.data["repositories"]}
        for rid in (src[0], dst[0]):
            if rid not in known:
                raise LookupError(f"repository {rid!r} is not in workspace {self.name!r}")
        link = {"id": self.data["next"], "note": note, "created_at": now(), "meta": dict(meta or {})}
        for side, (rid, symbol, file) in (("src", src), ("dst", dst)):
            link |= {f"{side}_repo_id": rid, f"{side}_symbol": symbol, f"{side}_file": file}
        self.data["links"].append(link)
        self.data["next"] += 1
        self.save()
        return link["id"]

    def set_meta(self, link_id: int, key: str, value: str) -> None:
        self._link(link_id)["meta"][key] = value
        self.save()

    def unlink(self, link_id: int) -> None:
        self.data["links"].remove(self._link(link_id))
        self.save()

    def _link(self, link_id: int) -> dict:
        for x in self.data["links"]:
            if x["id"] == link_id:
                return x
        raise LookupError(f"there is no link {link_id}")

    def links(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in LINKS.split(", ")]
        rows = [tuple(datetime.fromisoformat(x[n]) if n == "created_at" else x[n] for n in names) for x in self.data["links"]]
        return spark.createDataFrame(rows, LINKS)

    def repositories(self, spark: SparkSession) -> DataFrame:
        at = lambda x: datetime.fromisoformat(x) if x else None
        rows = [(r["id"], r["path"], at(r["added_at"]), at(r["last_indexed_at"])) for r in self.data["repositories"]]
        return spark.createDataFrame(rows, REPOSITORIES).orderBy("added_at")
