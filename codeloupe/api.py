"""What a user calls: indexing, queries of one index or a workspace, and impact simulation."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloupe.functions.text import line_slice
from codeloupe.model import CROSS
from codeloupe.operators import aggregates, graph, scoring, search, workspace
from codeloupe.parsing.registry import EXTENSIONS, parse
from codeloupe.plans import planning
from codeloupe.sources.sinks import plain
from codeloupe.sources.store import Store, repo_id
from codeloupe.sources.workspaces import Workspaces


class Loupe:
    """All commands over one store and one set of workspaces.

    Queries of a repository first refresh its index if it is older than ``threshold``; with
    ``refresh=False`` they read what is there.
    """

    def __init__(self, spark: SparkSession, store: str | Path | None = None, config: str | Path | None = None, threshold: timedelta = timedelta(seconds=10), refresh: bool = True):
        self.spark, self.store, self.workspaces = spark, Store(spark, store), Workspaces(config)
        self.threshold, self.refresh = threshold, refresh

    def index(self, root: str, rebuild: bool = False) -> dict:
        return self.store.index(root, rebuild)

    def _table(self, root: str, name: str) -> DataFrame:
        return self._tables(root, name)[0]

    def _tables(self, root: str, *names: str) -> list[DataFrame]:
        """Relations of one version of the index."""
        if self.refresh:
            self.store.refresh(root, self.threshold)
        return [self.store.table(n, repo_id(root)) for n in names]

    def symbols(self, file: str) -> dict:
        """Symbols and imports of one file, without an index."""
        language = EXTENSIONS.get(os.path.splitext(file)[1])
        if language is None:
            raise ValueError(f"no parser for {file!r}")
        found = parse(language, Path(file).read_text(errors="replace"))
        return {"symbols": [{"name": s.name, "type": s.type, "start_line": s.start_line, "end_line": s.end_line, "parent": s.parent} for s in found.symbols], "imports": [{"import_path": p, "alias": a, "line": n} for p, a, n in found.imports]}

    def symbol(self, root_or_file: str, name: str, type: str = "") -> list[dict]:
        """Symbols of a name, which may be dotted, with the lines of their bodies."""
        if os.path.isfile(root_or_file):
            text = Path(root_or_file).read_text(errors="replace")
            rows = [s for s in self.symbols(root_or_file)["symbols"] if s["name"] == name and type in ("", s["type"])]
            lines = text.splitlines()
            return [{**s, "file_path": root_or_file, "body": "".join(x + "\n" for x in lines[s["start_line"] - 1 : s["end_line"]])} for s in rows[:1]]
        found = search.search_symbols(self._table(root_or_file, "symbols"), search.SearchQuery(name=name, type=type))
        full = os.path.abspath(root_or_file)
        paths = [r[0] for r in found.select("file_path").distinct().collect()]
        if not paths:
            return []
        texts = self.spark.read.format("binaryFile").load([f"{full}/{p}" for p in paths]).select(F.col("path").alias("__path"), F.col("content").cast("string").alias("__text"))
        joined = found.join(texts, F.col("__path").endswith(F.concat(F.lit("/"), "file_path")))
        body = joined.withColumn("body", line_slice(F.col("__text"), F.col("start_line"), F.col("end_line"))).drop("__path", "__text")
        return [plain(r) for r in body.orderBy("file_path", "start_line").collect()]

    def search(self, root: str, **query) -> DataFrame:
        symbols, index = self._tables(root, "symbols", "postings")
        return search.search_symbols(symbols, search.SearchQuery(**query), index)

    def report(self, root: str) -> dict:
        files, symbols = self._tables(root, "files", "symbols")
        totals = plain(aggregates.report_totals(files, symbols).collect()[0])
        return totals | {"languages": [plain(r) for r in aggregates.report_languages(files, symbols).collect()], "types": [plain(r) for r in aggregates.report_types(symbols).collect()]}

    def imports(self, root: str, file: str = "", module: str = "") -> DataFrame:
        return search.search_imports(self._table(root, "imports"), file, module)

    def refs(self, root: str, file: str = "", caller: str = "", callee: str = "") -> DataFrame:
        return search.search_refs(self._table(root, "refs"), file, caller, callee)

    def hotspots(self, root: str, limit: int = 20) -> DataFrame:
        refs, symbols = self._tables(root, "refs", "symbols")
        return aggregates.hotspots(refs, symbols, limit)

    def tree(self, root: str, depth: int = 0) -> DataFrame:
        files, symbols = self._tables(root, "files", "symbols")
        return aggregates.directory_tree(files, symbols, depth)

    def files(self, root: str) -> DataFrame:
        files, symbols = self._tables(root, "files", "symbols")
        return aggregates.file_counts(files, symbols)

    def callers(self, root: str, symbol: str, depth: int = 2) -> DataFrame:
        """Direct callers at depth 1, else all paths of callers up to the depth (0: all)."""
        refs = self._table(root, "refs")
        return search.find_callers(refs, symbol) if depth == 1 else graph.callers_recursive(refs, symbol, depth)

    def dead(self, root: str, type: str = "", file: str = "", unexported: bool = False) -> DataFrame:
        symbols, refs = self._tables(root, "symbols", "refs")
        return aggregates.dead_symbols(symbols, refs, type, file, unexported)

    def simulate(self, root: str, symbol: str, change: str, max_depth: int = 6, cross_repo: bool = True, workspace_name: str = "") -> dict:
        """What a change of a symbol reaches, how risky that is, and what to do about it."""
        if not symbol.strip():
            raise ValueError("a symbol is needed")
        parsed = planning.parse_change(change)
        refreshed = self.store.refresh(root, self.threshold) if self.refresh else False
        repo, warnings, links = repo_id(root), [], None
        repos = {repo}
        if cross_repo and (workspace_name or self.workspaces.current()):
            try:
                ws = self.workspaces.open(workspace_name)
                links, known = ws.links(self.spark), {r["id"] for r in ws.data["repositories"]}
                indexed = set(self.store.repos())
                warnings += [f"workspace link {x['id']} skipped: repository {x['dst_repo_id']} has no index" for x in ws.data["links"] if x["dst_repo_id"] not in indexed]
                links = links.filter(F.col("dst_repo_id").isin(list(indexed)))
                repos |= known & indexed
            except (LookupError, RuntimeError) as error:
                warnings.append(f"workspace not used: {error}")
        symbols, refs = (self.store.table(t).filter(F.col("repo_id").isin(list(repos))) for t in ("symbols", "refs"))
        start = graph.start_symbol(symbols, repo, symbol)
        walked = graph.propagate(symbols, refs, start, max(max_depth, 0), links)
        scored = scoring.score(graph.impacts(walked)).cache()
        extent, scores = plain(graph.scope(walked).collect()[0]), plain(scoring.aggregate(scored).collect()[0])
        impacts = [plain(r) for r in scored.collect()]
        last = self.store.last_indexed(repo)
        bullets = [f"Risk score {scores['risk_score']} ({scores['risk_tier']}), confidence {scores['confidence']:.2f}", f"Predicted impacts: {extent['affected_symbols']} symbols across {extent['affected_files']} files in {extent['affected_repos']} repos"]
        if extent["cross_boundary_edges"]:
            bullets.append(f"Cross-boundary edges detected: {extent['cross_boundary_edges']}")
        return {
            "schema_version": "impact-sim/v1",
            "input": {"root": root, "symbol": symbol, "change": parsed, "options": {"max_depth": max_depth, "include_cross_repo": cross_repo}},
            "start": start,
            "summary": {"headline": f"Impact simulation for {symbol}", "bullets": bullets},
            "scores": scores,
            "scope": extent,
            "impacts": impacts,
            "high_risk_boundaries": [plain(r) | {"reason_codes": [CROSS]} for r in scoring.boundaries(scored).collect()],
            **planning.plan(start, extent, impacts, scores, warnings),
            "diagnostics": {"index_refreshed": refreshed, "index_age_seconds": int((datetime.now(UTC) - last).total_seconds()) if last else 0, "workspace_links_used": extent["cross_boundary_edges"], "analysis_depth": max_depth, "warnings": warnings},
        }

    # Workspaces

    def index_workspace(self, name: str = "", concurrency: int = 2, rebuild: bool = False) -> list[dict]:
        """Indexes all repositories; one that fails doesn't stop the others."""
        if concurrency < 1:
            raise ValueError("concurrency must be 1 at least")
        ws = self.workspaces.open(name)

        def one(r: dict) -> dict:
            try:
                return {"repo_id": r["id"], "stats": self.store.index(r["path"], rebuild)}
            except Exception as error:
                return {"repo_id": r["id"], "error": str(error)}

        with ThreadPoolExecutor(concurrency) as pool:
            done = list(pool.map(one, ws.data["repositories"]))
        for d in done:
            if "stats" in d:
                ws.indexed(d["repo_id"])
        return done

    def _workspace_table(self, name: str, table: str) -> tuple[DataFrame, list[str]]:
        ws = self.workspaces.open(name)
        ids = [r["id"] for r in ws.data["repositories"]]
        indexed = self.store.repos()
        return self.store.table(table).filter(F.col("repo_id").isin(ids)), [f"repository {i} has no index" for i in ids if i not in indexed]

    def search_workspace(self, name: str = "", **query) -> tuple[DataFrame, list[str]]:
        symbols, warnings = self._workspace_table(name, "symbols")
        return search.search_workspace(symbols, search.SearchQuery(**query), self._workspace_table(name, "postings")[0]), warnings

    def refs_workspace(self, name: str = "", **wanted: str) -> tuple[DataFrame, list[str]]:
        refs, warnings = self._workspace_table(name, "refs")
        return workspace.refs_workspace(refs, **wanted), warnings

    def imports_workspace(self, name: str = "", **wanted: str) -> tuple[DataFrame, list[str]]:
        imports, warnings = self._workspace_table(name, "imports")
        return workspace.imports_workspace(imports, **wanted), warnings

    def link(self, src: tuple[str, str, str], dst: tuple[str, str, str], note: str = "", meta: list[str] | tuple = (), name: str = "") -> int:
        """Links two (repository path, symbol, file hint); each hint must leave one symbol."""
        ws = self.workspaces.open(name)
        symbols = self.store.table("symbols")
        ends = [(repo_id(p), s, workspace.resolve_symbol(symbols, repo_id(p), s, hint)) for p, s, hint in (src, dst)]
        return ws.link(*ends, note, workspace.parse_meta(list(meta)))

    def links(self, name: str = "", check: bool = False, **wanted: str) -> DataFrame:
        ws = self.workspaces.open(name)
        found = workspace.list_links(ws.links(self.spark), **wanted)
        return workspace.validate_links(found, self.store.table("symbols"), ws.repositories(self.spark)) if check else found
