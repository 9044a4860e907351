import json
import os
from datetime import UTC, datetime, timedelta

import pytest

from codeloupe.api import Loupe
from codeloupe.model import SchemaMismatchError
from codeloupe.operators import fulltext
from codeloupe.parsing import registry
from codeloupe.sources import ingest
from codeloupe.sources.sinks import callers_text, impact_text, to_json, to_text, tree_text
from codeloupe.sources.store import Store, repo_id

MAIN = "package main\n\nfunc run() {\n\tservice()\n}\n\nfunc service() {\n\tload()\n}\n\nfunc Unused() {}\n"


@pytest.fixture
def repo(tmp_path, monkeypatch):
    monkeypatch.setitem(registry.EXTENSIONS, ".broken", "broken")
    monkeypatch.setitem(registry.PARSERS, "broken", int)  # fails on any text
    root = tmp_path / "src"
    for path, text in {"main.go": MAIN, "lib/util.py": "def load():\n    return 1\n", "node_modules/x.js": "function x() {}", ".hidden/y.py": "def y(): pass", "notes.txt": "no", "lib/bad.broken": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_index_again_and_again(spark, tmp_path, repo):
    store = Store(spark, tmp_path / "store")
    first = store.index(str(repo))
    assert {k: first[k] for k in ("added", "updated", "unchanged", "removed", "error")} == {"added": 2, "updated": 0, "unchanged": 0, "removed": 0, "error": 1}
    assert first["errors"][0]["path"] == "lib/bad.broken"
    rid = repo_id(str(repo))
    assert sorted(r[0] for r in store.table("symbols", rid).select("name").collect()) == ["Unused", "load", "run", "service"]
    assert sorted(tuple(r) for r in store.table("refs", rid).select("caller_name", "callee_name").collect()) == [("run", "service"), ("service", "load")]
    (repo / "lib/bad.broken").unlink()
    assert {k: v for k, v in store.index(str(repo)).items() if v} == {"unchanged": 2}
    os.utime(repo / "main.go", (1, 1))
    assert {k: v for k, v in store.index(str(repo)).items() if v} == {"unchanged": 2}  # same content
    (repo / "main.go").write_text(MAIN + "\nfunc more() { run() }\n")
    (repo / "lib/util.py").unlink()
    assert {k: v for k, v in store.index(str(repo)).items() if v} == {"updated": 1, "removed": 1}
    assert sorted(r[0] for r in store.table("symbols", rid).select("name").collect()) == ["Unused", "more", "run", "service"]
    assert store.table("refs", rid).count() == 3
    store.drop(str(repo))
    assert store.table("files").count() == 0
    store.drop(str(repo))


def test_freshness_and_version(spark, tmp_path, repo):
    store = Store(spark, tmp_path / "store")
    rid = repo_id(str(repo))
    assert store.should_refresh(rid)
    assert store.refresh(str(repo)) and not store.refresh(str(repo), timedelta(hours=1))
    later = datetime.now(UTC) + timedelta(seconds=11)
    assert store.should_refresh(rid, now=later) and not store.should_refresh(rid, timedelta(hours=1), now=later)
    assert store.should_refresh(rid, timedelta(seconds=-5), now=later)
    pointer = json.loads(store.files.read(store.pointer(rid)))
    write = lambda text: store.files.replace(store.pointer(rid), json.dumps(text), store.pointer(".draft"))
    write(pointer | {"version": 1})
    with pytest.raises(SchemaMismatchError):
        store.table("files")
    with pytest.raises(SchemaMismatchError):
        store.index(str(repo))
    del pointer["version"]
    write(pointer)
    assert store.table("files").count() == 2
    write(pointer | {"version": 1})
    assert store.index(str(repo), rebuild=True)["added"] == 2


def test_files_of_equal_hash_are_not_parsed(spark, tmp_path, repo, monkeypatch):
    store = Store(spark, tmp_path / "store")
    store.index(str(repo))
    (repo / "lib/bad.broken").unlink()
    os.utime(repo / "main.go", (1, 1))
    os.utime(repo / "lib/util.py", (1, 1))
    monkeypatch.setitem(registry.PARSERS, "go", int)  # would be an error
    monkeypatch.setitem(registry.PARSERS, "python", int)
    assert {k: v for k, v in store.index(str(repo)).items() if v} == {"unchanged": 2}
    (repo / "main.go").write_text(MAIN + "\n")
    found = store.index(str(repo))
    assert {k: found[k] for k in ("unchanged", "updated", "error")} == {"unchanged": 1, "updated": 0, "error": 1}
    assert store.table("symbols", repo_id(str(repo))).count() == 4  # the old rows stay


def test_readers_of_the_version_before_go_on(spark, tmp_path, repo):
    store = Store(spark, tmp_path / "store")
    store.index(str(repo))
    before = store.table("symbols")
    for k in range(3):
        (repo / "main.go").write_text(MAIN + f"\nfunc more{k}() {{}}\n")
        store.index(str(repo))
        assert before.count() >= 4  # planned before, and read after the new version
        before = store.table("symbols")
    folders = [n for n in store.files.names(f"{store.root}/{repo_id(str(repo))}")]
    assert len(folders) == 2  # the current one and the one before


def test_repositories_are_indexed_at_the_same_time(spark, tmp_path, monkeypatch):
    """Both are inside of their indexing at once, and neither loses the other's pointer."""
    import threading

    meet = threading.Barrier(2, timeout=120)
    listing = ingest.listing
    monkeypatch.setattr(ingest, "listing", lambda *a: (meet.wait(), listing(*a))[1])
    roots = [tmp_path / n for n in ("one", "two")]
    for root in roots:
        root.mkdir()
        (root / "a.go").write_text(f"package p\n\nfunc {root.name}() {{}}\n")
    stores = [Store(spark, tmp_path / "store") for _ in roots]
    threads = [threading.Thread(target=s.index, args=(str(r),)) for s, r in zip(stores, roots)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert sorted(r.name for r in stores[0].table("symbols").collect()) == ["one", "two"]


def test_stored_full_text_index(spark, tmp_path, repo):
    """The index gives what tokenising gives, reads only what holds a token, and follows changes."""
    store = Store(spark, tmp_path / "store")
    store.index(str(repo))
    for text in ("", "func more() { service() }\n"):
        (repo / "main.go").write_text(MAIN + text)
        store.index(str(repo))
        symbols, index = store.table("symbols"), store.table("postings")
        for query in ("serv", "load", "run", "zzz", "name : ^serv* OR load", '"def load" OR un*', "func* NOT unused"):
            own = sorted((r.name, round(r["rank"], 9)) for r in fulltext.ranked(symbols, query, index=index).collect())
            assert own == sorted((r.name, round(r["rank"], 9)) for r in fulltext.ranked(symbols.drop("words", "n_words", "symbol_id"), query).collect())
    assert fulltext.candidates(index, fulltext.parse_query("more").phrases()).count() == 1
    plan = fulltext.ranked(symbols, "more", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,more)" in plan


def test_api(spark, tmp_path, repo):
    (repo / "lib/bad.broken").unlink()
    other = tmp_path / "other"
    other.mkdir()
    (other / "remote.go").write_text("package r\n\nfunc remote() {}\n")
    api = Loupe(spark, tmp_path / "store", tmp_path / "config")
    root = str(repo)
    assert [r["name"] for r in json.loads(to_json(api.search(root, name="run")))] == ["run"]
    assert api.symbol(root, "service")[0]["body"] == "func service() {\n\tload()\n}\n"
    assert api.symbol(str(repo / "lib/util.py"), "load")[0]["body"].startswith("def load")
    assert api.symbols(str(repo / "main.go"))["symbols"][0]["name"] == "run"
    assert api.report(root)["total_symbols"] == 4
    assert [r["name"] for r in api.dead(root).collect()] == ["run", "Unused"]
    assert to_text(api.hotspots(root), "callee_name", "call_count") == "load     1\nservice  1"
    assert [r["caller_name"] for r in api.callers(root, "load", 1).collect()] == ["service"]
    from codeloupe.operators.aggregates import nested
    from codeloupe.operators.graph import caller_tree

    assert "run" in callers_text(caller_tree(api.callers(root, "load"), "load"))
    assert "lib/  1 files" in tree_text(nested(api.tree(root)))
    assert to_json(api.imports(root)) == "[]"

    ws = api.workspaces.create("w")
    api.workspaces.use("w")
    ws.add(root)
    ws.add(str(other))
    assert [("stats" in d) for d in api.index_workspace()] == [True, True]
    link = api.link((root, "service", ""), (str(other), "remote", "remote.go"), meta=["k=v"])
    assert api.links(check=True).select("id", "src_valid", "dst_valid").collect()[0] == (link, True, True)
    with pytest.raises(LookupError):
        api.link((root, "nothing", ""), (str(other), "remote", ""))
    found, warnings = api.search_workspace(like="r", limit=1)
    assert sorted(r["name"] for r in found.collect()) == ["remote", "run"] and not warnings
    result = api.simulate(root, "service", "rename_symbol:to=svc")
    assert {x["symbol"] for x in result["impacts"]} == {"run", "load", "remote", "service"} and result["scope"]["affected_repos"] == 2
    assert "Impact simulation for service" in impact_text(result)
    json.dumps(result)
    with pytest.raises(ValueError):
        api.simulate(root, " ", "rename_symbol:to=x")
    with pytest.raises(ValueError):
        api.index_workspace(concurrency=0)
    ws = api.workspaces.open()
    ws.remove(str(other))
    assert not ws.data["links"]
    api.workspaces.delete("w")
    assert api.workspaces.list() == [] and api.workspaces.current() == ""


def test_skipped_folders_are_not_entered(spark, tmp_path, monkeypatch):
    root = tmp_path / "vendor"  # the root's own name doesn't matter
    for path in ("a.go", "x [1]/{b}*.py", ".py", "node_modules/deep/c.js", ".git/d.py", "k=v/e.rs", "no", "f.txt"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x" if path != ".py" else "")  # one without a byte
    entered = []
    walk = os.walk
    monkeypatch.setattr(os, "walk", lambda top: (entered.append(x[0]) or x for x in walk(top)))
    found = ingest.listing(spark, str(root), "r")
    assert sorted(r.path for r in found.select("path").collect()) == [".py", "a.go", "k=v/e.rs", "x [1]/{b}*.py"]
    assert found.columns[:1] == ["repo_id"] and not [e for e in entered if "node_modules" in e or ".git" in e]
    assert ingest.listing(spark, str(tmp_path / "vendor/node_modules/deep"), "r").count() == 1
    (tmp_path / "empty").mkdir()
    assert ingest.listing(spark, str(tmp_path / "empty"), "r").count() == 0


def test_freshness_of_all_repositories(spark, tmp_path, repo):
    store = Store(spark, tmp_path / "store")
    assert store.freshness().count() == 0
    store.index(str(repo))
    later = datetime.now(UTC) + timedelta(seconds=11)
    assert [(r.repo_id, r.stale) for r in store.freshness(now=later).collect()] == [(repo_id(str(repo)), True)]
    assert [r.stale for r in store.freshness(timedelta(hours=1), later).collect()] == [False]
