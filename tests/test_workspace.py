import json

import pytest

from codeloupe.model import SchemaMismatchError
from codeloupe.operators import workspace
from codeloupe.sources.workspaces import Workspace, Workspaces
from tests.helpers import symbols, tuples


def test_links_validate(spark):
    syms = symbols(spark, [("src/a.go", "f", "function", 1, 2), ("src/b.go", "g", "function", 1, 2), ("lib/b.go", "g", "function", 1, 2), ("z.go", "h", "function", 1, 2)], "r1")
    rows = [(1, "f", "src/a.go"), (2, "f", "a.go"), (3, "g", "b.go"), (4, "h", "else.go"), (5, "none", "x.go")]
    links = spark.createDataFrame([(i, "r1", s, f, "gone", "x", "", "", i) for i, s, f in rows], "id long, src_repo_id string, src_symbol string, src_file string, dst_repo_id string, dst_symbol string, dst_file string, note string, created_at long")
    found = workspace.validate_links(links, syms, spark.createDataFrame([("r1",)], "id string"))
    got = {r["id"]: (r["src_valid"], r["src_actual_file"], r["src_error"]) for r in found.collect()}
    assert got[1] == (True, "src/a.go", None)
    assert got[2] == (False, "src/a.go", None)
    assert got[3][:2] == (False, None) and "ambiguous" in got[3][2]
    assert got[4] == (False, "z.go", None)
    assert got[5][0] is False and "not found" in got[5][2]
    assert found.filter("dst_valid IS NOT NULL").count() == 0 and found.filter("dst_error IS NULL").count() == 0


def test_links_filter(spark):
    links = spark.createDataFrame([(1, "a", "f", "b", "g", 2), (2, "b", "g", "c", "h", 1)], "id long, src_repo_id string, src_symbol string, dst_repo_id string, dst_symbol string, created_at long")
    ids = lambda **q: [r[0] for r in tuples(workspace.list_links(links, **q), "id")]
    assert ids() == [2, 1] and ids(repo="b") == [2, 1] and ids(src_repo="b") == [2] and ids(dst_repo="b") == [1] and ids(src_symbol="f", dst_symbol="g") == [1]


def test_meta(spark):
    links = spark.createDataFrame([(1,), (2,)], "id long")
    meta = spark.createDataFrame([(1, "b", "2"), (1, "a", "1")], "link_id long, key string, value string")
    assert sorted(tuples(workspace.with_meta(links, meta), "id", "meta")) == [(1, {"a": "1", "b": "2"}), (2, {})]
    assert workspace.parse_meta(["a=b=c", "d="]) == {"a": "b=c", "d": ""}
    with pytest.raises(ValueError):
        workspace.parse_meta(["=x"])


def test_catalogue_of_workspaces(tmp_path):
    all_ = Workspaces(tmp_path)
    ws = all_.create("one")
    a, b = ws.add("/x/a"), ws.add("/x/b")
    assert ws.add("/x/a") == a and len(ws.data["repositories"]) == 2
    link = ws.link((a, "f", "a.go"), (b, "g", "b.go"), meta={"k": "v"})
    ws.set_meta(link, "k", "w")
    assert Workspace(ws.file).data["links"][0]["meta"] == {"k": "w"}
    ws.unlink(link)
    for wrong in (lambda: ws.unlink(link), lambda: ws.remove("/x/c"), lambda: all_.open("none"), lambda: all_.use("none"), lambda: all_.open(), lambda: ws.link(("q", "f", ""), (b, "g", ""))):
        with pytest.raises(LookupError):
            wrong()
    ws.file.write_text(json.dumps(ws.data | {"version": 1}))
    with pytest.raises(SchemaMismatchError):
        all_.open("one")
