import json

from pyspark.sql import functions as F

from ripplegraph.sources import diff, reports, source_code

DIFF = '''diff --git a/app/a.py b/app/a.py
index 1..2 100644
--- a/app/a.py
+++ b/app/a.py
@@ -3,2 +3,4 @@ def f
+++ b/not_a_header.py
@@ -20 +22 @@
+x
@@ -30,2 +33,0 @@
-y
diff --git a/old.py b/old.py
deleted file mode 100644
--- a/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
diff --git a/m.py b/n.py
similarity index 100%
rename from m.py
rename to n.py
diff --git a/run.py b/run.py
old mode 100644
new mode 100755
diff --git a/empty.py b/empty.py
new file mode 100644
diff --git a/odd.py b/odd.py
index 3..4
diff --git "a/caf\\303\\251.py" "b/caf\\303\\251.py"
--- "a/caf\\303\\251.py"
+++ "b/caf\\303\\251.py"
@@ -1 +1 @@
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1 +1 @@
'''


def test_diff(spark):
    parsed = diff.blocks(spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "diff_id long, text string"))
    assert {tuple(r)[1:] for r in diff.changed_ranges(parsed).collect()} == {("app/a.py", 3, 6), ("app/a.py", 22, 22), ("app/a.py", 33, 34), ("café.py", 1, 1)}
    assert {tuple(r)[1:] for r in diff.whole_files(parsed).collect()} == {("old.py", "deleted"), ("m.py", "renamed from"), ("n.py", "renamed to"), ("odd.py", "unparseable diff header")}
    assert {r["path"] for r in diff.all_paths(parsed).collect()} == {"app/a.py", "old.py", "m.py", "n.py", "run.py", "empty.py", "odd.py", "café.py", "README.md"}


def test_unquote():
    assert diff.unquote(r'"a\"b\\c\t"') == 'a"b\\c\t' and diff.unquote("plain") == "plain" and diff.unquote(r'"\303\251"') == "é"
    assert diff.unquote(r'"a\8b\9"') == "a8b9" and diff.unquote(r'"\377"') == "\udcff"


def test_quoted_bytes_that_are_no_text(spark):
    text = 'diff --git "a/x\\377\\8.py" "b/x\\377\\8.py"\n--- "a/x\\377\\8.py"\n+++ "b/x\\377\\8.py"\n@@ -1 +1 @@\n'
    parsed = diff.blocks(spark.createDataFrame([(1, text)], "diff_id long, text string"))
    assert [r["file_path"] for r in diff.changed_ranges(parsed).collect()] == ["x\\xff8.py"]


def test_junit(spark, tmp_path):
    (tmp_path / "j.xml").write_text(
        '<testsuite><testcase classname="tests.t.C" name="ok" time="0.5"/><testcase classname="tests.t" name="bad" time="x"><failure message="a &lt; b">x</failure></testcase>'
        '<testcase name="err"><error/><skipped/></testcase><testcase classname="c" name="s"><skipped message="later"/></testcase></testsuite>'
    )
    got = {r["key"]: (r["status"], r["duration_s"], r["message"]) for r in reports.read_junit(spark, str(tmp_path)).collect()}
    assert got == {"tests.t.C.ok": ("pass", 0.5, None), "tests.t.bad": ("fail", None, "a < b"), "err": ("error", None, None), "c.s": ("skip", None, "later")}


def spec(name, status, cases, message=""):
    return {"name": name, "status": status, "message": message, "assertionResults": [{"ancestorTitles": a, "title": t, "status": s} for a, t, s in cases]}


def test_spec_report(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "r.json").write_text(json.dumps({"testResults": [spec("/r/src/a.test.ts", "passed", [(["d"], "one", "passed"), (["d"], "two", "todo"), (["d"], "x", "skipped"), (["d"], "x", "skipped")])]}))
    rows, refused = reports.read_specs(spark, str(tmp_path / "ok"), "/r")
    assert {(r["test_id"], r["status"]) for r in rows.collect()} == {("src/a.test.ts::d > one", "pass"), ("src/a.test.ts::d > two", "skip"), ("src/a.test.ts::d > x", "skip")}
    assert refused.count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "r.json").write_text(json.dumps({"testResults": [spec("/r/a.ts", "failed", [([], "q", "skipped")]), spec("/r/b.ts", "passed", [([], "t", "passed"), ([], "t", "passed"), ([], "p", "pending")])]}))
    _, refused = reports.read_specs(spark, str(tmp_path / "bad"), "/r")
    assert {r["reason"] for r in refused.collect()} == {"failed outside any test", "shared id", "never finished"}


def test_nested_suites(spark, tmp_path):
    one = lambda title, tags, status, last: {"title": title, "tags": tags, "tests": [{"status": status, "results": [{"status": last}] if last else []}]}
    report = {"suites": [{"specs": [one("a", ["tg:J1"], "expected", "passed")], "suites": [{"suites": [{"specs": [one("b", ["tg:J1", "tg:J7"], "expected", "failed"), one("c", [], "unexpected", "failed")]}]}]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    hit, stray, unknown = reports.suite_statuses(reports.read_suites(spark, str(tmp_path)), spark.createDataFrame([("J1",)], "journey string"))
    assert {(r["title"], r["status"]) for r in hit.collect()} == {("a", "expected"), ("b", "expected-not-passed")}
    assert [r["title"] for r in stray.collect()] == ["c"] and [r["journey"] for r in unknown.collect()] == ["J7"]


def test_trace_parts(spark, tmp_path):
    for n, tests in enumerate([{"a": [["x.py", "f"]]}, {"a": [], "b": None}]):
        (tmp_path / f"{n}.json").write_text(json.dumps({"root": "/r", "tests": tests, "declared": {}, "duplicates": ["z"] if n else []}))
    (tmp_path / "torn.json").write_text('{"root": "/r", "tests": {"a":')
    (tmp_path / "list.json").write_text('["not a trace"]')
    (tmp_path / "bare.json").write_text('{"root": "/r"}')
    traces, odd = reports.read_traces(spark, str(tmp_path))
    assert sorted(r["file"].rsplit("/")[-1] for r in odd.collect()) == ["bare.json", "list.json", "torn.json"]
    tests, refused = reports.merge_parts(traces)
    assert tests.count() == 3 and {r["test"] for r in refused.collect()} == {"a", "z"}


PYTHON = '''
import os.path as p
from .svc import append as ap, read
from . import ledger

@app.get("/x")
def handler(rows=None):
    def inner():
        return 1
    rows.append(3)
    return ap(ledger.write(rows)), helper(), inner()

def helper():
    [].append(1)
    return self.run()

class K:
    @app.post("/y")
    def m(self): ...
'''


def sources(spark):
    return spark.createDataFrame([("app/main.py", PYTHON), ("app/bad.py", "def ("), ("tests/test_a.py", "@app.get('/t')\ndef t(): ...")], "path string, content string")


def test_python_facts(spark):
    src = sources(spark)
    assert {tuple(r) for r in source_code.route_handlers(src).collect()} == {("app/main.py", "handler", "GET", "/x"), ("app/bad.py", None, None, None)}
    names = {(r["name"], r["how"]) for r in source_code.definitions(src).where("path = 'app/main.py'").collect()}
    assert {("handler", "def"), ("K", "def"), ("m", "method"), ("p", "import"), ("ap", "import")} <= names and ("inner", "def") not in names
    assert {(r["frm"], r["nxt"]) for r in source_code.call_graph(src).collect()} >= {("handler", "helper"), ("handler", "inner")}


def test_source_support(spark):
    src = sources(spark)
    edges = [(1, "append", "app/svc.py", "function"), (2, "write", "app/ledger.py", "function"), (3, "append", "app/ledger.py", "function"), (4, "helper", "app/main.py", "function"), (5, "inner", "app/main.py", "function"), (6, "append", "x/list.py", "method")]
    rows = [(i, "app/main.py", "handler", "function", path, name, kind) for i, name, path, kind in edges] + [(7, "app/bad.py", "f", "function", "a.py", "b", "function"), (8, "app/main.ts", "f", "function", "a.py", "b", "function")]
    e = spark.createDataFrame(rows, "id long, caller_path string, caller string, caller_kind string, callee_path string, callee string, callee_kind string")
    got = {r["id"]: r["support"] for r in source_code.source_support(e, source_code.references(src), source_code.import_bindings(src), source_code.definitions(src)).collect()}
    assert got == {1: "supported", 2: "supported", 3: "unsupported", 4: "supported", 5: "supported", 6: "supported", 7: "unknown", 8: "unknown"}


def test_app_entries(spark):
    src = spark.createDataFrame(
        [
            ("src/app/(g)/users/[id]/route.ts", "export async function GET() {}\nexport const POST = x\n"),
            ("src/app/page.tsx", "export default function Home() {}\n"),
            ("src/lib/page.tsx", "export default function No() {}\n"),
            ("src/app/login/actions.ts", "// c\n'use server'\nexport async function go() {}\nexport const act = async () => {}\n"),
            ("src/app/login/page.tsx", "function f() {\n  'use server'\n}\nexport default Login;\n"),
        ],
        "path string, content string",
    )
    got = {(r["name"], r["method"], r["route"]) for r in source_code.app_entries(src).collect()}
    assert got == {("GET", "GET", "/users/[id]"), ("POST", "POST", "/users/[id]"), ("Home", "PAGE", "/"), ("go", "ACTION", "/login"), ("act", "ACTION", "/login"), ("Login", "PAGE", "/login")}


def test_sources_pass_over_environments(spark, tmp_path):
    for name in ["a.py", "env/pyvenv.cfg", "env/b.py", "node_modules/c.py", "x/d.py", "x/e.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    assert {r["path"] for r in source_code.read_sources(spark, str(tmp_path), [".py"]).collect()} == {"a.py", "x/d.py"}


def test_last_line(spark):
    df = spark.createDataFrame([("def f():\n    x = 1\n    # end\n\n",), ("",)], "t string")
    assert [r[0] for r in df.select(source_code.last_substantive_line(F.col("t"))).collect()] == ["    x = 1", None]
