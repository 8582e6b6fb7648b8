import json

from loomgraph.__main__ import main
from loomgraph.plans.engine import Options
from loomgraph.sources.files import with_order
from loomgraph.streaming import changes

DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -2 +2,2 @@\n+x\n"


def test_windows_and_contexts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text(json.dumps({"commit": "c1", "at": "2024-01-01T00:10:00Z", "text": DIFF}) + "\n")
    counted = changes.changed_per_window(changes.read_diffs(spark, str(inbox)))
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.path, r.lines) for r in spark.table("counted").collect()] == [("a.py", 2)]
    files = with_order(spark.createDataFrame([("a.py", 0, "def f():\n    return 1\n")], "path string, file_ord int, content string"))
    got = []
    q = changes.contexts(changes.read_diffs(spark, str(inbox)), files, Options(), lambda n, out: got.append((n, out)), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(got) == 1 and "`a.py` -> `f()`" in got[0][1]


def test_command_line(spark, tmp_path):
    from loomgraph.sources import git

    repo = tmp_path / "r"
    repo.mkdir()
    for args in (["init", "-q"], ["config", "user.email", "a@b"], ["config", "user.name", "a"]):
        git.run_git(str(repo), *args)
    for body in ("1", "2"):
        (repo / "a.py").write_text(f"def f():\n    return {body}\n")
        git.run_git(str(repo), "add", ".")
        git.run_git(str(repo), "commit", "-q", "-m", body)
    assert main([str(repo), "HEAD~1..HEAD", "--format", "json", "--output", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out_final.json").read_text())["modified_core_logic"][0]["func"] == "f"
