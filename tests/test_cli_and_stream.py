from stackloom import cli
from stackloom.streaming.calls import closed_calls
from tests import traces


def test_tools(spark, tmp_path, capsys):
    path = traces.write(tmp_path, "t", {p: traces.event_lines(f, p) for p, f in zip((1, 2), traces.SIMILAR["a"], strict=True)})
    run = lambda *words: (cli.run(cli.parser().parse_args([*words[:1], *words[1:], path]), spark), capsys.readouterr().out)[1].splitlines()
    assert run("call-list", "-p") == ["1 Process 1", "2 Process 2"]
    assert run("call-matrix", "--group", "0.9") == ["1", "2"]
    assert run("call-matrix", "--simple-similarity") == ["#group: processes", "  1: 1", "  2: 2", "", "#group x group", "0.71"]
    assert run("call-matrix", "--compressed-txt")[-1].startswith("all: callers 5, callees 5, both 6")
    assert any("root function -> F1" in x for x in run("call-matrix", "--compressed-txt2"))
    assert any("all objects: 1, 2" in x for x in run("call-list", "--compressed-txt"))
    assert any("F1 -> F2" in x for x in run("profile", "-m", "-n")) and any("F1 -> F2 -> F4" in x for x in run("profile", "-t", "-n"))
    assert run("profile", "-f")[0] == "1000 Application" and run("profile", "-f")[1].startswith("\t1 F1")
    assert run("call-list", "-u")[0].startswith("functions: { 1 : F1")
    assert run("diff", "--tree-diff")[0] == "=1" and run("diff", "--extract", "--least", "2")[0].endswith("t-extract-p1-p2-1-1-1.otf")
    assert run("tikz")[0].startswith("\\definecolor{1}{RGB}{") and any("1: F1" in x for x in run("call-tree", "--dot", "-n"))
    run("call-matrix", "-%2", "--simple-similarity")
    assert run("similarity", "--metric", "scm") == ["1.00 0.71", "0.71 1.00"]
    assert any("F3" in x for x in run("call-list", "-n"))
    assert run("diff", "--flat-score")[0].startswith("0 ")
    assert run("call-tree", "--compressed-dot")[0] == "digraph {"


def test_stream(spark, tmp_path):
    rows = [(1, 1, 0, "E", 1), (1, 2, 2, "E", 2), (1, 3, 5, "L", 2), (2, 1, 0, "L", 9), (2, 2, 1, "E", 4)]
    later = [(1, 4, 9, "L", 1), (2, 3, 4, "L", 4)]
    schema = "process long, line long, ts long, kind string, function int"
    for part in (rows, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = closed_calls(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2, 1, 2, 2, 5, 3, 3), (1, 1, 0, 1, 0, 9, 9, 6), (2, 4, 0, 1, 1, 4, 3, 3)}
