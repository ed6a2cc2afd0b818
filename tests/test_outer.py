"""Command line, schema and streaming."""

import json

from quire.cli import main, parser, result
from quire.operators import chunk
from quire.operators.json_schema import json_schema
from quire.schema import TYPES
from quire.streaming.documents import each_batch


def test_schema(capsys):
    assert main(["schema"]) == 0
    s = json.loads(capsys.readouterr().out)
    assert {e["properties"]["type"]["const"] for e in s["properties"]["elements"]["items"]["oneOf"]} == set(TYPES) and s == json_schema()


def test_commands(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.txt").write_text("# T\n\none\n")
    (tmp_path / "b" / "x.txt").write_text("# T\n\ntwo\n")
    run = lambda *argv: result(spark, parser().parse_args(list(argv))).collect()
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert [(r.etype, r.n) for r in run("parse", a)] == [("heading", 1), ("paragraph", 1)]
    assert run("convert", a, "--to", "markdown")[0].markdown == "# T\n\none\n"
    assert [(r.change_type, r.old_value, r.new_value) for r in run("diff", a, b)] == [("modified", "one", "two")]
    assert run("chunk", a)[0].text == "# T\n\none" and "<h1>T</h1>" in run("render", a)[0].html
    assert "# T" in run("strip", a)[0].text and run("info", a)[0].text == "T"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("# T\n\none\n\n# U\n\ntwo")
    q = each_batch(spark, str(tmp_path / "in"), chunk.semantic, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["# T\n\none", "# U\n\ntwo"]
