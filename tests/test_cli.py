import json

from srclattice import cli


def tree(tmp_path, java, stop=""):
    (tmp_path / "A.java").write_text(java)
    (tmp_path / ".srclattice.yaml").write_text(f"architecture:\n  chainStopMethods: [{stop}]\n")
    return str(tmp_path)


def test_chains_stop_at_configured_methods(spark, tmp_path, capsys):
    root = tree(tmp_path, "class A { void main() { onClick(); } void onClick() { b(); } void b() { } }", '"on*"')
    assert cli.main(["call-chain", "A.b", "--root", root, "--json"]) == 0
    assert [json.loads(x)["chain"] for x in capsys.readouterr().out.splitlines()] == ["A.onClick -> A.b"]


def test_cut_output_says_so(spark, tmp_path, capsys):
    root = tree(tmp_path, "class A { " + " ".join(f"void m{i}() {{ }}" for i in range(60)) + " }")
    assert cli.main(["unused", "--root", root, "--json"]) == 0
    said = capsys.readouterr()
    assert len(said.out.splitlines()) == 50 and "50 of 60 rows" in said.err


def test_stop_names():
    assert cli._stop([]) is None and cli._stop(["get$*", "run"]) == r"^(?:get\$.*|run)$"
