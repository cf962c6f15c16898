import json

from strongroom.__main__ import main


def test_life_of_a_vault(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("STRONGROOM_PASSWORD", "one")
    tree, vault = tmp_path / "tree", str(tmp_path / "v")
    (tree / "docs").mkdir(parents=True)
    (tree / "docs/a.md").write_bytes(b"hello")
    (tree / "b.txt").write_bytes(b"")
    run = lambda *a: main([*a], spark)
    assert run("create", vault, "--memory", "128") == 0 and run("add", vault, str(tree)) == 0
    assert capsys.readouterr().out.split() == ["2"]
    assert run("rename", vault, "b.txt", "c.txt") == 0 and run("list", vault) == 0
    assert capsys.readouterr().out == "c.txt\t0\t0\ndocs/a.md\t5\t33\n"
    assert run("extract", vault, "docs/a.md", str(tmp_path / "out")) == 0 and (tmp_path / "out").read_bytes() == b"hello"
    monkeypatch.setenv("STRONGROOM_NEW_PASSWORD", "two")
    assert run("passwd", vault, "--memory", "128") == 0 and run("info", vault) == 1
    monkeypatch.setenv("STRONGROOM_PASSWORD", "two")
    capsys.readouterr()
    assert run("info", vault) == 0 and json.loads(capsys.readouterr().out)["generation"] == 3
    assert run("delete", vault, "c.txt") == 0 and run("delete", vault, "c.txt") == 1 and run("compact", vault) == 0
