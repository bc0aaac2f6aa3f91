"""Listing by tasks, ignore rules against git's own answer, and names of any kind."""

import shutil
import subprocess

import pytest

from ragloom.sources import files

#: (rule, path, whether it is a folder, whether the rule leaves it out)
TABLE = [
    ("*.log", "a.log", False, True), ("*.log", "x/y/a.log", False, True), ("*.log", "a.log.txt", False, False),
    ("a/*.txt", "a/b.txt", False, True), ("a/*.txt", "a/b/c.txt", False, False), ("a/*.txt", "z/a/b.txt", False, False),
    ("/top.txt", "top.txt", False, True), ("/top.txt", "x/top.txt", False, False), ("build/", "build", True, True), ("build/", "build", False, False), ("build/", "x/build", True, True),
    ("**/foo", "foo", False, True), ("**/foo", "a/b/foo", False, True), ("a/**", "a/b/c", False, True), ("a/**", "a", True, False), ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True), ("a/**/b", "a/xb", False, False),
    ("a**b", "axxb", False, True), ("a**b", "ax/xb", False, False), ("?.c", "x.c", False, True), ("?.c", "xy.c", False, False), ("a?b", "a/b", False, False),
    ("[abc].o", "b.o", False, True), ("[!abc].o", "b.o", False, False), ("[!abc].o", "d.o", False, True), ("[a-c]1", "b1", False, True), ("[]x]", "]", False, True), ("[[:digit:]]x", "7x", False, True),
    (r"\#a", "#a", False, True), ("#a", "#a", False, False), (r"\!a", "!a", False, True), (r"a\*b", "a*b", False, True), (r"a\*b", "axb", False, False), ("a ", "a", False, True), (r"a\ ", "a ", False, True),
    ("{x}", "{x}", False, True), ("a+b", "a+b", False, True), ("a.b", "axb", False, False),
]


def test_rules():
    for line, path, is_dir, out in TABLE:
        compiled = files.rule(line)
        got = compiled is not None and files.ignored(f"/r/{path}", is_dir, [("/r", compiled)])
        assert got is out, (line, path, is_dir)
    back = [("/r", files.rule("*.txt")), ("/r", files.rule("!keep.txt")), ("/r/sub", files.rule("keep.txt"))]
    assert not files.ignored("/r/keep.txt", False, back) and files.ignored("/r/sub/keep.txt", False, back) and files.rule("") is None and files.rule("!!x")[1]


@pytest.fixture
def tree(tmp_path):
    names = ["a.txt", "sub/b.md", ".hidden.txt", ".dot/c.txt", "_under.txt", "d.bin", "e f%20g.txt", "{x}.txt", "[a].txt", "a*b.txt", "q?.txt", "logs/one.log", "logs/keep.log", "a/t.txt", "a/b/c.txt", "build/x.txt", "deep/build/y.txt", "deep/er/z.tmp", "#note", "!bang", "é.txt", "back\\slash.txt"]
    root = tmp_path / "tree"
    for at in names:
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        if not (root / at).is_dir():
            (root / at).write_bytes(b"\0" if at == "d.bin" else at.encode())
    (root / ".gitignore").write_text("*.log\n!keep.log\na/*.txt\nbuild/\n\\#note\n\\!bang\n# words\n\n*.tmp  \n")
    (root / "deep/.gitignore").write_text("!*.tmp\n!build/\n")
    (root / "sub/link.txt").symlink_to(root / "a.txt")
    return root


@pytest.mark.filterwarnings("ignore")
def test_listing_equals_git(spark, tree, tmp_path):
    got = {r.uri.removeprefix(f"{tree}/") for r in files.list_files(spark, str(tree), f"file://{tmp_path}/list").collect()}
    assert got == {".gitignore", "deep/.gitignore", "a.txt", "sub/b.md", ".hidden.txt", ".dot/c.txt", "_under.txt", "d.bin", "e f%20g.txt", "{x}.txt", "[a].txt", "a*b.txt", "q?.txt", "logs/keep.log", "a/b/c.txt", "deep/build/y.txt", "deep/er/z.tmp", "é.txt", "back\\slash.txt"}
    if shutil.which("git"):
        subprocess.run(["git", "init", "-q", str(tree)], check=True, capture_output=True)
        said = subprocess.run(["git", "-C", str(tree), "ls-files", "-z", "--others", "--exclude-standard"], check=True, capture_output=True).stdout.decode()
        assert got == {p for p in said.split("\0") if p} - {"sub/link.txt"}


def test_names_are_no_patterns(spark, tree, tmp_path):
    listed = files.list_files(spark, str(tree), f"file://{tmp_path}/list", ("txt",), ("deep*", ".dot/*"))
    got = {r.uri.removeprefix(f"{tree}/"): r.text for r in files.read_files(listed).collect()}
    assert got == {n: n for n in ("a.txt", ".hidden.txt", "_under.txt", "e f%20g.txt", "{x}.txt", "[a].txt", "a*b.txt", "q?.txt", "a/b/c.txt", "é.txt", "back\\slash.txt")}
