"""The shell parse: segments, groups, here-documents, git calls, and what is left unparsed."""

import pytest

from logloom.functions import shellparse as s


def segs(c):
    return [x["tokens"] for x in s.parse(c)["segments"]]


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("cat a.txt", [["cat", "a.txt"]]),
        ("a | b && c; d &", [["a"], ["b"], ["c"], ["d"]]),
        ("echo 'x; y' \"a|b\" c\\;d", [["echo", "x; y", "a|b", "c;d"]]),
        ("echo a # note; b", [["echo", "a"]]),
        ("a \\\n  b\nc", [["a", "b"], ["c"]]),
        ("if true; then cat a; fi", [["true"], ["cat", "a"]]),
        ("for f in x; do cat $f; done", [["f", "in", "x"], ["cat", "$f"]]),
        ("cat a 2>/dev/null", [["cat", "a", "2", ">", "/dev/null"]]),
        ("echo $(rm -rf x) `y` <(z)", [["echo", s.SUBSTITUTION, s.SUBSTITUTION, s.SUBSTITUTION]]),
        ("(a; b)", [["a"], ["b"]]),
    ],
)
def test_segments(command, want):
    assert segs(command) == want


@pytest.mark.parametrize("command", [None, 5, [], "", "echo 'x", 'echo "x', "echo $(x", "echo `x", "x" * (s.MAX_COMMAND + 1), "$(" * 3000])
def test_skipped(command):
    assert s.parse(command)["skipped"]


def test_groups_and_redirects():
    one = lambda c, k=0: {n: s.parse(c)["segments"][k][n] for n in ("redirected", "alone", "unsure")}
    assert one("cat a") == {"redirected": False, "alone": True, "unsure": False}
    assert one("cat a | wc")["alone"] is False
    assert one("(cat a) > f")["redirected"] and one("{ cat a; } | wc")["alone"] is False
    assert one("( (cat a) ) | wc")["alone"] is False
    assert one("{ cat a")["unsure"] and one("(cat a) word")["unsure"]
    assert not one("then (cat a) fi")["unsure"]
    assert one("echo '{' cat")["unsure"] is False


def test_heredocs():
    p = s.parse("cat <<EOF > f\none\ntwo\nEOF\ncat <<-'X'\n\tin\n\tX\necho done")
    assert p["heredocs"] == ["one\ntwo", "\tin"] and [x["program"] for x in p["segments"]] == ["cat", "cat", "echo"]
    assert s.parse("grep '<<EOF' f")["heredocs"] == [] and s.parse("cat <<< word")["heredocs"] == []
    assert s.parse("cat <<E\n  E\nbody")["heredocs"] == ["  E\nbody"]
    m = s.parse("git commit -m \"$(cat <<'EOF'\nfix: it\nEOF\n)\"")
    assert m["heredocs"] == ["fix: it"] and m["git"][0]["message_unread"]


def test_git():
    g = lambda c: s.parse(c)["git"]
    assert g("git -C d -c a.b=1 -c A.B=2 commit -am 'feat: x' --no-verify")[0] | {} == {
        "sub": "commit", "args": ["-am", "feat: x", "--no-verify"], "configs": ["A.B=2"], "message": "feat: x", "message_unread": False, "configs_unread": False,
        "tokens": ["git", "-C", "d", "-c", "a.b=1", "-c", "A.B=2", "commit", "-am", "feat: x", "--no-verify"],
    }
    assert g("X=1 git push")[0]["sub"] == "push" and g("echo git push") == [] and g("git --version") == []
    assert [g(f"git commit {a}")[0]["message"] for a in ("-m x", "--message=x", "-mx", "-- -m x", "-Fm x", "-m")] == ["x", "x", "x", None, None, None]


def test_words():
    p = s.parse("A=1 B=2 /usr/bin/npm --prefix web run test -- x > out")["segments"][0]
    assert (p["assigned"], p["program"], p["first_operand"]) == (["A", "B"], "npm", "run")
    assert s.parse("cat -n a b < c")["segments"][0]["n_operands"] == 2
    assert s.normalise("cd  a\\ b &&  ls   -l") == "ls -l" and s.normalise("cd a\\&& ls") == "cd a\\&& ls"
