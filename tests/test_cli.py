"""The command line, from a listing to an unpacked tree."""

import io
import os
import tarfile

import pytest

from arcframe import cli


@pytest.fixture
def packed(spark, tmp_path):
    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "lib" / "a.so").write_bytes(b"so" * 5000)
    (src / "input").write_bytes(b"hello")
    os.link(src / "input", src / "lib" / "same")
    (tmp_path / "list.txt").write_text('dir /bin 0755 0 0\nfile "/bin/my tool" 0755 1 2 input\nslink /sh 0777 0 0 bin/tool\nsock /s 0600 0 0\n')
    assert cli.main(["pack", "-q", "-F", str(tmp_path / "list.txt"), "-D", str(src), "-c", "gzip", "-b", "8k", str(tmp_path / "l.img")]) == 0
    assert cli.main(["pack", "-D", str(src), "-c", "zstd", "-X", "level=3", "--all-root", "-e", str(tmp_path / "d.img")]) == 0
    return tmp_path


def test_inspecting(packed, capfd):
    img = str(packed / "l.img")
    assert cli.main(["inspect", "-l", "/bin", img]) == 0 and cli.main(["inspect", "-c", "bin/my tool", img]) == 0
    assert cli.main(["inspect", "-s", "bin/my tool", img]) == 0 and cli.main(["inspect", "-d", "-S", img]) == 0 and cli.main(["inspect", "-x", "bin", img]) == 0
    assert cli.main(["inspect", "-l", "none", img]) == 1
    out = capfd.readouterr().out
    assert "-rwxr-xr-x 1/2 5 my tool" in out and "hello" in out and "permissions: 0755" in out and 'file "bin/my tool" 0755 1 2' in out and "sock s" not in out
    assert cli.main(["inspect", "-u", "/", "-p", str(packed / "out"), "-T", "-C", "-S", img]) == 0
    assert (packed / "out" / "bin" / "my tool").read_bytes() == b"hello" and not (packed / "out" / "s").exists()


def test_converting(packed, capfd):
    img, archive, back = (str(packed / n) for n in ("d.img", "d.tar", "e.img"))
    assert cli.main(["to-tar", "-c", "gzip", img, archive]) == 0
    with tarfile.open(archive) as t:
        assert {m.name for m in t} == {"input", "lib", "lib/a.so", "lib/same"}
    assert cli.main(["from-tar", "-c", "xz", archive, back]) == 0
    assert cli.main(["from-tar", archive, back]) == 1  # it exists
    assert cli.main(["diff", "-a", img, "-b", back]) == 0
    assert cli.main(["diff", "-a", img, "-b", back, "-S"]) == 1
    assert cli.main(["from-tar", "-f", "-r", "lib", "-E", "*.so", archive, back]) == 1  # a link out of the new root
    assert cli.main(["from-tar", "-f", "-r", "lib", "-E", "*.so", "-E", "*same", archive, back]) == 0
    assert cli.main(["diff", "-a", img, "-b", back, "-e", str(packed / "x")]) == 1
    assert "< lib/a.so" in capfd.readouterr().out and (packed / "x" / "old" / "lib" / "a.so").exists()
    assert cli.main(["to-tar", "-d", "bin", "-r", "top", str(packed / "l.img"), archive]) == 0
    with tarfile.open(archive) as t:
        assert {m.name for m in t} == {"top", "top/my tool"}
    assert cli.main(["diff", "-a", img, "-b", str(packed / "none.img")]) == 2


def test_browsing(packed, capfd, monkeypatch):
    lines = ["pwd", "ls", "cd bin", "pwd", 'cat "my tool"', 'stat "my tool"', "cd none", "cat", "nonsense", "'open", "tree /", "exit", "ls"]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines) + "\n"))
    assert cli.main(["browse", str(packed / "l.img")]) == 0
    out, err = capfd.readouterr()
    assert out.index("/\n") < out.index("bin\n") < out.index("/bin\n") < out.index("hello") < out.index("permissions: 0755") < out.index("exit") < out.index("  my tool")
    assert "NotADirectoryError" in err and "FileNotFoundError" in err and "closing quotation" in err


def test_sizes():
    assert [cli.size(s) for s in ("5", "8k", "1M", "2g")] == [5, 8192, 1 << 20, 2 << 30]
    for wrong in ("", "k", "x", "50%"):
        with pytest.raises(Exception, match="size"):
            cli.size(wrong)
