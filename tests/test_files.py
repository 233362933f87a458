"""File access, locally and through Hadoop's interface, behaves alike."""

from __future__ import annotations

import pytest

from lamina.sources.files import HadoopFiles, LocalFiles, files_at
from lamina.sources.txlog import TxLog


@pytest.mark.parametrize("kind", ("local", "hadoop"))
def test_files(spark, tmp_path, kind):
    root = f"file://{tmp_path}/db"
    files = LocalFiles(root) if kind == "local" else HadoopFiles(spark, root)
    files.make("_log")
    assert files.write_new("_log/a", b"one") and not files.write_new("_log/a", b"two")
    assert files.read("_log/a") == b"one" and files.size("_log/a") == 3
    assert [n for n in files.list("_log") if not n.startswith(".")] == ["a"]
    outside = tmp_path / "outside"
    outside.write_bytes(b"xyz")
    files.copy_in(f"file://{outside}", "data/in")
    files.copy_in(f"file://{outside}", "data/moved", move=True)
    assert files.read("data/in") == files.read("data/moved") == b"xyz" and not outside.exists()
    files.delete("data")
    assert files.list("data") == []


def test_log_over_hadoop(spark, tmp_path):
    files = HadoopFiles(spark, f"file://{tmp_path}/db")
    log = TxLog(files, checkpoint_every=2)
    state = log.state()
    for i in range(5):
        after = log.commit(state, {"ops": [[0, 1, "aw==", "dg==", None]], "start_seq": i + 1, "last_seq": i + 1})
        assert log.commit(state, {}) is None  # the version is taken
        state = after
    assert TxLog(files).state().last_seq == 5 and len(TxLog(files).state().inline) == 5


def test_scheme_decides(spark, tmp_path):
    assert isinstance(files_at(spark, str(tmp_path)), LocalFiles)
    assert isinstance(files_at(spark, f"file://{tmp_path}"), LocalFiles)
