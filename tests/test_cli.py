"""The command line over a small repository of its own."""

import json
import subprocess

from codegrain import cli
from tests.test_build import FILES
from tests.test_io_and_workflow import Stub


class Quiet(Stub):
    """Finds something in the first batch only, whatever its id."""

    def chat(self, purpose, request):
        if purpose == "first_pass":
            found = {"status": "CANDIDATE", "title": "One Finding", "reason": "r", "chunk_ids": [], "context_symbols": []}
            return {"result": {"findings": [found], "truncated": False, "review": ["x"] * 5}, "prompt_tokens": 3, "output_tokens": 1}
        return super().chat(purpose, request)


def test_build_rank_analyse_verify(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True).stdout.decode().strip()
    repo.mkdir()
    run("init", "-q")
    for path, text in {**FILES, "notes.txt": "not in scope\n"}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_bytes("// caf\xe9\n".encode("cp1252") if text is None else text.encode())
    run("add", "-A")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "t")
    commit = run("rev-parse", "HEAD")
    (repo / "src/a.c").write_text("changed after the commit")
    tables = f"{tmp_path}/tables"

    def call(*argv):
        code = cli.main(list(argv), spark, Quiet)
        return code, json.loads(capsys.readouterr().out)

    code, got = call("build", "--repository", str(repo), "--commit", commit, "--out", tables, "--seed", "5", "--check-repeats")
    assert code == 0 and got["counts"]["source_file_count"] == len(FILES) and got["reproducible"]
    assert got["counts"]["source_bytes"] == got["counts"]["mapped_source_bytes"]
    code, got = call("verify", "--tables", tables, "--repository", str(repo), "--commit", commit, "--seed", "5")
    assert code == 0, got
    assert call("verify", "--tables", tables, "--repository", str(repo), "--commit", commit, "--seed", "6")[0] in (0, 1)
    code, got = call("rank", "--tables", tables, "--top", "1")
    assert code == 0 and len(got["top_batches"]) == 1
    code, got = call("analyse", "--tables", tables, "--out", f"{tmp_path}/out", "--mode", "priority", "--dry-run")
    assert code == 0 and got["batch_count"] >= 1 and got["evidence_bytes"] > 0
    assert call("analyse", "--tables", tables, "--out", f"{tmp_path}/out", "--mode", "all", "--dry-run", "--repository", str(repo), "--commit", commit)[0] == 0
    code, got = call("analyse", "--tables", tables, "--out", f"{tmp_path}/out", "--mode", "all", "--repository", str(repo), "--commit", commit)
    assert code == 0 and got["finding_status_counts"] == {"VERIFIED": got["batch_count"]}
