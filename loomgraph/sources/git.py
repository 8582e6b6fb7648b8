"""A git repository as tables: listings, diffs, ranges, snapshots of a commit without a working tree."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import with_order

TIMEOUT = 30.0


def run_git(repo: str, *args: str, timeout: float = TIMEOUT) -> bytes:
    """Output of a git command; a failure raises with git's own message."""
    got = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=timeout, check=False)
    if got.returncode:
        raise RuntimeError(f"git {args[0]}: {got.stderr.decode(errors='replace').strip()}")
    return got.stdout


def resolve(repo: str, ref: str) -> str:
    return run_git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def default_branch(repo: str) -> str:
    """The remote's head, main, master or HEAD, whichever is there first."""
    for ref in ("refs/remotes/origin/HEAD", "refs/heads/main", "refs/heads/master", "HEAD"):
        try:
            return resolve(repo, ref)
        except RuntimeError:
            continue
    raise RuntimeError("no commit")


def resolve_range(repo: str, text: str) -> tuple[str, str]:
    """(start, end) commits of `-N`, `END-N`, `START+N` or `A..B`, tried in this order."""
    text = text.strip()
    if m := re.fullmatch(r"(.*)-(\d+)", text):
        end = resolve(repo, m[1] or "HEAD")
        return resolve(repo, f"{end}~{int(m[2])}"), end
    if m := re.fullmatch(r"(.+)\+(\d+)", text):
        start = resolve(repo, m[1])
        for tip in ("HEAD", default_branch(repo)):
            later = run_git(repo, "rev-list", "--reverse", "--ancestry-path", f"{start}..{tip}").decode().split()
            if len(later) >= int(m[2]) > 0:
                return start, later[int(m[2]) - 1]
        raise ValueError(f"{text}: fewer commits follow")
    if ".." in text:
        a, b = text.split("..", 1)
        return resolve(repo, a or "HEAD"), resolve(repo, b.lstrip(".") or "HEAD")
    raise ValueError(f"{text}: not a commit range")


def tracked(repo: str, commit: str | None = None) -> list[str]:
    out = run_git(repo, "ls-tree", "-r", "-z", "--name-only", commit) if commit else run_git(repo, "ls-files", "-z")
    return [x for x in out.decode(errors="replace").split("\0") if x]


def blobs(repo: str, commit: str, names: list[str]) -> list[str | None]:
    """Texts of files of a commit, in one batch; None for what isn't there."""
    ask = "".join(f"{commit}:{n}\n" for n in names).encode()
    out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=ask, capture_output=True, timeout=TIMEOUT * 10, check=True).stdout
    texts, at = [], 0
    for _ in names:
        end = out.index(b"\n", at)
        head = out[at:end].split()
        at = end + 1
        if head[-1] == b"missing":
            texts.append(None)
            continue
        size = int(head[-1])
        texts.append(out[at : at + size].decode("utf-8", "ignore"))
        at += size + 1
    return texts


def snapshot(spark: SparkSession, repo: str, commit: str | None = None, group: int = 200) -> DataFrame:
    """files(path, file_ord, lang, content) of a commit (by default HEAD), in the listing's order. The driver lists names only; tasks read blobs from git's object store, `group` files at a time, so the repository must lie where executors see it. No working tree is made."""
    commit = resolve(repo, commit or "HEAD")
    rows = list(enumerate(tracked(repo, commit)))
    names = spark.createDataFrame([(n, i) for i, n in rows], "path string, file_ord int").repartition(max(1, -(-len(rows) // group)), "file_ord")
    schema = pa.schema([("path", pa.string()), ("file_ord", pa.int32()), ("content", pa.string())])

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                texts = blobs(repo, commit, part.column(0).to_pylist())
                keep = pa.array([x is not None for x in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=schema).filter(keep)

    return with_order(names.mapInArrow(read, "path string, file_ord int, content string"))


def diff(spark: SparkSession, repo: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """diff(text, raw): without context for the changed lines, and as git shows it for the payload. Without commits: the working tree against HEAD."""
    ends = [x for x in (start, end) if x] or ["HEAD"]
    return spark.createDataFrame([(run_git(repo, "diff", "-U0", *ends).decode(errors="replace"), run_git(repo, "diff", *ends).decode(errors="replace"))], "text string, raw string")


def changed_files(repo: str, start: str | None = None, end: str | None = None) -> list[str]:
    """Paths that differ and still exist at the end."""
    ends = [x for x in (start, end) if x] or ["HEAD"]
    return [x for x in run_git(repo, "diff", "--name-only", "--diff-filter=d", "-z", *ends).decode(errors="replace").split("\0") if x]
