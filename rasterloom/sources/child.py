"""Other programs, run within bounds: arguments only (no shell), a time limit and a limit on what they write."""

from __future__ import annotations

import subprocess
import threading
from dataclasses import dataclass


class ChildError(RuntimeError):
    """Why a child's output is not used."""


@dataclass
class Output:
    code: int
    out: bytes
    err: bytes


def run(argv: list[str], data: bytes = b"", seconds: float = 30.0, most: int = 1 << 24, most_err: int = 1 << 16) -> Output:
    """The child's output. One that runs or writes beyond a limit is ended and refused; error text is only cut."""
    if not argv or not all(isinstance(a, str) and "\0" not in a for a in argv):
        raise ChildError("arguments")
    try:
        child = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, shell=False)
    except OSError as e:
        raise ChildError("not started") from e
    got, why = {"out": b"", "err": b""}, []

    def drain(stream, name: str, limit: int) -> None:
        while piece := stream.read1(65536):
            if len(got[name]) + len(piece) > limit and name == "out":
                why.append("too much output")
                child.kill()
                return
            got[name] = (got[name] + piece)[:limit]

    def feed() -> None:
        try:
            child.stdin.write(data)
            child.stdin.close()
        except OSError:
            pass  # a child need not read all it is given

    threads = [threading.Thread(target=t, args=a, daemon=True) for t, a in ((drain, (child.stdout, "out", most)), (drain, (child.stderr, "err", most_err)), (feed, ()))]
    for t in threads:
        t.start()
    try:
        code = child.wait(seconds)
    except subprocess.TimeoutExpired:
        why.append("too slow")
        child.kill()
        code = child.wait()
    for t in threads:
        t.join(5)
    if why:
        raise ChildError(why[0])
    return Output(code, got["out"], got["err"])
