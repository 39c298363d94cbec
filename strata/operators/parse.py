"""Parsing of one source text, in a child process with limits on memory and time. Standard library only: the child imports nothing else."""

from __future__ import annotations

import ast
import os
import pickle
import select
import struct
import subprocess
import sys
import warnings

#: Functions, classes, a status, and the raw imports.
Facts = tuple[int, int, str, list[dict]]
MEMORY_BYTES, SECONDS = 1 << 30, 60.0


def parse(source: str) -> Facts:
    """Functions (async ones aside), classes, a status, and the raw imports of one source text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except SyntaxError:
        return 0, 0, "syntax_error", []
    except MemoryError:  # nesting beyond the parser's stack, or the limit
        return 0, 0, "too_large", []
    except (ValueError, RecursionError) as e:
        return 0, 0, type(e).__name__, []
    functions = classes = 0
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            functions += 1
        elif isinstance(node, ast.ClassDef):
            classes += 1
        elif isinstance(node, ast.Import):
            found += [{"level": 0, "module": a.name, "names": []} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append({"level": node.level or 0, "module": node.module, "names": [a.name for a in node.names]})
    return functions, classes, "ok", found


def serve(memory: int) -> None:
    """The child: a length and a text in, a length and a pickled answer out, until the input ends."""
    import resource

    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    given, out = sys.stdin.buffer, sys.stdout.buffer
    while head := given.read(8):
        try:
            answer = parse(given.read(struct.unpack("<q", head)[0]).decode("utf-8", "surrogatepass"))
        except MemoryError:
            os._exit(1)  # the input is out of step; the parent starts another child
        data = pickle.dumps(answer)
        out.write(struct.pack("<q", len(data)) + data)
        out.flush()


class Parser:
    """Parses texts in a child of this process. A text that takes it too much memory or time gets the status ``too_large`` or
    ``timed_out``, and the next text another child."""

    def __init__(self, memory: int = MEMORY_BYTES, seconds: float = SECONDS):
        self.memory, self.seconds = memory, seconds
        self.child: subprocess.Popen | None = None

    def __enter__(self) -> Parser:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.communicate()
            self.child = None

    def start(self) -> subprocess.Popen:
        code = f"import sys; sys.path[:] = {sys.path!r}; from strata.operators.parse import serve; serve({self.memory})"
        own = "/proc/self/exe"  # the interpreter itself, where sys.executable may be a script that looks for it
        self.child = subprocess.Popen([os.path.realpath(own) if os.path.exists(own) else sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        return self.child

    def _read(self, n: int) -> bytes | None:
        """So many bytes of the child's answer; none at its end. Nothing for too long is an error."""
        out, fd = b"", self.child.stdout.fileno()
        while len(out) < n:
            if not select.select([fd], [], [], self.seconds)[0]:
                raise TimeoutError
            block = os.read(fd, n - len(out))
            if not block:
                return None
            out += block
        return out

    def __call__(self, source: str) -> Facts:
        child = self.child or self.start()
        data = source.encode("utf-8", "surrogatepass")
        try:
            child.stdin.write(struct.pack("<q", len(data)))
            child.stdin.write(data)
            child.stdin.flush()
            head = self._read(8)
            answer = self._read(struct.unpack("<q", head)[0]) if head else None
            status = "too_large"
        except BrokenPipeError:
            answer, status = None, "too_large"
        except TimeoutError:
            answer, status = None, "timed_out"
        if answer is None:
            self.stop()
            return 0, 0, status, []
        return pickle.loads(answer)


_PARSERS: dict[tuple[int, float], Parser] = {}


def shared_parser(memory: int = MEMORY_BYTES, seconds: float = SECONDS) -> Parser:
    """This process's parser with such limits. Its child serves task after task, and ends when this process does."""
    return _PARSERS.setdefault((memory, seconds), Parser(memory, seconds))
