"""Running and checking generated Python: each text in a process of its own, in parallel over partitions."""

from __future__ import annotations

import ast
import contextlib
import os
import select
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Modules that generated code may not import.
BLOCKED_MODULES = ["os", "sys", "subprocess", "socket", "urllib", "http", "ftplib", "smtplib", "email", "ctypes", "mmap", "pickle", "shelve", "dbm", "sqlite3", "threading", "multiprocessing", "concurrent", "asyncio", "tkinter", "PyQt5", "PyQt6", "PySide2", "PySide6"]
#: Functions that it may not call.
BLOCKED_CALLS = ["eval", "exec", "compile", "__import__", "open", "input", "raw_input", "reload", "exit", "quit", "help", "license", "credits"]
#: Bytes of output and of errors that are kept.
KEPT = 1 << 20
#: Bytes that a file may have.
FILE_BYTES = 10 << 20

SAFETY = "is_safe boolean, violations array<string>"
RESULT = "success boolean, output string, error string, return_code int, execution_time double, timed_out boolean"


def violations(code: str | None, blocked: set[str], calls: set[str]) -> list[str]:
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [f"Syntax error: {e}"]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [f"Blocked import: {a.name}" for a in node.names if a.name.split(".")[0] in blocked]
        elif isinstance(node, ast.ImportFrom) and (node.module or "").split(".")[0] in blocked:
            found.append(f"Blocked import: {node.module}")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in calls:
            found.append(f"Blocked function: {node.func.id}")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__"):
            found.append(f"Blocked attribute: {node.attr}")
    return found


def safety_check(df: DataFrame, code: str, blocked: list[str] | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """df with safety struct(is_safe, violations); blocked modules add to the fixed ones, allowed ones leave them."""
    modules, calls = set(blocked_modules(blocked, allowed)), set(BLOCKED_CALLS)

    @F.pandas_udf(SAFETY)
    def check(s: pd.Series) -> pd.DataFrame:
        found = [violations(x, modules, calls) for x in s]
        return pd.DataFrame({"is_safe": [not f for f in found], "violations": found})

    return df.withColumn("safety", check(code))


def blocked_modules(custom: list[str] | None = None, allowed: tuple[str, ...] = ()) -> list[str]:
    """Modules that may not be imported, sorted: the fixed ones and custom ones, without allowed ones."""
    return sorted((set(BLOCKED_MODULES) | set(custom or [])) - set(allowed))


def imports(code: str | None) -> list[str]:
    """Modules that a text imports, sorted; none of a text that is no Python."""
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = {a.name for n in nodes if isinstance(n, ast.Import) for a in n.names}
    return sorted(found | {n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module})


@F.pandas_udf(T.ArrayType(T.StringType()))
def sorted_imports(s: pd.Series) -> pd.Series:
    return s.map(imports)


#: Extension modules that act without telling the audit hook; no text may load them, not even through another module.
UNHEARD = ["_posixsubprocess", "_ctypes", "_ctypes_test", "_testcapi", "_testinternalcapi", "_testlimitedcapi", "_interpreters", "_interpchannels", "_interpqueues", "_xxsubinterpreters", "_posixshmem", "_multiprocessing"]
#: Audit events, by their beginnings, that are refused whoever raises them: files and folders, processes, sockets, threads, foreign code, searches through live objects.
REFUSED = ["os.", "subprocess.", "pty.", "shutil.", "tempfile.", "glob.", "pathlib.", "socket.", "http.", "urllib.", "ftplib.", "smtplib.", "imaplib.", "poplib.", "nntplib.", "telnetlib.", "webbrowser.", "syslog.", "sqlite3.", "dbm.", "ctypes.", "mmap.", "fcntl.", "resource.", "signal.", "_thread.start", "gc.", "code.__new__", "sys.addaudithook", "sys.setprofile", "sys.settrace", "sys._current", "cpython.run", "setopencodehook"]

#: Libraries of numbers start a thread a core when they are loaded, which the limit on processes refuses to users other than root.
SINGLE = {"OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1", "MKL_NUM_THREADS": "1"}

#: Rows that are handed on at once, and the characters of output and errors that end a piece early.
PIECE_ROWS, PIECE_CHARS = 1000, 32 << 20

#: Runs programs under an audit hook. The hook can't be taken away, and holds all it needs in its own defaults, so a
#: program that finds frames, globals or builtins has nothing to change: it sees what the interpreter does and not how it was named.
#: Besides, the program's own imports of blocked modules fail, and blocked functions are not among its builtins.
#: This interpreter itself runs no program: it reads them one after another and forks, so each has a process that nothing was run in before.
#: It ends with its input.
#: Taking an interpreter apart writes to most of the memory that a forked process shares and costs several times what a short program does. So when all that
#: a program registered for its end has run, its garbage is collected, and if none of its functions is left that could still act, the process ends there.
#: If one is (held by a module of the library), or the end is of another kind than a plain one, the interpreter is taken apart as ever.
_GUARD = """
import builtins, os, sys
def arm(prefixes, refused, unheard):
    def hook(event, args, prefixes=prefixes, refused=refused, unheard=unheard, writes=os.O_WRONLY | os.O_RDWR | os.O_CREAT | os.O_TRUNC | os.O_APPEND, str=str, type=type, Refusal=PermissionError, NoImport=ImportError):
        if event == 'import':
            if args[0] in unheard:
                raise NoImport('Import of ' + args[0] + ' is not allowed')
        elif event == 'open' or event == 'os.listdir' or event == 'os.scandir':
            # only reading what imports read
            if type(args[0]) is not str or '/..' in args[0] or not (args[0] + '/').startswith(prefixes) or event == 'open' and args[2] & writes:
                raise Refusal(event + ' is not allowed')
        elif event.startswith(refused) and event != 'os.putenv' and event != 'os.unsetenv':
            raise Refusal(event + ' is not allowed')
    sys.addaudithook(hook)
def importer(blocked):
    def guarded(name, globals=None, locals=None, fromlist=(), level=0, real=builtins.__import__, blocked=blocked, NoImport=ImportError):
        if name.split('.')[0] in blocked and (globals is None or globals.get('__name__') == '__main__'):
            raise NoImport('Import of ' + name + ' is not allowed')
        return real(name, globals, locals, fromlist, level)
    return type(guarded)(guarded.__code__, {'__builtins__': {}}, 'guarded', guarded.__defaults__)
def take(n):
    parts = b''
    while len(parts) < n:
        part = os.read(0, n - len(parts))
        if not part:
            os._exit(0)
        parts += part
    return parts
def forked():
    # returns in the processes of programs only
    while True:
        seconds, memory, size, n = (int(x) for x in take(64).split())
        code = take(n)
        try:
            pid = os.fork()
        except OSError as e:
            os.write(1, ('%-64s' % ('failed %d' % e.errno)).encode())
            continue
        if not pid:
            return seconds, memory, size, code
        os.write(1, b'%-64d' % pid)
        os.waitid(os.P_PID, pid, os.WEXITED | os.WNOWAIT)
        try:
            os.killpg(pid, 9)
        except OSError:
            pass
        os.write(1, b'%-64d' % os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1]))
def limit(resource, seconds, memory, size):
    for what, most in ((resource.RLIMIT_CPU, seconds), (resource.RLIMIT_AS, memory), (resource.RLIMIT_FSIZE, size), (resource.RLIMIT_NPROC, 10), (resource.RLIMIT_CORE, 0)):
        try:
            resource.setrlimit(what, (most, most))
        except (OSError, ValueError):
            pass
def leave_with(ended, seen, collect):
    # first to be registered, so the last to run; functions of a program hold its builtins, so these are seen as long as one of them is there
    def leave(ended=ended, seen=seen, collect=collect, leave=os._exit, sys=sys, Fault=BaseException):
        try:
            if not ended:
                return
            sys.last_exc = sys.last_type = sys.last_value = sys.last_traceback = None
            files = sys.stdout, sys.stderr, sys.__stdout__, sys.__stderr__
            for step in (*(f.flush for f in files), collect, *(f.flush for f in files)):
                step()
        except Fault:
            return
        if seen() is None:
            leave(ended[0])
    import atexit
    atexit.register(leave)
def begin():
    modules, calls, refused, unheard, folder = sys.argv[1:]
    shown = {k: v for k, v in vars(builtins).items() if k not in calls.split(',')}
    shown['__import__'] = importer(frozenset(modules.split(',')) | {'builtins', 'importlib', '_frozen_importlib', '_frozen_importlib_external', 'posix', 'gc', '_thread'})
    import _weakref, encodings.idna, gc, linecache, resource, traceback
    leave_with(ended, _weakref.ref(shown['__import__']), gc.collect)
    gc.collect()
    gc.freeze()  # or collections in forked processes would copy the memory that they share
    del sys.modules['gc'], sys.modules['resource']
    prefixes = tuple(p.rstrip('/') + '/' for p in {*sys.path, *map(os.path.realpath, sys.path)} if p)
    seconds, memory, size, code = forked()
    os.setsid()
    for fd, path, mode in ((0, os.devnull, os.O_RDONLY), (1, folder + '/out', os.O_WRONLY), (2, folder + '/err', os.O_WRONLY)):
        own = os.open(path, mode)
        os.dup2(own, fd)
        os.close(own)
    limit(resource, seconds, memory, size)
    program = compile(code.decode('utf-8').replace('\\r\\n', '\\n').replace('\\r', '\\n'), '<code>', 'exec')
    sys.argv[:] = ['<code>']
    arm(prefixes, tuple(refused.split(',')), frozenset(unheard.split(',')))
    return program, {'__name__': '__main__', '__builtins__': shown}
ended = []  # the status of a plain end
try:
    exec(*begin())
except SystemExit as e:
    if type(e) is SystemExit and (e.code is None or type(e.code) is int and 0 <= e.code < 256):
        ended.append(e.code or 0)
    raise
except Exception:
    if sys.excepthook is sys.__excepthook__:
        ended.append(1)
    raise
else:
    ended.append(0)
"""


class Sandbox:
    """Runs texts one after another, each in a process forked from an interpreter that has run none; to be used in a with statement.

    Starting an interpreter costs many times what a short program does; here it is started once and not for each text. It starts with the first text.
    """

    def __init__(self, modules: set[str] | None = None, calls: set[str] | None = None) -> None:
        self.modules, self.calls = modules if modules is not None else set(BLOCKED_MODULES), calls if calls is not None else set(BLOCKED_CALLS)
        self.open: contextlib.ExitStack | None = None

    def __enter__(self) -> Sandbox:
        return self

    def __exit__(self, *_: object) -> None:
        if self.open:
            self.open.close()
            self.open = None

    def _start(self) -> None:
        with contextlib.ExitStack() as stack:
            folder = stack.enter_context(tempfile.TemporaryDirectory())
            os.mkdir(f"{folder}/work")
            self.pipes = []
            for name in ("out", "err"):
                os.mkfifo(f"{folder}/{name}")
                # also open for writing, so that a pipe has no end between two programs
                self.pipes.append(os.open(f"{folder}/{name}", os.O_RDWR | os.O_NONBLOCK))
                stack.callback(os.close, self.pipes[-1])
            lists = [",".join(x) for x in (self.modules, self.calls, REFUSED, UNHEARD)]
            self.server = subprocess.Popen([sys.executable, "-I", "-B", "-c", _GUARD, *lists, folder], cwd=f"{folder}/work", env={"PATH": os.defpath, **SINGLE}, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True, bufsize=0)
            stack.callback(self._end)
            self.open = stack.pop_all()

    def _end(self) -> None:
        self.server.kill()
        self.server.wait()
        self.server.stdin.close()
        self.server.stdout.close()

    def _said(self) -> str:
        """The next word of the interpreter that forks."""
        got = b""
        while len(got) < 64:
            part = self.server.stdout.read(64 - len(got))
            if not part:
                raise ConnectionError("the sandbox's interpreter has ended")
            got += part
        return got.decode().strip()

    def _drain(self, kept: list[bytearray]) -> None:
        """Read what the pipes hold and keep the first KEPT bytes of each, so that a run may say more."""
        for fd, own in zip(self.pipes, kept, strict=True):
            with contextlib.suppress(BlockingIOError):
                while part := os.read(fd, 1 << 16):
                    own += part[: max(0, KEPT - len(own))]

    def run(self, code: str, timeout: float, memory_mb: int) -> tuple:
        """The outcome of a text, as RESULT names it. If the interpreter that forks is gone, which no text can do, a text runs again from a new one."""
        began = time.monotonic()
        try:
            text = code.encode("utf-8")
            try:
                status, said, wrong = self._run(text, timeout, memory_mb)
            except ConnectionError:
                self.__exit__()
                status, said, wrong = self._run(text, timeout, memory_mb)
        except (OSError, ValueError) as e:
            if not isinstance(e, UnicodeError):  # which is the text's own
                self.__exit__()
            return False, "", str(e), -1, time.monotonic() - began, False
        if status is None:
            return False, "", f"Execution timed out after {timeout:g}s", -1, time.monotonic() - began, True
        return status == 0, said, wrong or None, status, time.monotonic() - began, False

    def _run(self, text: bytes, timeout: float, memory_mb: int) -> tuple[int | None, str, str]:
        """The return code of a program, null if its time was up, and what it printed."""
        if not self.open:
            self._start()
        ask = f"{int(timeout) + 1} {memory_mb << 20} {FILE_BYTES} {len(text)}".ljust(64).encode() + text
        while ask:
            ask = ask[self.server.stdin.write(ask) :]
        said = self._said()
        if said.startswith("failed"):
            raise OSError(os.strerror(int(said.split()[1])))
        pid, kept, late = int(said), [bytearray(), bytearray()], False
        until, ended, poll = time.monotonic() + timeout, self.server.stdout.fileno(), select.poll()
        for fd in (*self.pipes, ended):
            poll.register(fd, select.POLLIN)
        try:
            while True:
                found = {fd for fd, _ in poll.poll(None if late else max(0, 1000 * (until - time.monotonic())))}
                self._drain(kept)
                if ended in found:
                    break
                if not late and time.monotonic() >= until:
                    late = True
                    with contextlib.suppress(OSError):
                        os.kill(pid, signal.SIGKILL)
            status = int(self._said())
        except ConnectionError:  # nothing else would end the program
            with contextlib.suppress(OSError):
                os.kill(pid, signal.SIGKILL)
            raise
        self._drain(kept)
        said, wrong = (bytes(x).decode("utf-8", "replace") for x in kept)
        return None if late else status, said, wrong


def execute(code: str, timeout: float, memory_mb: int, modules: set[str] | None = None, calls: set[str] | None = None) -> tuple:
    """Run a text in a process of its own under an audit hook, with limits on time, memory, files and processes.

    What touches files outside of the interpreter's own library, processes, sockets, threads or foreign code raises inside the run, however
    it was reached. The run has a session of its own, of which nothing is left when it ends or its time is up. Of what it prints KEPT bytes are kept; it may print more.
    """
    with Sandbox(modules, calls) as box:
        return box.run(code, timeout, memory_mb)


def outcomes(frames: Iterator[pd.DataFrame], code: str, timeout: float, memory_mb: int, modules: set[str], calls: set[str]) -> Iterator[pd.DataFrame]:
    """The rows of frames with the outcome of each text, in pieces that are bounded by rows and by what was printed."""

    def joined(f: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, index=f.index, columns=[x.split()[0] for x in RESULT.split(", ")]).astype(object)
        return f.join(found.astype({"return_code": "Int32", "execution_time": "Float64"}))

    with Sandbox(modules, calls) as box:
        for f in frames:
            f = f.reset_index(drop=True)
            rows: list[tuple] = []
            chars = start = 0
            for i, x in enumerate(f[code]):
                if not isinstance(x, str):
                    rows.append((None,) * 6)
                elif bad := violations(x, modules, calls):
                    rows.append((False, "", "; ".join(bad), 1, 0.0, False))
                else:
                    rows.append(box.run(x, timeout, memory_mb))
                    chars += len(rows[-1][1]) + len(rows[-1][2] or "")
                if len(rows) == PIECE_ROWS or chars >= PIECE_CHARS or i + 1 == len(f):
                    yield joined(f.iloc[start : i + 1], rows)
                    rows, chars, start = [], 0, i + 1


def sandbox(df: DataFrame, code: str, timeout: float = 5.0, memory_mb: int = 512, blocked: list[str] | None = None) -> DataFrame:
    """df with the outcome of each text; what the safety check refuses does not run, and null texts have no outcome. A task forks its programs from one interpreter."""
    modules, calls = set(BLOCKED_MODULES) | set(blocked or []), set(BLOCKED_CALLS)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInPandas(lambda frames: outcomes(frames, code, timeout, memory_mb, modules, calls), f"{schema}, {RESULT}")


def test_script(completion: Column, tests: Column, entry_point: Column) -> Column:
    """A completion with its tests; tests that define check() are called with the entry point. Null where script_fault has a text."""
    call = F.when(tests.contains("def check"), F.concat(F.lit("\ncheck("), entry_point, F.lit(")\n"))).otherwise("")
    return F.concat(completion, F.lit("\n\n"), tests, call)


def script_fault(completion: Column, tests: Column, entry_point: Column) -> Column:
    """Why a completion can't be run with its tests; null if it can. A program that nobody calls or that isn't there must not count as passed."""
    called = tests.contains("def check")
    return F.when(tests.isNull(), "no tests").when(completion.isNull(), "no code").when(called & (F.coalesce(F.trim(entry_point), F.lit("")) == ""), "no entry point for check()")


@dataclass(frozen=True)
class ModelInfo:
    """What is known of a backend's model."""

    name: str
    available: bool = True
    context_length: int = 4096
    chat_template: str = "default"

    def fits(self, prompt: Column, max_tokens: int = 0) -> Column:
        """Whether a prompt, at four characters a token, and what is to be generated fit the context."""
        return text.token_estimate(prompt) + max_tokens <= self.context_length


def preferred(files: DataFrame, by: str, file: str, rank: Column, size: Column) -> DataFrame:
    """One file of each group: the one that is preferred most, of these the smallest."""
    return files.groupBy(by).agg(F.min_by(file, F.struct(rank.alias("a"), size.alias("b"))).alias(file))


class Client(Protocol):
    """A backend: a prompt to (text, tokens, finish_reason). Any function of this form serves."""

    def __call__(self, prompt: str) -> tuple[str, int, str]: ...


def replay(generations: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with texts that were generated before; a sample without one has finish_reason error."""
    own = generations.select(key, "text", "tokens_generated", "generation_time", "finish_reason")
    return samples.join(own, key, "left").withColumn("finish_reason", F.coalesce("finish_reason", F.lit("error"))).withColumn("text", F.coalesce("text", F.lit("")))


def batched(client: Callable[[list[str]], list[tuple[str, int, str]]], df: DataFrame, prompt: str = "prompt", size: int = 8) -> DataFrame:
    """df with texts from a client that takes lists of prompts, of at most size; a failed list is a failure of each of its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for s in range(0, len(f), size):
                part, began = f[prompt].iloc[s : s + size].tolist(), time.monotonic()
                try:
                    got = list(client(part))
                except Exception:  # noqa: BLE001  any failure of a backend is its rows' failure
                    got = [("", 0, "error")] * len(part)
                rows += [(*g, (time.monotonic() - began) / len(part)) for g in got]
            yield f.join(pd.DataFrame(rows, index=f.index, columns=["text", "tokens_generated", "finish_reason", "generation_time"]))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, text string, tokens_generated int, finish_reason string, generation_time double")


def generate(df: DataFrame, client: Callable[[str], tuple[str, int, str]], prompt: str = "prompt", retries: int = 3, delay: float = 1.0) -> DataFrame:
    """df with the text that client gives for each prompt; a prompt that keeps failing gives an empty text and finish_reason error.

    client is any function of a prompt to (text, tokens, finish_reason); it runs in the tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f[prompt]:
                began = time.monotonic()
                got = ("", 0, "error")
                for attempt in range(retries):
                    try:
                        got = client(p)
                        break
                    except Exception:  # noqa: BLE001  any failure of a backend is a row's failure
                        if attempt + 1 < retries:
                            time.sleep(delay * (attempt + 1))
                rows.append((*got, time.monotonic() - began))
            yield f.join(pd.DataFrame(rows, index=f.index, columns=["text", "tokens_generated", "finish_reason", "generation_time"]))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, text string, tokens_generated int, finish_reason string, generation_time double")
