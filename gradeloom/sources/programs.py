"""External programs as providers, checkers and generators: one child process for each task, a request and an answer a line.

A request is one JSON object on one line of the child's input, its answer one JSON object on one line of its output. The child lives as long as the
task; it is ended and started anew when it doesn't answer in time, ends, says too much, or says what is no JSON object, so that a late
answer is never taken for the next one's. Input and output are served together, so that a child that writes before it has read
everything can't block its task. Of its error output the last bytes are kept for messages.

Requests are {envelope: {"protocol": 1, "kind": "provider" | "assert" | "generate_tests"}, ...}; see answers(), checks() and tests_udtf().
"""

from __future__ import annotations

import contextlib
import json
import os
import selectors
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of errors.
TIMEOUT, FAILED, UNREADABLE = "provider_timeout", "exec_failed", "provider_protocol"


@dataclass(frozen=True)
class Program:
    """A command and its limits. Parts of the command that begin with "file:" are files that were sent with addFile(),
    "python:" is the Python that runs the task."""

    command: tuple[str, ...]
    env: dict[str, str] = field(default_factory=dict)
    seconds: float = 60.0
    most_bytes: int = 4 << 20
    envelope: str = "suite"

    def request(self, kind: str, **parts) -> bytes:
        return json.dumps({self.envelope: {"protocol": 1, "kind": kind}} | parts, ensure_ascii=False).encode() + b"\n"


class ProgramError(Exception):
    """What went wrong, and its class."""

    def __init__(self, message: str, kind: str = FAILED):
        super().__init__(message)
        self.kind = kind


class Child:
    """A running program. ask() starts it when it isn't running."""

    TOLD = 2000

    def __init__(self, program: Program):
        self.program, self.process, self.errors, self.starts = program, None, None, 0

    def _start(self) -> None:
        command = [sys.executable if x == "python:" else SparkFiles.get(x[5:]) if x.startswith("file:") else x for x in self.program.command]
        self.errors = tempfile.TemporaryFile()
        try:
            self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=self.errors, env=os.environ | self.program.env, bufsize=0)
        except OSError as e:
            self.errors.close()
            raise ProgramError(f"{command[0]} can't be started: {e.strerror}") from e
        self.starts += 1
        os.set_blocking(self.process.stdin.fileno(), False)
        os.set_blocking(self.process.stdout.fileno(), False)

    def _said(self) -> str:
        size = self.errors.seek(0, os.SEEK_END)
        self.errors.seek(max(0, size - self.TOLD))
        return self.errors.read().decode("utf-8", "replace").strip()

    def end(self) -> None:
        own, self.process = self.process, None
        if own is None:
            return
        for pipe in (own.stdin, own.stdout):
            with contextlib.suppress(OSError):
                pipe.close()
        own.kill()
        own.wait()
        self.errors.close()

    def _lost(self) -> ProgramError:
        code = self.process.wait()
        said = self._said()
        return ProgramError(f"ended with {code}" + (f": {said}" if said else ""))

    def _answer(self, request: bytes) -> bytes:
        """The bytes up to the end of one line."""
        deadline, left, got, own = time.monotonic() + self.program.seconds, memoryview(request), bytearray(), self.process
        with selectors.DefaultSelector() as waiting:
            waiting.register(own.stdout, selectors.EVENT_READ)
            waiting.register(own.stdin, selectors.EVENT_WRITE)
            while b"\n" not in got:
                ready = waiting.select(max(0.0, deadline - time.monotonic()))
                if not ready:
                    raise ProgramError(f"no answer within {self.program.seconds:g} s", TIMEOUT)
                for key, _ in ready:
                    if key.fileobj is own.stdin:
                        try:
                            left = left[os.write(own.stdin.fileno(), left) :]
                        except BlockingIOError:
                            continue
                        except BrokenPipeError:
                            left = left[len(left) :]  # its output tells more
                        if not left:
                            waiting.unregister(own.stdin)
                    else:
                        part = os.read(own.stdout.fileno(), 1 << 16)
                        if not part:
                            raise self._lost()
                        got += part
                        if len(got) > self.program.most_bytes:
                            raise ProgramError(f"an answer of over {self.program.most_bytes} bytes", UNREADABLE)
        if left:
            raise ProgramError("an answer before the request was read", UNREADABLE)
        return bytes(got)

    def ask(self, request: bytes) -> dict:
        if self.process is None:
            self._start()
        try:
            line, _, more = self._answer(request).partition(b"\n")
            if more:
                raise ProgramError("more than one line for a request", UNREADABLE)
            try:
                answer = json.loads(line)
            except (ValueError, RecursionError) as e:
                raise ProgramError(f"no JSON: {line[:200].decode('utf-8', 'replace')}", UNREADABLE) from e
            if not isinstance(answer, dict):
                raise ProgramError("an answer that is no object", UNREADABLE)
            return answer
        except ProgramError:
            self.end()
            raise


def _object(text: str | None, what: str) -> dict:
    try:
        value = json.loads(text or "{}")
    except (ValueError, RecursionError) as e:
        raise ProgramError(f"{what} is no JSON") from e
    if not isinstance(value, dict):
        raise ProgramError(f"{what} is no JSON object")
    return value


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


ANSWER = "output string, stop_reason string, empty_reason string, model string, cost_usd double, input_tokens long, output_tokens long, tool_calls string, error string, error_class string"


def answered(child: Child, request: str | None) -> tuple:
    """One answer of a provider as a row of ANSWER."""
    try:
        got = child.ask(child.program.request("provider", **_object(request, "the request")))
        told = got.get("error")
        if told is not None:
            told = told if isinstance(told, dict) else {"message": str(told)}
            return (None,) * 8 + (str(told.get("message") or "error"), told.get("class") or FAILED)
        if "output" not in got:
            raise ProgramError("an answer without output", UNREADABLE)
        usage = got.get("usage") if isinstance(got.get("usage"), dict) else {}
        cost = got.get("cost_usd")
        cost = float(cost) if isinstance(cost, (int, float)) and not isinstance(cost, bool) else None
        reasons = (_text(got.get(k)) for k in ("stop_reason", "empty_reason", "model"))
        return (_text(got["output"]), *reasons, cost, _whole(usage.get("input_tokens")), _whole(usage.get("output_tokens")), _text(got.get("tool_calls") or None), None, None)
    except ProgramError as e:
        return (None,) * 8 + (str(e), e.kind)


def _in_tasks(rows: DataFrame, columns: tuple[str, ...], result: str, name: str, program: Program, one) -> DataFrame:
    """rows with the columns that one(child, *values) gives, with one child for each task."""
    names = [f.split()[0] for f in result.split(", ")]

    @F.pandas_udf(result)
    def called(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        child = Child(program)
        try:
            for batch in batches:
                made = [one(child, *values) for values in zip(*batch, strict=True)]
                yield pd.DataFrame(made, columns=names).astype(object)
        finally:
            child.end()

    taken = {c.lower() for c in rows.columns}
    kept = [f"`{c}`" for c in rows.columns if c.lower() not in names]
    while name in taken:
        name += "_"
    return rows.withColumn(name, called(*columns)).select(*kept, f"{name}.*")


def answers(requests: DataFrame, program: Program, request: str = "request") -> DataFrame:
    """requests (a JSON object as text: prompt, vars, params, test, tools) with the columns of ANSWER; columns of these names give way. An error that the program
    tells keeps its class, one without a class is exec_failed, as is a crash; no answer in time is provider_timeout, one that can't be read provider_protocol."""
    return _in_tasks(requests, (request, request), ANSWER, "answer_", program, lambda child, text, _: answered(child, text))


CHECK = "check_passed boolean, check_score double, check_reason string"


def checked(child: Child, output: str | None, variables: str | None, config: str | None) -> tuple:
    """One verdict of a checker as a row of CHECK."""
    try:
        got = child.ask(child.program.request("assert", output=output, vars=_object(variables, "vars"), config=_object(config, "config")))
        if (told := got.get("error")) is not None:
            return None, None, str(told.get("message") if isinstance(told, dict) else told)
        if not isinstance(got.get("pass"), bool):
            raise ProgramError("a verdict without pass")
        score = got.get("score")
        score = float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else float(got["pass"])
        return got["pass"], score, _text(got.get("reason"))
    except ProgramError as e:
        return None, None, str(e)


def checks(cases: DataFrame, program: Program, output: str = "output_text", variables: str = "vars", config: str = "config") -> DataFrame:
    """cases with check_passed, check_score (1 or 0 where the program tells none) and check_reason; passed is null where the program gave no
    verdict, which leaves the assertion without one."""
    return _in_tasks(cases, (output, variables, config), CHECK, "check_", program, checked)


def tests_udtf(program: Program, defaults: dict | None = None):
    """A table function of one argument (JSON text, null for none) that gives the tests a program generates for it: test_id, vars and tags; a test that
    fails has an error instead. It runs where its argument's row is: `TABLE` arguments can be partitioned, laterals go row by row."""
    from pyspark.sql.functions import udtf

    own = dict(defaults or {})

    class Tests:
        def __init__(self):
            self.child = Child(program)

        def eval(self, given: str):
            try:
                got = self.child.ask(program.request("generate_tests", config=_object(given, "the argument")))
                tests = got.get("tests")
                if not isinstance(tests, list):
                    raise ProgramError(str(got.get("error") or "an answer without tests"))
                for k, test in enumerate(tests):
                    made = own | test | {"vars": own.get("vars", {}) | test.get("vars", {})}
                    tags = list(dict.fromkeys([*own.get("tags", []), *test.get("tags", [])]))
                    yield str(made.get("id") or f"test-{k + 1}"), json.dumps(made["vars"], sort_keys=True, ensure_ascii=False), tags, None
            except ProgramError as e:
                yield None, None, None, str(e)

        def terminate(self):
            self.child.end()

    return udtf(Tests, returnType="test_id string, vars string, tags array<string>, error string")
