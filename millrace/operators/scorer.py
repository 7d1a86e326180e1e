"""Scores by user code: a static policy, and a fresh interpreter for each component and example.

This keeps components apart and bounds their time and memory; it is no sandbox for hostile code,
and nothing runs unless the caller says that it may.
"""

from __future__ import annotations

import ast
import contextlib
import json
import os
import signal
import subprocess
import sys
import threading
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What component code may import from, and may not name.
MODULES = {
    "re": ("compile", "search", "match", "fullmatch", "findall", "finditer", "split", "sub", "subn", "escape", "IGNORECASE", "MULTILINE", "DOTALL", "VERBOSE", "ASCII", "error"),
    "json": ("loads", "dumps", "JSONDecodeError"),
    "math": ("isfinite", "isclose", "isnan", "isinf", "sqrt", "floor", "ceil", "trunc", "fabs", "gcd", "lcm", "factorial", "prod", "fsum", "log", "log10", "exp", "pow", "pi", "e", "inf", "nan"),
    "decimal": ("Decimal", "InvalidOperation", "DivisionByZero", "Overflow", "localcontext", "ROUND_HALF_EVEN", "ROUND_HALF_UP", "ROUND_DOWN"),
    "fractions": ("Fraction",),
}
FORBIDDEN = ("eval", "exec", "compile", "open", "input", "globals", "locals", "vars", "getattr", "setattr", "delattr", "hasattr", "dir", "type", "object", "super", "breakpoint", "help", "exit", "quit")
BUILTINS = (
    "abs", "all", "any", "bool", "bytes", "bytearray", "callable", "chr", "dict", "divmod", "enumerate", "filter", "float", "frozenset", "int", "isinstance", "issubclass", "iter",
    "len", "list", "map", "max", "min", "next", "ord", "pow", "print", "range", "repr", "reversed", "round", "set", "slice", "sorted", "str", "sum", "tuple", "zip",
    "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "ZeroDivisionError", "ArithmeticError", "OverflowError", "RuntimeError", "AssertionError", "StopIteration",
    "NotImplementedError", "ImportError", "AttributeError",
)
FRAMES = ("gi_frame", "gi_code", "gi_yieldfrom", "cr_frame", "cr_code", "cr_await", "ag_frame", "ag_code", "ag_await", "f_globals", "f_locals", "f_builtins", "f_back", "f_code", "tb_frame", "tb_next", "func_globals", "func_code")
# End of fixed values.


class PolicyError(ValueError):
    pass


class _Policy(ast.NodeVisitor):
    """Raises at the first construct outside the policy."""

    def __init__(self, apis: tuple[str, ...]) -> None:
        self.apis, self.aliases = set(apis), {}

    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            if n.name not in MODULES:
                raise PolicyError(f"import of {n.name}")
            self.aliases[n.asname or n.name] = n.name

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        outside = [n.name for n in node.names if n.name not in MODULES.get(node.module or "", ())]
        if node.level or outside:
            raise PolicyError(f"import of {outside} from {node.module}")

    def visit_Name(self, node: ast.Name) -> None:
        if node.id.startswith("__") or node.id in FORBIDDEN:
            raise PolicyError(f"name {node.id}")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if node.attr.startswith("_") or node.attr in FRAMES:
            raise PolicyError(f"attribute {node.attr}")
        owner = node.value.id if isinstance(node.value, ast.Name) else None
        if owner == "context" and node.attr not in self.apis:
            raise PolicyError(f"context.{node.attr}")
        if owner in self.aliases and node.attr not in MODULES[self.aliases[owner]]:
            raise PolicyError(f"{self.aliases[owner]}.{node.attr}")
        self.generic_visit(node)


def check_source(source: str, apis: tuple[str, ...] = ()) -> None:
    """Refuse code outside the policy; imports count wherever they stand."""
    tree = ast.parse(source)
    p = _Policy(apis)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            p.visit(node)
    p.visit(tree)
    if not any(isinstance(n, ast.FunctionDef) and n.name == "score" for n in tree.body):
        raise PolicyError("no function score(example, context)")


#: Sets the limits on itself, then becomes the program: no moment without them.
_LIMITED = """
import os, resource, sys
cpu, memory, written = map(int, sys.argv[1:4])
resource.setrlimit(resource.RLIMIT_CPU, (cpu, cpu))
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
resource.setrlimit(resource.RLIMIT_FSIZE, (written, written))
os.execv(sys.executable, [sys.executable, "-I", "-c", *sys.argv[4:]])
"""

#: Runs a component with the names that the policy allows. What it tells goes through a pipe of its
#: own, so that nothing that the component prints gets in the way; feedback is cut here.
_CHILD = """
import builtins, importlib, json, math, os, sys, types
job = json.loads(sys.stdin.read())
told = os.fdopen(int(sys.argv[1]), "w")
modules = {m: types.SimpleNamespace(**{n: getattr(importlib.import_module(m), n) for n in names}) for m, names in job["modules"].items()}

def import_(name, globals=None, locals=None, fromlist=(), level=0):
    if level or name not in modules or any(n not in job["modules"][name] for n in fromlist or ()):
        raise ImportError("outside the policy: " + name)
    return modules[name]

space = {"__name__": "component", "__builtins__": {**{n: getattr(builtins, n) for n in job["builtins"]}, "__import__": import_}}
exec(compile(job["source"], "component", "exec"), space)
out = space["score"](job["example"], None)
raw = out["raw_score"] if isinstance(out, dict) and "raw_score" in out else out
kind = "bool" if isinstance(raw, bool) else "number" if isinstance(raw, (int, float)) else "null" if raw is None else type(raw).__name__
value = None
if kind == "number":
    try:
        value = float(raw)
    except OverflowError:
        value = math.inf
    if not math.isfinite(value):
        kind, value = "nonfinite", None
feedback = out.get("feedback") if isinstance(out, dict) else None
if feedback is not None and not isinstance(feedback, str):
    feedback = json.dumps(feedback, ensure_ascii=False, default=repr)
cut = feedback is not None and len(feedback) > job["feedback"]
json.dump({"raw": value, "kind": kind, "feedback": feedback[: job["feedback"]] if cut else feedback, "feedback_truncated": cut}, told)
told.close()
"""


@dataclass
class Run:
    """How a process ended: its exit code (None: time was up), what it printed from the beginning,
    whether more was left away, and what it wrote to a pipe of its own."""

    code: int | None
    stdout: str
    stderr: str
    stdout_truncated: bool
    stderr_truncated: bool
    told: str

    @property
    def status(self) -> str:
        """ok, timeout (of the clock or of CPU time), output_limit (it failed after it had printed
        too much) or error."""
        if self.code is None or -self.code in (signal.SIGXCPU, signal.SIGKILL):
            return "timeout"
        if self.code and (self.stdout_truncated or self.stderr_truncated):
            return "output_limit"
        return "error" if self.code else "ok"


def run_isolated(program: str, stdin: str, seconds: float, most_output: int = 65536, memory: int = 1 << 30, written: int = 0, argument: bool = False) -> Run:
    """A Python program in a process group of its own, which is killed whole when time is up. It has
    `memory` bytes of address space and may write `written` bytes to a file. Of what it prints the
    first `most_output` bytes are held, the rest is read and left away, and the result says so. With
    `argument` its first argument is the number of a pipe, whose content comes back as `told`."""
    read, write = os.pipe()
    argv = [sys.executable, "-I", "-c", _LIMITED, str(max(1, int(seconds) + 1)), str(memory), str(written), program, *([str(write)] if argument else [])]
    p = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, pass_fds=(write,) if argument else (), env={"PATH": os.environ.get("PATH", "")})
    os.close(write)
    streams = {"out": p.stdout, "err": p.stderr, "told": os.fdopen(read, "rb")}
    held, more = dict.fromkeys(streams, b""), dict.fromkeys(streams, False)

    def feed() -> None:
        with contextlib.suppress(BrokenPipeError), p.stdin:
            p.stdin.write(stdin.encode())

    def listen(name: str) -> None:
        limit = most_output if name != "told" else 16 * most_output + (1 << 20)
        while chunk := streams[name].read1(1 << 16):
            room = limit - len(held[name])
            held[name] += chunk[: max(0, room)]
            more[name] |= len(chunk) > room

    helpers = [threading.Thread(target=feed), *(threading.Thread(target=listen, args=(x,)) for x in streams)]
    for h in helpers:
        h.start()
    try:
        code = p.wait(timeout=seconds)
    except subprocess.TimeoutExpired:
        code = None
    with contextlib.suppress(ProcessLookupError):  # also what it left running
        os.killpg(p.pid, signal.SIGKILL)
    p.wait()
    for h in helpers:
        h.join()
    for x in streams.values():
        x.close()
    out, err, told = (held[x].decode(errors="replace") for x in streams)
    return Run(code, out, err, more["out"], more["err"], told)


def score_one(source: str, example: dict, seconds: float, most_feedback: int = 65536) -> dict:
    """raw, kind, error, feedback, feedback_truncated of one component and example."""
    job = {"source": source, "example": example, "modules": MODULES, "builtins": BUILTINS, "feedback": most_feedback}
    run = run_isolated(_CHILD, json.dumps(job), seconds, argument=True, most_output=most_feedback)
    failed = {"raw": None, "kind": "error", "error": "COMPONENT_EXCEPTION", "feedback": None, "feedback_truncated": False}
    if run.status == "timeout":
        return failed | {"error": "COMPONENT_TIMEOUT"}
    if not run.code:
        with contextlib.suppress(ValueError):
            return {**json.loads(run.told), "error": None}
    last = run.stderr.strip().splitlines()[-1:]
    return failed | {"feedback": last[0][:most_feedback] if last else None}


def score_examples(examples: DataFrame, components: dict[str, str], allow_code: bool = False, seconds: float = 10.0, most_feedback: int = 65536) -> DataFrame:
    """example_id, component_id, raw, kind, error, feedback, feedback_truncated of (example_id,
    example: JSON) rows. Feedback beyond `most_feedback` characters is cut and marked; whatever a
    component does or prints is a row, never the end of the job."""
    if not allow_code:
        raise PermissionError("running components needs allow_code=True")
    for source in components.values():
        check_source(source)
    names = ["raw", "kind", "error", "feedback", "feedback_truncated"]

    def run(batches):
        for df in batches:
            rows = [(i, c, *(r[n] for n in names)) for i, e in zip(df["example_id"], df["example"], strict=True) for c, s in components.items() for r in [score_one(s, json.loads(e), seconds, most_feedback)]]
            yield pd.DataFrame(rows, columns=["example_id", "component_id", *names])

    kind = examples.schema["example_id"].dataType.simpleString()
    return examples.select("example_id", "example").mapInPandas(run, f"example_id {kind}, component_id string, raw double, kind string, error string, feedback string, feedback_truncated boolean")


def admitted(components: DataFrame, apis: tuple[str, ...] = ()) -> DataFrame:
    """component_id, admitted, refusal of (component_id, source) rows: what `check_source` says."""

    def run(batches):
        for df in batches:
            out = []
            for i, s in zip(df["component_id"], df["source"], strict=True):
                try:
                    out.append((i, check_source(s or "", apis)))
                except (ValueError, SyntaxError) as e:
                    out.append((i, str(e) if isinstance(e, PolicyError) else "no Python"))
            yield pd.DataFrame([(i, why is None, why) for i, why in out], columns=["component_id", "admitted", "refusal"])

    kind = components.schema["component_id"].dataType.simpleString()
    return components.select("component_id", "source").mapInPandas(run, f"component_id {kind}, admitted boolean, refusal string")


def run_programs(programs: DataFrame, allow_code: bool = False, seconds: float = 5.0, most_output: int = 65536, memory: int = 1 << 30) -> DataFrame:
    """id, status, exit_code (null: time was up, or it was killed), stdout, stderr and whether either
    was cut, of (id, program, stdin) rows; failure is data. Of each stream the first `most_output`
    bytes are kept."""
    if not allow_code:
        raise PermissionError("running programs needs allow_code=True")

    def run(batches):
        for df in batches:
            runs = [(i, run_isolated(p, s or "", seconds, most_output, memory, written=2 * most_output + 4096)) for i, p, s in zip(df["id"], df["program"], df["stdin"], strict=True)]
            out = [(i, r.status, r.code if r.code is not None and r.code >= 0 else None, r.stdout, r.stderr, r.stdout_truncated, r.stderr_truncated) for i, r in runs]
            yield pd.DataFrame(out, columns=["id", "status", "exit_code", "stdout", "stderr", "stdout_truncated", "stderr_truncated"]).astype({"exit_code": "Int32"})

    kind = programs.schema["id"].dataType.simpleString()
    return programs.select("id", "program", "stdin").mapInPandas(run, f"id {kind}, status string, exit_code int, stdout string, stderr string, stdout_truncated boolean, stderr_truncated boolean")


def as_score(df: DataFrame, raw: str = "raw", error: str = "error") -> DataFrame:
    return df.withColumn("score", F.when(F.col(error).isNull(), F.col(raw)))
