"""Components by name, settings, model routes, tasks and a bounded pool: what a service around the verbs needs.

Nothing here touches data; a component is a function or class that a plan calls.
"""

from __future__ import annotations

import importlib
import json
import os
import pkgutil
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints


class Registry:
    """Components of several families; each has a name, a settings class and what makes it."""

    def __init__(self) -> None:
        self.entries: dict[str, dict[str, tuple[type | None, Callable]]] = {}
        self.defaults: dict[str, str] = {}

    def component(self, family: str, name: str, settings: type | None = None, default: bool = False):
        """A decorator that registers a class or function; a family has one default, and a name stands once."""

        def add(made: Callable) -> Callable:
            known = self.entries.setdefault(family, {})
            if name in known:
                raise ValueError(f"{family} has a component {name} already")
            if default and family in self.defaults:
                raise ValueError(f"{family} has the default {self.defaults[family]} already")
            known[name] = settings, made
            if default:
                self.defaults[family] = name
            return made

        return add

    def discover(self, package: str) -> list[str]:
        """Imports every module under a package, so that what they register is known."""
        root = importlib.import_module(package)
        names = [m.name for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}.")]
        for name in names:
            importlib.import_module(name)
        return names

    def names(self, family: str) -> list[str]:
        return sorted(self.entries.get(family, {}))

    def make(self, family: str, name: str | None = None, settings: dict | None = None, env: dict[str, str] | None = None, **more: Any) -> Any:
        """The component, with its settings checked and, where the environment names them, taken from there.

        A parameter that is named after a family and not given is that family's default component.
        """
        name = name or self.defaults.get(family)
        if name not in self.entries.get(family, {}):
            raise ValueError(f"{family} has no component {name!r}; known: {', '.join(self.names(family)) or 'none'}")
        kind, made = self.entries[family][name]
        own = (checked(kind, {**from_env(kind, f"{family}_{name}", env), **(settings or {})}),) if kind else ()
        for wanted, of in get_type_hints(made.__init__ if isinstance(made, type) else made).items():
            if wanted in self.entries and wanted != family and wanted not in more and of is not type(None):
                more[wanted] = self.make(wanted, env=env)
        return made(*own, **more)


def from_env(kind: type, prefix: str, env: dict[str, str] | None) -> dict[str, str]:
    """Values of a settings class's fields that the environment has, as PREFIX_FIELD."""
    source = os.environ if env is None else env
    return {f.name: source[key] for f in fields(kind) if (key := f"{prefix}_{f.name}".upper()) in source}


def checked(kind: type, values: dict) -> Any:
    """A settings object of a dataclass: unknown names and missing or malformed values are errors."""
    hints = get_type_hints(kind)
    if unknown := set(values) - set(hints):
        raise ValueError(f"{kind.__name__} has no setting {', '.join(sorted(unknown))}")
    out = {}
    for f in fields(kind):
        if f.name in values:
            out[f.name] = value_of(hints[f.name], values[f.name], f"{kind.__name__}.{f.name}")
        elif f.default is MISSING and f.default_factory is MISSING:
            raise ValueError(f"{kind.__name__}.{f.name} is missing")
    return kind(**out)


def value_of(kind: Any, value: Any, name: str) -> Any:
    if is_dataclass(kind) and isinstance(value, dict):
        return checked(kind, value)
    if kind is bool and isinstance(value, str):
        said = value.strip().lower()
        if said in ("1", "true", "yes", "on"):
            return True
        if said in ("0", "false", "no", "off"):
            return False
    elif kind in (int, float, str) and not isinstance(value, (dict, list, bool)):
        try:
            return kind(value)
        except (TypeError, ValueError):
            pass
    elif not isinstance(kind, type) or isinstance(value, kind):
        return value
    raise ValueError(f"{name} cannot be {value!r}")


def load_settings(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SPINDRIFT") -> dict:
    """Settings of a JSON (or, with a YAML reader at hand, YAML) file, then PREFIX__A__B of the environment over them."""
    out: dict = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ValueError(f"{path}: no YAML reader is installed; use JSON") from None
            out = yaml.safe_load(text) or {}
        else:
            out = json.loads(text)
        if not isinstance(out, dict):
            raise ValueError(f"{path} holds no settings")
    for key, value in sorted((os.environ if env is None else env).items()):
        if key.startswith(f"{prefix}__"):
            at, *steps = [out, *key.removeprefix(f"{prefix}__").lower().split("__")]
            for step in steps[:-1]:
                at = at.setdefault(step, {})
            at[steps[-1]] = value
    return out


@dataclass
class Router:
    """Model calls by the model's name. clients: a function of (task, inputs, schema) for each name; schema-less answers are checked here."""

    clients: dict[str, Callable[[str, dict], Any]]
    routes: dict[str, str] = field(default_factory=dict)
    retries: int = 1

    def client(self, model: str) -> Callable:
        name = self.routes.get(model, model)
        if name not in self.clients:
            raise ValueError(f"no client for the model {model!r}")
        return self.clients[name]

    def __call__(self, model: str, task: str, inputs: dict, needs: Iterable[str] = ()) -> dict:
        """The answer as a structure with the needed fields; asked again, with what was wrong, where it has not."""
        wrong = ""
        for _ in range(self.retries + 1):
            answer = self.client(model)(task, {**inputs, **({"wrong": wrong} if wrong else {})})
            answer = parsed(answer) if isinstance(answer, str) else answer
            missing = [n for n in needs if not isinstance(answer, dict) or n not in answer]
            if isinstance(answer, dict) and not missing:
                return answer
            wrong = f"missing: {', '.join(missing)}" if isinstance(answer, dict) else "no JSON object"
        raise ValueError(f"{model} gave no answer to {task}: {wrong}")


def parsed(text: str) -> dict | None:
    """The JSON object of a text, or of its part from the first { to the last }."""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            if isinstance(made := json.loads(part), dict):
                return made
        except ValueError:
            continue
    return None


#: What a task can become from each state.
NEXT = {"pending": ("running", "canceled"), "running": ("completed", "failed", "canceled")}


class Tasks:
    """Research tasks: made, run, canceled, listed newest first. A task's Spark jobs carry its id as a tag, so cancelling stops them."""

    def __init__(self, spark=None, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.clock, self.lock = spark, clock, threading.Lock()
        self.rows: dict[str, dict] = {}

    def create(self, request: Any) -> str:
        with self.lock:
            task = uuid.uuid4().hex
            self.rows[task] = {"id": task, "created_at": self.clock(), "state": "pending", "request": request, "result": None, "error": ""}
            return task

    def move(self, task: str, state: str, **more: Any) -> bool:
        """Whether the task could go to the state; a task that has ended stays as it is."""
        with self.lock:
            row = self.rows[task]
            if state not in NEXT.get(row["state"], ()):
                return False
            row |= {"state": state, **more}
            return True

    def run(self, task: str, work: Callable[[Any], Any]) -> None:
        if not self.move(task, "running"):
            return
        if self.spark is not None:
            self.spark.addTag(task)
        try:
            self.move(task, "completed", result=work(self.rows[task]["request"]))
        except Exception as e:  # noqa: BLE001 - whatever stops a task is told in it
            self.move(task, "failed", error=f"{type(e).__name__}: {e}")
        finally:
            if self.spark is not None:
                self.spark.removeTag(task)

    def cancel(self, task: str) -> bool:
        done = self.move(task, "canceled")
        if done and self.spark is not None:
            self.spark.interruptTag(task)
        return done

    def get(self, task: str) -> dict | None:
        return dict(self.rows[task]) if task in self.rows else None

    def page(self, cursor: str = "", limit: int = 20) -> tuple[list[dict], str]:
        """A page of 1 to 50 tasks, newest first, and the cursor of the next one ('' at the end)."""
        offset, limit = int(cursor or 0), min(50, max(1, limit))
        rows = sorted(self.rows.values(), key=lambda r: (r["created_at"], r["id"]), reverse=True)
        return [dict(r) for r in rows[offset : offset + limit]], str(offset + limit) if offset + limit < len(rows) else ""


def in_order(work: Callable[[Any], Any], items: Iterable[Any], workers: int = 8) -> list[Any]:
    """What work gives for each item, in the items' order, a few at once; an item that fails gives its error."""

    def one(item: Any) -> Any:
        try:
            return work(item)
        except Exception as e:  # noqa: BLE001 - one failure does not stop the others
            return e

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(one, items))


def steps(ctx: Any, *chain: tuple[Callable[[Any], bool], Callable[[Any], Any]]) -> Any:
    """ctx through a chain of (should it run, what it does)."""
    for wanted, work in chain:
        if wanted(ctx):
            ctx = work(ctx)
    return ctx


def first_that_can(handlers: list[tuple[Callable[..., bool], Callable]], default: Callable) -> Callable:
    """A function that gives its arguments to the first handler that can take them."""

    def run(*args: Any) -> Any:
        return next((work for can, work in handlers if can(*args)), default)(*args)

    return run
