"""Registry, settings, routes of models, tasks, pools."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import pytest

from spindrift.plans import components as c


@dataclass
class Limits:
    size: int = 3


@dataclass
class CacheSettings:
    path: str
    ttl: float = 1.5
    on: bool = True
    limits: Limits = field(default_factory=Limits)


def registry() -> c.Registry:
    r = c.Registry()

    @r.component("cache", "memory", CacheSettings, default=True)
    class Memory:
        def __init__(self, settings: CacheSettings) -> None:
            self.settings = settings

    @r.component("cache", "none")
    def none():
        return None

    @r.component("crawler", "plain")
    class Plain:
        def __init__(self, cache: Memory, depth: int = 1) -> None:
            self.cache, self.depth = cache, depth

    Plain.__init__.__annotations__["cache"] = Memory
    return r


def test_registry():
    r = registry()
    made = r.make("cache", settings={"path": "/x", "limits": {"size": "7"}}, env={"CACHE_MEMORY_TTL": "2", "CACHE_MEMORY_ON": "no"})
    assert (made.settings.path, made.settings.ttl, made.settings.on, made.settings.limits.size) == ("/x", 2.0, False, 7)
    crawler = r.make("crawler", "plain", env={"CACHE_MEMORY_PATH": "/y"}, depth=2)
    assert crawler.cache.settings.path == "/y" and crawler.depth == 2
    assert r.make("crawler", "plain", cache=None).cache is None and r.names("cache") == ["memory", "none"] and r.make("cache", "none") is None
    for wrong in ({"path": "x", "odd": 1}, {}, {"path": "x", "ttl": "soon"}, {"path": "x", "on": "maybe"}, {"path": ["x"]}):
        with pytest.raises(ValueError):
            r.make("cache", "memory", wrong, env={})
    for family, name in (("cache", "redis"), ("odd", "x"), ("crawler", None)):
        with pytest.raises(ValueError):
            r.make(family, name)
    with pytest.raises(ValueError):
        r.component("cache", "memory")(object)
    with pytest.raises(ValueError):
        r.component("cache", "other", default=True)(object)
    assert "spindrift.plans.catalog" in r.discover("spindrift.plans")


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    at.write_text(json.dumps({"cache": {"path": "/a", "ttl": 1}, "mode": "x"}))
    assert c.load_settings(str(at), {"SPINDRIFT__CACHE__TTL": "9", "SPINDRIFT__NEW__A__B": "1", "OTHER": "2"}) == {"cache": {"path": "/a", "ttl": "9"}, "mode": "x", "new": {"a": {"b": "1"}}}
    at.write_text("[1]")
    with pytest.raises(ValueError):
        c.load_settings(str(at), {})
    assert c.load_settings(None, {}) == {}


def test_router():
    seen = []

    def client(task: str, inputs: dict):
        seen.append(inputs)
        return 'Here: {"a": 1, "b": 2}' if "wrong" in inputs else "none"

    route = c.Router({"one": client}, {"fast": "one"})
    assert route("fast", "t", {"q": 1}, ["a"]) == {"a": 1, "b": 2} and len(seen) == 2 and "wrong" in seen[1]
    with pytest.raises(ValueError):
        route("one", "t", {}, ["z"])
    with pytest.raises(ValueError):
        route("slow", "t", {})


def test_tasks(spark):
    clock = iter(range(100))
    tasks = c.Tasks(spark, lambda: next(clock))
    ids = [tasks.create(i) for i in range(60)]
    tasks.run(ids[0], lambda r: spark.range(10).count() + r)
    tasks.run(ids[1], lambda r: 1 / 0)
    assert tasks.get(ids[0])["result"] == 10 and tasks.get(ids[1])["state"] == "failed" and "ZeroDivisionError" in tasks.get(ids[1])["error"]
    assert tasks.cancel(ids[2]) and not tasks.cancel(ids[0]) and tasks.get("none") is None
    tasks.run(ids[2], lambda r: r)
    assert tasks.get(ids[2])["state"] == "canceled" and tasks.get(ids[2])["result"] is None
    first, cursor = tasks.page("", 500)
    second, end = tasks.page(cursor, 50)
    assert [r["id"] for r in first + second] == ids[::-1] and len(first) == 50 and end == ""


def test_pool_and_steps():
    def work(x: int) -> int:
        time.sleep(0.01 * (5 - x))
        return 10 // x

    got = c.in_order(work, [1, 2, 0, 5], 4)
    assert got[:2] + got[3:] == [10, 5, 2] and isinstance(got[2], ZeroDivisionError)
    assert c.steps(1, (lambda x: True, lambda x: x + 1), (lambda x: x > 5, lambda x: 0), (lambda x: x == 2, lambda x: x * 10)) == 20
    run = c.first_that_can([(lambda u: u.endswith(".pdf"), lambda u: "pdf"), (lambda u: "x" in u, lambda u: "x")], lambda u: "html")
    assert [run(u) for u in ("x.pdf", "x", "y")] == ["pdf", "x", "html"]
