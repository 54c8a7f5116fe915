"""Routers that include each other, imports of imports, first visits and several repositories at once."""

import random
import textwrap

import pytest

from rippletrace.jobs import queries as Q
from rippletrace.jobs import trace as K
from rippletrace.jobs.derive import derive
from rippletrace.operators import graph as G
from rippletrace.operators import names as N
from rippletrace.operators import source_index as S

CHAIN = {f"r{i}.py": f"from fastapi import APIRouter\nfrom r{i - 1} import router as inner\nrouter = APIRouter(prefix='/r{i}', tags=['t{i}'], dependencies=[Depends(d{i})])\n@router.get('/own')\ndef own{i}(): pass\nrouter.include_router(inner)\n" for i in range(1, 13)}
NESTED = {
    **CHAIN,
    "r0.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix='/r0')\n@router.get('/own')\ndef own0(): pass\n",
    "main.py": """
        from fastapi import APIRouter, Depends, FastAPI
        import plain
        from pkg import shared, make_router, PREFIX
        from r12 import router as top
        from r3 import router as third

        V = "/v1"


        def create_app(settings):
            app = FastAPI(dependencies=[Depends(auth)])
            for each in (top, third):
                app.include_router(each, prefix=f"{V}/x", tags=["all"], dependencies=[Depends(limit)])
            app.include_router(make_router(), prefix=V + "/made")
            app.include_router(shared)
            if settings.debug:
                app.include_router(router=plain.router)

            @app.get(V + "/inner")
            @app.post(path="/outer")
            def handler(): pass

            app.add_api_route("/added", plain.view, methods=["PUT"])
            app.include_router(plain.router, prefix=settings.prefix)
            app.mount("/sub", sub)
            return app


        app = create_app(None)
        sub = FastAPI()
        @sub.get("/not-listed")
        def lost(): pass
        dead = APIRouter()
        @dead.get("/dead")
        def gone(): pass
        late = APIRouter()
        app.include_router(late, prefix="/late")
        @late.get("/too-late")
        def too_late(): pass
        a, b = APIRouter(prefix="/a"), None
        @app.get(settings.path)
        def unread(): pass
        @mock.patch("x.y")
        def test_it(): pass
        """,
    "plain.py": """
        from fastapi import APIRouter
        router = APIRouter()
        other = APIRouter(prefix="/o")
        @router.get("")
        def root(): pass
        other.include_router(router, prefix="/back")
        router.include_router(other)
        @other.get("/last")
        def last(): pass
        @deco
        def view(): pass
        """,
    "pkg/__init__.py": "from .inner import *\nfrom .inner import _hidden as seen\n",
    "pkg/inner.py": """
        from fastapi import APIRouter
        from .deep import shared
        PREFIX = "/p"
        def make_router():
            made = APIRouter(prefix="/m", tags=["made"])
            @made.delete("/{key}")
            def remove(key): pass
            return made
        def _hidden(): pass
        """,
    "pkg/deep.py": "from fastapi import APIRouter\nshared = APIRouter(prefix='/shared')\n@shared.get('/s')\ndef serve(): pass\n",
}


def files_of(spark, *apps):
    rows = [(repo, f"/{repo}/app/{name}", "app." + name.removesuffix(".py").removesuffix("/__init__").replace("/", "."), textwrap.dedent(text).lstrip("\n")) for repo, app in apps for name, text in app.items()]
    return spark.createDataFrame(rows, "repo string, file_path string, module string, content string")


@pytest.fixture(scope="module")
def nested(spark):
    return K.trace(files_of(spark, ("one", NESTED)))


def test_routes_of_nested_routers(nested):
    rows = nested.endpoints.orderBy("reg_order").collect()
    found = [(r["endpoint_id"], r["name"], r["tags"], r["dependencies"]) for r in rows]
    down = lambda top: [top - k for k in range(top + 1)]
    chain = []
    for top in (12, 3):
        for i in down(top):
            path = "/v1/x" + "".join(f"/r{j}" for j in range(top, i - 1, -1)) + "/own"
            chain.append((f"GET {path}", f"own{i}", ["all", *(f"t{j}" for j in range(top, max(i, 1) - 1, -1))], ["auth", "limit", *(f"d{j}" for j in range(top, max(i, 1) - 1, -1))]))
    assert found == [
        *chain,
        ("DELETE /v1/made/m/{key}", "remove", ["made"], ["auth"]),
        ("GET /shared/s", "serve", [], ["auth"]),
        ("GET ", "root", [], ["auth"]),
        ("POST /outer", "handler", [], ["auth"]),
        ("GET /v1/inner", "handler", [], ["auth"]),
        ("PUT /added", "view", [], ["auth"]),
    ]
    view = rows[-1]
    assert (view["file_path"], view["module"], view["start_line"], view["end_line"]) == ("/one/app/plain.py", "app.plain", 11, 11)
    errors = sorted((r["file_path"], r["error"], r["start_line"]) for r in nested.errors.collect())
    assert errors == [("/one/app/main.py", "Unreadable route: get", 41), ("/one/app/main.py", "Unreadable route: include_router", 24)]


def test_a_router_that_includes_its_outer_one_ends(spark):
    app = {"main.py": "from fastapi import FastAPI, APIRouter\napp = FastAPI()\na = APIRouter(prefix='/a')\nb = APIRouter(prefix='/b')\n@b.get('/x')\ndef x(): pass\nb.include_router(a)\na.include_router(b)\napp.include_router(a)\n"}
    rows = K.trace(files_of(spark, ("r", app))).endpoints.collect()
    assert [r["endpoint_id"] for r in rows] == ["GET /a/b/x"]


def test_scan_survives_any_file():
    deep = "def f():\n    " + "a" + ".b" * 5000 + "()\n"
    assert [r["kind"] for r in S.scan_file("x.py", "x", deep)] in (["symbol"], ["error"])
    sums = "from fastapi import APIRouter\nr = APIRouter(prefix=" + "+".join(["'/a'"] * 300) + ")\n@r.get('/x')\ndef f(): pass\n"
    assert [r["path"] for r in S.scan_file("x.py", "x", sums) if r["kind"] == "route"] == ["/a" * 300 + "/x"]
    for bad in ("def (", "\0", "(" * 500, "x = " + "-" * 100_000 + "1", "\ud800"):
        assert [r["kind"] for r in S.scan_file("x.py", "x", bad)] in (["error"], [])
    assert S.scan_file("x.py", "x", None) == S.scan_file("x.py", "x", "") == []


SHARED = """
    from app.pkg import work, Tool, tools as t
    from app.stars import starred, _private, listed
    from fastapi import FastAPI
    app = FastAPI()

    @app.get("/a")
    def a():
        work()
        t.use()
        starred()

    @app.get("/b")
    def b(tool: Tool):
        tool.run()
        _private()
        listed()
    """
PACKAGE = {
    "main.py": SHARED,
    "pkg/__init__.py": "from .work import work\nfrom .impl import Tool\nfrom . import tools\n",
    "pkg/work.py": "from app.stars import starred\ndef work():\n    starred()\n    back()\ndef back():\n    work()\n",
    "pkg/impl.py": "class Tool:\n    def run(self):\n        return self.walk()\n    def walk(self): pass\n",
    "pkg/tools.py": "def use(): pass\n",
    "stars.py": "from app.more import *\nfrom app.other import *\nfrom app.stars import *\n",
    "more.py": "from app.stars import *\ndef starred(): pass\ndef _private(): pass\n",
    "other.py": "from app.more import starred\n__all__ = ['listed', '_private']\ndef listed(): pass\ndef _private(): pass\ndef starred(): pass\n",
}
OTHER = {**PACKAGE, "pkg/work.py": "def work(): pass\n", "pkg/impl.py": "class Tool:\n    def run(self): pass\n"}


def test_names_through_packages_in_two_repositories(spark):
    traced = K.trace(files_of(spark, ("one", PACKAGE), ("two", OTHER)))
    found = {}
    for r in traced.symbols.orderBy("repo", "endpoint_id", "sym_ord").collect():
        assert r["file_path"].startswith(f"/{r['repo']}/")
        found.setdefault((r["repo"], r["endpoint_id"]), []).append(r["symbol_name"].removeprefix("app."))
    assert found == {
        ("one", "GET /a"): ["main.a", "pkg.work.work", "more.starred", "pkg.work.back", "pkg.tools.use"],
        ("one", "GET /b"): ["main.b", "pkg.impl.Tool.run", "pkg.impl.Tool.walk", "other._private", "other.listed"],
        ("two", "GET /a"): ["main.a", "pkg.work.work", "pkg.tools.use", "more.starred"],
        ("two", "GET /b"): ["main.b", "pkg.impl.Tool.run", "other._private", "other.listed"],
    }
    stacks = {(r["repo"], r["endpoint_id"], r["file_path"].rsplit("/", 1)[1]): [f["function_name"].rsplit(".", 1)[1] for f in r["frames"]] for r in traced.stacks.collect()}
    assert stacks["one", "GET /a", "more.py"] == ["a", "work"] and stacks["two", "GET /a", "more.py"] == ["a"]
    assert all(r["file_path"].startswith(f"/{r['repo']}/") for r in traced.references.collect())
    assert traced.endpoints.groupBy("repo").count().collect() and {tuple(r) for r in traced.endpoints.select("repo", "reg_order").collect()} == {("one", 0), ("one", 1), ("two", 0), ("two", 1)}


def test_aliases_that_lead_on_and_in_circles(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(50)] + [(f"c{i}", f"c{(i + 1) % 12}") for i in range(12)] + [("to.c", "c3.x"), ("m", "p.m"), ("p", "q"), ("q.m.f", "end"), ("grow", "grow.x"), ("u", "v.x"), ("v", "u.y"), ("same", "same")]
    plan = [("r", a, b, False) for a, b in rows] + [("r", "w.work", "w.work.work", True), ("s", "n50", "elsewhere", False), (None, "n3", "x", False)]
    found = N.resolve_aliases(spark.createDataFrame(plan, "repo string, alias string, target string, is_module boolean"))
    got = {(r["repo"], r["alias"]): r["target"] for r in found.collect() if r["repo"]}
    assert got == {**{("r", f"n{i}"): "n50" for i in range(50)}, ("r", "m"): "q.m", ("r", "p"): "q", ("r", "q.m.f"): "end", ("r", "w.work"): "w.work.work", ("s", "n50"): "elsewhere"}
    names = spark.createDataFrame([("r", "m.f"), ("r", "n7.a.b"), ("r", "w.work"), ("r", "w.work.other"), ("s", "n7"), ("r", None)], "repo string, fullname string")
    assert {(r["repo"], r["fullname"]): r["target"] for r in N.follow(names, found).collect()} == {("r", "m.f"): "end", ("r", "n7.a.b"): "n50.a.b", ("r", "w.work"): "w.work.work"}
    assert N.resolve_aliases(spark.createDataFrame([], "repo string, alias string, target string, is_module boolean")).collect() == []


def plain_walk(roots, calls, files):
    """(node, place, parent, stack) in the order of a recursive walk, without recursion."""
    out = {}
    for endpoint, root in roots:
        rows, seen, first = [(root, 0, None, None)], {root}, set()
        path = [(root, iter(calls.get(root, [])))]
        while path:
            to = next((c for c in path[-1][1] if c not in seen), None)
            if to is None:
                path.pop()
                continue
            stack = [n for n, _ in path] if to in files and files[to] not in first else None
            first.add(files.get(to))
            seen.add(to)
            rows.append((to, len(rows), path[-1][0], stack))
            path.append((to, iter(calls.get(to, []))))
        out[endpoint] = rows
    return out


def walked(frame):
    out = {}
    for r in frame.orderBy("endpoint", "place").collect():
        out.setdefault(r["endpoint"], []).append((r["node"], r["place"], r["parent"], r["stack"]))
    return out


def test_first_visits_equal_a_plain_walk(spark):
    draw = random.Random(3)
    edges = [(a, draw.randrange(60), o) for a in range(50) for o in range(draw.randrange(5))] + [(1, 1, 0), (7, 8, 0), (7, 8, 3)]
    roots = [(f"e{i}", draw.randrange(60)) for i in range(20)] + [("x", 59), ("y", 59)]
    files = {n: f"f{n % 7}" for n in range(55)}
    e = spark.createDataFrame(edges, "caller long, callee long, ord int")
    reached = G.reachability(spark.createDataFrame(roots, "endpoint string, node long"), e)
    calls = {}
    for a, b, o in sorted(edges, key=lambda x: (x[0], x[2], x[1])):
        calls.setdefault(a, []).append(b)
    found = walked(G.first_visits(reached, e, spark.createDataFrame(list(files.items()), "node long, file string")))
    assert found == plain_walk(roots, calls, files)


def test_the_query_of_first_visits(spark, sf_dir):
    symbols, edges, ends = derive(spark, sf_dir, "symbols", "call_edges", "named_endpoints")
    calls = {}
    for r in edges.select("caller", "callee", "ord").orderBy("caller", "ord", "callee").collect():
        calls.setdefault(r[0], []).append(r[1])
    files = {r[0]: r[1] for r in symbols.select("node", "file_path").collect()}
    assert walked(Q.QUERIES["first_visits"](spark, sf_dir)) == plain_walk([tuple(r) for r in ends.select("reg_order", "node").collect()], calls, files)


def test_rounds_of_the_closure_shuffle_only_new_rows(spark):
    """What was reached and the calls are read in their buckets; a round shuffles its own rows."""
    plans, add = [], G.Growing.add
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        G.Growing.add = lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or add(self, rows)
        edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "caller long, callee long")
        found = G.reachability(spark.createDataFrame([("e", 0)], "endpoint string, node long"), edges).count()
    finally:
        G.Growing.add = add
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for p in plans if "LeftAnti" in p]
    assert found == 7 and len(rounds) >= 6 and all(p.count("Exchange hashpartitioning") == 2 for p in rounds)


PATTERNS = {
    "deps.py": """
        from contextlib import contextmanager
        from .db import Session, open_session
        from .cache import Cache
        from typing import Annotated, Optional

        class Base:
            cache: Cache
            def __init__(self, session: Session):
                self.session = session
                self.other = open_session()
                self.log: "Optional[Log]" = None

        class Log:
            def note(self): pass
            @staticmethod
            def plain(x): x.note()
            @classmethod
            def make(cls) -> "Log": return cls()

        class lower:
            def act(self): pass

        def get_base() -> Base: return Base(open_session())
        async def get_later() -> Annotated[Base, "x"]: return get_base()
        def untyped(): return get_base()
        def nothing(x): return x.y
        base = get_base()
        """,
    "db.py": """
        class Query:
            def first(self): return self
            def where(self) -> "Query": return self
        class Session:
            def __enter__(self) -> "Session": return self
            def query(self) -> Query: return Query()
            def close(self): self.query().where().first()
        def open_session() -> Session: return Session()
        """,
    "cache.py": "class Cache:\n    def get(self): pass\n",
    "main.py": """
        from fastapi import FastAPI, Depends
        from app import deps
        from app.deps import Base, Log, base, get_base, get_later, untyped, nothing, lower
        app = FastAPI()

        @app.get("/fields")
        def fields(b: Base = Depends(get_base)):
            b.cache.get()
            b.session.close()

        @app.get("/returned")
        async def returned():
            x = get_base()
            x.other.query().first()
            (await get_later()).log.note()

        @app.get("/untyped")
        def from_untyped():
            untyped().cache.get()
            nothing(1).close()

        @app.get("/module")
        def of_module():
            deps.base.session.close()
            base.log.note()

        @app.get("/with")
        def within():
            with deps.open_session() as s:
                s.close()

        @app.get("/class")
        def of_class(small: lower):
            Log.make().note()
            small.act()
            for small in ():
                small.act()

        @app.get("/unknown")
        def unknown(request, b: Base):
            request.close()
            b.missing.close()
            b = request
            b.session.close()
        """,
}


def test_what_objects_are_across_files(spark):
    traced = K.trace(files_of(spark, ("r", PATTERNS)))
    found = {}
    for r in traced.symbols.where("sym_ord > 0").orderBy("endpoint_id", "sym_ord").collect():
        found.setdefault(r["endpoint_id"], []).append(r["symbol_name"].removeprefix("app."))
    order = lambda names: [n for n in names if not n.endswith(("Base", "Query", "Session"))]
    assert order(found["GET /returned"])[:2] == ["deps.get_base", "db.open_session"]
    # Classes themselves stand for the first lines of their files.
    reach = {k: set(order(v)) for k, v in found.items()}
    of_close = {"db.Session.close", "db.Session.query", "db.Query.first", "db.Query.where"}
    assert reach == {
        "GET /fields": {"cache.Cache.get"} | of_close,
        "GET /returned": {"deps.get_base", "db.open_session", "db.Session.query", "db.Query.first", "deps.get_later", "deps.Log.note"},
        "GET /untyped": {"deps.untyped", "deps.get_base", "db.open_session", "cache.Cache.get", "deps.nothing"},
        "GET /module": of_close | {"deps.Log.note"},
        "GET /with": {"db.open_session"} | of_close,
        "GET /class": {"deps.Log.make", "deps.Log.note", "deps.lower.act"},
    }
