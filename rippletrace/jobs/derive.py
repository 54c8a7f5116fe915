"""Tables of the shape that the operators need, derived from the given ones.

The given tables hold neither code nor diffs. Plain SQL that Spark and other
engines understand alike makes such tables out of ``documents``, ``pages`` and
``lineitem``; ``{array}`` stands for the name of the function that makes an
array, ``{docs}`` for the number of documents. The work of each query so grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions import columns as C

_BASE = "CASE WHEN doc_id % 50 = 0 THEN '__init__.py' WHEN doc_id % 50 = 1 THEN 'main.py' ELSE 'mod_' || CAST(doc_id AS STRING) || '.py' END"
_FILE = f"'/srv/app/' || source || '/p' || CAST(doc_id AS STRING) || '/' || {_BASE}"
_N = "4 * {docs}"

SOURCE_FILES = f"SELECT doc_id, {_FILE} AS file_path, text AS content FROM documents"

SYMBOLS = " UNION ALL ".join(
    f"""SELECT doc_id * 4 + {k} AS node, CAST(FLOOR((doc_id * 4 + {k}) / 64) AS BIGINT) AS block, doc_id, {k} AS def_order,
    'app.' || source || '.m' || CAST(doc_id AS STRING) AS module, 'f{k}' AS name,
    'app.' || source || '.m' || CAST(doc_id AS STRING) || '.f{k}' AS fullname, {_FILE} AS file_path,
    {1 + 12 * k} AS start_line, CASE WHEN (doc_id + {k}) % 9 = 0 THEN NULL ELSE CAST({4 + 12 * k} + (doc_id + {k}) % 7 AS INT) END AS end_line
    FROM documents"""
    for k in range(4)
)

_EDGES = [
    ("TRUE", "node + node % 64 + 1", 1),
    ("TRUE", "node + node % 64 + 2", 2),
    ("node % 64 % 3 = 0", "node + 7", 3),
    ("node % 16 = 15", "node - node % 64 + CAST(FLOOR(node % 64 / 4) AS BIGINT)", 4),
]
CALL_EDGES = " UNION ALL ".join(
    f"""SELECT block, node AS caller, {callee} AS callee, {o} AS ord, CAST(start_line + 1 + {o % 3} AS INT) AS line FROM symbols
    WHERE {when} AND {callee} < block * 64 + 64 AND {callee} < {_N}"""
    for when, callee, o in _EDGES
)

ENDPOINTS = f"""SELECT 'app' AS repo, page_id AS reg_order, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path,
    CASE page_id % 4 WHEN 0 THEN {{array}}('GET') WHEN 1 THEN {{array}}('POST') WHEN 2 THEN {{array}}('PUT', 'GET') ELSE {{array}}('DELETE', 'PATCH') END AS methods,
    {{array}}('tag' || CAST(page_id % 7 AS STRING), 'tag' || CAST(page_id % 5 AS STRING)) AS tags,
    {{array}}('get_db', 'dep' || CAST(page_id % 6 AS STRING)) AS dependencies,
    s.node, s.name, s.module, s.file_path, s.start_line,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 0 ELSE COALESCE(s.end_line, s.start_line + 50) END AS end_line
    FROM pages JOIN symbols s ON s.node = (page_id * 13 + 5) % ({_N})"""

# In each file the endpoint's own function, and those that it calls.
REFERENCES = """SELECT DISTINCT 'app' AS repo, e.endpoint_id, CASE WHEN s.node = e.node THEN 0 ELSE 1 + s.node END AS ref_ord0,
    s.node AS sym_ord, s.file_path, s.fullname AS symbol_name, s.start_line, COALESCE(s.end_line, s.start_line + 50) AS end_line
    FROM (SELECT endpoint_id, node, node AS target FROM named_endpoints UNION
          SELECT e.endpoint_id, e.node, c.callee AS target FROM named_endpoints e JOIN call_edges c ON c.caller = e.node) e
    JOIN symbols s ON s.node = e.target"""

DIFF_FILES = f"""SELECT 'app' AS repo, l_orderkey AS change_id, file_idx, d.file_path,
    CASE WHEN l_partkey % 7 = 3 THEN REPLACE(d.file_path, '.py', '.js') WHEN l_suppkey % 5 = 2 THEN SUBSTRING(d.file_path, 10) WHEN l_suppkey % 5 = 3 THEN d.base ELSE d.file_path END AS name,
    CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'R' THEN 'deleted' WHEN l_partkey % 11 = 0 THEN 'renamed' ELSE 'modified' END AS change_type,
    CAST(1 + l_suppkey % 40 AS INT) AS start_line, CAST(1 + CAST(FLOOR(l_quantity) AS BIGINT) % 5 AS INT) AS plus, CAST(l_linenumber % 3 AS INT) AS minus
    FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS INT) AS file_idx
          FROM lineitem) x
    JOIN (SELECT doc_id, {_FILE} AS file_path, {_BASE} AS base FROM documents) d ON d.doc_id = l_partkey % {{docs}}"""

# The rows of DIFF_FILES in another order of work: lines get their document's source, and no paths, before they are numbered. So they are
# shuffled as they are, and by order last, which gathering a change's files needs as well; paths are made when nothing is shuffled any more.
# ``derive`` gives the number of parts, for what is done with a part (diffs are written and parsed) is far more work than its bytes tell: joined to
# one part a core, the last few would take as long as all the others.
_NUMBERED = "FROM (SELECT *, CAST(ROW_NUMBER"
DIFF_FILES_LATE = (
    DIFF_FILES.split(_NUMBERED)[0]
    + f"""FROM (SELECT *, {_FILE} AS file_path, {_BASE} AS base
      {_NUMBERED}{DIFF_FILES.split(_NUMBERED)[1].split("FROM lineitem")[0]}
        FROM (SELECT /*+ REPARTITION(l_orderkey) */ lineitem.*, documents.doc_id, documents.source FROM lineitem LEFT JOIN documents ON documents.doc_id = l_partkey % {{docs}}) y) x
      WHERE doc_id IS NOT NULL) d"""
)

# Routers in blocks of 16 that include each other; the first of a block is an application, but in every fifth block a router that nothing includes.
ROUTER_PLAN = """SELECT doc_id, CAST(FLOOR(doc_id / 16) AS BIGINT) AS block, doc_id % 16 AS i, CASE WHEN doc_id % 16 % 3 = 1 OR doc_id % 16 = 0 THEN '' ELSE '/r' || CAST(doc_id % 16 AS STRING) END AS own_prefix,
    CASE WHEN doc_id % 16 > 0 AND doc_id % 2 = 0 THEN 't' || CAST(doc_id % 16 AS STRING) END AS own_tag,
    '/srv/app/routes/r' || CAST(doc_id AS STRING) || '.py' AS file_path FROM documents"""
INCLUDE_PLAN = """SELECT p.doc_id AS outer_id, c.doc_id AS inner_id, CASE WHEN c.i % 3 = 0 THEN '' ELSE '/v' || CAST(c.i AS STRING) || w.more END AS prefix, CASE WHEN c.i % 5 = 0 THEN 'v' || CAST(c.i AS STRING) END AS tag,
    CAST(ROW_NUMBER() OVER (PARTITION BY p.doc_id ORDER BY c.i) AS INT) AS seq
    FROM (SELECT i, CAST(CASE WHEN i % 4 = 0 THEN FLOOR(i / 2) ELSE i - 1 END AS BIGINT) AS outer_i, '' AS more, 0 AS least FROM (SELECT DISTINCT i FROM router_plan WHERE i > 0) x
        UNION ALL SELECT 8, 2, '/again', 0 UNION ALL SELECT 4, 6, '/round', 1) w
    JOIN router_plan c ON c.i = w.i AND (w.least = 0 OR c.block % 3 = 1) JOIN router_plan p ON p.i = w.outer_i AND p.block = c.block"""

# Chains of names of 1 to 20 steps, half of them by way of a module with another name; every seventh is a circle.
ALIAS_PLAN = """SELECT 'app' AS repo, 'p.b' || CAST(block AS STRING) || '.n' || CAST(i AS STRING) AS alias,
    CASE WHEN i < block % 20 THEN CASE WHEN i % 2 = 1 THEN 'q.b' ELSE 'p.b' END || CAST(block AS STRING) || '.n' || CAST(i + 1 AS STRING) WHEN block % 7 = 6 THEN 'p.b' || CAST(block AS STRING) || '.n0'
      ELSE 'p.b' || CAST(block AS STRING) || '.' || source END AS target
    FROM (SELECT CAST(FLOOR(doc_id / 21) AS BIGINT) AS block, doc_id % 21 AS i, source FROM documents) x WHERE i <= block % 20
    UNION ALL SELECT DISTINCT 'app', 'q.b' || CAST(CAST(FLOOR(doc_id / 21) AS BIGINT) AS STRING), 'p.b' || CAST(CAST(FLOOR(doc_id / 21) AS BIGINT) AS STRING) FROM documents"""

#: In the order in which each needs those before.
DERIVED = {
    "source_files": SOURCE_FILES,
    "symbols": SYMBOLS,
    "call_edges": CALL_EDGES,
    "endpoints": ENDPOINTS,
    "diff_plan": DIFF_FILES,
    "router_plan": ROUTER_PLAN,
    "include_plan": INCLUDE_PLAN,
    "alias_plan": ALIAS_PLAN,
}


def derive(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The tables ``names`` as DataFrames.

    They are temporary views of a session of their own, so that runs over
    different folders don't meet.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for t in ("documents", "pages", "lineitem"):
        session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    docs, parts = session.table("documents").count(), spark.conf.get("spark.sql.shuffle.partitions")
    late = DIFF_FILES_LATE.replace("REPARTITION(", f"REPARTITION({parts}, ")
    for name, sql in (DERIVED | {"diff_plan": late}).items():
        session.sql(sql.format(array="array", docs=docs)).createOrReplaceTempView(name)
        if name == "endpoints":
            named = session.table("endpoints").withColumn("endpoint_id", C.endpoint_id(F.col("methods"), F.col("path")))
            named.createOrReplaceTempView("named_endpoints")
            session.sql(REFERENCES).createOrReplaceTempView("reference_rows")
            # Files by when the endpoint first refers to them.
            session.sql(
                """SELECT repo, endpoint_id, file_path, start_line, end_line, sym_ord, symbol_name,
                MIN(ref_ord0) OVER (PARTITION BY endpoint_id, file_path) AS ref_ord FROM reference_rows"""
            ).createOrReplaceTempView("endpoint_references")
    return [session.table(n) for n in names]


_DOCS = "(SELECT COUNT(*) FROM documents)"
#: SQL that makes the same tables for an oracle, by name and in the order in which each needs those before.
ORACLE_TABLES = {
    **{n: DERIVED[n].format(array="list_value", docs=_DOCS) for n in ("source_files", "symbols", "call_edges", "endpoints")},
    "named_endpoints": "SELECT *, array_to_string(list_sort(methods), ',') || ' ' || path AS endpoint_id FROM endpoints",
    "reference_rows": REFERENCES,
    "endpoint_references": """SELECT repo, endpoint_id, file_path, start_line, end_line, sym_ord, symbol_name,
       MIN(ref_ord0) OVER (PARTITION BY endpoint_id, file_path) AS ref_ord FROM reference_rows""",
    "diff_plan": DIFF_FILES.format(docs=_DOCS),
    "router_plan": ROUTER_PLAN,
    "include_plan": INCLUDE_PLAN,
    "alias_plan": ALIAS_PLAN,
    # The symbols as they stand in source code, where each one has an end.
    "code_symbols": "SELECT * REPLACE (CAST(4 + 12 * def_order + (doc_id + def_order) % 7 AS INT) AS end_line) FROM symbols",
}


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, module, content): Python files with the functions of ``symbols``, the calls of ``call_edges`` and the routes of ``endpoints``.

    Functions and calls stand in the lines that these tables give. What is
    called is imported below the functions, and routes are added last.
    """
    symbols, edges, ends = derive(spark, sf_dir, "symbols", "call_edges", "endpoints")
    short = F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("_"), "name")
    # Some modules are imported by way of others that import from them, by name, all at once or twice over.
    doc, own = F.col("doc_id").cast("string"), F.col("module")
    facade, deep = F.concat(F.lit("app.facade.m"), doc), F.concat(F.lit("app.facade.deep"), doc)
    origin = F.when(F.col("doc_id") % 20 == 0, deep).when(F.col("doc_id") % 5 == 0, facade).otherwise(own)
    callee = symbols.select(F.col("node").alias("callee"), short.alias("short"), F.concat(F.lit("from "), origin, F.lit(" import "), "name", F.lit(" as "), short).alias("import"))
    call = F.struct("line", "ord", F.concat("short", F.lit("()")).alias("text"), "import")
    calls = edges.join(callee, "callee").groupBy(F.col("caller").alias("node")).agg(F.array_sort(F.collect_list(call)).alias("calls"))
    quoted = F.array_join(F.transform("methods", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", ")
    route = F.concat(F.lit("app.add_api_route('"), "path", F.lit("', "), "name", F.lit(", methods=["), quoted, F.lit("])\n"))
    routes = ends.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(route)), "").alias("routes"))
    rows = symbols.join(calls, "node", "left").join(routes, "node", "left")
    length = F.lit(3).cast("int") + ((F.col("doc_id") + F.col("def_order")) % 7).cast("int")
    none = F.array().cast("array<struct<line:int,ord:int,text:string,import:string>>")
    here = lambda i: F.transform(F.filter(F.coalesce("calls", none), lambda c: c["line"] == F.col("start_line") + i), lambda c: c["text"])
    body = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.lit("    "), F.array_join(F.concat(F.array(F.lit("pass")), here(i)), "; "), F.lit("\n")))
    text = F.concat(F.lit("def "), "name", F.lit("(x):\n"), F.array_join(body, ""), F.repeat(F.lit("\n"), 11 - length))
    parts = rows.select("doc_id", "file_path", "module", "def_order", text.alias("text"), F.transform(F.coalesce("calls", none), lambda c: c["import"]).alias("imports"), F.coalesce("routes", F.lit("")).alias("routes"))
    # In as many parts as asked: they are few bytes, and much work where they are scanned.
    of = ["doc_id", "file_path", "module"]
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *of).groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("def_order", "text", "imports", "routes"))).alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    imports = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["imports"])))), "\n")
    some = symbols.where("def_order = 0 and doc_id % 5 = 0")
    given = F.when(F.col("doc_id") % 10 == 0, F.lit("*")).otherwise(F.lit("f0, f1, f2, f3"))
    file = lambda module: F.concat(F.lit("/srv/"), F.replace(module, F.lit("."), F.lit("/")), F.lit(".py")).alias("file_path")
    first = some.select(file(facade), facade.alias("module"), F.concat(F.lit("from "), own, F.lit(" import "), given, F.lit("\n")).alias("content"))
    second = some.where("doc_id % 20 = 0").select(file(deep), deep.alias("module"), F.concat(F.lit("from "), facade, F.lit(" import *\n")).alias("content"))
    made = F.lit("\nfrom fastapi import FastAPI\napp = FastAPI()\n")
    files = parts.select("file_path", "module", F.concat(joined("text"), imports, made, joined("routes")).alias("content"))
    return files.unionByName(first).unionByName(second)


def router_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, module, content): a file for each router of ``router_plan``, with two routes, the includes of ``include_plan`` between them and the document's text as a comment."""
    routers, includes = derive(spark, sf_dir, "router_plan", "include_plan")
    text = lambda c: F.col(c).cast("string")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    tags = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(", tags=["), quoted(F.col(c)), F.lit("]"))).otherwise("")
    load = F.concat(F.lit("from app.routes.r"), text("inner_id"), F.lit(" import router as c"), text("inner_id"), F.lit("\n"))
    call = F.concat(F.lit("router.include_router(c"), text("inner_id"), F.lit(", prefix="), quoted(F.col("prefix")), tags("tag"), F.lit(")\n"))
    lines = includes.groupBy(F.col("outer_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", load.alias("load"), call.alias("call")))).alias("lines"))
    joined = lambda c: F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<seq:int,load:string,call:string>>")), lambda x: x[c]), "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]+", "\n# ").alias("note"))
    is_app = (F.col("i") == 0) & (F.col("block") % 5 != 4)
    made = F.when(is_app, F.lit("router = FastAPI()\n")).otherwise(F.concat(F.lit("router = APIRouter(prefix="), quoted(F.col("own_prefix")), tags("own_tag"), F.lit(")\n")))
    route = lambda verb, name: F.concat(F.lit(f"@router.{verb}('/{name}"), text("doc_id"), F.lit(f"')\ndef {name}"), text("doc_id"), F.lit("(): pass\n"))
    rows = routers.join(lines, "doc_id", "left").join(docs, "doc_id")
    content = F.concat(F.lit("from fastapi import APIRouter, FastAPI\n"), joined("load"), made, route("get", "own"), joined("call"), route("post", "late"), F.lit("# "), "note", F.lit("\n"))
    return rows.select("file_path", F.concat(F.lit("app.routes.r"), text("doc_id")).alias("module"), content.alias("content"))


def service_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, module, content): for each document a class whose objects have the next document's as ``next``, declared in one of four ways.

    A method calls that of the object which is 1 to 5 steps on. Every third file
    is imported by way of a package.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]+", "\n# ").alias("note"))
    text = lambda c: c.cast("string")
    doc, then = text(F.col("doc_id")), text(F.col("doc_id") + 1)
    origin = F.when((F.col("doc_id") + 1) % 3 == 0, F.lit("app.svc")).otherwise(F.concat(F.lit("app.svc.m"), then))
    head = F.concat(F.lit("from "), origin, F.lit(" import S"), then, F.lit(", make"), then, F.lit("\n\n\nclass S"), doc, F.lit(":\n"))
    held = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("    next: S"), then, F.lit("\n")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("    def __init__(self, other: 'S"), then, F.lit(" | None' = None):\n        self.next = other\n")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("    def __init__(self):\n        self.next = make"), then, F.lit("()\n")))
        .otherwise(F.concat(F.lit("    async def start(self):\n        made = S"), then, F.lit("()\n        self.next = made\n")))
    )
    on = F.repeat(F.lit(".next"), (1 + F.col("doc_id") % 5).cast("int"))
    run = F.concat(F.lit("    def run(self):\n        far = self"), on, F.lit("\n        far.run()\n\n\ndef make"), doc, F.lit("() -> S"), doc, F.lit(":\n    return S"), doc, F.lit("()\n# "), "note", F.lit("\n"))
    files = docs.select(F.concat(F.lit("/srv/app/svc/m"), doc, F.lit(".py")).alias("file_path"), F.concat(F.lit("app.svc.m"), doc).alias("module"), F.concat(head, held, run).alias("content"))
    line = F.concat(F.lit("from app.svc.m"), doc, F.lit(" import S"), doc, F.lit(", make"), doc)
    package = docs.where("doc_id % 3 = 0").groupBy().agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    return files.unionByName(package.select(F.lit("/srv/app/svc/__init__.py").alias("file_path"), F.lit("app.svc").alias("module"), "content"))


def diff_texts(plan: DataFrame) -> DataFrame:
    """(repo, change_id, diff_text): the planned files of each change as one unified diff.

    In every 97th change the last hunk is shorter than it says.
    """
    path, kind = F.col("name"), F.col("change_type")
    n = lambda c: c.cast("string")

    def numbered_lines(word: str, count: Column) -> Column:
        """Lines ``word`` 1, 2, ...; few ones, as they are planned, are the start of a fixed text."""
        few = "".join(f"{word} {i}\n" for i in range(1, 10))
        many = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(f"{word} "), n(i), F.lit("\n"))), "")
        return F.when(count < 1, "").when(count < 10, F.substring(F.lit(few), F.lit(1), count * (len(word) + 3))).otherwise(many)

    new, old = numbered_lines("+new", F.col("plus")), lambda count: numbered_lines("-old", count)
    header = lambda a, b: F.concat(F.lit("--- "), a, F.lit("\n+++ "), b, F.lit("\n"))
    hunk = lambda a, b, c, d: F.concat(F.lit("@@ -"), n(a), F.lit(","), n(b), F.lit(" +"), n(c), F.lit(","), n(d), F.lit(" @@\n"))
    a, b = F.concat(F.lit("a/"), path), F.concat(F.lit("b/"), path)
    start, plus, minus = F.col("start_line"), F.col("plus"), F.col("minus")
    # Of a broken hunk one line more is said to be there on either side.
    more = (F.col("change_id") % 97 == 0).cast("int")
    edit = F.concat(hunk(start, minus + 1 + more, start, plus + 1 + more), F.lit(" same\n"), old(minus), new)
    text = (
        F.when(kind == "added", F.concat(header(F.lit("/dev/null"), b), hunk(F.lit(0), F.lit(0), F.lit(1), plus + more), new))
        .when(kind == "deleted", F.concat(header(a, F.lit("/dev/null")), hunk(F.lit(1), minus + 1 + more, F.lit(0), F.lit(0)), old(minus + 1)))
        .when(kind == "renamed", F.concat(header(F.concat(F.lit("a/old/"), path), b), edit))
        .otherwise(F.concat(header(a, b), edit))
    )
    parts = plan.withColumn("part", text).groupBy("repo", "change_id").agg(F.array_sort(F.collect_list(F.struct("file_idx", "part"))).alias("parts"))
    return parts.select("repo", "change_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("diff_text"))
