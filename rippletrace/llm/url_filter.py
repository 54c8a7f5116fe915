"""URL filter by rules and by a tree of path templates per host.

Variable segments become wildcards from the root down; siblings whose labels are
alike are merged at every level; and what is left is rejected by its purity.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does.

    A rule is (verdict, "host/path"). It fits its host and all subdomains if the
    path starts with the rule's. Of rules equally long the first by code point
    counts. The rules are a configured list and stand in the plan as literals,
    longest first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """The path with runs of digits, and of hexadecimal digits of 8 or more, as ``#``."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]*[0-9][0-9a-fA-F]{7,}|[0-9a-fA-F]{7,}[0-9][0-9a-fA-F]*", "#"), "[0-9]+", "#")


def path_templates(shapes: DataFrame, depth: int | None = None, max_children: int = 16, least_share: float = 0.05) -> DataFrame:
    """The path of templates from the host to each (host, shape), as arrays ``nodes``.

    ``shapes`` has host, shape, n, labelled and bad, one row per (host, shape);
    all come back. nodes[0] is the empty template of the host, nodes[d] the
    first d segments. From the root down, a node with more than
    ``max_children`` different next segments turns those into ``*`` that hold
    less than ``least_share`` of its URLs, so that no node has more than
    max(max_children, 1 / least_share) + 1 children. Segments are followed to
    their end; with ``depth``, what follows that many is one variable tail, ``**``.

    Where a single shape goes on below a node, nothing can branch any more: the
    rest of it is one last node that stands for ``steps`` levels (else 1). So
    there are as many rounds as the longest common beginning of two shapes has
    segments, however long paths are, and a round reads only shapes that go on.
    """
    segments = F.slice(F.split(F.col("shape"), "/"), 2, 1 << 30)  # what precedes the first slash is always empty
    if depth is not None:
        segments = F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))).otherwise(segments)
    rows = materialise(shapes.withColumns({"seg": segments, "nodes": F.array(F.lit("")), "steps": F.lit(1)}), "url-shapes")
    done, d = rows.where(F.size("seg") == 0), 0
    rows = rows.where(F.size("seg") > 0)
    while not rows.isEmpty():
        here = rows.withColumns({"prefix": F.element_at("nodes", -1), "next": F.get("seg", F.lit(d))})
        children = here.groupBy("host", "prefix", "next").agg(F.sum("n").alias("n_child"), F.count(F.lit(1)).alias("shapes"))
        nodes = children.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n_child").alias("n_node"), F.sum("shapes").alias("below"))
        rare = (F.col("children") > max_children) & (F.col("n_child") < least_share * F.col("n_node"))
        alone = F.col("below") == 1
        marks = children.join(nodes, ["host", "prefix"]).where(rare | alone)
        marks = marks.select("host", "prefix", "next", F.when(rare, F.lit("*")).alias("star"), alone.alias("alone"))
        rest = F.slice("seg", d + 1, 1 << 30)
        ends = F.coalesce("alone", F.lit(False))
        step = F.when(ends, F.array_join(rest, "/")).otherwise(F.coalesce("star", "next"))
        # Each level reads the rows several times, so its result is written.
        level = here.join(marks, ["host", "prefix", "next"], "left").select(
            *shapes.columns, "seg", F.concat("nodes", F.array(F.concat("prefix", F.lit("/"), step))).alias("nodes"),
            F.when(ends, F.size(rest)).otherwise(F.lit(1)).alias("steps"), (ends | (F.size("seg") == d + 1)).alias("at_end"),
        )
        level = materialise(level, "url-level")
        done = done.unionByName(level.where("at_end").drop("at_end"))
        rows, d = level.where("NOT at_end").drop("at_end"), d + 1
        if d % 16 == 0:  # a plan of few parts, however many rounds there are
            done = materialise(done, "url-ended")
    return done.drop("seg")


def template_purity(rows: DataFrame, similar_z: float = 1.0, prior: float = 0.2, strength: float = 4.0) -> DataFrame:
    """(host, template, purity): the smoothed share of bad labels of each node of the trees.

    ``rows`` are those of ``path_templates``. At each level siblings are sorted
    by their share of bad labels; neighbours are merged if a two-sample test
    tells their shares apart by less than ``similar_z`` standard errors. A
    merged branch has the purity (bad + strength * parent) / (labelled +
    strength), where parent is that of the branch above, and ``prior`` above a
    host. A branch without any label so inherits its parent's. A last node that
    stands for several levels has the purity that they give one after another.
    """
    at = F.posexplode("nodes").alias("level", "template")
    nodes = rows.select("host", "labelled", "bad", "nodes", "steps", at).groupBy("host", "level", "template")
    above = F.when(F.col("level") > 0, F.get("nodes", F.col("level") - 1))
    steps = F.max(F.when(F.col("level") == F.size("nodes") - 1, F.col("steps")).otherwise(F.lit(1))).alias("steps")
    nodes = materialise(nodes.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min(above).alias("parent"), steps), "url-nodes")
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    smooth = (F.col("bad") + strength * F.col("of_parent")) / (F.col("labelled") + strength)
    # The same smoothing, once per step.
    share = F.coalesce(F.try_divide("bad", "labelled"), F.col("of_parent"))
    chained = share + (F.col("of_parent") - share) * F.pow(strength / (F.col("labelled") + strength), F.col("steps"))
    chained = F.when(F.col("steps") > 1, chained).otherwise(smooth)
    level = nodes.where("level = 0").withColumn("of_parent", F.lit(float(prior))).select("host", "template", smooth.alias("purity"))
    done = level = materialise(level, "url-purity")
    for d in range(1, deepest + 1):
        share = F.try_divide("bad", "labelled")  # null for branches without a label, which are never merged
        siblings = Window.partitionBy("host", "parent", F.col("labelled") > 0).orderBy(share, "template")
        before = {c: F.lag(c).over(siblings) for c in ("bad", "labelled")}
        pooled = F.try_divide(F.col("bad") + before["bad"], F.col("labelled") + before["labelled"])
        gap = F.abs(share - F.try_divide(before["bad"], before["labelled"]))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), before["labelled"])))
        apart = F.coalesce((gap >= similar_z * error) & (gap > 0), F.lit(True)).cast("int")
        here = nodes.where(F.col("level") == d).withColumn("apart", apart)
        here = here.withColumn("branch", F.sum("apart").over(siblings))
        branches = here.groupBy("host", "parent", F.col("labelled") > 0, "branch").agg(
            F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.collect_list("template").alias("templates"), F.max("steps").alias("steps")
        )
        known = level.select("host", F.col("template").alias("parent"), F.col("purity").alias("of_parent"))
        level = branches.join(known, ["host", "parent"]).select("host", F.explode("templates").alias("template"), chained.alias("purity"))
        level = materialise(level, "url-purity")
        done = done.unionByName(level)
    return done


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    labels: str | None = None,
    reject_at: float = 0.8,
    prior: float = 0.2,
    strength: float = 4.0,
    similar_z: float = 1.0,
    **tree: float,
) -> DataFrame:
    """Add host, path, rule and verdict ("allow" or "block") to every row.

    The longest fitting rule decides. Other URLs are judged by the path template
    of their host: it is rejected if its purity, the smoothed share of bad
    labels in its merged branch (``template_purity``), is ``reject_at`` or more.
    Labels are the column ``labels`` (1 bad, 0 good, null unknown), or else the
    verdicts that the rules give to the URLs they cover, so that a branch or
    host mostly blocked by rules takes its remaining URLs with it.

    A null URL or one without ``://`` has an empty host and path and is judged
    like any other URL of that host; URLs of any length are read whole. Repeated
    rows are judged alike and all kept; an empty table gives an empty table.
    Columns of ``pages`` that are named as new ones (host, path, rule, verdict)
    are replaced; any other name is allowed. Only counts per (host, shape of
    path) are shuffled to learn. Verdicts of shapes that hold a thousandth of
    all rows or more, of which there are at most a thousand, are broadcast; rows
    of the others, which no hot key is among, are joined by a shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    work = pages.select(row.alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), *([F.col(labels).alias("label")] if labels else []))
    work = work.withColumns({"fit": fitting_rule(F.col("host"), F.col("path"), rules), "shape": _shape(F.col("path"))})
    known = F.col("label").cast("int") if labels else F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    counts = [F.count(F.lit(1)).alias("n"), F.count("known").alias("labelled"), F.coalesce(F.sum("known"), F.lit(0)).alias("bad")]
    rows = path_templates(work.withColumn("known", known).groupBy("host", "shape").agg(*counts), **tree)
    purity = template_purity(rows, similar_z, prior, strength)
    judged = rows.select("host", "shape", "n", F.element_at("nodes", -1).alias("template")).join(purity, ["host", "template"])
    verdict = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    judged = materialise(judged.select(F.col("host").alias("of_host"), F.col("shape").alias("of_shape"), "n", verdict.alias("by_tree")), "url-verdicts")
    hot = (judged.agg(F.sum("n")).first()[0] or 0) / 1000
    same = (F.col("host") == F.col("of_host")) & (F.col("shape") == F.col("of_shape"))
    common = F.broadcast(judged.where(F.col("n") >= hot))
    out = work.join(common, same).unionByName(work.join(common, same, "left_anti").join(judged.where(F.col("n") < hot), same))
    return out.select(
        *[F.col(f"row.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_tree").alias("verdict"),
    )
