"""URL filters: host and path rules, then a tree of path templates judged by the labels of their pages."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.texts import attach
from ledgerline.sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with all its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def host_of(url):
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without a ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    """From the end of the host up to ? # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules):
    """A struct of name and verdict of the longest rule that fits (a block first if equally long), or null."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.host + rule.path).alias("name"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, named).otherwise(chosen)
    return chosen


def lexical_template(path):
    """The segments of a path, those with a digit as * (and their extension)."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s),
    )


def _shared_length(low, high):
    """How many first elements two arrays share."""
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _differs(bad, labelled, all_bad, all_labelled, deviation):
    """Whether bad labels are further than ``deviation`` standard errors from the rate of all."""
    rate = F.try_divide(all_bad.cast("double"), all_labelled)
    return F.coalesce(F.abs(bad - labelled * rate) > deviation * F.sqrt(labelled * rate * (1 - rate)), F.lit(False))


def _generalised(counted: DataFrame, frequent_share: float, deviation: float) -> DataFrame:
    """host, lex, labelled, bad, template and depths (of the nodes where templates part, the host's first).

    The tree is walked from the hosts down. All templates of a node that begin alike walk on together, to where
    they part; there the next segments are compared under the node, as already generalised. A segment stays if it has at least
    ``frequent_share`` of the node's pages or its labels differ from the node's; the others become one *. A round is
    a few joins of counts, and there are as many as the most partings on one path.
    """
    none = F.array().cast("array<string>")
    walking = written(
        counted.withColumns({"template": none, "depths": F.array(F.lit(0)), "at": F.lit(0)}), "paths"
    )
    ended = []
    while not walking.isEmpty():
        rest = F.slice("lex", F.col("at") + 1, F.size("lex") - F.col("at"))
        nodes = walking.groupBy("host", "template").agg(
            F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
            _shared_length(F.min(rest), F.max(rest)).alias("shared"),  # of the least and the greatest, hence of all
        )
        along = F.concat("template", F.slice("lex", F.col("at") + 1, F.col("shared")))
        moved = attach(walking, written(nodes, "nodes"), ["host", "template"]).withColumn("template", along)
        moved = written(moved.withColumn("at", F.col("at") + F.col("shared")).drop("shared"), "moved")
        ended.append(moved.where(F.size("lex") == F.col("at")).drop("all_pages", "all_labelled", "all_bad"))
        parting = moved.where(F.size("lex") > F.col("at")).withColumn("segment", F.get("lex", F.col("at")))
        children = parting.groupBy("host", "template", "segment").agg(
            F.sum("pages").alias("own_pages"), F.sum("labelled").alias("own_labelled"), F.sum("bad").alias("own_bad"),
            *[F.max(name).alias(name) for name in ("all_pages", "all_labelled", "all_bad")],
        )
        frequent = F.col("own_pages") >= frequent_share * F.col("all_pages")
        differs = _differs(F.col("own_bad"), F.col("own_labelled"), F.col("all_bad"), F.col("all_labelled"), deviation)
        stays = F.startswith("segment", F.lit("*")) | frequent | differs
        named = children.select("host", "template", "segment", F.when(stays, F.col("segment")).otherwise("*").alias("name"))
        stepped = attach(parting, written(named, "children"), ["host", "template", "segment"])
        walking = written(
            stepped.select(
                "host", "lex", "pages", "labelled", "bad",
                F.concat("template", F.array("name")).alias("template"),
                F.concat("depths", F.array(F.col("at") + 1)).alias("depths"),
                (F.col("at") + 1).alias("at"),
            ),
            "paths",
        )
    found = walking  # empty: a table without pages has no round
    for part in ended:
        found = found.unionByName(part)
    return found.drop("at", "pages")


def _judged(paths: DataFrame, deviation: float, prior: float, strength: float) -> DataFrame:
    """host, lex, branch (the node that decides) and rejected share, for every lexical template."""
    node = F.transform("depths", lambda d, i: F.struct(
        d.alias("depth"), F.slice(F.col("template"), 1, d).alias("prefix"),
        F.when(i > 0, F.slice(F.col("template"), 1, F.get(F.col("depths"), i - 1))).alias("above"),
    ))
    expanded = paths.select("host", "lex", "labelled", "bad", F.inline(node))
    nodes = expanded.groupBy("host", "depth", "prefix", "above").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    parents = nodes.select("host", F.col("prefix").alias("above"), F.col("labelled").alias("all_labelled"), F.col("bad").alias("all_bad"))
    differs = _differs(F.col("bad"), F.col("labelled"), F.col("all_bad"), F.col("all_labelled"), deviation)
    kept = attach(nodes, parents, ["host", "above"]).where((F.col("depth") == 0) | differs)
    share = (F.col("bad") + prior * strength) / (F.col("labelled") + strength)
    branches = written(kept.select("host", "depth", "prefix", share.alias("share")), "kept-nodes")
    return (
        attach(expanded.select("host", "lex", "depth", "prefix"), branches, ["host", "depth", "prefix"])
        .where(F.col("share").isNotNull())
        .groupBy("host", "lex")
        .agg(F.max(F.struct("depth", "prefix", "share")).alias("branch"))
        .select("host", "lex", F.col("branch.prefix").alias("branch"), F.col("branch.share").alias("share"))
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    frequent_share: float = 0.05,
    deviation: float = 1.96,
    prior: float = 0.2,
    strength: float = 5.0,
    reject_share: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch, bad_share: one row per row of ``pages`` (page_id, url).

    The longest rule that fits decides. Without one, the path's template does: segments with digits are
    wildcards, and so are, level by level under the node as already generalised, all segments that have less than
    ``frequent_share`` of the node's pages and whose labels do not differ from the node's. Both are shares and
    errors, so a section is judged alike in a small table and a large one. Labels
    (page_id, bad boolean; the worst of several) are counted at every node of a host's tree. A node whose
    bad labels are within ``deviation`` standard errors of its parent's rate is merged with the parent, so the
    deepest node that differs, or the host, is the ``branch`` that decides: it is blocked if its share of bad
    labels, smoothed by ``strength`` labels of rate ``prior``, is over ``reject_share``.

    Null urls and urls without :// have an empty host and path and are a host of their own in the tree. Repeated
    rows each count; labels of unknown or null pages are ignored, and without labels nothing is blocked but by
    rules. Other columns are ignored. Only counts per template are joined and grouped, so a host with a
    third of all pages is as many rows as it has templates.
    """
    worst = labels.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("lex", lexical_template(F.col("path")))
    counted = (
        split.join(worst, "page_id", "left")
        .groupBy("host", "lex")
        .agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    )
    paths = written(_generalised(counted, frequent_share, deviation), "templates")
    judged = attach(paths.select("host", "lex", "template"), _judged(paths, deviation, prior, strength), ["host", "lex"])
    judged = written(judged, "branches")  # so that a hot template can be split in the join with its pages
    rule = rule_for(F.col("host"), F.col("path"), rules)
    found = attach(split.withColumn("found", rule), judged, ["host", "lex"])
    by_branch = F.when(F.col("share") > reject_share, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("found.name").alias("rule"),
        F.coalesce("found.verdict", by_branch).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        F.concat(F.lit("/"), F.array_join("branch", "/")).alias("branch"),
        F.round("share", 9).alias("bad_share"),
    )
