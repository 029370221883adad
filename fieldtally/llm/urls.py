"""URL filters: a tree of path templates for each host, judged by smoothed labelled purity.

A URL's path is cut into segments. From one branching point to the next, until no path has segments left, those that vary become the
wildcard ``*``: those that look like an identifier, unless their own labels differ from those of the identifiers beside
them, and those of a branching point with many rare children. Of the named siblings that remain, those on one side of
the rejection share are compared with each other: a branch that is statistically like the rest of its side is merged
with it into one branch, ``{good}`` or ``{bad}``, also where there are only two. Branches without labels stay as they
are. Each template has counts of good and bad labels; its share of bad ones is smoothed towards its parent's, up to the
host and all hosts together. A URL is blocked if the deepest template that it fits is impure and has labels of its own;
without labels it is allowed. Rules (allow and block lists) come first.

Every step is a grouped aggregation over (host, template so far, segment); counts of one host are partial sums, so
a host with a third of all rows is no larger than its number of templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, packed, remove, shared_path, stored

#: A segment with digits, or of hexadecimal or long opaque text, looks like an identifier.
IDENTIFIER = r"^(?=.*[0-9]).*$|^[0-9a-fA-F-]{8,}$|^.{40,}$"
WILDCARD, GOOD, BAD = "*", "{good}", "{bad}"
#: A branching point generalises its children if they average fewer pages than this and are at least so many.
RARE, MANY = 5.0, 20
#: Branches are alike if their shares of bad labels differ by less than so many standard errors.
ALIKE_Z = 2.0
#: Pseudo-labels by which a template is pulled to its parent, and the bad share that rejects.
PRIOR, PRIOR_BAD, REJECT = 2.0, 0.1, 0.5


def parts(url: Column) -> Column:
    """Struct (host, path). Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.struct(lower.alias("host"), F.regexp_extract(behind, r"^[^?#]*", 0).alias("path"))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null.

    A rule is (verdict, ``host/path``); it fits its host and all subdomains, if the path starts with the rule's.
    Longest by the whole rule's length; a tie goes to the first by code point.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        here = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, here).otherwise(best)
    return best


def segments(path: Column) -> Column:
    """All segments of a path, as they are."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")


def alike(bad: Column, labelled: Column, all_bad: Column, all_labelled: Column) -> Column:
    """Whether a branch's share of bad labels is within ALIKE_Z standard errors of that of the rest; null without labels.

    ``all_``: sums over the branch and the rest. The error is the usual one of two shares under one common share.
    """
    share = F.try_divide(all_bad, all_labelled)
    rest = all_labelled - labelled
    variance = F.greatest(share * (1 - share), F.lit(0.01)) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), rest))
    return F.abs(F.try_divide(bad, labelled) - F.try_divide(all_bad - bad, rest)) < ALIKE_Z * F.sqrt(variance)


def _shared(rest: Column, other: Column) -> Column:
    """How many first segments two paths share; ``other`` is no beginning of ``rest``."""
    at = F.array_position(F.zip_with(rest, other, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(rest)).cast("int")


def _alone(segment: Column) -> Column:
    """What a segment without a sibling becomes."""
    return F.when(segment.isin(WILDCARD, GOOD, BAD) | segment.rlike(IDENTIFIER), WILDCARD).otherwise(segment)


def _past_chains(level: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``level`` with each path taken on to where its branching point's paths part, or to its own end before.

    Up to there no segment has a sibling, so what it becomes and its smoothed share follow from itself, however many
    there are. ``longest`` is the greatest rest below a point: the paths that part from it do so where they differ from it,
    and those that don't are beginnings of it. Joined rows are stored before they are summed, so that a host with many of
    them is split; the second value returned is these tables.
    """
    key = ["host", "template"]
    point = level.groupBy(key).agg(F.max("rest").alias("longest"))
    shared = each = stored(level.join(point.hint("merge"), key).withColumn("same", _shared(F.col("rest"), F.col("longest"))), "shared")
    parts = each.groupBy(key).agg(F.min(F.when(F.col("same") < F.size("rest"), F.col("same"))).alias("parts"))
    each = each.join(parts.hint("merge"), key).withColumn("chain", F.coalesce("parts", F.size("longest")))
    each = stored(each.withColumn("steps", F.least(F.size("rest"), F.col("chain"))).drop("longest", "same", "parts"), "steps")
    # labels of the paths that are still there after so many steps, and the share that they make of the one before
    sums = each.groupBy(*key, "chain", "steps").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.first("bad_share").alias("up"), F.first("support").alias("s0"))
    ends = sums.groupBy(*key, "chain").agg(F.collect_list(F.struct("steps", "bad", "labelled")).alias("ends"), F.first("up").alias("up"), F.first("s0").alias("s0"))
    there = lambda t, c: F.aggregate(F.filter("ends", lambda e: e["steps"] >= t), F.lit(0).cast("long"), lambda a, e: a + e[c])

    def step(shares: Column, t: Column) -> Column:
        bad, labelled = there(t, "bad"), there(t, "labelled")
        share = (bad + PRIOR * F.element_at(shares, -1)["share"]) / (labelled + PRIOR)
        return F.array_append(shares, F.struct(share.alias("share"), labelled.alias("support")))

    first = F.array(F.struct(F.col("up").alias("share"), F.col("s0").alias("support")))
    turns = F.when(F.col("chain") > 0, F.sequence(F.lit(1), F.col("chain"))).otherwise(F.array().cast("array<int>"))
    shares = ends.select(*key, F.aggregate(turns, first, step).alias("shares"))
    here = F.get(F.col("shares"), F.col("steps"))
    past = each.join(shares.hint("merge"), key).select(
        "host", "segments", F.slice("rest", F.col("steps") + 1, F.size("rest")).alias("rest"),
        F.concat("template", F.transform(F.slice("rest", F.lit(1), F.col("steps")), _alone)).alias("template"),
        here["share"].alias("bad_share"), here["support"].alias("support"), "n", "bad", "labelled",
    )
    return past, [shared, each]


def templates(paths: DataFrame) -> DataFrame:
    """The deepest template of each path, and its purity: host, segments, template (array), bad_share, support (labels).

    ``paths``: host, segments, bad (1, 0, or null without a label). Rows are pre-aggregated by whole path first, so the
    result grows with the number of different paths alone. Each round takes all paths on to the next branching point and
    then past it, so there are as many rounds as branching points lie on one path, however long paths are; a path leaves
    where it ends. A node's share is smoothed towards its parent's, from all hosts down. A round's tables are removed after it.
    """
    spark = paths.sparkSession
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    smoothed = (F.col("bad") + PRIOR * F.col("up")) / (F.col("labelled") + PRIOR)
    level = paths.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("bad"), F.count("bad").alias("labelled")
    )
    level = whole = stored(level, "paths")
    total = level.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0)) + PRIOR * PRIOR_BAD) / (F.coalesce(F.sum("labelled"), F.lit(0)) + PRIOR)).alias("up")
    )
    root = level.groupBy("host").agg(*sums).withColumn("up", total.scalar())
    root = root.select("host", smoothed.alias("bad_share"), F.col("labelled").alias("support"))
    level = level.join(root.hint("merge"), "host").withColumn("template", F.array().cast("array<string>")).withColumn("rest", F.col("segments"))
    level = stored(level, "level")
    remove(spark, whole)
    kept = ("host", "segments", "template", "bad_share", "support")
    path = shared_path(spark, "templates")
    level.where(F.size("rest") == 0).select(*kept).write.parquet(path)
    wild = F.col("segment").isin(WILDCARD, GOOD, BAD)  # as in a path that is a template itself
    opaque = ~wild & F.col("segment").rlike(IDENTIFIER)
    plain = ~wild & ~opaque
    side = F.when(plain & (F.col("labelled") > 0), F.when(F.col("bad") >= REJECT * F.col("labelled"), BAD).otherwise(GOOD))
    kinds = {"named": plain, "opaque": opaque, "good": side == GOOD, "bad": side == BAD}
    while not (live := level.where(F.size("rest") > 0)).isEmpty():
        past, used = _past_chains(live)
        past = stored(past, "past-chains")
        for gone in (level, *used):
            remove(spark, gone)
        past.where(F.size("rest") == 0).select(*kept).write.mode("append").parquet(path)
        here = past.where(F.size("rest") > 0).withColumn("segment", F.get("rest", F.lit(0)))
        child = stored(here.groupBy("host", "template", "segment").agg(*sums, F.first("bad_share").alias("up")), "children")
        # a branching point's facts: children, pages and labels below it, of each kind of child
        facts = [
            F.sum(F.when(is_one, F.lit(1) if c == "kids" else F.col(c))).alias(f"{kind}_{c}")
            for kind, is_one in kinds.items() for c in ("kids", "n", "bad", "labelled")
        ]
        point = child.groupBy("host", "template").agg(*facts)
        near = {k: F.coalesce(alike(F.col("bad"), F.col("labelled"), F.col(f"{k}_bad"), F.col(f"{k}_labelled")), F.lit(k == "opaque")) for k in ("opaque", "good", "bad")}
        varies = plain & (F.col("named_kids") >= MANY) & (F.col("named_n") < RARE * F.col("named_kids"))
        general = (
            F.when(wild | varies | (opaque & near["opaque"]), WILDCARD)
            .when((side == GOOD) & near["good"], GOOD)
            .when((side == BAD) & near["bad"], BAD)
            .otherwise(F.col("segment"))
        )
        step = child.join(point.hint("merge"), ["host", "template"]).select("host", "template", "segment", general.alias("to"), "n", "bad", "labelled", "up")
        node = step.groupBy("host", "template", "to").agg(*sums, F.first("up").alias("up"))
        node = node.select("host", "template", "to", smoothed.alias("bad_share"), F.col("labelled").alias("support"))
        step = step.select("host", "template", "segment", "to").join(node.hint("merge"), ["host", "template", "to"])
        moved = here.drop("bad_share", "support").join(step.hint("merge"), ["host", "template", "segment"])
        rest = F.slice("rest", F.lit(2), F.size("rest"))
        level = moved.select("host", "segments", rest.alias("rest"), F.concat("template", F.array("to")).alias("template"), "bad_share", "support", "n", "bad", "labelled")
        level = stored(level, "level")
        for gone in (past, child):
            remove(spark, gone)
        level.where(F.size("rest") == 0).select(*kept).write.mode("append").parquet(path)
    remove(spark, level)
    return spark.read.schema(level.select(*kept).schema).parquet(path)


def judge(pages: DataFrame, rules: list[tuple[str, str]], label: str, url: str = "url") -> DataFrame:
    """``pages`` with columns host, path, rule, verdict, template, bad_share and support.

    The verdict is the longest fitting rule's, else ``block`` where the URL's template has labels and a bad share of
    REJECT or more, else ``allow``. ``label`` names a boolean column (true: bad; null: no label). A null URL, or one
    without ``://``, has an empty host and path and is judged like any other of that host. Columns of the new names are
    replaced, others pass through, whatever their names; repeated rows get equal results, and an empty table gives an
    empty one.
    """
    new = ("host", "path", "rule", "verdict", "template", "bad_share", "support")
    p = packed(pages, new, u=parts(named(url)), bad=named(label).cast("int"))
    p = p.withColumns({"r": rule_for(F.col("u.host"), F.col("u.path"), rules), "host": F.col("u.host"), "segments": segments(F.col("u.path"))})
    # templates of the different paths, then joined to the rows: one row a path, however many pages it has
    both = p.join(templates(p.select("host", "segments", "bad")).hint("merge"), ["host", "segments"])
    verdict = F.when((F.col("support") > 0) & (F.col("bad_share") >= REJECT), "block").otherwise("allow")
    out = both.select(
        "row", "host", F.col("u.path").alias("path"), F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), verdict).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "bad_share", "support",
    )
    return out.select("row.*", *new)
