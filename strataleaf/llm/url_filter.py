"""URL filters: rules first, then a tree of path templates per host.

Rules name a host and the start of a path; the longest that fits decides. Every other page is
judged by its template. Per host, a page's path is read segment by segment, to its end:
digits, long hexadecimal strings and, where a place in the tree has many different children,
every child become wildcards. Branches of one place whose share of blocked pages does not differ from
that of their siblings together are merged. The labelled pages are those that a rule decides.
A template's purity is its share of blocked pages, smoothed towards that of its parent in the
tree, then of the same template on all hosts, then of all labelled pages; a template is
rejected if that is at least ``purity``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import UPPER, cut, join_skewed

#: A place with at least so many children, and so many for each hundred pages, has variable ones.
MANY_CHILDREN, CHILDREN_PER_100 = 12, 25
#: Pseudo-pages of the parent in a smoothed share; a template is rejected from PURITY on.
WEIGHT, PURITY = 5.0, 0.9
#: A key (a host's url, a place of a tree) is hot from 1/HOT of the rows on, but not below HOT_MIN rows.
HOT, HOT_MIN = 1024, 256
#: Branches within so many standard errors of their siblings are merged.
SIGMAS = 2.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules like ``allow org/`` or ``block example.org/es/``."""
    out = []
    for line in lines:
        verdict, _, where = line.strip().partition(" ")
        host, slash, path = where.strip().partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(verdict, host.translate({ord(c): c.lower() for c in UPPER}), slash + path))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return host & F.startswith(F.col("path"), F.lit(rule.path))


def _shape(segment: Column) -> Column:
    """A segment with its obviously variable parts as wildcards."""
    digits = F.regexp_replace(segment, r"[0-9]+", "*")
    return F.when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("*")).otherwise(digits)


def _hot(n: Column, rows: int) -> Column:
    return n >= max(HOT_MIN, math.ceil(rows / HOT))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, place, template) from distinct (host, path, n): n is the number of pages with that path.

    A host's tree is walked from the root, one segment a step, over distinct paths. A place
    is the template without its last segment. Children of a place are counted exactly; a
    place with one path under it has no variable children, so what is left of that path
    follows in one step. The walk ends when no two paths share a place, however deep.
    """
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), _shape)
    now = cut(paths.select("host", "path", "n", segments.alias("segments"), F.lit("").alias("template")))
    done = now.where(F.size("segments") == 0).select("host", "path", F.lit("").alias("place"), "template")
    now = now.where(F.size("segments") > 0)
    k = 0
    while rows := now.count():
        here = now.withColumn("child", F.get("segments", F.lit(k)))
        # One row for each distinct child meets in a place, not one for each path.
        children = here.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"))
        places = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"), F.sum("paths").alias("paths"))
        variable = (F.col("kinds") >= MANY_CHILDREN) & (F.col("kinds") * 100 >= F.col("pages") * CHILDREN_PER_100)
        places = places.select("host", "template", variable.alias("variable"), "paths")
        met = join_skewed(here, places, ["host", "template"], _hot(F.col("paths"), rows))
        met = met.withColumn("place", F.col("template")).withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("variable"), F.lit("*")).otherwise(F.col("child"))))
        last, alone = F.size("segments") == k + 1, F.col("paths") == 1
        rest = F.slice("segments", k + 2, F.greatest(F.size("segments") - (k + 1), F.lit(0)))
        whole = F.when(last, F.col("template")).otherwise(F.concat_ws("/", F.col("template"), F.array_join(rest, "/")))
        above = F.when(last, F.col("place")).otherwise(F.regexp_replace(whole, "/[^/]*$", ""))
        met = cut(met.select("host", "path", "n", "segments", "place", "template", (last | alone).alias("ends"), whole.alias("whole"), above.alias("above")))
        done = done.unionByName(met.where("ends").select("host", "path", F.col("above").alias("place"), F.col("whole").alias("template")))
        now = met.where("NOT ends").select("host", "path", "n", "segments", "template")
        k += 1
    return done


def purities(counts: DataFrame) -> DataFrame:
    """(host, template, purity) from counts (host, place, template, blocked, labelled) of all templates."""
    total = counts.agg(F.sum("blocked"), F.sum("labelled")).first()
    share = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    smooth = lambda k, n, to: (k + WEIGHT * to) / (n + WEIGHT)
    rows = counts.count()
    everywhere = counts.groupBy("template").agg(F.sum("blocked").alias("_k"), F.sum("labelled").alias("_l"), F.count(F.lit(1)).alias("_m"))
    everywhere = everywhere.select("template", "_m", smooth(F.col("_k"), F.col("_l"), F.lit(share)).alias("_everywhere"))
    siblings = counts.groupBy("host", "place").agg(F.sum("blocked").alias("_kp"), F.sum("labelled").alias("_np"), F.count(F.lit(1)).alias("_m"))
    met = join_skewed(counts, siblings, ["host", "place"], _hot(F.col("_m"), rows)).drop("_m")
    met = join_skewed(met, everywhere, ["template"], _hot(F.col("_m"), rows)).drop("_m")
    pooled = F.col("_kp") / F.greatest(F.col("_np"), F.lit(1))
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0)) / F.greatest(F.col("labelled"), F.lit(1)))
    own = F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1))
    met = cut(met.withColumn("_merged", (F.col("labelled") == 0) | (F.abs(own - pooled) <= SIGMAS * error)))
    only = lambda c: F.sum(F.when(F.col("_merged"), F.col(c)).otherwise(F.lit(0)))
    merged = met.groupBy("host", "place").agg(only("blocked").alias("_km"), only("labelled").alias("_nm"), F.count(F.lit(1)).alias("_m"))
    rows = join_skewed(met, merged, ["host", "place"], _hot(F.col("_m"), rows))
    k = F.when(F.col("_merged"), F.col("_km")).otherwise(F.col("blocked"))
    n = F.when(F.col("_merged"), F.col("_nm")).otherwise(F.col("labelled"))
    # Without a label on the host, the same template on other hosts decides.
    parent = smooth(F.col("_kp"), F.col("_np"), F.col("_everywhere"))
    return rows.select("host", "template", smooth(k, n, F.when(F.col("_np") > 0, parent).otherwise(F.col("_everywhere"))).alias("purity"))


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    A null url, or one without ``://``, has an empty host and an empty path; all such pages
    are one host without a segment. A rule fits its host and every subdomain if the path
    starts with the rule's; the longest decides (of equally long ones, the first given).
    Rows are judged one by one, so repeated rows and null ids are kept. A very long path is
    read to its end. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    by_length = sorted(rules, key=lambda r: -len(r.text))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(by_length):
        rule = F.when(_fits(r), F.lit(r.text)).otherwise(rule)
        verdict = F.when(_fits(r), F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict)
    # Rules look at host and path alone, so the tree needs distinct paths with their numbers of pages.
    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.max("_verdict").alias("_verdict")))
    walked = cut(templates(paths))
    known = paths.withColumnRenamed("host", "_host").withColumnRenamed("path", "_path")
    judged_paths = cut(walked.join(known, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))).drop("_host", "_path"))
    labelled = F.when(F.col("_verdict").isNotNull(), F.col("n")).otherwise(F.lit(0))
    counts = cut(judged_paths.groupBy("host", "place", "template").agg(F.sum(F.when(F.col("_verdict") == "block", F.col("n")).otherwise(F.lit(0))).alias("blocked"), F.sum(labelled).alias("labelled"), F.count(F.lit(1)).alias("paths")))
    distinct = judged_paths.count()
    found = purities(counts).join(counts.select("host", "template", "paths"), ["host", "template"])
    decided = join_skewed(judged_paths.select("host", "path", "n", "template"), found, ["host", "template"], _hot(F.col("paths"), distinct)).select("host", "path", "n", "template", "purity")
    judged = join_skewed(rows, decided, ["host", "path"], _hot(F.col("n"), paths.agg(F.sum("n")).first()[0] or 0))
    chosen = F.coalesce("_verdict", F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", chosen.alias("verdict"), "template", "purity")
