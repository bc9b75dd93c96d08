"""URL filter lists, with DataFrame functions only.

A rule is a host, a path prefix and a verdict; it fits its host and all subdomains. Each URL is expanded into host-suffix and
path-prefix expressions, but only of the shapes (number of host labels, length of path) that occur among the rules. A short prefix of
an expression's SHA-256 digest is the key of an equi-join with the rules; survivors are confirmed by the full digest. Rules are counted and their
shapes gathered while the plan is built. Of
several rules the longest wins, then the one with the longer host, then block before allow.

The rules' shapes are a small set whatever the rules are (at most labels times path lengths). Up to BROADCAST_RULES rules, which
is checked, and LOOKUP_SHAPES shapes, every shape is a broadcast join of its own, and pages stay where they are; beyond, Spark joins by
shuffle and splits hot keys, and every different host and path is judged once.

Edge cases: a null URL, or one without ://, has an empty host and path and fits no rule; an empty URL too; repeated rows get the same
verdict each; rows with a null id are judged like others; null parts of a rule count as empty, and rules without a host are
ignored; without rules all get the default; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut

DEFAULT_VERDICT = "allow"
PREFIX_DIGITS = 8
BROADCAST_RULES = 100_000
#: Shapes up to which each is looked up by itself.
LOOKUP_SHAPES = 32


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (host and path of the deciding rule, or null), verdict.
    rules: host, path, verdict."""
    rules = (
        rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .filter("rule_host <> '' AND verdict IS NOT NULL")
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substr("full", F.lit(1), F.lit(PREFIX_DIGITS)))
        .withColumn("labels", F.size(F.split("rule_host", r"\.", -1)))
        .withColumn("path_chars", F.length("rule_path"))
    )
    shapes = [tuple(r) for r in rules.select("labels", "path_chars").distinct().collect()]
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    parsed = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not shapes:
        return parsed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("path_chars")) for n, c in shapes])
    host_labels = F.size(F.split("host", r"\.", -1))
    fitting = F.filter(known, lambda s: (s["labels"] <= host_labels) & (s["path_chars"] <= F.length("path")) & (F.col("host") != ""))
    suffix = lambda s: F.element_at(F.array(*[F.substring_index("host", ".", -n) for n in range(1, most + 1)]), s["labels"])
    most = max(n for n, _ in shapes)
    digest = lambda n, chars: _digest(suffix({"labels": F.lit(n)}), F.substr(F.col("path"), F.lit(1), F.lit(chars)))
    place = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    # the few rules of a prefix are one row; whether one of them is meant is told by the whole digest after the join
    by_prefix = lambda some: some.groupBy("prefix").agg(F.collect_list(F.struct("full", place.alias("rule"))).alias("rules"))
    confirmed = lambda met, sought: F.get(F.filter(met, lambda r: r["full"] == F.col(sought)), F.lit(0))["rule"]
    if small and len(shapes) <= LOOKUP_SHAPES:  # a look-up for each shape; pages aren't shuffled
        judged, found = parsed, []
        for i, (n, chars) in enumerate(sorted(shapes)):
            fits = (F.col("host") != "") & (host_labels >= n) & (F.length("path") >= chars)
            judged = judged.withColumn(f"digest{i}", F.when(fits, digest(n, chars))).withColumn(f"prefix{i}", F.substr(f"digest{i}", F.lit(1), F.lit(PREFIX_DIGITS)))
            own = by_prefix(rules.filter((F.col("labels") == n) & (F.col("path_chars") == chars))).select(F.col("prefix").alias(f"of{i}"), F.col("rules").alias(f"rules{i}"))
            judged = judged.join(F.broadcast(own), F.col(f"prefix{i}") == F.col(f"of{i}"), "left")
            found.append(confirmed(f"rules{i}", f"digest{i}"))
        judged = judged.withColumn("best", F.greatest(*found) if len(found) > 1 else found[0])
    else:  # the verdict depends on host and path alone, so each of them is judged once
        expressions = F.transform(fitting, lambda s: _digest(suffix(s), F.substr(F.col("path"), F.lit(1), s["path_chars"])))
        spread = parsed.select("host", "path", F.explode(expressions).alias("digest")).withColumn("prefix", F.substr("digest", F.lit(1), F.lit(PREFIX_DIGITS)))
        met = by_prefix(rules)
        fits = spread.join(F.broadcast(met) if small else met, "prefix").withColumn("rule", confirmed("rules", "digest")).filter("rule IS NOT NULL")
        decided = cut(fits.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(F.max("rule").alias("best")))
        judged = parsed.join(decided, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
