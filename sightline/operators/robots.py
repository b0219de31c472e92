"""robots.txt rules as a table and their decision as a join.

A file is read line by line in one expression; urls then meet only the rules of
their site and the longest pattern that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

_STATE = "struct<agents:array<string>,open:boolean,rules:array<struct<agent:string,allow:boolean,pattern:string>>>"


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots: site_id, body.  site_id, agent (lower case), allow, pattern.

    Lines of user agents that follow each other name one group, and the rules
    after them hold for all of these.  Comments, rules before any agent and empty
    patterns are left out; an agent without rules keeps a row with a null
    pattern, because its own group replaces that of all agents."""
    field = lambda x, k: F.trim(F.regexp_replace(F.try_element_at(F.split(x, ":", 2), F.lit(k)), r"\s+$|^\s+", ""))
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", "")))
    lines = F.filter(lines, lambda x: x.contains(":"))
    lines = F.transform(lines, lambda x: F.struct(F.lower(field(x, 1)).alias("name"), field(x, 2).alias("value")))
    none = F.struct(F.array().cast("array<string>"), F.lit(False), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>")).cast(_STATE)

    def step(acc: Column, x: Column) -> Column:
        agent = F.lower(x["value"])
        rule = lambda a, allow, pattern: F.struct(a.alias("agent"), allow.alias("allow"), pattern.alias("pattern"))
        named = F.struct(F.when(acc["open"], F.concat(acc["agents"], F.array(agent))).otherwise(F.array(agent)), F.lit(True), F.concat(acc["rules"], F.array(rule(agent, F.lit(True), F.lit(None).cast("string"))))).cast(_STATE)
        new = F.when(x["value"] == "", F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>")).otherwise(F.transform(acc["agents"], lambda a: rule(a, x["name"] == "allow", x["value"])))
        ruled = F.struct(acc["agents"], F.lit(False), F.concat(acc["rules"], new)).cast(_STATE)
        return F.when(x["name"] == "user-agent", named).when(x["name"].isin("allow", "disallow"), ruled).otherwise(F.struct(acc["agents"], F.lit(False), acc["rules"]).cast(_STATE))

    rules = F.aggregate(lines, none, step, lambda acc: acc["rules"])
    return robots.select("site_id", F.explode(F.array_distinct(rules)).alias("r")).select("site_id", "r.*").distinct()


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression from a path's start: ``*`` is any
    run, a last ``$`` the path's end, all else is itself."""
    whole = F.endswith(pattern, F.lit("$"))
    bare = F.when(whole, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    plain = F.regexp_replace(bare, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(plain, r"\*+", ".*"), F.when(whole, F.lit("$")).otherwise(F.lit("")))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages: url and site_id (other columns stay).  robots: site_id, status, body.
    ``allowed`` for agent.

    The group of the agent's own name holds, else that of ``*``.  Of the patterns
    that fit a url's path and query the longest decides, and of equally long ones
    one that allows; a url that none fits is allowed, and so is every url of a
    site whose file is missing, has a status of 400 or more, or is null.  Of
    several files of a site the one with the highest status counts.  A site's
    rules are gathered into one row, so a hot site costs no row twice."""
    one = robots.groupBy("site_id").agg(F.max_by("body", "status").alias("body"), F.max("status").alias("status")).where("status < 400")
    rules = robots_rules(one).where(F.col("agent").isin(agent.lower(), "*"))
    sets = rules.groupBy("site_id").agg(
        F.bool_or(F.col("agent") == agent.lower()).alias("own"),
        F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("agent", F.length("pattern").alias("size"), "allow", pattern_regex(F.col("pattern")).alias("regex")))).alias("rules"),
    )
    sets = sets.select("site_id", F.filter("rules", lambda r: r["agent"] == F.when(F.col("own"), F.lit(agent.lower())).otherwise(F.lit("*"))).alias("_rules"))
    target = F.concat(urls.path(F.col("url")), F.regexp_extract(F.col("url"), r"(\?[^#]*)", 1))
    fits = F.filter("_rules", lambda r: F.regexp_like(F.col("_target"), r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    x = pages.join(sets, "site_id", "left").withColumn("_target", target)
    return x.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_rules", "_target")
