"""URL rules found by their rarest literal token; DataFrame expressions only.

A rule is a host and a path prefix with a verdict. Its tokens are its host labels and whole path
segments; of these the one that fewest pages hold indexes the rule. The tokens of each distinct
(host, path) fetch the rules they index, by a hash join, and only those run their regular
expressions. The longest rule that fits decides, ties going to the rule text smaller in code
points; where none fits, `default` does.

Rules are a table of any size, broadcast only up to BROADCAST_RULES rows. Pages without a token of
the index take no part in the search; verdicts go back to pages by (host, path), a join that splits
where many pages share one.

Edge cases: a null url, or one without `://`, has an empty host and path and no rule; other nulls,
repeated rows and empty tables pass through; an empty rule list leaves the default. A very long url
has as many tokens as it has labels and segments. Columns other than page_id and url take no part
and may have any names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def host_regex(self) -> str:
        """Fits the host itself and its subdomains."""
        return rf"(?s)^(?:.*\.)?{_escaped(self.host)}\z"

    @property
    def path_regex(self) -> str:
        return f"^{_escaped(self.path)}"

    @property
    def tokens(self) -> list[str]:
        segments = self.path.split("/")[1:-1]  # whole segments only: the last may go on in the url
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in segments if x]


def _escaped(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", s)


def parse(lines: list[str]) -> list[Rule]:
    """Rules from lines such as `block example.com/de/`."""
    out = []
    for line in lines:
        verdict, text = line.split()
        host, slash, path = text.partition("/")
        out.append(Rule(host.lower(), slash + path, verdict))
    return out


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    def tagged(parts: Column, tag: str) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(F.concat(tagged(F.split(host, r"\."), "h:"), tagged(F.split(path, "/"), "p:")))


def table(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, verdict, rank, host_regex, path_regex, tokens: a row for each rule."""
    rows = [
        {"rule": r.text, "verdict": r.verdict, "rank": -len(r.text), "host_regex": r.host_regex, "path_regex": r.path_regex, "tokens": r.tokens} for r in rules
    ]
    kind = "array<struct<rule:string,verdict:string,rank:int,host_regex:string,path_regex:string,tokens:array<string>>>"
    return pages.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def index(x: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """rules by the token of theirs that fewest rows of x(host, path) hold; ties go to the first in code point order.

    A rule without a token is indexed by the empty one, which every row has.
    """
    hint = F.broadcast if few else lambda d: d
    vocabulary = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = x.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(hint(vocabulary), "token").groupBy("token").count()
    each = rules.select("*", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    best = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    return each.groupBy("rule", "verdict", "rank", "host_regex", "path_regex").agg(best.alias("by")).select(
        "rule", "verdict", "rank", "host_regex", "path_regex", F.col("by.token").alias("token")
    )


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return x.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    few = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if few else lambda d: d
    by = materialize(index(x, table(pages, rules), few))
    urls = x.where("host <> ''").select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(F.array_append(tokens_of(F.col("host"), F.col("path")), F.lit(""))).alias("token"))
    fitting = asked.join(hint(by), "token").where(F.rlike("host", F.col("host_regex")) & F.rlike("path", F.col("path_regex")))
    won = fitting.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "verdict")).alias("won"))
    return x.join(won, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )
