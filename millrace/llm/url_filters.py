r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host`` + ``path``. Of the tokens that any matching URL must contain whole (runs of
``[0-9a-z]`` in the pattern's literal text that cannot be longer in the URL), the one that occurs in the fewest URLs of the
table is the rule's entry in the index. A URL fetches the rules under its own tokens; only those run their regular
expressions. Of the rules that match, the listed ones (host and path rules) come before the general ones, then the longest wins.

Pattern language (``rule``):

- ``host/path``   listed rules: the host and its subdomains, paths that begin so (``com/``, ``example.com/en/``)
- ``||text``      general rules: ``text`` begins at a host label
- ``text``        general rules: anywhere
- ``*`` any run of characters, ``^`` the end or one character that is none of letters, digits, ``_-.%``, ``|`` at the end: the end

Rule lists of at most ``BROADCAST_RULES`` rows are sent to the executors and a scan of the URLs is all that happens after
the counting of tokens. Longer lists stay in Spark: URL tokens are joined to index entries; tokens that are in many URLs are
salted, as their number is known from the counting. Both ways give the same verdicts.

Defined cases: a NULL url or one without ``://`` has an empty host and path and gets ``allow`` without a rule; equal rules count once,
equal patterns with both actions block; of several longest rules the first in code point order is reported; repeated
rows, repeated and NULL ids are answered row by row; empty tables give empty results and an empty rule list allows everything. Patterns are compared with A-Z in
lower case on both sides in the host, as written in the path (general rules: lower case everywhere). Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import staged

ALLOW, BLOCK = "allow", "block"
BROADCAST_RULES = 100_000
# URLs that share one copy of an index entry in the join.
SALTED = 1_000_000

# The rules that were given, as (action, host and path).
LISTED = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
# General rules for URLs that no listed rule fits: names of link farms, pills, betting, piracy and adult sites, trackers' endpoints.
GENERAL = [(BLOCK, "||spam-*."), (BLOCK, "||*-spam."), (BLOCK, "||link-farm"), (BLOCK, "||cheap-pills."), (BLOCK, "||cheap-viagra"),
           (BLOCK, "||viagra"), (BLOCK, "||cialis"), (BLOCK, "||pharmacy-*online"), (BLOCK, "||casino"), (BLOCK, "-casino."), (BLOCK, "||poker-"),
           (BLOCK, "||online-betting"), (BLOCK, "||payday-loans"), (BLOCK, "||porn"), (BLOCK, "||xxx-"), (BLOCK, "||xxx."), (BLOCK, "||sex-cams"),
           (BLOCK, "||warez"), (BLOCK, "||torrent-*download"), (BLOCK, "||adserver."), (BLOCK, "||doubleclick."), (BLOCK, "/adclick^"),
           (BLOCK, "/wp-login.php|"), (BLOCK, "/xmlrpc.php|"), (BLOCK, "/viagra^"), (BLOCK, "/casino-bonus^"), (BLOCK, "/cheap-pills^")]

_TOKEN = "[0-9a-z]+"
# Neither host nor path holds this character: it stands behind them as the end.
_END = "#"
_SEPARATOR = "[^0-9A-Za-z_.%-]"
_LOWER = {upper: upper + 32 for upper in range(65, 91)}
_RULES = "action string, text string, listed boolean, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """A compiled rule; every subject that its regular expression matches holds all of ``tokens`` as whole runs."""

    action: str
    text: str
    listed: bool
    regex: str
    tokens: tuple[str, ...]


def _literal(text: str) -> str:
    """``text`` as a pattern that Java, Python and RE2 read alike."""
    return "".join(c if re.match(r"[0-9A-Za-z_/]|[^\x00-\x7f]", c) else "\\" + c if c in r"^\[]" else f"[{c}]" for c in text)


def listed_rule(action: str, text: str) -> Rule:
    """A host and a prefix of the path; the path's last run of letters may go on in a URL, so it is no token."""
    host, slash, path = text.partition("/")
    if not host or not slash:
        raise ValueError(f"a listed rule is a host, '/' and a path: {text!r}")
    host, path = _ascii_lower(host), slash + path
    tokens = re.findall(_TOKEN, host) + re.findall(rf"{_TOKEN}(?=[^0-9a-z])", _ascii_lower(path))
    return Rule(action, text, True, f"^([^/]*[.])?{_literal(host)}{_literal(path)}", tuple(sorted(set(tokens))))


def general_rule(action: str, text: str) -> Rule:
    """Wildcards anywhere, all in lower case."""
    low = _ascii_lower(text)
    body, at_label, at_end = low.removeprefix("||").removesuffix("|"), low.startswith("||"), low.endswith("|")
    if not body.strip("*^"):
        raise ValueError(f"a rule without text: {text!r}")
    regex = "".join(f"[^{_END}]*" if c == "*" else _SEPARATOR if c == "^" else _literal(c) for c in body)
    # A run is a token if what stands beside it in the pattern ends it: another character, a label's start or the end.
    fenced = ("." if at_label else "*") + body + ("." if at_end else "*")
    tokens = re.findall(rf"(?<=[^0-9a-z*]){_TOKEN}(?=[^0-9a-z*])", fenced)
    return Rule(action, text, False, ("^([^/]*[.])?" if at_label else "") + regex + (_END if at_end else ""), tuple(sorted(set(tokens))))


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def compiled(listed: Sequence[tuple[str, str]] = LISTED, general: Sequence[tuple[str, str]] = GENERAL) -> list[Rule]:
    """Every pattern once; block wins where a pattern has both actions."""
    rules: dict[tuple[bool, str], Rule] = {}
    for make, pairs in ((listed_rule, listed), (general_rule, general)):
        for action, text in pairs:
            if action not in (ALLOW, BLOCK):
                raise ValueError(f"{action!r} is neither {ALLOW!r} nor {BLOCK!r}")
            rule = make(action, text)
            if (rule.listed, text) not in rules or action == BLOCK:
                rules[rule.listed, text] = rule
    return list(rules.values())


def lower(text: Column) -> Column:
    """A-Z in lower case, no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parts(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3))
    return (F.coalesce(lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def _tokens(host: Column, path: Column) -> Column:
    """The URL's tokens, each once; the empty one stands for rules without any."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.concat(host, lower(path)), F.lit(_TOKEN), F.lit(0))))


def _best_first() -> list[Column]:
    return [F.desc("listed"), F.desc(F.length("text")), F.asc("text")]


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.action, r.text, r.listed, r.regex, list(r.tokens)) for r in rules], _RULES)


def index(urls: DataFrame, rules: DataFrame, all_rules_small: bool) -> DataFrame:
    """``rules`` with their rarest token (``entry``) and the number of rows of ``urls`` (host, path) that hold it (``n``)."""
    entries = rules.select("listed", "text", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = entries.select("token").distinct()
    held = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    held = held.join(F.broadcast(wanted) if all_rules_small else wanted.hint("shuffle_hash"), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (entries.join(F.broadcast(counts) if all_rules_small else counts, "token", "left")
              .groupBy("listed", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("entry"))).alias("rarest")))
    return rules.join(rarest, ["listed", "text"]).select("action", "text", "listed", "regex", "rarest.entry", "rarest.n")


def _judge(ranked: list[tuple[str, str, bool, str, str]]):
    """Rows (page_id, host, path) to rows with rule, pattern and verdict; ``ranked`` are rules, the first that matches wins."""
    by_token: dict[str, list[int]] = {}
    for number, (*_, entry) in enumerate(ranked):
        by_token.setdefault(entry, []).append(number)
    runs = re.compile(_TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[int, re.Pattern] = {}
        always = by_token.get("", [])
        for batch in batches:
            rules, general, verdicts = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                low = _ascii_lower(host + path)
                fetched = set(always)
                for token in set(runs.findall(low)):
                    fetched.update(by_token.get(token, ()))
                found = None
                for number in sorted(fetched):
                    pattern = patterns.get(number)
                    if pattern is None:
                        pattern = patterns[number] = re.compile(ranked[number][3])
                    if pattern.search((host + path if ranked[number][2] else low) + _END):
                        found = ranked[number]
                        break
                rules.append(found[1] if found and found[2] else None)
                general.append(found[1] if found and not found[2] else None)
                verdicts.append(found[0] if found else ALLOW)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(general, pa.string()), pa.array(verdicts, pa.string())],
                                             names=[*batch.schema.names, "rule", "pattern", "verdict"])

    return run


def _joined(urls: DataFrame, indexed: DataFrame) -> DataFrame:
    """The same verdicts by a join on tokens, for rule lists of any length."""
    urls = staged(urls.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    indexed = indexed.withColumn("copies", F.ceil((F.col("n") + 1) / SALTED).cast("int"))
    entries = indexed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    salts = indexed.groupBy("entry").agg(F.max("copies").alias("copies"))
    many = staged(salts.where("copies > 1"), "url-salts")
    held = urls.select("row", "host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("entry"))
    # Frequent tokens are at most as many as URLs' tokens per SALTED rows; they are few, yet the join does not rely on it.
    held = held.join(many, "entry", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    subject = F.concat(F.when(F.col("listed"), F.concat("host", "path")).otherwise(lower(F.concat("host", "path"))), F.lit(_END))
    best = F.min(F.struct((~F.col("listed")).alias("general"), (-F.length("text")).alias("shorter"), "text", "action")).alias("best")
    found = held.join(entries, ["entry", "salt"]).where(F.rlike(subject, F.col("regex"))).groupBy("row").agg(best)
    listed = ~F.col("best.general")
    return (urls.join(found, "row", "left")
            .select("page_id", "host", "path", F.when(listed, F.col("best.text")).alias("rule"), F.when(~listed, F.col("best.text")).alias("pattern"),
                    F.coalesce("best.action", F.lit(ALLOW)).alias("verdict")))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (the listed one that decides), verdict, pattern (the general one).

    ``rules`` is a table as :func:`rule_table` makes it: each pattern once.
    """
    host, path = _parts(F.col(f"`{url_column}`").cast("string"))
    urls = pages.select(F.col(f"`{id_column}`").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = staged(rules, "url-rules")
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    indexed = index(urls, rules, few)
    if few:
        ranked = [tuple(r) for r in indexed.orderBy(*_best_first()).select("action", "text", "listed", "regex", "entry").collect()]
        judged = urls.mapInArrow(_judge(ranked), "page_id bigint, host string, path string, rule string, pattern string, verdict string")
    else:
        judged = _joined(urls, staged(indexed, "url-index"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")
