"""Credentials in parts: access identifiers, secrets and endpoints are found by patterns, put in order within their scope and linked; weak candidates count only next to a part that completes them.

Only Spark's own functions. Positions: the pieces between the matches of a pattern and the matches themselves alternate, so a match begins at the sum of the lengths of all before it. The interval join of parts
within scopes is a merge: parts and scope borders of a text in one order of start, each part sees the nearest end before it and the nearest start after it of every role in its scope. No pairs
are made, so a text of many parts costs its sort only.

| Kind | Role | Weak |
|-|-|-|
| assign (a keyword with a value of 12 or more characters), hex | secret | no |
| access | identifier | no |
| short (a keyword with a value of 6 to 11), key (20 or more characters with upper case, lower case and digits, no other secret in them) | secret | yes |
| user (a name of an account, user or client) | identifier | yes |
| endpoint (an address with a scheme, or a host that is named as one) | endpoint | yes |

A scope is a passage between blank lines; parts are linked up to REACH code points apart. A weak identifier or endpoint needs a secret there, a weak secret an identifier or endpoint; two weak parts complete each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between two parts of one credential, at most.
REACH = 200


def either_case(words: str) -> str:
    """The pattern with each of its letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Between a keyword and its value.
SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){SET}([A-Za-z0-9+/_.=-]+)"
#: A failing match of these two kinds is followed by no other in its run of characters, so the least length can be part of the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
USER = f"({either_case('username|user|login|account|client_?id')}){SET}([A-Za-z0-9._@+-]+)"
ENDPOINT = rf"""([a-z][a-z0-9+]{{1,15}}://|({either_case('host|server|endpoint')}){SET}[A-Za-z0-9-]+\.)[A-Za-z0-9._~:/?#@%&=+-]+"""
KEY = "[A-Za-z0-9+/_-]{20,}"
BORDER = r"\n[\x20\t\r]*\n"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "endpoint": ENDPOINT, "key": KEY}
#: What every match begins with, and of which characters it holds one: both only spare Spark's engine the search where there is no match.
BEGINS = {"assign": "(?=[pPsStTaA])", "user": "(?=[uUlLaAcC])", "endpoint": "(?=[a-zHSE])"}
HOLDS = {"assign": ":=", "user": ":=", "endpoint": ":="}
BASE, WEAK = ("assign", "access", "hex"), ("user", "endpoint", "short", "key")
ORDER = (*BASE, *WEAK)
ROLE = {"assign": "secret", "hex": "secret", "short": "secret", "key": "secret", "access": "id", "user": "id", "endpoint": "endpoint"}
#: Values of a keyword from which it is an assign, and a short.
LONG, SHORT, LEAST_USER = 12, 6, 3


def _part(kind: str, match: Column) -> Column:
    """What a match of a pattern is: a kind, or null where it fails."""
    if kind == "assign":
        size = F.length(F.regexp_extract(match, ASSIGN, 2))
        return F.when(size >= LONG, F.lit("assign")).when(size >= SHORT, F.lit("short"))
    if kind == "user":
        return F.when(F.length(F.regexp_extract(match, USER, 2)) >= LEAST_USER, F.lit("user"))
    if kind == "key":
        return F.when(match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]"), F.lit("key"))
    return F.lit(kind)


def _matches(name: str) -> Column:
    found = F.regexp_extract_all("text", F.lit(BEGINS.get(name, "") + PATTERNS[name]), F.lit(0))
    if name not in HOLDS:
        return found
    one, two = (F.contains("text", F.lit(c)) for c in HOLDS[name])
    return F.when(one | two, found).otherwise(F.array().cast("array<string>"))


def _pieces(name: str, pattern: str, kind: Column | None = None) -> Column:
    """Of the matches of a pattern: its name, their number, the length before each and its own, and its kind."""
    pairs = F.arrays_zip(F.transform(F.split("text", pattern, -1), F.length).alias("gap"), F.col(f"_{name}").alias("match"))

    def piece(x, i):
        return F.struct(F.lit(name).alias("pattern"), i.alias("i"), x["gap"].alias("gap"), F.length(x["match"]).alias("size"), (F.lit("border") if name == "border" else _part(name, x["match"])).alias("kind"))

    return F.transform(F.filter(pairs, lambda x: x["match"].isNotNull()), piece)


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id and spans (array of kind, start, end and linked, by start, then kind as in ORDER; positions are code points, end is exclusive).

    All spans of strong kinds are there, and those of weak kinds that a complementary part completes; `linked` says for each whether one does. One row for each row given, repeated ones too; doc_id may be null. A null or empty text
    has no spans. Other columns are not read. No rows give no rows.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = own.select("*", *(_matches(k).alias(f"_{k}") for k in PATTERNS))
    some = lambda kinds: F.greatest(*(F.size(f"_{k}") for k in kinds)) > 0
    met = met.withColumn("_border", F.when(some(PATTERNS), F.regexp_extract_all("text", F.lit(BORDER), F.lit(0))))
    parts = F.flatten(F.filter(F.array(*(F.when(F.size(f"_{k}") > 0, _pieces(k, p)) for k, p in (PATTERNS | {"border": BORDER}).items())), lambda x: x.isNotNull()))
    rows = met.select("row", "doc_id", parts.alias("parts")).select("row", "doc_id", F.explode_outer("parts").alias("p")).select("row", "doc_id", "p.*").repartition("row")
    before = Window.partitionBy("row", "pattern").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.withColumn("rank", F.coalesce(F.array_position(F.array(*(F.lit(k) for k in ORDER)), F.col("kind")), F.lit(0)).cast("int"))

    order = Window.partitionBy("row").orderBy("start", "rank", "pattern")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind").isin(*BASE)
    inside = (F.col("kind") == "key") & ((F.coalesce(F.max(F.when(base, F.col("end"))).over(past), F.lit(0)) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(future) < F.col("end")))
    scope = F.sum(F.when(F.col("kind") == "border", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("row", "doc_id", F.when(~F.coalesce(inside, F.lit(False)), F.col("kind")).alias("kind"), "start", "end", "rank", "pattern", scope.alias("scope"))

    order = Window.partitionBy("row", "scope").orderBy("start", "rank", "pattern")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(*roles: str) -> Column:
        part = F.col("kind").isin(*(k for k, r in ROLE.items() if r in roles))
        left, right = F.max(F.when(part, F.col("end"))).over(past), F.min(F.when(part, F.col("start"))).over(future)
        return F.coalesce(left + reach >= F.col("start"), F.lit(False)) | F.coalesce(right - reach <= F.col("end"), F.lit(False))

    secret = F.col("kind").isin(*(k for k, r in ROLE.items() if r == "secret"))
    rows = rows.select("row", "doc_id", "kind", "start", "end", "rank", F.when(secret, near("id", "endpoint")).otherwise(near("secret")).alias("linked"))
    kept = F.col("kind").isin(*ORDER) & (~F.col("kind").isin(*WEAK) | F.col("linked"))
    span = F.when(kept, F.struct("start", "rank", "kind", "end", "linked"))
    out = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["linked"].alias("linked"))).alias("spans"))


def sql(reach: int = REACH) -> str:
    """The digests of op12's query as a SQL statement."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    size = f"length(regexp_extract(match, {quoted(ASSIGN)}, 2))"
    kind = {
        "assign": f"CASE WHEN {size} >= {LONG} THEN 'assign' WHEN {size} >= {SHORT} THEN 'short' END",
        "user": f"CASE WHEN length(regexp_extract(match, {quoted(USER)}, 2)) >= {LEAST_USER} THEN 'user' END",
        "key": "CASE WHEN regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[0-9]') THEN 'key' END",
    }
    each = " UNION ALL ".join(
        f"SELECT r, '{k}' AS pattern, i, gap, length(match) AS size, {kind.get(k, quoted(k))} AS kind FROM (SELECT r, unnest(range(len(m))) AS i, unnest(list_transform(string_split_regex(text, {quoted(p)})[:len(m)], lambda x: length(x))) AS gap, unnest(m) AS match"
        f" FROM (SELECT r, text, regexp_extract_all(text, {quoted(p)}) AS m FROM d) WHERE len(m) > 0)"
        for k, p in (PATTERNS | {"border": BORDER}).items()
    )
    listed = lambda kinds: ", ".join(quoted(k) for k in kinds)
    of = lambda *roles: listed(k for k, r in ROLE.items() if r in roles)
    near = lambda *roles: f"(coalesce(max(CASE WHEN kind IN ({of(*roles)}) THEN stop END) OVER past + {reach} >= start, false) OR coalesce(min(CASE WHEN kind IN ({of(*roles)}) THEN start END) OVER future - {reach} <= stop, false))"
    windows = lambda by: f"WINDOW past AS (PARTITION BY {by} ORDER BY start, rank, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), future AS (PARTITION BY {by} ORDER BY start, rank, pattern ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ORDER)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    e AS ({each}),
    s AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, pattern ORDER BY i)::BIGINT AS stop, coalesce(list_position([{listed(ORDER)}], kind), 0) AS rank FROM e),
    p AS (SELECT *, stop - size AS start FROM s),
    q AS (SELECT *, kind = 'key' AND (coalesce(max(CASE WHEN kind IN ({listed(BASE)}) THEN stop END) OVER past > start, false) OR coalesce(min(CASE WHEN kind IN ({listed(BASE)}) THEN start END) OVER future < stop, false)) AS inside,
      sum(CASE WHEN kind = 'border' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY start, rank, pattern ROWS UNBOUNDED PRECEDING) AS scope FROM p {windows('r')}),
    k AS (SELECT r, scope, pattern, CASE WHEN NOT coalesce(inside, false) THEN kind END AS kind, start, stop, rank FROM q),
    l AS (SELECT *, CASE WHEN kind IN ({of('secret')}) THEN {near('id', 'endpoint')} ELSE {near('secret')} END AS linked FROM k {windows('r, scope')}),
    f AS (SELECT r, {count}, count(*) FILTER (linked) AS n_linked, {text} FILTER (kind IN ({listed(BASE)})) AS base, {text} AS spans FROM l WHERE kind IN ({listed(BASE)}) OR kind IN ({listed(WEAK)}) AND linked GROUP BY r)
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ORDER)}, coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON f.r = d.r"""
