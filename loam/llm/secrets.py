"""Secret scans with corpus-wide ownership frequency.

Candidates are found by fixed patterns, leftmost and without overlap per kind. Their values are hashed, and the hashes counted
over the whole corpus by distinct repositories and owners: a value that many owners have is a copied example; one that
a single owner has is that owner's, and looks live.

All of it is DataFrame operations. A row is searched for a kind only if it holds the kind's pattern at all; the spans come from the
matches and the gaps between them, whose lengths in code points sum up to places, in time linear in the matches. Only hashes are shuffled, counted by (hash,
owner, repository) before (hash): a value in every document is one partial sum per task.

Defined cases: a null text is empty; empty texts have no spans; null owners and repositories are values of their own; repeated rows are scanned
each and count as one repository; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, pattern, group that is the value, least length of it. The first three are the base, in its order.
BASE = [
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
#: The same for the kinds that are added, with texts one of which every match holds.
ADDED = [
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", r"(xox[baprs]-[A-Za-z0-9-]{10,})", 1, 15, ("xox",)),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 29, ("eyJ",)),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27, ("PRIVATE KEY-----",)),
]
KINDS = [k[0] for k in (*BASE, *ADDED)]
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it within loops."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column, chunk: int = 256) -> Column:
    """Running sums of an array<bigint>: of chunks, then within each, so no list is copied for every one of its elements."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int"))
    own = lambda k: F.slice(lengths, k * chunk + 1, F.lit(chunk))
    kind = "struct<at:bigint,sums:array<bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")).cast(kind)
    totals = F.transform(numbers, lambda k: F.aggregate(own(k), F.lit(0).cast("bigint"), lambda s, x: s + x))
    ends = F.aggregate(totals, zero, add, lambda s: s["sums"])
    within = lambda ends: F.transform(numbers, lambda k: F.aggregate(own(k), zero, add, lambda s: F.transform(s["sums"], lambda x: x + F.coalesce(F.get(ends, k - 1), F.lit(0)))))
    return F.when(F.size(lengths) > 0, F.flatten(bound(ends, within))).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, number: int, pattern: str, group: int, least: int, holds: Column) -> Column:
    """Spans (start, kind, stop, value) of one kind: places are sums of the lengths of gaps and matches before; linear in text and matches."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x):
        lengths = F.transform(x["whole"], lambda w, i: (F.length(w) + F.length(F.get(x["gaps"], i))).cast("bigint"))
        stops = bound(lengths, lambda x: running(x))
        return F.transform(F.arrays_zip(x["whole"].alias("whole"), stops.alias("stop")), span)

    def span(s):
        value = s["whole"] if group == 1 else F.regexp_extract(s["whole"], pattern, group)  # group 1 is the whole match
        return F.struct((s["stop"] - F.length(s["whole"])).alias("start"), F.lit(number).alias("kind"), s["stop"].alias("stop"), value.alias("value")).cast(SPAN[6:-1])

    return F.when(holds, F.filter(bound(both, placed), lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(SPAN))


RUN = r"[A-Za-z0-9_.-]+"


def web_tokens(text: Column, number: int, holds: Column) -> Column:
    """Spans of the three-part kind, whose pattern would look at a long run from each of its ``eyJ``: each maximal run is cut at its dots once.

    A match takes its first part from a part's first ``eyJ`` on, for a later one ends at the same dot, and two parts more, all of eight characters at least behind that; the next one may
    begin with the part after.
    """
    segment = f"struct<free:int,at:bigint,found:{SPAN}>"

    def of_run(r: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            seg, i, two, three = x["seg"], x["i"], x["two"], x["three"]
            p = F.instr(seg, "eyJ")
            fits = (i >= s["free"]) & (p > 0) & (F.length(seg) - p >= 10) & (F.length(two) >= 8) & (F.length(three) >= 8)
            begin = r["start"] + s["at"] + p - 1
            value = F.concat(F.substring(seg, p, F.length(seg)), F.lit("."), two, F.lit("."), three)
            span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + F.length(value)).alias("stop"), value.alias("value")).cast(SPAN[6:-1])
            after = s["at"] + F.length(seg) + 1
            return F.when(fits, F.struct((i + 3).alias("free"), after.alias("at"), F.concat(s["found"], F.array(span)).alias("found")).cast(segment)).otherwise(
                F.struct(s["free"].alias("free"), after.alias("at"), s["found"].alias("found")).cast(segment)
            )

        parts = F.split(r["run"], r"\.", -1)
        three = lambda v: F.transform(v, lambda seg, i: F.struct(seg.alias("seg"), i.alias("i"), F.coalesce(F.get(v, i + 1), F.lit("")).alias("two"), F.coalesce(F.get(v, i + 2), F.lit("")).alias("three")))
        zero = F.struct(F.lit(0).alias("free"), F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found")).cast(segment)
        return F.aggregate(bound(parts, three), zero, step, lambda s: s["found"])

    both = F.struct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("whole"), F.split(text, RUN, -1).alias("gaps"))

    def placed(x):
        stops = bound(F.transform(x["whole"], lambda w, i: (F.length(w) + F.length(F.get(x["gaps"], i))).cast("bigint")), lambda v: running(v))
        runs = F.transform(F.arrays_zip(x["whole"].alias("run"), stops.alias("stop")), lambda r: F.struct((r["stop"] - F.length(r["run"])).alias("start"), r["run"].alias("run")))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.contains(r["run"], F.lit("eyJ"))), of_run))

    return F.when(holds, bound(both, placed)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, doc_id, repository, owner, spans): all spans of every row, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    t = F.col("text")
    kinds = [spans(t, i, p, g, n, t.rlike(p)) for i, (_, p, g, n) in enumerate(BASE)]
    for i, (_, p, g, n, marks) in enumerate(ADDED, len(BASE)):
        holds = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            holds = holds | F.contains(t, F.lit(m))
        kinds.append(web_tokens(t, i, holds) if marks == ("eyJ",) else spans(t, i, p, g, n, holds))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", F.sort_array(F.concat(*kinds)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array), n_live, n_shared, n_copied (distinct values by ownership).

    A value is ``live`` with one owner, ``copied`` with ``copied_owners`` or more, ``shared`` between.
    """
    found = stored(candidates(docs, repository, owner), "secret-spans")
    held = found.where(F.size("spans") > 0).select(
        "row", "repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("hash")
    )
    owners = (
        held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    verdicts = held.join(owners, "hash").groupBy("row").agg(
        F.count_if(F.col("owners") == 1).alias("n_live"),
        F.count_if((F.col("owners") > 1) & (F.col("owners") < copied_owners)).alias("n_shared"),
        F.count_if(F.col("owners") >= copied_owners).alias("n_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(verdicts, "row", "left").select("doc_id", "spans", zero("n_live"), zero("n_shared"), zero("n_copied"), zero("most_repositories"))


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scanned.select(
        "doc_id", count(0), count(1), count(2), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        "n_live", "n_shared", "n_copied", "most_repositories",
    )


def _oracle() -> str:
    kinds = [(*k, None) for k in BASE] + ADDED
    quoted = lambda p: p.replace("'", "''")
    one = "\nUNION ALL\n".join(
        f"""SELECT row, {i} AS kind, unnest(regexp_extract_all(text, '{quoted(p)}', 0)) AS m, unnest(regexp_extract_all(text, '{quoted(p)}', {g})) AS value,
       unnest(string_split_regex(text, '{quoted(p)}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{quoted(p)}', 0), 1) AS n, {least} AS least
FROM rows WHERE regexp_matches(text, '{quoted(p)}')"""
        for i, (_, p, g, least, _) in enumerate(kinds)
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
pieces AS ({one}),
placed AS (
  SELECT row, kind, value, least, sum(len(gap) + len(m)) OVER (PARTITION BY row, kind ORDER BY n)::BIGINT AS stop, len(m) AS size FROM pieces
), spans AS (
  SELECT row, kind, value, stop - size AS start, {names}[kind + 1] || ':' || (stop - size) || ':' || stop AS said FROM placed WHERE len(value) >= least
), held AS (
  SELECT DISTINCT row, r.doc_id AS repository, r.source AS owner, value FROM spans JOIN rows r USING (row)
), owners AS (
  SELECT value, count(*) AS owners, sum(repositories)::BIGINT AS repositories
  FROM (SELECT value, owner, count(DISTINCT coalesce(repository::VARCHAR, '')) AS repositories FROM held GROUP BY value, owner) GROUP BY value
), verdicts AS (
  SELECT row, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners = 2) AS n_shared, count(*) FILTER (owners >= 3) AS n_copied, max(repositories) AS most_repositories
  FROM held JOIN owners USING (value) GROUP BY row
), joined AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(said, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared,
  coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM rows LEFT JOIN joined USING (row) LEFT JOIN verdicts USING (row)
"""


ORACLE = _oracle()
