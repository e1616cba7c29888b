"""Secret scan with corpus-wide ownership frequency, in Column expressions only.

Places of all matches come from cutting the text at the pattern: the gaps and
the matches alternate, so their running lengths are the spans in code points.
Running values are made in blocks (first a value per block, then inside each),
so the time of a text grows with its matches, not with their square.
Besides the base kinds, long mixed tokens are candidates. Each candidate's hash
is aggregated over repositories and owners: what many owners hold is a copied
example, what one owner holds looks like a live credential and is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import row_key, text_or_empty
from leadloom.session import write_scratch


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds matches; ``holds`` tells from a match whether it counts."""

    name: str
    pattern: str
    holds: object = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "^" + _ASSIGN, "")) >= 12


#: Fixed by the result contract. Runs of one character class start at the run's
#: start, so the minimum length can stand in the pattern for the last two.
BASE = (
    Kind("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _long_value),
    Kind("access", r"AKIA[A-Z0-9]{14,}"),
    Kind("hex", r"[0-9a-f]{16,}"),
)
#: Candidates of the method: long tokens that mix letters and several digits.
CANDIDATE = Kind("token", r"[A-Za-z0-9_-]{20,}", lambda m: m.rlike("[A-Za-z].*[A-Za-z]") & m.rlike(r"(?:\d.*?){4}"))
ORDER = [k.name for k in (*BASE, CANDIDATE)]


_SPANS = "array<struct<start:int,rank:int,end:int,match:string>>"
_BLOCK = 128


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a one-element array names it inside the expression."""
    return F.transform(F.array(value), use)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """array<bigint> of the combined values up to each place; ``combine`` must be associative, ``start`` neutral."""
    none, zero = F.array().cast("array<bigint>"), F.lit(start).cast("bigint")

    def listed_from(at, part, inclusive):
        def step(state, x):
            new = combine(state["at"], x)
            return F.struct(new.alias("at"), F.concat(state["all"], F.array(new if inclusive else state["at"])).alias("all"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("all")), step, lambda state: state["all"])

    def in_blocks(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
        return F.flatten(F.zip_with(blocks, listed_from(zero, totals, False), lambda b, at: listed_from(at, b, True)))

    def cut(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
                           lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK))

    return F.when(F.size(values) == 0, none).otherwise(named(values, lambda v: named(cut(v), in_blocks)))


def spans(text: Column, kind: Kind) -> Column:
    """array<struct<start,rank,end,match>> of the leftmost non-overlapping matches that hold; code points."""
    def placed(matches):
        gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
        ends = running(F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")), lambda a, b: a + b)
        return F.zip_with(matches, ends, lambda m, e: F.struct(
            (e - F.length(m)).cast("int").alias("start"), F.lit(ORDER.index(kind.name)).alias("rank"),
            e.cast("int").alias("end"), m.alias("match")))

    found = F.when(text.rlike(kind.pattern), named(F.regexp_extract_all(text, F.lit(kind.pattern), 0), placed).cast(_SPANS)).otherwise(
        F.array().cast(_SPANS))
    return F.filter(found, lambda s: kind.holds(s["match"])) if kind.holds else found


def apart_from(some: Column, base: Column) -> Column:
    """Those of ``some`` spans that overlap no ``base`` span: one pass over both, ordered by their start.

    A span is apart if no base span up to its place ends behind its start, and
    the next base span doesn't start before its end.
    """
    rank = F.lit(len(BASE))
    far = 2**31 - 1

    def swept(every):
        upto = running(F.transform(every, lambda s: F.when(s["rank"] < rank, s["end"]).otherwise(0).cast("bigint")), _larger)
        after = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(
            s["rank"] < rank, s["start"]).otherwise(far).cast("bigint"))), _smaller, far))
        return named(upto, lambda u: named(after, lambda n: F.filter(
            every, lambda s, i: (s["rank"] >= rank) & (F.get(u, i) <= s["start"]) & (F.get(n, i) >= s["end"]))))

    return F.when((F.size(some) == 0) | (F.size(base) == 0), some).otherwise(named(F.sort_array(F.concat(base, some)), swept))


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None = None,
         repo_col: str | None = None) -> DataFrame:
    """(row, id, key, owner, repo, base, more) per row of ``docs``, written once to the shared folder.

    base: spans of the base kinds by start, then kind; more: candidates that
    overlap none of them. A null text has no spans. Without ``repo_col`` each
    document is its own repository; without ``owner_col`` all have one owner.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), row_key(f"`{id_col}`", f"`{text_col}`").alias("key"),
        (F.col(owner_col).cast("string") if owner_col else F.lit("")).alias("owner"),
        (F.col(repo_col).cast("string") if repo_col else F.col(id_col).cast("string")).alias("repo"),
        text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    found = rows.select("id", "key", "owner", "repo",
                        *[spans(F.col("text"), k).alias(k.name) for k in (*BASE, CANDIDATE)])
    found = found.select("id", "key", "owner", "repo",
                         F.sort_array(F.concat(*[F.col(k.name) for k in BASE])).alias("base"), "token")
    more = apart_from(F.col("token"), F.col("base"))
    return write_scratch(found.select(F.monotonically_increasing_id().alias("row"), "id", "key", "owner", "repo",
                                      "base", more.alias("more")), "secrets")


def secret_of(match: Column) -> Column:
    """The value that is compared across the corpus: what follows the name, or the match."""
    return F.regexp_replace(match, "^" + _ASSIGN, "")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of each candidate value: distinct repositories (per owner) and owners.

    Three aggregations with map-side combine; a value in a third of all
    documents costs one row per task, repository and owner.
    """
    values = scanned.select("owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    hashed = values.select("owner", "repo", F.xxhash64(secret_of(F.col("s.match"))).alias("hash"))
    return (hashed.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
            .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
            .groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")))


def live_candidates(scanned: DataFrame, frequency: DataFrame, max_owners: int = 1, max_repos: int = 10) -> DataFrame:
    """(row, span) of candidates that at most ``max_owners`` owners and ``max_repos`` repositories hold."""
    each = scanned.where(F.size("more") > 0).select("row", F.explode("more").alias("span"))
    owned = frequency.where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("hash")
    return (each.withColumn("hash", F.xxhash64(secret_of(F.col("span.match"))))
            .join(owned, "hash", "left_semi").select("row", "span"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source",
                 repo_col: str | None = None, max_owners: int = 1, max_repos: int = 10) -> DataFrame:
    """(id, key, base, spans) per row of ``docs``: base spans always stay, live-looking candidates are added.

    Each span: start, rank (place of its kind in ``ORDER``), end (exclusive),
    match. Null text: no spans; repeated rows: a row each; empty table: empty.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    live = live_candidates(scanned, ownership(scanned), max_owners, max_repos)
    added = live.groupBy("row").agg(F.collect_list("span").alias("added"))  # at most the candidates of one text
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,match:string>>")
    return scanned.join(added, "row", "left").select(
        "id", "key", "base", F.sort_array(F.concat("base", F.coalesce("added", empty))).alias("spans"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source",
             repo_col: str | None = None, max_owners: int = 1, max_repos: int = 10) -> DataFrame:
    """(id, kind, start, end, hash, n_repos, n_owners, verdict) of every candidate: live or example."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    names = F.array(*[F.lit(n) for n in ORDER])
    each = scanned.select("id", F.explode(F.concat("base", "more")).alias("s")).select(
        "id", names[F.col("s.rank")].alias("kind"), "s.start", "s.end",
        F.xxhash64(secret_of(F.col("s.match"))).alias("hash"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    return each.join(ownership(scanned), "hash").select(
        "id", "kind", "start", "end", "hash", "n_repos", "n_owners",
        F.when(live, "live").otherwise("example").alias("verdict"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(n) for n in ORDER])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def merged(found: Column) -> Column:
    """array<struct<start,end>>: sorted spans, overlapping ones as one."""
    def joined(all_, reach):
        heads = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["start"] >= F.get(reach, i - 1)))
        return named(heads, lambda h: F.transform(h, lambda i, k: F.struct(
            F.get(all_, i)["start"].alias("start"),
            F.get(reach, F.coalesce(F.get(h, k + 1), F.size(all_)) - 1).cast("int").alias("end"))))

    return named(found, lambda x: named(running(F.transform(x, lambda s: s["end"].cast("bigint")), _larger),
                                        lambda reach: joined(x, reach)))


def redacted(text: Column, found: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans count as one; ``found`` isn't empty.

    The text is cut into about as many stretches as each holds spans, and the
    spans are replaced inside their stretch: reading to a place in a string
    takes its length, so this is the length times the root of the spans.
    """
    def replaced(cuts, t):
        many = F.ceil(F.sqrt(F.size(cuts))).cast("int")

        def stretch(k):
            first = k * many
            begin = F.coalesce(F.get(cuts, first - 1)["end"], F.lit(0))
            own = F.slice(cuts, first + 1, many)
            return named(own, lambda o: named(F.substring(t, begin + 1, F.element_at(o, -1)["end"] - begin), lambda part: F.array_join(
                F.transform(o, lambda s, i: _before(part, F.coalesce(F.get(o, i - 1)["end"], begin) - begin, s["start"] - begin, mark)), "")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / many).cast("int"))
        return F.concat(F.array_join(F.transform(blocks, stretch), ""),
                        F.substring(t, F.element_at(cuts, -1)["end"] + 1, F.length(t)))

    return named(merged(found), lambda cuts: replaced(cuts, text))


def _before(part: Column, begin: Column, end: Column, mark: str) -> Column:
    return F.concat(F.substring(part, begin + 1, end - begin), F.lit(mark))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **how) -> DataFrame:
    """``docs`` with all reported spans masked in the text; other columns and clean rows unchanged, whatever their names.

    ``length_col`` is set to the new number of code points where the text has changed.
    """
    found = (find_secrets(docs, id_col, text_col, **how).where(F.size("spans") > 0)
             .groupBy("id", "key").agg(F.first("spans").alias("spans")))  # equal rows have equal spans
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
                         F.col(f"`{id_col}`").cast("bigint").alias("id"), row_key(f"`{id_col}`", f"`{text_col}`").alias("key"))
    same = (F.col("d.key") == F.col("k.key")) & F.col("d.id").eqNullSafe(F.col("k.id"))
    both = packed.alias("d").join(found.alias("k"), same, "left").select("whole", "spans")
    text = F.col("whole")[text_col]
    masked = both.select("whole", "spans", F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))).alias("text"))
    out = {text_col: F.col("text")}
    if length_col:
        old = F.col("whole")[length_col]
        out[length_col] = F.when(F.col("spans").isNull() | F.col("text").eqNullSafe(text), old).otherwise(
            F.length("text").cast(docs.schema[length_col].dataType))
    return masked.select(*[out.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
