"""URL rules: resolve and normalise, rank, filter, hash, label.

Resolution follows RFC 3986 the way common URL-join functions do it, written
as a list of steps over named parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from urllib.parse import uses_netloc, uses_params, uses_relative

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import (
    BLOCKED_HOSTS, BLOCKED_TLDS, HIGH_VALUE_WORDS, JUNK_DOMAINS, LOW_VALUE_WORDS,
)
from leadloom.functions.patterns import any_of

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|\z)"
_IP_LITERAL = r"^(?:v[0-9A-Fa-f]+\..+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%.+)?)\z"
# Links that resolve by copying: no spaces, query, parameters, dots or brackets.
_PLAIN_URL = r"^https?://[^/?#;\[\]\x00-\x20]+(?:/[^?#;\[\]\x00-\x20]*)?\z"
_PLAIN_PATH = r"^/(?!/)[^?#;\[\]\x00-\x20]*\z"
_PLAIN_ORIGIN = r"^(https?://[^/?#\[\]\x00-\x20]+)(?:[/?#]|\z)"
_NO_STRINGS = "array<string>"

Scope = dict[str, Column]


def _strip_controls(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _bad_netloc(netloc: Column) -> Column:
    opened, closed = netloc.contains("["), netloc.contains("]")
    literal = F.regexp_extract(netloc, r"\[([^\]]*)\]", 1)
    return (opened != closed) | (opened & closed & ~literal.rlike(_IP_LITERAL))


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    hierarchical = (scheme != "") & scheme.isin(*uses_netloc) & ((path == "") | path.startswith("/"))
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(path.startswith("//") | hierarchical, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def _remove_dot_segments(path: Column) -> Column:
    """Apply ``.`` and ``..``; a step above the root is ignored."""
    kept = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast(_NO_STRINGS),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(seg == ".", acc).otherwise(F.array_append(acc, seg)),
    )
    joined = F.array_join(kept, "/")
    ends_in_dots = path.rlike(r"(?:^|/)\.\.?\z")
    return F.when(ends_in_dots & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def _clean(s: Scope) -> Scope:
    base = F.coalesce(s["base"], F.lit(""))
    return {"no_base": base == "", "b": _strip_controls(base),
            "t": _strip_controls(F.coalesce(s["target"], F.lit("")))}


def _parts(s: Scope) -> Scope:
    out: Scope = {}
    for side in ("b", "t"):
        for i, name in enumerate(("scheme", "netloc", "path", "query"), start=1):
            part = F.regexp_extract(s[side], _PARTS, i)
            out[f"{side}_{name}"] = F.lower(part) if name == "scheme" else part
    out["fragment"] = F.regexp_extract(s["t"], r"(?s)#(.*)", 1)
    return out


def _params(s: Scope) -> Scope:
    """Split ``;parameters`` off the last path segment; an empty one is dropped."""
    out: Scope = {"t_own_scheme": s["t_scheme"],
                  "t_scheme": F.when(s["t_scheme"] == "", s["b_scheme"]).otherwise(s["t_scheme"])}
    for side in ("b", "t"):
        scheme = out["t_scheme"] if side == "t" else s["b_scheme"]
        path = s[f"{side}_path"]
        params = F.when(path.contains(";") & scheme.isin(*uses_params),
                        F.regexp_extract(path, r"(;[^/]*)\z", 1)).otherwise("")
        out[f"{side}_params"] = F.when(params == ";", "").otherwise(params)
        out[f"{side}_path"] = F.left(path, F.length(path) - F.length(params))
    return out


def _merge(s: Scope) -> Scope:
    """Path of the result before dot segments are removed."""
    base_dir = F.regexp_extract(s["b_path"], r"(?s)^(.*/)", 1)
    base_dir = F.when(s["b_path"] == "", "/").otherwise(base_dir)
    relative = F.regexp_replace(F.concat(base_dir, s["t_path"]), "/+", "/")
    return {
        "merged": F.when(s["t_netloc"] != "", s["t_path"])
        .when(s["t_path"].startswith("/"), s["t_path"])
        .otherwise(relative),
        # Without a base a link is only taken apart to drop its fragment.
        "bad": F.when(s["no_base"], s["target"].contains("#") & _bad_netloc(s["t_netloc"]))
        .otherwise(_bad_netloc(s["t_netloc"]) | _bad_netloc(s["b_netloc"])),
    }


def _choose(s: Scope) -> Scope:
    """Parts of the result; ``verbatim`` links of another scheme stay as written."""
    foreign = s["no_base"] | (s["b_scheme"] != s["t_scheme"]) | ~s["t_scheme"].isin(*uses_relative)
    own = foreign | (s["t_netloc"] != "")
    same_page = ~own & (s["t_path"] == "") & (s["t_params"] == "")
    dotted = F.when(s["merged"].rlike(_DOT_SEGMENT), _remove_dot_segments(s["merged"])).otherwise(s["merged"])
    return {
        "verbatim": foreign & ~s["target"].contains("#"),
        "scheme": F.when(foreign, s["t_own_scheme"]).otherwise(s["t_scheme"]),
        "netloc": F.when(own, s["t_netloc"]).otherwise(s["b_netloc"]),
        "path": F.when(own, F.concat(s["t_path"], s["t_params"]))
        .when(same_page, F.concat(s["b_path"], s["b_params"]))
        .otherwise(F.concat(F.when(dotted == "", "/").otherwise(dotted), s["t_params"])),
        "query": F.when(same_page & (s["t_query"] == ""), s["b_query"]).otherwise(s["t_query"]),
    }


def _join(s: Scope) -> Scope:
    return {"joined": F.when(s["verbatim"], s["target"]).otherwise(
        _unsplit(s["scheme"], s["netloc"], s["path"], s["query"]))}


_STEPS: tuple[Callable[[Scope], Scope], ...] = (_clean, _parts, _params, _merge, _choose, _join)


def _normalized(s: Scope) -> Column:
    """No fragment and no trailing slashes; unusable input becomes ''."""
    usable = F.coalesce((s["target"] != "") & ~s["bad"], F.lit(False))
    return F.when(usable, F.rtrim(s["joined"], F.lit("/"))).otherwise("")


def _absolute(s: Scope) -> Column:
    """The resolved URL as a browser shows it: fragment and slashes are kept."""
    usable = F.coalesce((s["target"] != "") & ~s["bad"], F.lit(False))
    fragment = F.when(s["fragment"] != "", F.concat(F.lit("#"), s["fragment"])).otherwise("")
    return F.when(usable, F.concat(s["joined"], fragment)).otherwise("")


def _let(scope: Scope, steps: Sequence[Callable[[Scope], Scope]], final: Callable[[Scope], Column]) -> Column:
    """Name the results of each step, so that no expression is written out twice."""
    if not steps:
        return final(scope)
    new = steps[0](scope)
    bound = F.struct(*[c.alias(k) for k, c in new.items()])
    return F.transform(
        F.array(bound), lambda s: _let({**scope, **{k: s[k] for k in new}}, steps[1:], final)
    )[0]


def normalize_url(base: Column, target: Column) -> Column:
    """``target`` resolved against ``base``, without fragment and trailing slashes.

    Empty or unusable input gives ''. Plain absolute and root-relative links
    need no parsing and take a short way through generated code.
    """
    origin = F.regexp_extract(base, _PLAIN_ORIGIN, 1)
    plain_path = target.rlike(_PLAIN_PATH) & ~target.contains("/.") & (origin != "")
    return (
        F.when(target.rlike(_PLAIN_URL), F.rtrim(target, F.lit("/")))
        .when(plain_path, F.rtrim(F.concat(origin, target), F.lit("/")))
        .otherwise(_let({"base": base, "target": target}, _STEPS, _normalized))
    )


def resolve_url(base: Column, target: Column) -> Column:
    """Like ``normalize_url``, but fragment and trailing slashes stay."""
    origin = F.regexp_extract(base, _PLAIN_ORIGIN, 1)
    plain_path = target.rlike(_PLAIN_PATH) & ~target.contains("/.") & (origin != "")
    return (
        F.when(target.rlike(_PLAIN_URL), target).when(plain_path, F.concat(origin, target))
        .otherwise(_let({"base": base, "target": target}, _STEPS, _absolute))
    )


@lru_cache(maxsize=128)
def _normalized_columns(base: str, target: str) -> Column:
    """Built once per pair of names: the expression is long and never changes."""
    return normalize_url(F.col(base), F.col(target))


def with_normalized_url(df: DataFrame, base: str, target: str, out: str) -> DataFrame:
    return df.withColumn(out, _normalized_columns(base, target))


def rank_url(url: Column, high: Sequence[str] = HIGH_VALUE_WORDS, low: Sequence[str] = LOW_VALUE_WORDS) -> Column:
    """0 = likely contact page, 1 = neutral, 2 = low value or empty."""
    lowered = F.lower(url)
    return (
        F.when(url.isNull() | (url == ""), 2)
        .when(lowered.rlike(any_of(high)), 0)
        .when(lowered.rlike(any_of(low)), 2)
        .otherwise(1)
    )


def is_junk(url: Column, junk_domains: Sequence[str] = JUNK_DOMAINS) -> Column:
    if not junk_domains:
        return F.lit(False)
    return F.coalesce(F.lower(url).rlike(any_of(junk_domains)), F.lit(False))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_strip_controls(F.coalesce(url, F.lit(""))), _PARTS, 2)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(_strip_controls(F.coalesce(url, F.lit(""))), _PARTS, 3)
    return F.regexp_replace(path, r";[^/]*\z", "")


def has_blocked_host(url: Column, tlds: Sequence[str] = BLOCKED_TLDS, hosts: Sequence[str] = BLOCKED_HOSTS,
                     strict_hosts: bool = False) -> Column:
    """Network location ends with a blocked suffix.

    The plain test is case-sensitive, sees the port and needs no dot before
    the suffix. ``strict_hosts`` lower-cases, drops user and port and asks for
    a whole label.
    """
    suffixes = [*tlds, *hosts]
    if not suffixes:
        return F.lit(False)
    if not strict_hosts:
        return netloc(url).rlike(any_of(suffixes, tail=True))
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*\z", ""))
    labels = [s.lstrip(".").lower() for s in suffixes]
    return F.concat(F.lit("."), host).rlike(any_of(["." + s for s in labels], tail=True))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def node_label(node_id: Column) -> Column:
    """Query nodes keep their text; URL nodes show host and path start."""
    host, path = netloc(node_id), url_path(node_id)
    return (
        F.when(node_id.startswith("QUERY:"), node_id)
        .when(_bad_netloc(host), F.left(node_id, F.lit(30)))
        .when(path != "", F.concat(host, F.left(path, F.lit(15)), F.lit("...")))
        .otherwise(host)
    )


def display_label(label: Column) -> Column:
    return F.when(F.length(label) > 35, F.concat(F.left(label, F.lit(32)), F.lit("..."))).otherwise(label)
