"""SQL spellings of the shared rules, for the check queries."""

from __future__ import annotations

from leadloom import config as C
from leadloom.config import STOP_WORDS
from leadloom.functions.patterns import any_of


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# Patterns of this file's own: it must not repeat what the implementation does.
_NOISE = r"(?is)<!--.*?-->|<svg[^>]*/>|<(?:script|style|noscript|svg|iframe|title|textarea|template)\b[^>]*>.*?</(?:script|style|noscript|svg|iframe|title|textarea|template)\s*>"
_BLOCKS = ("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
           "html li main nav ol option p pre section table tbody td tfoot th thead tr ul").split()
_CHARACTERS = (("&nbsp;", " "), ("&#160;", " "), ("&#64;", "@"), ("&#x40;", "@"), ("&commat;", "@"), ("&#46;", "."), ("&copy;", "©"),
               ("&reg;", "®"), ("&middot;", "·"), ("&euro;", "€"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&eacute;", "é"), ("&#233;", "é"),
               ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_OPEN, _SHUT = "\x02", "\x03"  # in place of <a …> and its end


def decode(expr: str) -> str:
    for entity, char in _CHARACTERS:
        expr = f"replace({expr}, {lit(entity)}, {lit(char)})"
    return expr


def remove_noise(expr: str) -> str:
    return rep(expr, _NOISE, "")


def strip_tags(expr: str) -> str:
    lines = rep(rep(expr, r"[ \t\r\n\f]+", " "), rf"(?i)</?(?:{'|'.join(_BLOCKS)})(?:\s[^>]*)?/?>", "\n")
    spaced = rep(decode(rep(lines, r"</?[A-Za-z!?][^>]*>", "")), "[ \t\u00a0]+", " ")
    return f"trim({rep(spaced, ' ?' + chr(10) + '[ ' + chr(10) + ']*', chr(10))}, {lit(' ' + chr(10))})"


def anchors(clean: str) -> str:
    """Array of 'attributes SHUT content and rest', one per opened anchor; the first element is what stands before."""
    marked = f"regexp_replace({clean}, '(?is)<a(\\s[^>]*)?>', '{_OPEN}\\1{_SHUT}', 'g')"
    return f"string_split({marked}, '{_OPEN}')"


def anchor_href(piece: str) -> str:
    quoted = f"regexp_extract(split_part({piece}, '{_SHUT}', 1), " + lit(r"""(?is)(?:^|\s)href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""") + ", 1)"
    return decode(f"trim({quoted}, {lit(chr(34) + chr(39))})")


def _content(piece: str) -> str:
    return rf"regexp_split_to_array(split_part({piece}, '{_SHUT}', 2), '(?i)</a\s*>')"


def anchor_text(piece: str) -> str:
    return rep(strip_tags(f"{_content(piece)}[1]"), r"\n+", " ")


def anchor_rest(piece: str) -> str:
    return f"array_to_string({_content(piece)}[2:], '')"


def rank(expr: str, high=C.HIGH_VALUE_WORDS, low=C.LOW_VALUE_WORDS) -> str:
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN 2 "
            f"WHEN {matches(f'lower({expr})', any_of(high))} THEN 0 "
            f"WHEN {matches(f'lower({expr})', any_of(low))} THEN 2 ELSE 1 END")


def rooted_url(base: str, href: str) -> str:
    """Absolute URL of a root-relative or absolute link, normalised."""
    joined = (f"CASE WHEN {matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN {href} "
              f"ELSE regexp_extract({base}, '^[a-z]+://[^/?#]*') || {href} END")
    return f"rtrim(regexp_replace({joined}, '#.*', ''), '/')"


def emails(expr: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({expr}, {lit(C.EMAIL_PATTERN)})))"


def clean_emails(expr: str, suffixes=C.EMAIL_IGNORED_SUFFIXES, prefixes=C.EMAIL_IGNORED_PREFIXES) -> str:
    return (f"list_filter({expr}, lambda e: NOT {matches('lower(e)', any_of(suffixes, tail=True))} "
            f"AND NOT {matches('e', any_of(prefixes, head=True))})")


def key_hash(expr: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({expr} || '|{seed}'), 1, 8))::BIGINT"


def score(tokens: str, lang: str) -> str:
    return f"len(list_filter({tokens}, lambda t: t IN {in_list(STOP_WORDS[lang])}))"


def language_cte(source: str, key: str, text: str) -> str:
    """CTE body: key, language (NULL if no stop word occurs)."""
    langs = list(STOP_WORDS)
    scores = ", ".join(f"{score('tokens', name)} AS s_{name}" for name in langs)
    best = "greatest(" + ", ".join(f"s_{n}" for n in langs) + ")"
    pick = " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in langs)
    return (f"SELECT {key}, CASE WHEN {best} = 0 THEN NULL {pick} END AS language FROM (SELECT {key}, {scores} FROM "
            f"(SELECT {key}, string_split_regex(lower({text}), {lit(r'[^\p{L}]+')}) AS tokens FROM {source}))")


def markdown_ctes(source: str, prefix: str = "md") -> str:
    """CTEs up to ``<prefix>`` (page_id, url, html, body): page text with links rewritten.

    Links in the stored pages are root-relative or absolute, which
    ``rooted_url`` covers; the browser form keeps fragment and slashes.
    """
    absolute = ("CASE WHEN " + matches("h", "^[a-zA-Z][a-zA-Z0-9+.-]*:") +
                " THEN h ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || h END")
    encode = lambda e: f"replace(replace({e}, '&', '&amp;'), '<', '&lt;')"
    return f"""
{prefix}_a AS (SELECT page_id, url, html, {anchors(remove_noise('html'))} AS pieces FROM {source}),
{prefix}_b AS (SELECT page_id, url, p, i, {anchor_text('p')} AS t, {anchor_href('p')} AS h FROM
               (SELECT page_id, url, unnest(pieces[2:]) AS p, generate_subscripts(pieces[2:], 1) AS i FROM {prefix}_a)),
{prefix}_c AS (SELECT page_id, string_agg(CASE WHEN t <> '' AND h <> '' THEN '[' || {encode('t')} || '](' || {encode(absolute)} || ')'
                      ELSE {_content('p')}[1] END || {anchor_rest('p')}, '' ORDER BY i) AS linked FROM {prefix}_b GROUP BY page_id),
{prefix} AS (SELECT a.page_id, a.url, a.html, {strip_tags("pieces[1] || coalesce(linked, '')")} AS body
             FROM {prefix}_a a LEFT JOIN {prefix}_c c ON a.page_id = c.page_id)"""


LEAD_STORE = """
lead_store AS (SELECT lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.test' AS email,
    c_mktsegment || ' Co' AS company_name, c_name AS founder_name, 'segment ' || c_mktsegment AS reason,
    c_acctbal < 2000 AS contacted, c_acctbal < 0 AS delivery_failed,
    coalesce(first_order, TIMESTAMP '1992-01-01 00:00:00') AS date_found, c_nationkey, c_custkey, c_acctbal
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey)
    ON o_custkey = c_custkey)"""
