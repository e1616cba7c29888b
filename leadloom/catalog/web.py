"""URLs and pages: links, text, e-mails, language, observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.catalog import sql as S
from leadloom.catalog.registry import query
from leadloom.config import EMAIL_HEADER_PREFIX, EMAIL_HEADER_SUFFIX, HuntConfig
from leadloom.functions import context, html as H, language, urls
from leadloom.functions.patterns import any_of
from leadloom.operators import language_model as M
from leadloom.operators import leads as L, pages as P
from leadloom.sources.tables import fetch_pages, read_for_parsing, read_table

# Word lists for the stored pages, whose words are invented.
HIGH, LOW = ("/the", "/and", "/of"), ("/in", "/nicht")
JUNK = ("spam-farm", "cheap-pills")
SUFFIXES = (".png", "mail1.example.com", "mail5.example.com")


@query("page_scan", """
SELECT page_id, url, md5(html) AS html_md5 FROM pages
WHERE url IN (SELECT url FROM pages WHERE contains(url, '?'))""")
def page_scan(spark, sf):
    pages = read_table(spark, sf, "pages")
    requests = pages.where(F.col("url").contains("?")).select("url")
    return fetch_pages(requests, pages).select("page_id", "url", F.md5("html").alias("html_md5"))


_TARGETS = [
    "'about/#contact-section'", "'contact.html'", "'../z/./w'", "'//b.org/p/'", "'?p=2'", "'mailto:i@a.com'",
    "'HTTPS://B.com/Q'", "'../../../..'", "'   '", "'http://[bad'", "''", "'#top'", "'/a//b/../c?d=/#f'",
    "url", "'https:'", "concat('/p/', page_id, '/')", "concat('./d//', page_id, '/..')", "'javascript:void(0)'",
]
_RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


@query("url_normalize", rf"""
WITH v AS (SELECT page_id, url AS base, unnest([{', '.join(_TARGETS)}]) AS target,
                  unnest(range({len(_TARGETS)})) AS variant FROM pages),
p AS (SELECT *, regexp_replace(target, '^[\x00-\x20]+', '') AS t FROM v),
q AS (SELECT *, lower(regexp_extract(t, {S.lit(_RFC)}, 1)) AS ts, regexp_extract(t, {S.lit(_RFC)}, 2) AS tn,
        regexp_extract(t, {S.lit(_RFC)}, 3) AS tp, regexp_extract(t, {S.lit(_RFC)}, 4) AS tq,
        lower(regexp_extract(base, {S.lit(_RFC)}, 1)) AS bs, regexp_extract(base, {S.lit(_RFC)}, 2) AS bn,
        regexp_extract(base, {S.lit(_RFC)}, 3) AS bp, regexp_extract(base, {S.lit(_RFC)}, 4) AS bq FROM p),
m AS (SELECT *, CASE WHEN tp LIKE '/%' THEN tp ELSE regexp_replace(
        (CASE WHEN bp = '' THEN '/' ELSE regexp_extract(bp, '^(.*/)', 1) END) || tp, '/+', '/', 'g') END AS merged FROM q),
d AS (SELECT *, string_split(merged, '/') AS segs FROM m),
r AS (SELECT *, list_reduce(list_transform(segs, lambda s: [s]), lambda a, x:
          CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN x[1] = '.' THEN a ELSE a || x END,
          CAST([] AS VARCHAR[])) AS kept FROM d),
j AS (SELECT *, CASE WHEN array_to_string(kept, '/') || (CASE WHEN segs[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END)
                 = '' THEN '/' ELSE array_to_string(kept, '/') ||
                 (CASE WHEN segs[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END) END AS path FROM r),
o AS (SELECT page_id, variant, target, CASE
    WHEN target = '' OR contains(tn, '[') <> contains(tn, ']') THEN ''
    WHEN ts <> '' AND ts <> bs THEN regexp_replace(target, '#.*', '')
    WHEN tn <> '' THEN bs || '://' || tn || tp || (CASE WHEN tq <> '' THEN '?' || tq ELSE '' END)
    WHEN tp = '' THEN bs || '://' || bn || bp || (CASE WHEN tq <> '' THEN '?' || tq WHEN bq <> '' THEN '?' || bq ELSE '' END)
    ELSE bs || '://' || bn || (CASE WHEN path LIKE '/%' THEN '' ELSE '/' END) || path ||
         (CASE WHEN tq <> '' THEN '?' || tq ELSE '' END) END AS joined FROM j)
SELECT page_id, CAST(variant AS BIGINT) AS variant, target, rtrim(joined, '/') AS url FROM o""")
def url_normalize(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    targets = F.expr(f"array({', '.join(_TARGETS)})")
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(targets).alias("variant", "target"))
    return urls.with_normalized_url(rows, "base", "target", "url").select(
        "page_id", F.col("variant").cast("bigint").alias("variant"), "target", "url")


_SUFFIX = "['', '/About-Us', '/blog/2023', '/team/blog', '/TAGS']"


@query("url_rank", f"""
SELECT page_id, url, CAST({S.rank('url')} AS BIGINT) AS link_rank
FROM (SELECT page_id, url || unnest({_SUFFIX}) AS url FROM pages UNION ALL SELECT page_id, '' FROM pages)""")
def url_rank(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    rows = pages.select("page_id", F.explode(F.expr(
        "array('', url, url || '/About-Us', url || '/blog/2023', url || '/team/blog', url || '/TAGS')")).alias("url"))
    return rows.withColumn("link_rank", urls.rank_url(F.col("url")).cast("bigint"))


@query("junk_filter", f"SELECT page_id, url FROM pages WHERE NOT {S.matches('lower(url)', any_of(JUNK))}")
def junk_filter(spark, sf):
    return read_table(spark, sf, "pages", ["page_id", "url"]).where(~urls.is_junk(F.col("url"), JUNK))


_NETLOC = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


@query("host_blocklist", f"""
WITH v AS (SELECT page_id, unnest([url, upper(url), regexp_replace(url, '^([a-z]+://[^/]*)', '\\1:8080')]) AS url FROM pages),
n AS (SELECT page_id, url, regexp_extract(url, '{_NETLOC}', 1) AS host FROM v)
SELECT page_id, url, {S.matches('host', any_of(('.org', 'tion.example.net'), tail=True))} AS blocked,
       {S.matches("'.' || lower(regexp_replace(host, ':[0-9]*$', ''))", any_of(('.org', '.tion.example.net'), tail=True))}
         AS blocked_strict FROM n""")
def host_blocklist(spark, sf):
    rows = read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", F.explode(F.array(
        F.col("url"), F.upper("url"), F.regexp_replace("url", "^([a-z]+://[^/]*)", "$1:8080"))).alias("url"))
    lists = ((".org",), ("tion.example.net",))
    return rows.withColumns({
        "blocked": urls.has_blocked_host(F.col("url"), *lists),
        "blocked_strict": urls.has_blocked_host(F.col("url"), *lists, strict_hosts=True)})


@query("url_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(spark, sf):
    return read_table(spark, sf, "pages", ["page_id", "url"]).select(
        "page_id", urls.url_hash(F.col("url")).alias("url_hash"))


_ESCAPED = """replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
 '''', '&#x27;')"""


@query("node_label", f"""
WITH n AS (SELECT page_id, unnest([url, 'QUERY: "' || url || '"', regexp_extract(url, '^[a-z]+://[^/]*')]) AS node_id,
                  CASE WHEN contains(url, '?') THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title
           FROM pages),
p AS (SELECT *, regexp_extract(node_id, '{_NETLOC}', 1) AS host,
             regexp_extract(node_id, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM n),
l AS (SELECT *, CASE WHEN starts_with(node_id, 'QUERY:') THEN node_id WHEN path <> '' THEN host || left(path, 15) || '...'
                ELSE host END AS label FROM p)
SELECT page_id, node_id, label, CASE WHEN length(label) > 35 THEN left(label, 32) || '...' ELSE label END AS display_label,
       CASE WHEN title = '' THEN node_id ELSE {_ESCAPED} END AS tooltip FROM l""")
def node_label(spark, sf):
    from leadloom.operators.graph import tooltip

    rows = read_table(spark, sf, "pages").select(
        "page_id", F.explode(F.expr("array(url, 'QUERY: \"' || url || '\"', regexp_extract(url, '^[a-z]+://[^/]*', 0))"))
        .alias("node_id"),
        F.when(F.col("url").contains("?"), "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
        .alias("title"))
    label = urls.node_label(F.col("node_id"))
    return rows.select("page_id", "node_id", label.alias("label"), urls.display_label(label).alias("display_label"),
                       tooltip(F.col("title"), F.col("node_id")).alias("tooltip"))


@query("html_text", f"SELECT page_id, {S.strip_tags(S.remove_noise('html'))} AS text FROM pages")
def html_text(spark, sf):
    pages = read_for_parsing(spark, sf, "pages", ["page_id", "html"])
    return pages.select("page_id", H.html_text(F.col("html")).alias("text"))


@query("link_markdown", f"WITH {S.markdown_ctes('pages')} SELECT page_id, body AS text FROM md")
def link_markdown(spark, sf):
    return P.page_text(read_for_parsing(spark, sf, "pages")).select("page_id", F.col("body").alias("text"))


LINKS_SQL = f"""
raw_links AS (SELECT page_id, page_url, i - 1 AS pos, {S.anchor_href('f')} AS href, {S.anchor_text('f')} AS link_text
  FROM (SELECT page_id, page_url, unnest(found[2:]) AS f, generate_subscripts(found[2:], 1) AS i
        FROM (SELECT page_id, url AS page_url, {S.anchors(S.remove_noise('html'))} AS found FROM pages))),
links AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, href, link_text, {S.rooted_url('page_url', 'href')} AS url
          FROM raw_links WHERE href <> '')"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href, link_text, url FROM links")
def page_links(spark, sf):
    return P.page_links(read_for_parsing(spark, sf, "pages")).select("page_id", "pos", "href", "link_text", "url")


@query("top_links", f"""
WITH {LINKS_SQL},
ranked AS (SELECT DISTINCT page_id, url, {S.rank('url', HIGH, LOW)} AS link_rank FROM links)
SELECT page_id, url, CAST(link_rank AS BIGINT) AS link_rank, leaf FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link_rank, url) AS leaf FROM ranked) WHERE leaf <= 4""")
def top_links(spark, sf):
    best = P.top_links(P.page_links(read_for_parsing(spark, sf, "pages")), max_leafs=4, high=HIGH, low=LOW)
    return best.select("page_id", "url", F.col("link_rank").cast("bigint").alias("link_rank"),
                       F.col("leaf").cast("bigint").alias("leaf"))


@query("page_emails", f"""
SELECT source, id, array_to_string(emails, ',') AS emails, CAST(len(emails) AS BIGINT) AS n_emails FROM (
  SELECT 'page' AS source, page_id AS id, {S.emails('html')} AS emails FROM pages
  UNION ALL SELECT 'document', doc_id, {S.emails('text')} FROM documents)""")
def page_emails(spark, sf):
    texts = read_for_parsing(spark, sf, "pages", ["page_id", "html"]).select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), "html").unionByName(
        read_for_parsing(spark, sf, "documents", ["doc_id", "text"]).select(
            F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("html")))
    found = texts.select("source", "id", H.all_emails(F.col("html")).alias("e"))
    return found.select("source", "id", F.array_join("e", ",").alias("emails"), F.size("e").cast("bigint").alias("n_emails"))


@query("clean_emails", f"""
SELECT doc_id, array_to_string({S.clean_emails('e', SUFFIXES)}, ',') AS emails,
       array_to_string({S.clean_emails('e')}, ',') AS strict_emails
FROM (SELECT doc_id, {S.emails("text || ' u00a@x.test 12345b@x.test ok@x.test a@b.PNG'")} AS e FROM documents)""")
def clean_emails(spark, sf):
    found = H.all_emails(F.concat("text", F.lit(" u00a@x.test 12345b@x.test ok@x.test a@b.PNG")))
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", found.alias("e"))
    return docs.select("doc_id", F.array_join(H.clean_emails(F.col("e"), SUFFIXES), ",").alias("emails"),
                       F.array_join(H.clean_emails(F.col("e")), ",").alias("strict_emails"))


@query("language_guard", f"""
WITH l AS ({S.language_cte('documents', 'doc_id, lang', 'text')})
SELECT doc_id, coalesce(language, 'unknown') AS language, coalesce(language = 'en', true) AS kept,
       coalesce(language = lang, false) AS agrees FROM l""")
def language_guard(spark, sf):
    docs = read_for_parsing(spark, sf, "documents", ["doc_id", "text", "lang"]).select(
        "doc_id", "lang", language.detect_language(F.col("text")).alias("language"))
    return docs.select("doc_id", F.coalesce("language", F.lit("unknown")).alias("language"),
                       language.passes_language_guard(F.col("language")).alias("kept"),
                       F.coalesce(F.col("language") == F.col("lang"), F.lit(False)).alias("agrees"))


@query("language_detect", r"""
WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
c AS (SELECT doc_id, lang, word, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, n, substr('_' || word || '_', i, 3) AS gram
      FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM c)),
p AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM g WHERE lang IS NOT NULL GROUP BY lang, gram),
v AS (SELECT count(DISTINCT gram) AS v FROM p),
t AS (SELECT lang, sum(n)::BIGINT AS total FROM p GROUP BY lang),
k AS (SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM p) WHERE place <= 3000),
d AS (SELECT doc_id, gram, sum(n)::BIGINT AS n FROM g GROUP BY doc_id, gram),
s AS (SELECT doc_id, t.lang, sum(d.n * round(1000 * ln((coalesce(k.n, 0) + 1) / (total + v)))::BIGINT) AS score, sum(d.n)::BIGINT AS n_grams
      FROM d CROSS JOIN t CROSS JOIN v LEFT JOIN k ON k.lang = t.lang AND k.gram = d.gram GROUP BY doc_id, t.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS place FROM s) WHERE place = 1)
SELECT documents.doc_id, b.lang AS language, coalesce(n_grams, 0) AS n_grams FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id""")
def language_detect(spark, sf):
    """Profiles of the labelled documents, and the language that they give every document."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"])
    return M.detect_languages(docs, M.fit_languages(docs))


OBSERVED_SQL = f"""{S.markdown_ctes('pages')},
guard AS ({S.language_cte('md', 'page_id', 'body')}),
observed AS (SELECT md.page_id, url, language, {S.clean_emails(S.emails('html'), SUFFIXES)} AS emails,
    CASE WHEN trim(body) = '' THEN 'blank' WHEN NOT coalesce(language = 'en', true) THEN 'other_language' ELSE 'ok' END AS status,
    body FROM md JOIN guard ON md.page_id = guard.page_id)"""


@query("page_observation", f"""
WITH {OBSERVED_SQL}
SELECT page_id, status, coalesce(language, 'unknown') AS language, CAST(len(emails) AS BIGINT) AS n_emails,
  CASE WHEN status = 'ok' THEN left(CASE WHEN len(emails) > 0 THEN {S.lit(EMAIL_HEADER_PREFIX)} || array_to_string(emails, ', ')
       || {S.lit(EMAIL_HEADER_SUFFIX)} || body ELSE body END, 16000) ELSE '' END AS text FROM observed""")
def page_observation(spark, sf):
    seen = P.observations(read_for_parsing(spark, sf, "pages"), HuntConfig(), SUFFIXES)
    return seen.select("page_id", "status", F.coalesce("language", F.lit("unknown")).alias("language"),
                       F.size("emails").cast("bigint").alias("n_emails"), "text")


@query("path_context", r"""
WITH l AS (SELECT page_id, '[0] ' || regexp_extract(url, '^[a-z]+://[^/]*') || chr(10) || '[1] ' || url || ' -> [Note: page '
                  || page_id || ']' || chr(10) || '[2] ' || url || '/team' AS path FROM pages)
SELECT page_id, right(path, 60) AS last_60, path AS whole FROM l""")
def path_context(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    ledger = F.array(F.concat(F.lit("[0] "), F.regexp_extract("url", "^[a-z]+://[^/]*", 0)))
    ledger = context.add_to_ledger(ledger, F.lit(1), F.col("url"))
    ledger = context.annotate_last(ledger, F.concat(F.lit("page "), F.col("page_id").cast("string")))
    ledger = context.add_to_ledger(ledger, F.lit(2), F.concat("url", F.lit("/team")))
    rows = pages.select("page_id", ledger.alias("ledger"))
    return rows.select("page_id", context.path_context(F.col("ledger"), 60).alias("last_60"),
                       context.path_context(F.col("ledger"), 0).alias("whole"))


@query("prompt_build", r"""
SELECT doc_id, '<context>' || chr(10) || 'profile of ' || source || chr(10) || '</context>' || chr(10) ||
  '<context>' || chr(10) || 'find ' || lang || chr(10) || '</context>' || chr(10) || 'March 2026' || chr(10) ||
  '<scratchpad>' || chr(10) || '[0] https://' || source || '.test/' || doc_id || chr(10) || '</scratchpad>' || chr(10) ||
  'https://' || source || '.test/' || doc_id || chr(10) ||
  '<document>' || chr(10) || text || chr(10) || '</document>' AS prompt FROM documents""")
def prompt_build(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    url = F.concat(F.lit("https://"), "source", F.lit(".test/"), F.col("doc_id").cast("string"))
    memory = context.path_context(context.add_to_ledger(F.array().cast("array<string>"), F.lit(0), url), 10_000)
    return docs.select("doc_id", context.evaluation_prompt(
        F.concat(F.lit("profile of "), "source"), F.concat(F.lit("find "), "lang"), F.to_date(F.lit("2026-03-15")),
        memory, url, F.col("text")).alias("prompt"))


@query("unvisited_urls", """
WITH visited AS (SELECT DISTINCT sha256(url) AS url_hash FROM pages WHERE contains(url, '?'))
SELECT page_id, url FROM pages WHERE sha256(url) NOT IN (SELECT url_hash FROM visited)""")
def unvisited_urls(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"]).withColumn("url_hash", urls.url_hash(F.col("url")))
    visited = pages.where(F.col("url").contains("?")).select("url_hash").distinct()
    return L.unvisited(pages, visited).select("page_id", "url")


@query("visited_append", f"""
WITH {LINKS_SQL},
visited AS (SELECT DISTINCT url FROM links WHERE link_text LIKE '%the%')
SELECT DISTINCT sha256(url) AS url_hash, url, TIMESTAMP '2026-03-15 00:00:00' AS visited_at FROM links
WHERE url NOT IN (SELECT url FROM visited)""")
def visited_append(spark, sf):
    links = P.page_links(read_for_parsing(spark, sf, "pages"))
    visited = links.where(F.col("link_text").contains("the")).select(urls.url_hash(F.col("url")).alias("url_hash")).distinct()
    return L.new_visited_rows(links.select("url"), visited, F.expr("TIMESTAMP_NTZ '2026-03-15 00:00:00'"))
