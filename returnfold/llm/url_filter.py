"""URL verdicts from host and path rules, shared among equivalent addresses.

Pages that redirect to one address, or name one as canonical, are the same page: connected components
over these links carry a verdict to every alias. A page's own rule comes first, then an allow rule
anywhere in its component, then a block rule there; otherwise it is allowed. DataFrame functions only.

Targets are resolved against their page's address, and addresses are compared without fragment and dot
segments, with scheme and host in lower case. Every canonical link and refresh of a page counts.

Null url: host and path empty, no links, allowed. Null html: no links. Repeated rows each get a row.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

#: Fixed values of the contract: rule and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring("_rest", F.length(raw) + 1, F.length("_rest")), r"^[^?#]*", 0)
    return df.withColumn("_rest", rest).withColumn("host", F.translate(raw, UPPER, LOWER)).withColumn("path", path).drop("_rest")


def rule_of(rules: dict[str, str], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits; null if none does."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), rules[r] != "allow", r)):
        name, slash, rest = rule.partition("/")
        host_fits = (F.col(host) == name) | F.col(host).endswith("." + name)
        fits.append(F.when(host_fits & F.col(path).startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for rule lists too long for one expression: rules (rule, verdict) joined on each suffix of a host."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keyed = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start"))
    fit = urls.select("host", "path").distinct().withColumn("suffix", suffix).join(keyed, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "allow", "rule"))
    return fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


#: Named character references that addresses may hold; numeric ones are worked out.
REFERENCES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "quest": "?", "equals": "=", "num": "#", "period": ".", "percnt": "%", "lowbar": "_", "plus": "+", "commat": "@", "semi": ";", "comma": ",", "excl": "!", "lpar": "(", "rpar": ")", "nbsp": " "}
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: What a page doesn't show: comments, and what scripts and styles hold.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)"
#: A tag with its attributes; a quoted value is a unit, whatever it holds. At most 100 quoted values, so that no page exhausts a stack.
TAG = r"""(?is)<(?:link|meta|base)[\s/][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,100}+>"""
#: An attribute with a value: name and value.
ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
PIECE = r"(?s)&#[xX][0-9A-Fa-f]{1,8};?|&#[0-9]{1,9};?|&[A-Za-z]{1,12};|[^&]+|&"


def unescaped(text: Column) -> Column:
    """text without character references; those that name no character stay as they are."""
    named = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])

    def char(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9A-Fa-f]+);?$", 1)
        code = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        numeric = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(p.startswith("&#"), numeric).when(p.startswith("&"), F.try_element_at(named, F.regexp_extract(p, "^&([A-Za-z]*)", 1))), p)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), char), "")


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of this name, without quotes, references and white space around it; null if there is none."""
    names, values = (F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    value = F.get(values, (F.array_position(F.transform(names, F.lower), name) - 1).cast("int"))
    return F.regexp_replace(unescaped(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")), r"^\s+|\s+$", "")


def resolved(url: Column, to: Column) -> Column:
    """The address that to means on the page url; null if it is none."""
    root = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return (
        F.when(to.rlike(SCHEME + "//"), to).when(to.startswith("//"), F.concat(F.substring_index(url, "://", 1), F.lit(":"), to)).when(to.startswith("/"), F.concat(root, to)).when(to.startswith("?"), F.concat(root, path, to))
        .when(to.startswith("#"), bare).when(~to.rlike(SCHEME), F.concat(root, F.when(folder == "", "/").otherwise(folder), to))
    )


def comparable(url: Column) -> Column:
    """An address in the form in which addresses are compared."""
    root = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    parts = F.split(path, "/")
    up = lambda seen: F.when(F.size(seen) > 1, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen)
    step = lambda seen, x: F.when(x == ".", seen).when(x == "..", up(seen)).otherwise(F.concat(seen, F.array(x)))
    kept = F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    kept = F.when(path.rlike(r"(?s)/\.\.?$") | (kept == ""), F.concat(kept, F.lit("/"))).otherwise(kept)
    dotted = F.when(F.concat(path, F.lit("/")).rlike(r"/\.\.?/"), kept).otherwise(path)
    return F.when(root == "", url).otherwise(F.concat(F.translate(root, UPPER, LOWER), dotted, query))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url, and the form in which it is compared or that of an address it redirects to or names as canonical.

    Targets are resolved against the page's first <base href>, if it has one. Comments, scripts and styles don't count.
    """
    seen = pages.where("url like '%://%'").select("url", F.coalesce(F.regexp_extract_all(F.regexp_replace("html", UNSEEN, " "), F.lit(TAG), F.lit(0)), F.array().cast("array<string>")).alias("tags"))
    is_ = lambda tag, name: F.lower(F.substring(tag, 2, 4)) == name
    bases = F.filter(F.transform(F.filter("tags", lambda t: is_(t, "base")), lambda t: attribute(t, "href")), lambda x: x.isNotNull())
    tags = seen.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode("tags").alias("tag")).where(~is_(F.col("tag"), "base"))
    tag = F.col("tag")
    canonical = is_(tag, "link") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = is_(tag, "meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    shown = F.regexp_extract(attribute(tag, "content"), r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?(.*)$""", 1)
    to = F.when(canonical, attribute(tag, "href")).when(refresh, F.regexp_replace(shown, r"""(?s)^["']|["'].*$""", ""))
    origin = F.coalesce(F.when(F.col("base") != "", resolved(F.col("url"), F.col("base"))), F.col("url"))
    # stored, as Spark would put these expressions into each place where the next ones name them
    named = stored(stored(tags.select("url", "base", to.alias("to")), "targets").where("to <> ''").select("url", origin.alias("origin"), "to"), "origins")
    found = named.select("url", comparable(resolved(F.col("origin"), F.col("to"))).alias("b")).union(seen.select("url", comparable(resolved(F.col("url"), F.lit("#")))))
    return found.select(F.col("url").alias("a"), "b").where("b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: dict[str, str], more_links: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule and verdict; more_links: further (a, b) redirects."""
    links = page_links(pages)
    if more_links is not None:
        links = links.union(more_links.select("a", "b"))
    own = host_and_path(pages.select("page_id", "url")).withColumn("rule", rule_of(rules))
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None).cast("string")
    groups = components(links)
    said = host_and_path(groups, "node").withColumn("rule", rule_of(rules)).withColumn("said", verdict)
    shared = said.groupBy("component").agg(F.bool_or(F.col("said") == "allow").alias("allowed"), F.bool_or(F.col("said") == "block").alias("blocked"))
    shared = groups.join(shared.where("allowed or blocked"), "component").select(F.col("node").alias("url"), F.when(F.col("allowed"), "allow").otherwise("block").alias("shared"))
    return own.join(shared, "url", "left").select("page_id", "host", "path", "rule", F.coalesce(verdict, "shared", F.lit("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every url of pages judged by RULES."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


ORACLE = {
    "op10_url_filter": r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html FROM pages
), tags AS (
  SELECT url, html_id, unnest(list_zip(ts, range(len(ts)))) AS z FROM (SELECT *, regexp_extract_all(seen, '(?is)<(?:link|meta|base)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS ts FROM (
    SELECT url, row_number() OVER () AS html_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|$)', ' ', 'g'), '(?is)<(?:script\b.*?(?:</script\s*>|$)|style\b.*?(?:</style\s*>|$)|template\b.*?(?:</template\s*>|$))', ' ', 'g') AS seen FROM p WHERE url LIKE '%://%'))
), cells AS (
  SELECT url, html_id, tag_id, kind, c[1] AS name, c[2] AS quoted, c[3] AS nth FROM (
    SELECT url, html_id, z[2] AS tag_id, lower(z[1][2:5]) AS kind, unnest(list_zip(regexp_extract_all(z[1], @ATTRIBUTE, 1), regexp_extract_all(z[1], @ATTRIBUTE, 2), range(len(regexp_extract_all(z[1], @ATTRIBUTE, 1))))) AS c FROM tags)
), valued AS (
  SELECT url, html_id, tag_id, kind, lower(name) AS name, nth, array_to_string(list_transform(regexp_extract_all(CASE WHEN quoted[1] IN ('"', '''') THEN quoted[2:-2] ELSE quoted END, '(?s)&#[xX][0-9A-Fa-f]{1,8};?|&#[0-9]{1,9};?|&[A-Za-z]{1,12};|[^&]+|&'),
    lambda x: CASE WHEN x[1] <> '&' OR x = '&' THEN x WHEN x[2] <> '#' THEN coalesce(@NAMED[rtrim(x[2:], ';')], x)
      ELSE CASE WHEN (CASE WHEN lower(x[3]) = 'x' THEN ('0x' || rtrim(x[4:], ';'))::BIGINT ELSE rtrim(x[3:], ';')::BIGINT END) BETWEEN 1 AND 55295 OR (CASE WHEN lower(x[3]) = 'x' THEN ('0x' || rtrim(x[4:], ';'))::BIGINT ELSE rtrim(x[3:], ';')::BIGINT END) BETWEEN 57344 AND 1114111 THEN chr((CASE WHEN lower(x[3]) = 'x' THEN ('0x' || rtrim(x[4:], ';'))::BIGINT ELSE rtrim(x[3:], ';')::BIGINT END)::INT) ELSE x END END), '') AS value FROM cells
), tagged AS (
  SELECT url, html_id, tag_id, any_value(kind) AS kind, arg_min(trim(value, @SPACE), nth) FILTER (name = 'href') AS href, arg_min(trim(value, @SPACE), nth) FILTER (name = 'rel') AS rel,
    arg_min(trim(value, @SPACE), nth) FILTER (name = 'http-equiv') AS equiv, arg_min(trim(value, @SPACE), nth) FILTER (name = 'content') AS content FROM valued GROUP BY 1, 2, 3
), based AS (
  SELECT *, first_value(CASE WHEN kind = 'base' THEN href END IGNORE NULLS) OVER (PARTITION BY html_id ORDER BY tag_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM tagged
), aimed AS (
  SELECT url AS page, base, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN regexp_replace(regexp_extract(content, '(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?(.*)$', 1), '(?s)^["'']|["''].*$', '', 'g') END AS dest FROM based
), origins AS (
  SELECT page, dest, CASE WHEN coalesce(base, '') = '' THEN page WHEN regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN base WHEN starts_with(base, '//') THEN split_part(page, '://', 1) || ':' || base
    WHEN starts_with(base, '/') THEN regexp_extract(page, '^[^/?#]*://[^/?#]*') || base WHEN regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN page
    ELSE regexp_extract(page, '^[^/?#]*://[^/?#]*') || coalesce(nullif(regexp_extract(regexp_extract(page, '(?s)^[^/?#]*://[^/?#]*([^?#]*)', 1), '(?s)^.*/'), ''), '/') || base END AS url FROM aimed WHERE dest <> ''
  UNION ALL SELECT url, '#', url FROM p WHERE url LIKE '%://%'
), named AS (
  SELECT page, url, dest, regexp_extract(url, '^[^/?#]*://[^/?#]*') AS root, regexp_extract(url, '(?s)^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path FROM origins
), full_links AS (
  SELECT page AS a, CASE WHEN regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN dest WHEN starts_with(dest, '//') THEN split_part(url, '://', 1) || ':' || dest
    WHEN starts_with(dest, '/') THEN root || dest WHEN starts_with(dest, '?') THEN root || path || dest WHEN starts_with(dest, '#') THEN regexp_replace(url, '(?s)#.*$', '')
    WHEN NOT regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN root || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^.*/') ELSE '/' END || dest END AS b
  FROM named
), cut AS (
  SELECT a, b, regexp_extract(b, '^[^/?#]*://[^/?#]*') AS root, regexp_extract(b, '(?s)^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(b, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM full_links WHERE b IS NOT NULL
), straight AS (
  SELECT *, list_reduce(list_transform(string_split(path, '/'), lambda x: [x]),
      lambda seen, x: CASE WHEN x[1] = '.' THEN seen WHEN x[1] = '..' AND len(seen) > 1 THEN seen[:-2] WHEN x[1] = '..' THEN seen ELSE list_concat(seen, x) END) AS parts
  FROM cut
), links AS (
  SELECT a, CASE WHEN root = '' THEN b ELSE translate(root, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_matches(path || '/', '/\.\.?/') THEN coalesce(nullif(array_to_string(parts, '/') || CASE WHEN regexp_matches(path, '(?s)/\.\.?$') THEN '/' ELSE '' END, ''), '/') ELSE path END || query END AS b
  FROM straight
), two AS (
  SELECT a, b FROM links WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM links WHERE b IS NOT NULL AND a <> b
), reach(a, b) AS (
  SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a
), urls AS (
  SELECT DISTINCT url FROM p UNION SELECT b FROM two
), parts AS (
  SELECT url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM urls
), hosts AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*')) + 1 :], '^[^?#]*') AS path FROM parts
), rules(rule, said, rhost, rpath) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), own AS (
  SELECT h.url, any_value(h.host) AS host, any_value(h.path) AS path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.said, length(r.rule)) AS said
  FROM hosts h LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
  GROUP BY h.url
), shared AS (
  SELECT r.a AS url, bool_or(o.said = 'allow') AS allowed, bool_or(o.said = 'block') AS blocked
  FROM reach r JOIN own o ON o.url = r.b GROUP BY r.a
)
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule,
  coalesce(o.said, CASE WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own o ON o.url = p.url LEFT JOIN shared s ON s.url = p.url
""".replace("@ATTRIBUTE", r"""'(?s)([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'""")
    .replace("@NAMED", "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in REFERENCES.items()) + "}")
    .replace("@SPACE", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")
}
