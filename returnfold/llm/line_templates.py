"""Line dedup by a log-template tree, in DataFrame functions alone.

A line's tokens are its words, those with a digit shown as "<*>". The tree has a fixed depth: number
of tokens, then the first LEAD tokens; a leaf holds the lines that agree in these. First, each line is
its own template. Then, of the lines that do not recur as they are, a leaf's tokens that stand often at
their place (in LEAST_DOCS lines, and in one of PLACES lines) are fixed and all others become "<*>";
lines that agree in this, with a share of SHARE fixed tokens or more, have one template, so a leaf may
hold several.

A template recurs if LEAST_DOCS documents or more have it, in as many different settings, none of them
that of more than half the documents. A line's setting is the number of lines of its document, the
document's length in steps of STEP characters, and the numbers of tokens of the line before and of the
line after. Copies of one document share their settings, whatever their number, and so don't count as
recurrence. Lines of recurring templates are dropped wherever they stand.

A null text stays null; empty and blank lines stay. A document left with nothing but blank lines, that
had more, is marked empty. Rows with the same doc_id and text count as one document, and each is
returned; rows that share a doc_id alone keep apart. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LEAD, LEAST_DOCS, STEP, SHARE, PLACES = 4, 5, 64, 0.6, 16
BLANKS = "[ \\t\\r\\f]+"


def template_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, line, n, leaf, shape, around) of each line with tokens: these, masked, and their number.

    h is a hash of the text, so that rows sharing a doc_id keep apart; leaf is a hash too. shape and
    around are the two halves of a line's setting, that of its document and that of its neighbours.
    """
    text, lines = F.col("text"), F.split("text", "\n")
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f")
    plain = F.when(odd, F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))).otherwise(F.transform(lines, lambda x: F.trim(x)))  # the cheap way for most texts
    mask = lambda x: F.when(x.rlike("[0-9]"), F.array_join(F.transform(F.split(x, " "), lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t)), " ")).otherwise(x)
    shape = F.xxhash64(F.size(lines), F.floor(F.length("text") / STEP)).alias("shape")
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), shape, F.when(text.rlike("[0-9]"), F.transform(plain, mask)).otherwise(plain).alias("lines"))
    counted = lines.withColumn("n", F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)))
    none, many = F.array(F.lit(-1)), F.size("n") - 1
    around = counted.withColumns({"before": F.concat(none, F.slice("n", 1, many)), "after": F.concat(F.slice("n", 2, many), none)})
    each = around.select("doc_id", "h", "shape", F.posexplode(F.arrays_zip("lines", "n", "before", "after")).alias("pos", "of")).where("of.n > 0")
    leaf = F.xxhash64("of.n", F.substring_index("of.lines", " ", LEAD))
    return each.select("doc_id", "h", "pos", F.col("of.lines").alias("line"), F.col("of.n").alias("n"), leaf.alias("leaf"), "shape", ((F.col("of.before") + 1).cast("long") * (1 << 32) + F.col("of.after") + 1).alias("around"))


def hashes(text) -> dict:
    """Two hashes that stand for a line or template."""
    return {"k": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def recurrence(rows: DataFrame, key: list[str]) -> DataFrame:
    """key with times, the number of lines, and recurs; rows has key, doc_id, h, shape and around.

    A line that a document holds several times counts once, with the least of its neighbours.
    """
    once = rows.groupBy(*key, "doc_id", "h").agg(F.min("shape").alias("shape"), F.min("around").alias("around"), F.count("*").alias("times"))
    settings = once.groupBy(*key, "shape", "around").agg(F.count("*").alias("docs"), F.sum("times").alias("times"))
    whole = settings.groupBy(*key).agg(F.sum("docs").alias("docs"), F.count("*").alias("settings"), F.max("docs").alias("most"), F.sum("times").alias("times"))
    return whole.select(*key, "times", F.expr(f"docs >= {LEAST_DOCS} and settings >= {LEAST_DOCS} and most * 2 <= docs").alias("recurs"))


def frequent_tokens(rows: DataFrame) -> DataFrame:
    """(n, leaf, often): for each place of a leaf's lines its frequent tokens, at most PLACES of them; rows has n, leaf, total and line."""
    token = rows.select("n", "leaf", "total", F.posexplode(F.split("line", " ")).alias("at", "token"))
    each = token.groupBy("n", "leaf", "total", "at", "token").agg(F.count("*").alias("times"))
    often = F.when((F.col("times") >= LEAST_DOCS) & (F.col("times") * PLACES >= F.col("total")), F.col("token"))
    places = each.groupBy("n", "leaf", "at").agg(F.collect_list(often).alias("tokens"))
    return places.groupBy("n", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("often"))


def drop_templates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with lines of recurring templates taken out of text, and n_lines, n_dropped and emptied.

    Lines are told apart by two hashes; only those in leaves with several different lines move as text.
    Columns of docs by the names of the new ones come twice.
    """
    names = docs.columns
    own = docs.toDF(*(c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(names)))
    lines, place = template_lines(own.select("doc_id", "text")), ["doc_id", "h", "pos"]
    hashed = stored(lines.withColumns(hashes(F.col("line"))).drop("line"), "lines")
    known = stored(recurrence(hashed, ["n", "leaf", "k", "k2"]), "templates")
    exact = stored(known.where("recurs").select("k", "k2"), "exact")
    leaves = known.where("not recurs").groupBy("n", "leaf").agg(F.sum("times").alias("total"), F.count("*").alias("kinds")).where(f"total >= {LEAST_DOCS} and kinds > 1")
    leaves = stored(leaves.select("n", "leaf", "total"), "leaves")
    mixed = stored(lines.join(leaves, ["n", "leaf"]).withColumns(hashes(F.col("line"))).join(exact, ["k", "k2"], "left_anti").drop("k", "k2"), "mixed")
    often = stored(frequent_tokens(mixed), "often")
    shown = F.transform(F.split("line", " "), lambda t, i: F.when(F.array_contains(F.get("often", i)["tokens"], t), t).otherwise("<*>"))
    fixed = F.size(F.filter("shown", lambda t: t != "<*>"))
    varied = mixed.join(often, ["n", "leaf"]).select(*place, "n", "leaf", "shape", "around", shown.alias("shown")).where(fixed.between(F.lit(SHARE) * F.col("n"), F.col("n") - 1))
    varied = stored(varied.withColumns(hashes(F.array_join("shown", " "))).drop("shown"), "varied")
    loose = stored(recurrence(varied, ["n", "leaf", "k", "k2"]).where("recurs").select("n", "leaf", "k", "k2"), "loose")
    gone = hashed.join(exact, ["k", "k2"], "left_semi").select(*place).union(varied.join(loose, ["n", "leaf", "k", "k2"], "left_semi").select(*place))
    gone = gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("_gone"))
    parts = F.split("text", "\n")
    marked = own.withColumn("_h", F.xxhash64("text")).join(gone.toDF("_d", "_g", "_gone"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left")
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    n = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    out = marked.withColumns({"_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), "_dropped": n, "text": kept})
    out = out.withColumn("_emptied", (F.col("_dropped") > 0) & (F.trim(F.regexp_replace("text", "[ \\t\\r\\f\\n]+", " ")) == ""))
    return out.select(*own.columns, "_lines", "_dropped", "_emptied").toDF(*names, "n_lines", "n_dropped", "emptied")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents without the lines of recurring templates."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return drop_templates(docs).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = {
    "op7_line_templates": r"""
WITH docs AS (
  SELECT doc_id, text, row_number() OVER () AS rid FROM documents
), raw AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
    len(string_split(text, chr(10))) AS lines, length(text) // 64 AS steps
  FROM docs WHERE text IS NOT NULL
), plain AS (
  SELECT rid, pos, lines, steps, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) AS line FROM raw
), masked AS (
  SELECT rid, pos, lines, steps, array_to_string(list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS line FROM plain
), sized AS (
  SELECT *, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n FROM masked
), around AS (
  SELECT *, (lines, steps) AS shape, (coalesce(lag(n) OVER w, -1), coalesce(lead(n) OVER w, -1)) AS around FROM sized WINDOW w AS (PARTITION BY rid ORDER BY pos)
), tree AS (
  SELECT rid, pos, line, n, shape, around, array_to_string(string_split(line, ' ')[1:4], ' ') AS leaf FROM around WHERE n > 0
), once AS (
  SELECT line, rid, shape, min(around) AS around FROM tree GROUP BY ALL
), exact AS (
  SELECT line FROM (SELECT line, shape, around, count(*) AS docs FROM once GROUP BY ALL)
  GROUP BY line HAVING sum(docs) >= 5 AND count(*) >= 5 AND 2 * max(docs) <= sum(docs)
), others AS (
  SELECT * FROM tree ANTI JOIN exact USING (line)
), leaves AS (
  SELECT n, leaf, count(*) AS total FROM others GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT line) > 1
), tokens AS (
  SELECT o.rid, o.pos, o.n, o.leaf, l.total, unnest(string_split(o.line, ' ')) AS token, generate_subscripts(string_split(o.line, ' '), 1) AS place
  FROM others o JOIN leaves l USING (n, leaf)
), often AS (
  SELECT n, leaf, place, token FROM tokens GROUP BY n, leaf, place, token, total HAVING count(*) >= 5 AND count(*) * 16 >= total
), shown AS (
  SELECT t.rid, t.pos, t.n, t.leaf, string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY t.place) AS line, count(*) FILTER (coalesce(f.token, '<*>') <> '<*>') AS fixed
  FROM tokens t LEFT JOIN often f USING (n, leaf, place, token) GROUP BY t.rid, t.pos, t.n, t.leaf
), varied AS (
  SELECT s.rid, s.pos, s.n, s.leaf, s.line, t.shape, t.around FROM shown s JOIN tree t USING (rid, pos) WHERE s.fixed >= 0.6 * s.n AND s.fixed < s.n
), varied_once AS (
  SELECT n, leaf, line, rid, shape, min(around) AS around FROM varied GROUP BY ALL
), loose AS (
  SELECT n, leaf, line FROM (SELECT n, leaf, line, shape, around, count(*) AS docs FROM varied_once GROUP BY ALL)
  GROUP BY ALL HAVING sum(docs) >= 5 AND count(*) >= 5 AND 2 * max(docs) <= sum(docs)
), gone AS (
  SELECT rid, pos FROM tree SEMI JOIN exact USING (line) UNION SELECT rid, pos FROM varied SEMI JOIN loose USING (n, leaf, line)
), kept AS (
  SELECT r.rid, string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM raw r LEFT JOIN gone g ON r.rid = g.rid AND r.pos = g.pos GROUP BY r.rid
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM docs d LEFT JOIN kept k USING (rid)
"""
}
