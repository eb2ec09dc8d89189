"""License scans, in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along paths.

Every line, every paragraph (lines up to an empty one) and the whole of every text are compared
with the wordings of licence notices, headers and files. Terms are ``[a-z0-9]+`` after lower-casing; inverse document frequencies of the templates'
terms are counted over all documents, any other term weighs as one that no document has.
What to compare is found by an exact filter: of each template the commonest terms are left out as long as
they alone could not reach the threshold, so a unit without any of the rest can't either.

Of a text's units that reach the threshold the one with most weight in common with its template is the best: a whole licence outweighs
a line of it. A text whose best unit makes up most of its words, or that bears a licence file's name, is a licence file and speaks for its
directory. A text without a licence takes that of the nearest ancestor directory, found
by joining each of its ancestor paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .scratch import Scratch, table

THRESHOLD = 0.6
#: A licence file has at least this share of its terms in its best unit, or a name of this kind.
FILE_PERCENT = 50
FILE_NAME = "(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
BREAK = "\\n[\\x20\\x09-\\x0D]*\\n"
def _terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    word = ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out[word], word = out.get(word, 0) + 1, ""
    return out


VOCABULARY = sorted({w for _, t in TEMPLATES for w in _terms(t)})


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+', 0)"


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each vocabulary term; both over all rows."""
    words = F.array_intersect(F.expr(_tokens("text")), F.array(*map(F.lit, VOCABULARY)))
    found = docs.select(F.explode(words).alias("w")).groupBy("w").count().collect()
    return docs.count(), {r.w: r["count"] for r in found}


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def _needles(idf: dict[str, float]) -> list[str]:
    """Terms of which a unit must hold one to reach the threshold with any template."""
    out: set[str] = set()
    for _, text in TEMPLATES:
        weights = sorted((idf[w], w, (f * idf[w]) ** 2) for w, f in _terms(text).items())
        total, left = sum(x for *_, x in weights), 0.0
        for _, w, x in weights:
            if math.sqrt((left + x) / total) >= THRESHOLD - 1e-9:
                out.add(w)
            else:
                left += x
    return sorted(out)


def license_units(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, license, score, n_unit, n_all): each text's best unit and template; ``docs`` has key and text."""
    n, df = document_frequencies(docs)
    idf = {w: _idf(n, df.get(w, 0)) for w in VOCABULARY}
    other = _idf(n, 0)
    needles = F.array(*map(F.lit, _needles(idf)))
    near = docs.withColumn("all", F.expr(_tokens("text"))).where(F.arrays_overlap("all", needles)).select("key", F.size("all").alias("n_all"), "text")
    units = [F.expr(f"transform({part}, (x, i) -> struct({kind} AS kind, i AS i, x AS x))") for kind, part in enumerate((r"split(text, '\n', -1)", f"split(text, '{BREAK}', -1)".replace("\\", "\\\\"), "array(text)"))]
    units = near.select("key", "n_all", F.explode(F.concat(*units)).alias("u")).select("key", "n_all", "u.kind", "u.i", F.expr(_tokens("u.x")).alias("words")).where(F.arrays_overlap("words", needles))
    units = scratch.save(units.withColumn("n_unit", F.size("words")), "units", free=True)
    unit = ["key", "kind", "i", "n_all", "n_unit"]
    tf = units.select(*unit, F.explode("words").alias("w")).groupBy(*unit, "w").agg(F.count("*").alias("tf"))
    spark = docs.sparkSession
    weights = spark.createDataFrame([(w, x) for w, x in idf.items()], "w string, idf double")
    sizes = [math.sqrt(sum((f * idf[w]) ** 2 for w, f in _terms(t).items())) for _, t in TEMPLATES]
    templates = spark.createDataFrame([(i, w, f * idf[w] / sizes[i]) for i, (_, t) in enumerate(TEMPLATES) for w, f in _terms(t).items()], "template int, w string, weight double")
    # Both tables are as small as TEMPLATES.
    weighed = scratch.save(tf.join(F.broadcast(weights), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other))), "weighed", free=True)
    scratch.drop("units")
    norm = weighed.groupBy("key", "kind", "i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = weighed.join(F.broadcast(templates), "w").groupBy(*unit, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dot.join(norm, ["key", "kind", "i"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= THRESHOLD)
    best = scored.groupBy("key").agg(F.min(F.struct(F.round(-F.col("dot"), 3).alias("mass"), (-F.col("score")).alias("minus"), "kind", "i", "template", "n_unit", "n_all")).alias("b"))
    license = F.element_at(F.array(*(F.lit(name) for name, _ in TEMPLATES)), F.col("b.template") + 1)
    return best.select("key", license.alias("license"), (-F.col("b.minus")).alias("score"), "b.n_unit", "b.n_all")


def scan_licenses(docs: DataFrame, path: Column) -> DataFrame:
    """(doc_id, path, license, how, score) of every row of ``docs`` (doc_id, text, ...); ``path`` gives its place.

    ``how`` is ``file`` (a licence file), ``header`` (a notice of its own), ``inherited`` or ``none``
    (license and score null). A directory with several licence files takes the best score,
    then the first licence by name. Ties between units go to lines before paragraphs before whole texts, the first of them, then the first template. Null
    and empty texts have no line; a null path has no ancestors. Rows that repeat doc_id, path
    and text are alike. Other columns are unused, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    base = docs.select(F.col("doc_id"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    parts = [x for c in ("doc_id", "path", "text") for x in (F.col(c).isNull(), F.col(c))]
    base = base.withColumn("key", F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts[::-1]).alias("h2")))
    found = scratch.save(license_units(base.where("text IS NOT NULL").select("key", "text"), scratch), "found", free=True)
    is_file = (F.col("n_unit") * 100 >= FILE_PERCENT * F.col("n_all")) | F.coalesce(F.lower("path").rlike(FILE_NAME), F.lit(False))
    own = base.drop("text").join(found, "key", "left").withColumn("file", F.col("license").isNotNull() & is_file).drop("n_unit", "n_all")
    scratch.drop("weighed")
    own = scratch.save(own, "own", free=True)
    scratch.drop("found")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    speaks = own.where("file AND path IS NOT NULL").groupBy(parent.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    speaks = scratch.save(speaks.select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.minus")).alias("dir_score")), "speaks")
    # Each directory once, with all its ancestors; then the nearest one that speaks.
    dirs = own.where("license IS NULL AND path IS NOT NULL").select(parent.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("p")).withColumn("ancestor", F.array_join(F.slice("p", 1, F.col("depth")), "/")).drop("p").dropDuplicates(["dir", "ancestor"])
    nearest = ancestors.join(speaks.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_score"), "depth").alias("near"))
    out = own.withColumn("dir", parent).join(nearest, "dir", "left")
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    how = F.when(F.col("license").isNull(), F.when(inherited, "inherited").otherwise("none")).when(F.col("file"), "file").otherwise("header")
    return out.select("doc_id", "path", F.coalesce("license", "near.dir_license").alias("license"), how.alias("how"), F.coalesce("score", "near.dir_score").alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{w}', {f})" for i, (name, t) in enumerate(TEMPLATES) for w, f in _terms(t).items())
    return f"""
WITH tmpl(template, license, w, f) AS (VALUES {rows}),
docs AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM docs),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM tok WHERE w IN (SELECT w FROM tmpl) GROUP BY w),
idf AS (SELECT DISTINCT t.w, ln((1 + n.n) / (1.0 + coalesce(df.df, 0))) + 1 AS idf FROM tmpl t CROSS JOIN n LEFT JOIN df USING (w)),
tw AS (SELECT template, license, w, f * idf / sqrt(sum((f * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tmpl JOIN idf USING (w)),
unit AS (SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs
    UNION ALL SELECT doc_id, 1, unnest(string_split_regex(text, '{BREAK}')), generate_subscripts(string_split_regex(text, '{BREAK}'), 1) FROM docs
    UNION ALL SELECT doc_id, 2, text, 1 FROM docs),
uw AS (SELECT doc_id, kind, i, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM unit),
tf AS (SELECT doc_id, kind, i, w, count(*) AS tf FROM uw GROUP BY ALL),
x AS (SELECT doc_id, kind, i, w, tf, tf * coalesce(idf, ln(1 + n.n) + 1) AS x FROM tf CROSS JOIN n LEFT JOIN idf USING (w)),
norm AS (SELECT doc_id, kind, i, sqrt(sum(x * x)) AS norm, sum(tf) AS n_unit FROM x GROUP BY ALL),
dot AS (SELECT doc_id, kind, i, template, license, sum(x * weight) AS dot FROM x JOIN tw USING (w) GROUP BY ALL),
scored AS (SELECT *, round(dot / norm, 6) AS score FROM dot JOIN norm USING (doc_id, kind, i) WHERE round(dot / norm, 6) >= {THRESHOLD}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(-dot, 3), score DESC, kind, i, template) = 1),
alln AS (SELECT doc_id, count(*) AS n_all FROM tok GROUP BY doc_id),
own AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS dir, b.license, b.score, b.license IS NOT NULL AND (b.n_unit * 100 >= {FILE_PERCENT} * a.n_all OR regexp_matches(lower(d.path), '{FILE_NAME}')) AS file FROM docs d LEFT JOIN best b USING (doc_id) LEFT JOIN alln a USING (doc_id)),
speaks AS (SELECT dir, license, score FROM own WHERE file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (SELECT o.dir, s.license, s.score FROM (SELECT DISTINCT dir FROM own) o JOIN speaks s ON o.dir = s.dir OR starts_with(o.dir, s.dir || '/') OR s.dir = '' QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(s.dir) DESC) = 1)
SELECT doc_id, path, coalesce(o.license, near.license) AS license,
    CASE WHEN o.license IS NULL THEN CASE WHEN near.license IS NULL THEN 'none' ELSE 'inherited' END WHEN file THEN 'file' ELSE 'header' END AS how,
    coalesce(o.score, near.score) AS score
FROM own o LEFT JOIN near USING (dir)"""


SQL = _sql()
