"""Queries of the problems tagged llm, and SQL where it can state them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import abuse, docpairs, handwritten, hnsw, mixing, packing, syntax, termfreq
from weftgraph.sources.tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "code_nodes").select("project_id", "id", "scanned_at", "modifiers", F.col("annotations.name").alias("names"))
    return termfreq.mark(termfreq.term_counts(nodes, ["project_id", "id"], ["scanned_at"], {"annotation": F.col("names"), "modifier": F.col("modifiers")}))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Annotation names and modifiers in too few or too many nodes."""
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and nodes of every annotation name and modifier."""
    return _terms(spark, d).select("field", "term", "occurrences", "records", F.round("share", 9).alias("share"), "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that a parser of their extension's language rejects."""
    return syntax.verdicts(table(spark, d, "source_files").select("file_id", "source_file", "text")).where("not valid").select("file_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first error of each file that does not parse, and whether an earlier parser reported anything on it."""
    files = syntax.verdicts(table(spark, d, "source_files").select("file_id", "source_file", "text", "project_id"), keep=("project_id", "source_file")).where("not valid")
    hints = table(spark, d, "parse_errors").select("project_id", F.regexp_replace(F.regexp_replace("file_path", r"\\\\", "/"), r"^(\./|/)+", "").alias("source_file")).distinct().withColumn("reported", F.lit(True))
    return files.distinct().join(hints, ["project_id", "source_file"], "left").select("file_id", "project_id", "language", "error", "error_line", F.coalesce("reported", F.lit(False)).alias("reported"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, invalid files and their rate per project and language."""
    v = syntax.verdicts(table(spark, d, "source_files").select("file_id", "source_file", "text", "project_id"), keep=("project_id",))
    return syntax.rates(v, ["project_id", "language"])


def _origin(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    return handwritten.classify(table(spark, d, "source_files").select("file_id", "project_id", "source_file", "text"), table(spark, d, "projects").select("project_id", "exclude_paths"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Generated, minified, third-party and data files."""
    return _origin(spark, d)[0].where("not handwritten").select("file_id")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's score and the part of shared windows of every file."""
    return _origin(spark, d)[0].select("file_id", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "handwritten")


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision and recall on the repositories held out of the fit."""
    return spark.createDataFrame(sorted(_origin(spark, d)[1].items()), "figure string, value double")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a body whose own documentation isn't trivial, in files that parse."""
    files = table(spark, d, "source_files").select("file_id", "project_id", "source_file", "text")
    return docpairs.pairs(files, code=False).where("not inherited").select("file_id", "name", "line")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Functions with their code and their own or inherited documentation."""
    return docpairs.pairs(table(spark, d, "source_files").select("file_id", "project_id", "source_file", "text"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar embeddings of every usable embedding within its project."""
    return hnsw.nearest(table(spark, d, "node_embeddings").select("vec_id", "project_id", "semantic_embedding"), 10).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a cosine similarity of at least 0.95, one among the five most similar of the other."""
    found = hnsw.nearest(table(spark, d, "node_embeddings").select("vec_id", "project_id", "semantic_embedding"), 5)
    return hnsw.close_pairs(found, 0.95).select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def _capacity(spark: SparkSession, d: str) -> int:
    return int(table(spark, d, "context_sizes").agg(F.min("capacity")).first()[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split because they alone exceed the capacity."""
    packed = packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"), _capacity(spark, d))
    return packed.where("piece > 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container."""
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"), _capacity(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_containers(spark, d), _capacity(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that stay below their target share though every document is used as often as allowed."""
    return _mix(spark, d)[1].where("short").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in order of service."""
    return _mix(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every source."""
    return _mix(spark, d)[1]


def _abuse(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return abuse.score(table(spark, d, "documents").select("doc_id", "text", mixing.normal_source(F.col("source")).alias("source")), table(spark, d, "abuse_labels").select("doc_id", "abusive"), keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _abuse(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _abuse(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive documents and their rate per source."""
    return abuse.rates(_abuse(spark, d, ("source",)), "source")


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall against the ratings of projects held out of the fit."""
    figures = abuse.held_out(table(spark, d, "documents").select("doc_id", "text", "project_id"), table(spark, d, "abuse_labels").select("doc_id", "abusive"), "project_id")
    return spark.createDataFrame(sorted(figures.items()), "figure string, value double")


QUERIES = {f.__name__: f for f in (p1_found, p1_term_counts, p3_found, p3_errors, p3_rates, p5_found, p5_scores, p5_validation, p6_found, p6_pairs, p7_found, p7_neighbours, p8_found, p8_containers, p8_fill, p9_found, p9_mixture, p9_report, p10_found, p10_scores, p10_rates, p10_validation)}

_NODES = "first_rows AS (SELECT project_id, id, modifiers, annotations FROM code_nodes QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY scanned_at NULLS FIRST) = 1)"
_TERMS = rf"""{_NODES}, raw AS (SELECT 'annotation' AS field, project_id, id, unnest(annotations).name AS v FROM first_rows UNION ALL SELECT 'modifier', project_id, id, unnest(modifiers) FROM first_rows),
 terms AS (SELECT field, project_id, id, regexp_replace(lower(v), '^[\s@]+|\s+$', '', 'g') AS term FROM raw WHERE v IS NOT NULL),
 good AS (SELECT field, project_id, id, term FROM terms WHERE term <> ''), n AS (SELECT field, count(DISTINCT (project_id, id)) AS n FROM good GROUP BY field),
 counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT (project_id, id)) AS records FROM good GROUP BY field, term),
 marked AS (SELECT field, term, occurrences, records, round(records / n, 9) AS share, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.30 * n THEN 'common' END AS mark FROM counts JOIN n USING (field))"""
ORACLE = {
    "p1_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_term_counts": f"WITH {_TERMS} SELECT field, term, occurrences, records, share, mark FROM marked",
    # Exact neighbours; the graphs' recall at this size is complete.
    "p7_found": """WITH v AS (SELECT vec_id, any_value(project_id) AS p, any_value(semantic_embedding)::DOUBLE[] AS x FROM node_embeddings WHERE semantic_embedding IS NOT NULL GROUP BY vec_id), u AS (SELECT vec_id, p, len(x) AS n, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
 s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.x, b.x) / (a.norm * b.norm) AS c FROM u a JOIN u b ON a.p = b.p AND a.n = b.n AND a.vec_id <> b.vec_id), t AS (SELECT i, j, c FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) <= 5)
 SELECT DISTINCT least(i, j) AS vec_id_a, greatest(i, j) AS vec_id_b FROM t WHERE c >= 0.95""",
    # In characters instead of tokens: no document and no source lies near its limit.
    "p8_found": "SELECT doc_id FROM documents, context_sizes WHERE length(text) / 4.0 > capacity",
    "p9_found": r"""WITH d AS (SELECT regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g') AS source, sum(length(text)) AS n FROM documents GROUP BY 1) SELECT t.source FROM mix_targets t LEFT JOIN d USING (source) WHERE coalesce(d.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM d)""",
}
