"""Queries over manifests: profiles, constraints, duplicate groups, splits, weights, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import exprs
from siftwork.operators import audit, checks, groups, split
from siftwork.plans.registry import query
from siftwork.sources import readers
from siftwork.sources.registry import CONDITIONS, conditions
from siftwork.sources.views import MANIFEST_SQL as _M
from siftwork.sources.views import manifest, table

_NAMES = ("dataset_name", "generator_family", "file_format", "licence_identifier")
_STRIP = r"regexp_replace({c}::VARCHAR, '^\s+|\s+$', '', 'g')"
_HAS = r"({c} IS NOT NULL AND " + _STRIP + " <> '')"


def _each(select: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(select.replace("{c}", c) for c in columns)


@query(f"WITH {_M} SELECT label, count(*) AS n FROM manifest WHERE label IS NOT NULL GROUP BY label")
def audit_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.class_counts(manifest(spark, sf_dir))


@query(f"WITH {_M} " + _each("SELECT '{c}' AS column_name, " + _STRIP + " AS value, count(*) AS n FROM manifest WHERE " + _HAS + " GROUP BY 1, 2", _NAMES))
def audit_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(manifest(spark, sf_dir), *_NAMES)


@query(f"WITH {_M} " + _each("SELECT '{c}' AS column_name, round(quantile_cont({c}::DOUBLE, 0.0), 9) AS minimum, round(quantile_cont({c}::DOUBLE, 0.25), 9) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 9) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 9) AS q75, round(quantile_cont({c}::DOUBLE, 1.0), 9) AS maximum FROM manifest", ("width", "height")))
def audit_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.quantiles(manifest(spark, sf_dir), "width", "height")
    return found.withColumns({c: F.round(c, 9) for c in audit.QUANTILES})


@query(f"WITH {_M} SELECT file_format AS value, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1 FROM manifest WHERE label IN (0, 1) GROUP BY 1")
def audit_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_crosstab(manifest(spark, sf_dir))


_ALL = ("sample_id", "path", "label", "dataset_name", "dataset_version", "generator_family", "source_group_id", "original_image_id", "width", "height", "file_format", "licence_identifier", "content_checksum", "perceptual_hash", "split")


@query(f"WITH {_M} " + _each("SELECT '{c}' AS column_name, count(*) FILTER (WHERE NOT " + _HAS + ") AS n_missing FROM manifest", _ALL) + " UNION ALL SELECT 'extra_column', count(*) FROM manifest")
def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_counts(manifest(spark, sf_dir), "content_checksum", "extra_column")


@query(f"WITH {_M} SELECT count(content_checksum) - count(DISTINCT content_checksum) AS n_duplicates FROM manifest")
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_count(manifest(spark, sf_dir))


_SHORT = "SELECT '{c}' AS column_name, coalesce(bool_and(lo = hi) AND count(*) >= 2 AND min(lo) = 0 AND max(hi) = 1, false) AS is_shortcut FROM (SELECT {c}, min(label) AS lo, max(label) AS hi FROM manifest WHERE label IN (0, 1) AND " + _HAS + " GROUP BY 1)"


@query(f"WITH {_M} " + _each(_SHORT, _NAMES))
def audit_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_shortcuts(manifest(spark, sf_dir), *_NAMES)


_POLICY = [(f"src{i}", i % 5 != 4, i % 2 == 0, i % 3 != 0, i % 4 != 3) for i in range(18)]
_POLICY_SQL = "policy(dataset_name, approved, allow_real, allow_fake, generator_labelled) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d}, {e})" for a, b, c, d, e in _POLICY) + ")"


@query(f"""WITH {_M}, {_POLICY_SQL}, p AS (SELECT dataset_name, count(*) FILTER (WHERE label = 0) AS r, count(*) FILTER (WHERE label = 1) AS f FROM manifest GROUP BY 1),
j AS (SELECT p.dataset_name, r, f, coalesce(approved, false) AS ok, allow_real, allow_fake FROM p LEFT JOIN policy USING (dataset_name)),
w AS (SELECT count(*) FILTER (WHERE label = 0) AS r, count(*) FILTER (WHERE label = 1) AS f, count(DISTINCT CASE WHEN label = 1 AND generator_labelled THEN trim(generator_family) END) AS k FROM manifest LEFT JOIN policy USING (dataset_name))
SELECT dataset_name, 'source not approved' AS problem FROM j WHERE NOT ok
UNION ALL SELECT dataset_name, 'real rows not allowed' FROM j WHERE ok AND r > 0 AND NOT allow_real
UNION ALL SELECT dataset_name, 'fake rows not allowed' FROM j WHERE ok AND f > 0 AND NOT allow_fake
UNION ALL SELECT '*', 'no real rows' FROM w WHERE r = 0 UNION ALL SELECT '*', 'no fake rows' FROM w WHERE f = 0 UNION ALL SELECT '*', 'too few fake families' FROM w WHERE k < 5""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame(_POLICY, "dataset_name string, approved boolean, allow_real boolean, allow_fake boolean, generator_labelled boolean")
    return checks.policy_violations(manifest(spark, sf_dir), policy, least_families=5)


_BAD_ROWS = [("a", "1", "g", "10", "20", "0" * 64, "f" * 16, "train"), (" ", "2", "", "0", "x", "0" * 63, "g" * 16, "other"), ("c", None, "g", None, "5", None, "F" * 16, "test"), ("d", "0.0", "g", "3", "-1", "A" * 64, "1" * 17, "unassigned")]
_BAD = ("sample_id", "label", "source_group_id", "width", "height", "content_checksum", "perceptual_hash", "split")
_BAD_SQL = f"b({', '.join(_BAD)}) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _BAD_ROWS) + ")"


@query(f"""WITH {_BAD_SQL}
SELECT sample_id, 'blank sample_id' AS rule FROM b WHERE trim(sample_id) = ''
UNION ALL SELECT sample_id, 'label' FROM b WHERE coalesce(try_cast(label AS DOUBLE) NOT IN (0, 1), true)
UNION ALL SELECT sample_id, 'blank source_group_id' FROM b WHERE trim(source_group_id) = ''
UNION ALL SELECT sample_id, 'width' FROM b WHERE coalesce(NOT try_cast(width AS DOUBLE) > 0, true)
UNION ALL SELECT sample_id, 'height' FROM b WHERE coalesce(NOT try_cast(height AS DOUBLE) > 0, true)
UNION ALL SELECT sample_id, 'content_checksum' FROM b WHERE NOT coalesce(regexp_full_match(content_checksum, '[0-9a-fA-F]{{64}}'), false)
UNION ALL SELECT sample_id, 'perceptual_hash' FROM b WHERE NOT coalesce(regexp_full_match(perceptual_hash, '[0-9a-fA-F]{{16}}'), false)
UNION ALL SELECT sample_id, 'split' FROM b WHERE split NOT IN ('train', 'validation', 'test', 'generator_validation', 'generator_test', 'unassigned')""")
def row_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.manifest_violations(spark.createDataFrame(_BAD_ROWS, ", ".join(f"{c} string" for c in _BAD)))


_HAMMING = "bit_count(xor(('0x' || substr(a.h, 1, 8))::BIGINT, ('0x' || substr(b.h, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.h, 9, 8))::BIGINT, ('0x' || substr(b.h, 9, 8))::BIGINT))"
_PAIRS = f"h AS (SELECT DISTINCT perceptual_hash AS h FROM manifest), pairs AS (SELECT a.h AS a, b.h AS b, ({_HAMMING})::INTEGER AS distance FROM h a JOIN h b ON a.h < b.h WHERE {_HAMMING} <= 4)"


@query(f"WITH {_M}, {_PAIRS} SELECT a, b, distance FROM pairs")
def hash_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.hash_pairs(manifest(spark, sf_dir), 4)


_GROUPED = f"""WITH RECURSIVE {_M}, {_PAIRS}, k AS (
  SELECT sample_id, 's' || source_group_id AS v FROM manifest UNION ALL SELECT sample_id, 'c' || content_checksum FROM manifest UNION ALL SELECT sample_id, 'h' || perceptual_hash FROM manifest
), least AS (SELECT v, min(sample_id) AS x FROM k GROUP BY v), links AS (
  SELECT x, sample_id AS y FROM k JOIN least USING (v) WHERE x <> sample_id
  UNION SELECT p.x, q.x FROM pairs JOIN least p ON p.v = 'h' || a JOIN least q ON q.v = 'h' || b
), bi AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach AS (
  SELECT sample_id AS id, sample_id AS r FROM manifest UNION SELECT reach.id, bi.y FROM reach JOIN bi ON bi.x = reach.r
), comp AS (SELECT id, min(r) AS least_id FROM reach GROUP BY id),
grouped AS (SELECT manifest.*, 'split-' || substr(sha256(least_id), 1, 16) AS split_group_id FROM manifest JOIN comp ON comp.id = manifest.sample_id)"""


@query(f"{_GROUPED} SELECT sample_id, split_group_id FROM grouped")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.split_groups(manifest(spark, sf_dir), 4).select("sample_id", "split_group_id")


@query(f"""WITH {_M}, f AS (SELECT generator_family, count(*) AS n FROM manifest WHERE label = 1 GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, generator_family) AS rn FROM f)
SELECT generator_family, n, CASE WHEN rn = 1 THEN 'generator_test' ELSE 'generator_validation' END AS split FROM r WHERE rn <= 2""")
def holdout_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.holdout_families(manifest(spark, sf_dir), minimum_rows=3)


_BANDS = "SELECT sample_id, label, source_group_id, content_checksum, CASE WHEN substr(md5('17|' || sample_id), 1, 1) < '2' THEN 'test' WHEN substr(md5('17|' || sample_id), 1, 1) < '4' THEN 'validation' ELSE 'train' END AS split FROM manifest"


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring(split.seeded(17, "sample_id"), 1, 1)
    return manifest(spark, sf_dir).withColumn("split", F.when(head < "2", "test").when(head < "4", "validation").otherwise("train"))


@query(f"""WITH {_M}, x AS ({_BANDS}), i AS (SELECT split, 'content_checksum' AS identity, lower(content_checksum) AS value FROM x UNION ALL SELECT split, 'source_group_id', source_group_id FROM x)
SELECT identity, value, count(DISTINCT split) AS n_splits FROM i GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def leakage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.leaking_identities(_banded(spark, sf_dir), "content_checksum", "source_group_id")


@query(f"WITH {_M}, x AS ({_BANDS}) SELECT split, count(*) AS n_rows, count(DISTINCT source_group_id) AS n_groups FROM x GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_banded(spark, sf_dir).withColumn("split_group_id", F.col("source_group_id")))


@query(f"WITH {_M}, x AS ({_BANDS}), r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY sample_id) AS rn FROM x WHERE label IN (0, 1)) SELECT sample_id, label, split FROM r WHERE rn <= 5")
def pilot_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.first_per_group(_banded(spark, sf_dir).where("label in (0, 1)"), ["split", "label"], ["sample_id"], 5).select("sample_id", "label", "split")


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) SELECT event_id, event_type FROM r WHERE rn <= 100")
def capped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.first_per_group(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 100)


_ST = "CASE WHEN label = 0 THEN dataset_name ELSE dataset_name || chr(31) || generator_family END"


@query(f"""WITH {_M}, r AS (SELECT sample_id, label, {_ST} AS st FROM manifest WHERE label IN (0, 1)), s AS (SELECT label, st, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM s GROUP BY 1)
SELECT sample_id, label, round(0.5::DOUBLE / (k * n), 12) AS weight FROM r JOIN s USING (label, st) JOIN k USING (label)""")
def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sampling_weights(manifest(spark, sf_dir)).withColumn("weight", F.round("weight", 12))


_UNIFORM = "('0x' || substr(md5('17|' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH {_M}, r AS (SELECT sample_id, label, {_ST} AS st FROM manifest WHERE label IN (0, 1)), s AS (SELECT label, st, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT label, count(*) AS k FROM s GROUP BY 1),
w AS (SELECT sample_id, md5(sample_id) AS d, 0.5::DOUBLE / (k * n) AS weight FROM r JOIN s USING (label, st) JOIN k USING (label)),
edges AS (SELECT sample_id, sum(weight) OVER (ORDER BY d, sample_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () AS hi, row_number() OVER (ORDER BY d, sample_id) AS spot FROM w),
spans AS (SELECT sample_id, coalesce(lag(hi) OVER (ORDER BY spot), 0) AS lo, CASE WHEN spot = max(spot) OVER () THEN 1 ELSE hi END AS hi FROM edges),
draws AS (SELECT range AS draw, {_UNIFORM.format("range")} AS u FROM range(2000))
SELECT draw, sample_id FROM draws JOIN spans ON u >= lo AND u < hi""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.weighted_sample(split.sampling_weights(manifest(spark, sf_dir)), draws=2000, seed=17)


_SEEDED = "md5('{0}|' || split_group_id)"
#: Holdouts by families, controls for holdouts without real rows, and the first of the seeds whose three parts have both labels.
_SPLIT = f"""{_GROUPED}, f AS (SELECT generator_family, count(*) AS n FROM grouped WHERE label = 1 GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, generator_family) AS place FROM f),
g AS (SELECT split_group_id, bool_or(label = 0) AS has_real, bool_or(label = 1) AS has_fake, bool_or(label = 1 AND coalesce(place = 2, false)) AS in_validation, bool_or(label = 1 AND coalesce(place = 1, false)) AS in_test FROM grouped LEFT JOIN p USING (generator_family) GROUP BY 1),
held AS (SELECT split_group_id, CASE WHEN in_validation THEN 'generator_validation' ELSE 'generator_test' END AS split, has_real FROM g WHERE in_validation OR in_test),
without AS (SELECT s AS split, row_number() OVER (ORDER BY spot) AS place FROM (VALUES ('generator_validation', 1), ('generator_test', 2)) AS v(s, spot) WHERE NOT coalesce((SELECT bool_or(has_real) FROM held WHERE held.split = s), false)),
real AS (SELECT split_group_id, row_number() OVER (ORDER BY {_SEEDED.format(17)}, split_group_id) AS spot, greatest(1, floor(count(*) OVER () * 0.1::DOUBLE + 0.5)) AS each FROM g WHERE NOT in_validation AND NOT in_test AND has_real AND NOT has_fake),
controls AS (SELECT split_group_id, split FROM real JOIN without ON spot > (place - 1) * each AND spot <= place * each),
free AS (SELECT * FROM g WHERE NOT in_validation AND NOT in_test AND split_group_id NOT IN (SELECT split_group_id FROM controls)),
tried AS (SELECT attempt, free.*, row_number() OVER (PARTITION BY attempt ORDER BY md5((17 + attempt)::VARCHAR || '|' || split_group_id), split_group_id) AS spot, greatest(1, floor(count(*) OVER (PARTITION BY attempt) * 0.1::DOUBLE + 0.5)) AS part FROM free, (SELECT range AS attempt FROM range(100))),
placed AS (SELECT attempt, split_group_id, has_real, has_fake, CASE WHEN spot <= part THEN 'test' WHEN spot <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM tried),
good AS (SELECT min(attempt) AS attempt FROM (SELECT attempt FROM (SELECT attempt, split, bool_or(has_real) AND bool_or(has_fake) AS ok FROM placed GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (WHERE ok) = 3)),
assigned AS (SELECT split_group_id, split FROM held UNION ALL SELECT split_group_id, split FROM controls UNION ALL SELECT split_group_id, split FROM placed JOIN good USING (attempt))
SELECT sample_id, split_group_id, assigned.split FROM grouped JOIN assigned USING (split_group_id)"""


@query(_SPLIT.replace(" l ON l.doc_id = d.doc_id\n)", " l ON l.doc_id = d.doc_id WHERE toxic IS NOT NULL\n)", 1))
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as the SQL does, which asks for the validation holdout first
    policy = split.SplitPolicy(minimum_holdout_family_rows=3, keep_linked_holdouts=True)
    labelled = manifest(spark, sf_dir).where("label is not null")
    return split.assign_splits(groups.split_groups(labelled, 4), policy).select("sample_id", "split_group_id", "split")


_COND = ", ".join(f"('{c.condition_id}', '{c.family}')" for c in CONDITIONS)


@query(f"WITH c(condition_id, family) AS (VALUES {_COND}) SELECT condition_id, family, round(1.0::DOUBLE / (6 * count(*) OVER (PARTITION BY family)), 12) AS probability FROM c")
def condition_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = conditions(spark).select("condition_id", "family")
    return dim.join(dim.groupBy("family").agg(F.count("*").alias("n")), "family").select("condition_id", "family", F.round(F.lit(1.0) / (6 * F.col("n")), 12).alias("probability"))


@query("SELECT doc_id, sha256(text) AS content_sha256, 'split-' || substr(sha256('doc-' || doc_id), 1, 16) AS group_id FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("content_sha256"), exprs.group_id(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("group_id"))


@query("""WITH s AS (SELECT doc_id, source, sha256(unhex('73696674776f726b2d737461626c652d736565642d763100' || '0000000000000003' || '69' || '0000000000000002' || '3137' || '73' || printf('%016x', strlen(doc_id::VARCHAR)) || hex(encode(doc_id::VARCHAR)) || '73' || printf('%016x', strlen(source)) || hex(encode(source)))) AS d FROM documents)
SELECT doc_id, (('0x' || substr(d, 1, 8))::BIGINT & 2147483647) * 4294967296 + ('0x' || substr(d, 9, 8))::BIGINT AS seed FROM s""")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", exprs.stable_seed(17, F.col("doc_id"), F.col("source")).alias("seed"))


@query("""SELECT p_partkey, greatest(1, round_even(p_size * 0.25, 0))::BIGINT AS quarter, greatest(1, floor(p_size * 0.1 + 0.5))::BIGINT AS tenth, (2 * ceil(3 * (p_size / 10.0)) + 1)::BIGINT AS kernel, replace(replace(p_name, '|', '\\|'), chr(10), ' ') AS cell FROM part""")
def size_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    return part.select("p_partkey", exprs.resized(size, 0.25).alias("quarter"), exprs.half_up_count(size, 0.1).alias("tenth"), exprs.blur_kernel_size(size / 10).alias("kernel"), exprs.markdown_cell(F.col("p_name")).alias("cell"))


@query("""WITH f AS (SELECT page_id, 'page ' || page_id || CASE WHEN page_id % 3 = 0 THEN '.PNG' ELSE '.png' END AS name FROM pages), p AS (SELECT page_id AS pair_id, 'page ' || page_id || '.png' AS wanted FROM pages WHERE page_id % 2 = 0)
SELECT pair_id, coalesce(e.name, n.name) AS path, e.name IS NOT NULL AS exact FROM p LEFT JOIN f e ON e.name = wanted LEFT JOIN f n ON regexp_replace(lower(n.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(wanted), '[^a-z0-9]', '', 'g')""")
def pair_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    name = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    files = pages.select(F.concat(name, F.when(F.col("page_id") % 3 == 0, ".PNG").otherwise(".png")).alias("name"))
    wanted = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("pair_id"), F.concat(name, F.lit(".png")).alias("wanted"))
    return readers.resolve_names(wanted, files, "wanted").select("pair_id", F.col("name").alias("path"), "exact")
