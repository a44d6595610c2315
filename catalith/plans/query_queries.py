"""Semantic queries, matrices and ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.text import normalised_name
from catalith.operators import ccm, search, semantic
from catalith.plans.registry import query
from catalith.session import table
from catalith.sources import bridge as B

LE = B.LINE_ENTRIES_SQL
#: Names of entries that the term queries run over: a realistic one for each part, before the part's own name.
ENTRY_NAMES = (
    "DefaultCropOrigin", "DefaultCropSize", "ActiveArea", "SensorBorder", "MaskedAreas", "Masked Area", "ImageWidth", "Optical Black", "Margin", "ExposureTime", "FNumber", "F Number", "ISOSpeed", "ExposureBiasValue", "GainControl",
    "AEProgramMode", "WhiteBalance", "White Balance", "AsShotNeutral", "WB_RGGBLevels", "Camera_WB", "ColorTempKelvin", "ColorMatrix1", "CameraCalibration1", "ProfileName", "ToneCurve", "Film Simulation", "Colour Space", "Camera To XYZ",
    "LensModel", "Lens Correction", "DistortionCorrection", "VignettingCorr", "OpcodeList3", "AFMicroAdj", "Peripheral", "Orientation", "BlackLevel", "White Clip", "LinearizationTable", "Raw Curve", "CFAPattern", "BayerOrder",
    "RawDataOffset", "StripByteCounts", "Byte Order", "BitDepth", "PixelShift", "Smart HDR", "Ambience", "Panoramic", "ObjectName", "Headline", "Caption-Abstract", "By-line", "Keywords", "SubjectArea", "UserComment", "Artist", "",
)
_NAMES = "names AS (SELECT p_partkey AS asset_id, " + "[" + ", ".join(f"'{n}'" for n in ENTRY_NAMES) + f"][CAST(p_partkey % {len(ENTRY_NAMES)} AS INTEGER) + 1] || ' ' || p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 'mk_PhaseOne0' ELSE 'ifd0' END AS ifd FROM part)"
_TERMS = f"""{_NAMES}, r(kind, b, re) AS (VALUES ('crop', 0, 'crop'), ('crop', 1, 'border'), ('crop', 2, 'margin'), ('crop', 3, 'padding|maskedarea|masked area|opticalblack|optical black'), ('crop', 4, 'activearea|active area'),
  ('crop', 5, 'origin'), ('crop', 6, 'offset'), ('crop', 7, 'size|width|height'), ('crop', 8, 'sensor'), ('crop', 9, 'image'),
  ('exposure_gain', 10, 'exposure|aeprogram|ae program|shutter|aperture|fnumber|f-number|f number|brightness|iso'), ('exposure_gain', 11, 'bias|compensation'), ('exposure_gain', 12, 'gain'),
  ('white_balance', 13, 'whitebalance|white balance|asshotneutral|asshotwhitexy|colortemp|color temperature|^wb|_wb| wb'),
  ('color', 14, 'color|colour|illuminant|profile|tonecurve|tone curve|creative style|creativestyle|picture style|picturestyle|film simulation|filmsimulation|dynamic range optimizer|dynamicrangeoptimizer'),
  ('color', 14, 'matrix|cameratoxyz|camera to xyz|cameratorgb|camera to rgb|ccm'), ('color', 15, 'matrix|cameratoxyz|camera to xyz|cameratorgb|camera to rgb|ccm'), ('color', 16, 'calibration'), ('color', 17, 'profile'),
  ('lens_correction', 18, 'lens|distort|vignet|aberration|shading|peripheral|diffraction|opcode|radial correction|radialcorrection|optical correction|opticalcorrection|afmicroadj|af micro adj|microadjustment'),
  ('lens_correction', 19, 'correction|corr|distort|vignet|aberration|shading|opcode|afmicroadj|af micro adj|microadjustment'), ('orientation', 20, 'orientation'),
  ('raw_processing', 21, 'blacklevel|black level|opticalblack|optical black|blackmask|black mask'), ('raw_processing', 22, 'whitelevel|white level|whiteclip|white clip|saturationlevel|saturation level'),
  ('raw_processing', 23, 'linearization|linearity|linearresponse|linear response|rawcurve|raw curve|klut'), ('raw_processing', 24, 'cfa|bayer'), ('raw_processing', 25, 'rawdata|raw data|rawfile|raw file|rawformat|raw format|rawimage|raw image|originalraw'),
  ('raw_processing', 26, 'storage|strip|bytecount|byte count|fileoffset|file offset|dataoffset|data offset|datalength|data length|compresseddata|compressed data|byteorder|byte order'),
  ('raw_processing', 8, 'sensor|validbits|valid bits|bitdepth|bit depth|rawdepth|raw depth|rawvaluerange|raw value range|rawvaluemedian|raw value median|maskedpixels|masked pixels'),
  ('raw_processing', 27, 'pixelshift|pixel shift|multishot|multi shot|multiframe|multi frame|deepfusion|deep fusion|smart hdr|imagefusion|image fusion|creative style|creativestyle|picture style|picturestyle|film simulation|filmsimulation'),
  ('raw_processing', 27, 'dynamic range optimizer|dynamicrangeoptimizer|active dlighting|activedlighting|raw develop|rawdevelop|ambience|thermal|radiometric|emissivity|planck|irwindow|ir window|real2ir|real to ir|stitch|panorama|panoramic'),
  ('descriptive', 28, 'title|objectname|object name|headline'), ('descriptive', 29, 'description|caption|abstract|comment'), ('descriptive', 30, 'creator|author|byline|by-line'), ('descriptive', 31, 'keyword|subject')),
  hit AS (SELECT asset_id, ifd, kind, b FROM names JOIN r ON regexp_matches(lower(name), re) UNION ALL SELECT asset_id, ifd, k, 8 FROM names, (VALUES ('crop'), ('raw_processing')) g(k) WHERE contains(lower(ifd), 'phaseone')),
  m AS (SELECT asset_id, ifd, kind, CAST(bit_or(CAST(1 AS BIGINT) << b) AS BIGINT) AS terms, list(b) AS bs FROM hit GROUP BY asset_id, ifd, kind)"""


def _named(spark, d):
    n = F.element_at(F.array(*[F.lit(x) for x in ENTRY_NAMES]), (F.col("p_partkey") % len(ENTRY_NAMES) + 1).cast("int"))
    ifd = F.when(F.col("p_partkey") % 9 == 0, "mk_PhaseOne0").otherwise("ifd0")
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.concat(n, F.lit(" "), "p_name").alias("name"), ifd.alias("ifd"))


@query("term_bits", f"WITH {_TERMS} SELECT asset_id, kind, terms FROM m")
def term_bits(spark, d):
    return semantic.match_terms(_named(spark, d), "name", "ifd").select("asset_id", "kind", "terms")


@query("term_confidence", f"""WITH {_TERMS} SELECT asset_id, kind, CASE kind
  WHEN 'crop' THEN CASE WHEN list_has_any(bs, [0]) THEN 90 WHEN list_has_any(bs, [4]) THEN 88 WHEN list_has_any(bs, [1, 2, 3]) THEN 70 WHEN list_has_any(bs, [8, 9]) THEN 45 ELSE 0 END
  WHEN 'exposure_gain' THEN CASE WHEN list_has_any(bs, [10, 12]) THEN 90 ELSE 82 END WHEN 'color' THEN CASE WHEN list_has_any(bs, [15]) THEN 94 WHEN list_has_any(bs, [16, 17]) THEN 88 ELSE 70 END
  WHEN 'lens_correction' THEN CASE WHEN list_has_all(bs, [18, 19]) THEN 92 ELSE 68 END WHEN 'orientation' THEN 95
  WHEN 'raw_processing' THEN CASE WHEN list_has_any(bs, [21, 22, 23, 24]) THEN 92 WHEN list_has_any(bs, [25, 26]) THEN 86 WHEN list_has_any(bs, [27]) THEN 84 ELSE 78 END ELSE 90 END AS confidence FROM m""")
def term_confidence(spark, d):
    m = semantic.match_terms(_named(spark, d), "name", "ifd")
    return m.select("asset_id", "kind", semantic.confidence(F.col("kind"), F.col("terms")).alias("confidence"))


@query("default_terms", """SELECT kind, terms, count(*) AS n FROM (
  SELECT 'descriptive' AS kind, CAST(268435456 AS BIGINT) AS terms FROM pages WHERE regexp_matches(lower(html), 'title|object ?name|headline') AND NOT regexp_matches(lower(html), 'description|caption|abstract|comment|creator|author|byline|by-line|keyword|subject'))
  GROUP BY ALL""")
def default_terms(spark, d):
    title = semantic.bit("title")
    own = tuple(r for r in semantic.RULES if r[0] == "descriptive")
    return semantic.match_terms(table(spark, d, "pages").select("html"), "html", rules=own).where(f"kind = 'descriptive' and terms = {title}").groupBy("kind", "terms").agg(F.count("*").alias("n"))


_SERIES = f"""WITH {LE}, f AS (SELECT asset_id, block_id, ifd, tag, min(entry_id) AS id FROM le WHERE flags & 1 = 0 AND tag IN (2, 4, 6) GROUP BY ALL)
  SELECT asset_id, block_id, ifd, count(*) AS n_tags, string_agg(CAST(id AS VARCHAR), ',' ORDER BY tag) AS sources FROM f GROUP BY ALL HAVING count(*) >= """


@query("series_groups", _SERIES + "2")
def series_groups(spark, d):
    return semantic.series_groups(B.line_entries(spark, d), [2, 4, 6])


@query("series_min_values", _SERIES + "3")
def series_min_values(spark, d):
    return semantic.series_groups(B.line_entries(spark, d), [2, 4, 6], least=3)


@query("crop_rect", """SELECT l_orderkey AS asset_id, l_quantity AS x, l_tax * 100 AS y, l_extendedprice AS w, l_discount * 100 AS h, 95 AS confidence FROM lineitem WHERE l_quantity >= 0 AND l_tax * 100 >= 0 AND l_extendedprice > 0 AND l_discount * 100 > 0""")
def crop_rect(spark, d):
    r = semantic.rectangle(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_extendedprice"), F.col("l_discount") * 100)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), r.alias("r")).where("r is not null").select("asset_id", "r.*", F.lit(95).alias("confidence"))


@query("active_area_rect", """SELECT l_orderkey AS asset_id, l_tax * 100 AS x, l_discount * 100 AS y, l_quantity - l_tax * 100 AS w, l_quantity - l_discount * 100 AS h, 92 AS confidence FROM lineitem WHERE l_quantity - l_tax * 100 > 0 AND l_quantity - l_discount * 100 > 0 AND l_tax >= 0 AND l_discount >= 0""")
def active_area_rect(spark, d):
    r = semantic.bounds_rectangle(F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity"), F.col("l_quantity"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), r.alias("r")).where("r is not null").select("asset_id", "r.*", F.lit(92).alias("confidence"))


_VEC = "v AS (SELECT vec_id AS asset_id, list_slice(embedding, 1, [1, 2, 3, 9, 10, 12, 16, 39][CAST(vec_id % 8 AS INTEGER) + 1]) AS x FROM embeddings)"


def _vectors(spark, d):
    n = F.element_at(F.array(*[F.lit(i) for i in (1, 2, 3, 9, 10, 12, 16, 39)]), (F.col("vec_id") % 8 + 1).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"), F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double")).alias("x"))


@query("matrix_shape", f"""WITH {_VEC} SELECT asset_id, len(x) AS n, CASE WHEN len(x) = 1 THEN 'scalar' WHEN len(x) <= 4 THEN 'vec' || len(x) WHEN len(x) IN (9, 16) THEN 'matrix' || CAST(sqrt(len(x)) AS INTEGER) || 'x' || CAST(sqrt(len(x)) AS INTEGER)
  WHEN len(x) % 3 = 0 THEN 'matrix' || CAST(len(x) // 3 AS INTEGER) || 'x3' ELSE 'table' END AS shape FROM v""")
def matrix_shape(spark, d):
    v = _vectors(spark, d).withColumn("n", F.size("x").cast("long"))
    return v.select("asset_id", "n", semantic.shape(F.col("n")).alias("shape"))


@query("numeric_status", f"WITH {_VEC} SELECT CASE WHEN len(x) = 0 THEN 'not_numeric' WHEN len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) > 0 THEN 'invalid' ELSE 'complete' END AS status, count(*) AS n, CAST(sum(len(x)) AS BIGINT) AS total FROM v GROUP BY ALL")
def numeric_status(spark, d):
    return _vectors(spark, d).groupBy(semantic.numeric_status(F.col("x")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.size("x")).alias("total"))


@query("numeric_budget_running", """WITH c AS (SELECT label, vec_id, len(embedding) AS n, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS run FROM embeddings)
  SELECT label, vec_id, CAST(n AS BIGINT) AS n, CAST(least(run, 1000) - least(run - n, 1000) AS BIGINT) AS returned, CASE WHEN least(run, 1000) - least(run - n, 1000) < n THEN 'partial' ELSE 'complete' END AS status FROM c""")
def numeric_budget_running(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.size("embedding").cast("long").alias("n"))
    return semantic.budgeted(e, ["label"], ["vec_id"], "n", 1000)


@query("ccm_fields", f"""WITH {_VEC} SELECT asset_id, CAST(len(x) AS BIGINT) AS n, CAST(CASE WHEN len(x) IN (9, 16) THEN CAST(sqrt(len(x)) AS INTEGER) WHEN len(x) % 3 = 0 THEN len(x) // 3 ELSE 1 END AS BIGINT) AS n_rows,
  CAST(CASE WHEN len(x) IN (9, 16) THEN CAST(sqrt(len(x)) AS INTEGER) WHEN len(x) % 3 = 0 THEN 3 ELSE len(x) END AS BIGINT) AS n_cols FROM v""")
def ccm_fields(spark, d):
    return ccm.fields(_vectors(spark, d))


@query("ccm_issues", f"""WITH {_VEC}, i AS (SELECT asset_id, x, unnest(list_filter([CASE WHEN len(x) % 3 <> 0 THEN 'matrix_count_not_multiple_of_3' END, CASE WHEN len(x) > 36 THEN 'matrix_count_too_large' END,
  CASE WHEN CAST(sqrt(len(x)) AS INTEGER) * CAST(sqrt(len(x)) AS INTEGER) <> len(x) THEN 'calibration_not_square' END, CASE WHEN len(x) = 2 AND NOT (x[1] > 0 AND x[2] > 0 AND x[1] + x[2] <= 1) THEN 'white_xy_out_of_range' END,
  CASE WHEN len(x) >= 3 AND list_min(x) <= 0 THEN 'balance_not_positive' END], lambda e: e IS NOT NULL)) AS issue FROM v) SELECT asset_id, issue FROM i""")
def ccm_issues(spark, d):
    return ccm.issues(_vectors(spark, d))


@query("fuzzy_normalize", """SELECT p_partkey AS id, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_brand || 'Name' || p_name, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM part""")
def fuzzy_normalize(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), normalised_name(F.concat("p_brand", F.lit("Name"), "p_name")).alias("norm"))


QUERY_TEXTS = ("red plate", "small widget", "azure gizmo", "bolt")
ALIASES = (("azure gizmo", "blue gizmo"), ("small widget", "small anvil"), ("bolt", "rod"))


@query("fuzzy_exact_alias", """WITH t(query, term, kind, score) AS (VALUES ('red plate', 'red plate', 'exact', 100.0), ('small widget', 'small widget', 'exact', 100.0), ('azure gizmo', 'azure gizmo', 'exact', 100.0), ('bolt', 'bolt', 'exact', 100.0), ('azure gizmo', 'blue gizmo', 'alias', 96.0), ('small widget', 'small anvil', 'alias', 96.0), ('bolt', 'rod', 'alias', 96.0)), h AS (SELECT t.query, p_partkey AS id, t.score, t.kind FROM part JOIN t ON contains(' ' || p_name || ' ', ' ' || t.term || ' '))
  SELECT query, id, CAST(max(score) AS DOUBLE) AS score, arg_max(kind, score) AS kind FROM h GROUP BY query, id""")
def fuzzy_exact_alias(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), normalised_name("p_name").alias("norm"))
    return search.exact_and_alias(names, spark.createDataFrame([(q,) for q in QUERY_TEXTS], "query string"), spark.createDataFrame(list(ALIASES), "query string, alias string"))


@query("fuzzy_topk")
def fuzzy_topk(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.fuzzy_top_k(e, "name", ["red plte", "smal wigdet", "azure gizmo", "gren gizmo"], ALIASES, least=60, k=8)
