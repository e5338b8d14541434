"""Registered queries of the text, date and matching operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import readings as T
from inkledger.functions.dates import ERAS, era_date
from inkledger.operators import matching as M
from inkledger.session import table

#: A plain fold for accented letters, the map of these queries.
ACCENTS = dict(zip("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc"))
_FOLD_SQL = f"translate({{0}}, '{''.join(ACCENTS)}', '{''.join(ACCENTS.values())}')"


def _era_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates seventy years earlier, written as era dates, some of them damaged."""
    day = F.add_months(F.col("o_orderdate").cast("date"), -840)
    text = F.lit(None).cast("string")
    for mark, _, _, before, first, last in ERAS[2:0:-1]:
        text = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.concat(F.lit(mark), (F.year(day) - before).cast("string"), F.lit("、"), F.month(day).cast("string"), F.lit("、"), F.dayofmonth(day).cast("string"))).otherwise(text)
    broken = F.when(F.col("o_orderkey") % 10 == 3, F.concat(text, F.lit("、一"))).when(F.col("o_orderkey") % 10 == 7, F.regexp_replace(text, "、[0-9]+、", "、13、")).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", broken.alias("text"))


def era_date_format_parse(spark, sf):
    return _era_texts(spark, sf).withColumn("d", era_date(F.col("text"))).select("o_orderkey", "text", F.col("d.value").cast("string").alias("day"), F.col("d.reason").alias("reason"))


def title_date_extract(spark, sf):
    titles = _era_texts(spark, sf).select("o_orderkey", F.concat(F.lit("名簿 "), F.regexp_replace(F.regexp_replace("text", "^大", "大正"), "^昭", "昭和"), F.lit("日調")).alias("t"))
    titles = titles.select("o_orderkey", F.regexp_replace("t", "^(.*?)([0-9]+)、([0-9]+)、([0-9]+)日", "$1$2年$3月$4日").alias("title"))
    found = titles.withColumn("written", T.era_in_title("title")).withColumn("d", era_date(F.col("written")))
    state = F.when(F.col("written").isNull(), "no date").when(F.col("d.value").isNull(), "refused").otherwise("would write")
    return found.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def fold_variants(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.folded("text", ACCENTS) != F.trim("text")).alias("changed"))


def token_counts(spark, sf):
    rows = table(spark, sf, "documents")
    hits = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0))
    return rows.groupBy("fmt").agg(hits("-->").alias("arrows"), hits("[0-9]+").alias("numbers"), hits("\\n\\n").alias("breaks"))


def seniority_numbers(spark, sf):
    text = F.when(F.col("seniority_no") % 5 == 0, F.translate(F.col("seniority_no").cast("string"), T.DIGITS, T.WIDE_DIGITS)).when(F.col("seniority_no") % 7 == 0, F.concat(F.col("seniority_no").cast("string"), F.lit("?"))).otherwise(F.col("seniority_no").cast("string"))
    rows = table(spark, sf, "observation_in").select("obs_id", text.alias("text")).where("text IS NOT NULL").distinct()
    return rows.withColumn("p", T.plain_number(F.col("text"))).select("obs_id", "text", "p.value", "p.reason")


def geta_marks(spark, sf):
    rows = table(spark, sf, "cell_label").select("label_id", "name_raw").distinct()
    return rows.select("label_id", T.geta_count("name_raw").alias("geta"), T.strip_marks(F.coalesce("name_raw", F.lit(""))).alias("stripped"))


def _names(spark, sf):
    lexicon = table(spark, sf, "part").groupBy(F.col("p_name").alias("entry")).agg(F.min("p_partkey").alias("ordinal"))
    return lexicon, lexicon.select(F.concat(F.substring("entry", 1, 3), F.substring("entry", 5, 50)).alias("reading"))


def lexicon_suggest(spark, sf):
    lexicon, readings = _names(spark, sf)
    return M.suggestions(M.lexicon_matches(readings, lexicon, T.folded_similarity(ACCENTS)), readings)


def lexicon_suggest_lev(spark, sf):
    lexicon, readings = _names(spark, sf)
    score = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return M.suggestions(M.lexicon_matches(readings, lexicon, score), readings)


def _candidates(spark, sf):
    rows = table(spark, sf, "cell_label").select("cell_id", "user_id", "name_raw").distinct()
    human = rows.groupBy("cell_id").agg(F.min_by("name_raw", "user_id").alias("human"))
    return rows.join(human, "cell_id")


def agreement_status(spark, sf):
    fold = lambda c: F.translate(c, "〓冶乍", "　治作")
    return M.agreement(_candidates(spark, sf), ["cell_id", "user_id"], "human", "name_raw", fold)


def worst_agreement(spark, sf):
    return M.worst_status(agreement_status(spark, sf), "cell_id")


def coverage_buckets(spark, sf):
    rows = table(spark, sf, "observation_in").where("name_raw IS NOT NULL").select("volume_id", "frame_no", "row_index", "obs_id", "name_raw").distinct()
    first = rows.groupBy("volume_id", "frame_no", "row_index").agg(F.min_by("name_raw", "obs_id").alias("page"))
    both = rows.join(first, ["volume_id", "frame_no", "row_index"])
    both = both.withColumn("coverage", T.line_coverage("name_raw", "page"))
    return M.bucketed(both.withColumn("size", F.length("name_raw")), "coverage", "size")


def length_buckets(spark, sf):
    rows = table(spark, sf, "documents").where("n_chars > 0 AND n_cues >= 0").select((F.col("n_cues") / (F.col("n_chars") / 60.0)).alias("score"), F.col("n_chars").cast("double").alias("size"))
    return M.bucketed(rows, "score", "size")


def _split(spark, sf):
    rows = table(spark, sf, "observation").select("obs_id", "as_of_date", "name_raw", "branch_code").distinct()
    identity = F.concat_ws("|", F.coalesce("as_of_date", F.lit("")), F.coalesce("name_raw", F.lit("")), F.coalesce("branch_code", F.lit("")))
    return M.holdout_split(rows, identity, ["obs_id"], "salt-1")


def holdout_split(spark, sf):
    return _split(spark, sf).select("obs_id", "academy_id", "use_flag")


def split_coverage(spark, sf):
    return M.split_coverage(_split(spark, sf), "as_of_date")


def machine_readings(spark, sf):
    return M.machine_readings(lexicon_suggest_lev(spark, sf), "reading", "lexicon").select("reading", "engine", "value", "confidence")


def text_line_filter(spark, sf):
    lines = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kept = M.text_lines(lines, "line", "-->|^[0-9]+\\r?$|^\\r?$")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("counted").alias("counted"))


QUERIES = {
    f.__name__: f
    for f in (
        era_date_format_parse, title_date_extract, fold_variants, token_counts, seniority_numbers, geta_marks, lexicon_suggest, lexicon_suggest_lev,
        agreement_status, worst_agreement, coverage_buckets, length_buckets, holdout_split, split_coverage,
    )
}

_ERA_TEXT = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN t || '、一' WHEN o_orderkey % 10 = 7 THEN regexp_replace(t, '、[0-9]+、', '、13、') ELSE t END AS text, d FROM (
 SELECT o_orderkey, d, CASE WHEN d BETWEEN DATE '1912-07-30' AND DATE '1926-12-25' THEN '大' || (year(d) - 1911) || '、' || month(d) || '、' || day(d)
  WHEN d BETWEEN DATE '1926-12-25' AND DATE '1989-01-07' THEN '昭' || (year(d) - 1925) || '、' || month(d) || '、' || day(d) END AS t FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 840 MONTH AS DATE) AS d FROM orders) a) b"""
_AGREE = """SELECT cell_id, user_id, CASE WHEN bool_or(trim(coalesce(human, ''), ' ') = '') OR NOT bool_or(trim(coalesce(name_raw, ''), ' ') <> '') THEN 'no_human_value' WHEN bool_or(name_raw = human) THEN 'agree'
 WHEN bool_or(translate(name_raw, '〓冶乍', '　治作') = translate(human, '〓冶乍', '　治作')) THEN 'variant_equal' ELSE 'disagree' END AS status
 FROM (SELECT DISTINCT c.cell_id, c.user_id, c.name_raw, h.human FROM cell_label c JOIN (SELECT cell_id, arg_min_null(name_raw, user_id) AS human FROM cell_label GROUP BY cell_id) h ON c.cell_id = h.cell_id) x GROUP BY ALL"""
_IDENT = "coalesce(as_of_date, '') || '|' || coalesce(name_raw, '') || '|' || coalesce(branch_code, '')"
_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(5), lambda i: CAST(('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8)) AS BIGINT))), lambda a, b: (a * 96 + b) % 100)"
_HOLD = f"SELECT obs_id, as_of_date, academy_id, CASE WHEN {_MOD} < 30 THEN 'holdout' ELSE 'train' END AS use_flag FROM (SELECT *, sha1(academy_id || 'salt-1') AS h FROM (SELECT obs_id, as_of_date, substr(sha1(k || '|' || (row_number() OVER (PARTITION BY k ORDER BY obs_id) - 1)), 1, 16) AS academy_id FROM (SELECT DISTINCT obs_id, as_of_date, {_IDENT} AS k, name_raw, branch_code FROM observation) d) e) f"

SQL = {
    "era_date_format_parse": f"""SELECT o_orderkey, text, CASE WHEN o_orderkey % 10 NOT IN (3, 7) THEN CAST(d AS VARCHAR) END AS day,
 CASE WHEN o_orderkey % 10 = 3 THEN 'expected year/month/day, got 4 part(s)' WHEN o_orderkey % 10 = 7 THEN 'month 13 out of range' END AS reason FROM ({_ERA_TEXT}) t""",
    "title_date_extract": f"SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'no date' WHEN o_orderkey % 10 = 7 THEN 'refused' ELSE 'would write' END AS state, count(*) AS n FROM ({_ERA_TEXT}) t GROUP BY 1",
    "fold_variants": f"SELECT lang, count(*) AS n, count(*) FILTER ({_FOLD_SQL.format('trim(text, chr(32))')} <> trim(text, ' ')) AS changed FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "token_counts": """SELECT fmt, CAST(coalesce(sum(len(regexp_extract_all(text, '-->'))), 0) AS BIGINT) AS arrows, CAST(coalesce(sum(len(regexp_extract_all(text, '[0-9]+'))), 0) AS BIGINT) AS numbers,
 CAST(coalesce(sum(len(regexp_extract_all(text, '\\n\\n'))), 0) AS BIGINT) AS breaks FROM documents GROUP BY fmt""",
    "seniority_numbers": """SELECT DISTINCT obs_id, text, CASE WHEN regexp_matches(translate(text, '０１２３４５６７８９', '0123456789'), '^[0-9]+$') THEN CAST(translate(text, '０１２３４５６７８９', '0123456789') AS BIGINT) END AS value,
 CASE WHEN NOT regexp_matches(translate(text, '０１２３４５６７８９', '0123456789'), '^[0-9]+$') THEN 'not a plain number' END AS reason FROM (SELECT obs_id, CASE WHEN seniority_no % 5 = 0 THEN translate(CAST(seniority_no AS VARCHAR), '0123456789', '０１２３４５６７８９')
 WHEN seniority_no % 7 = 0 THEN seniority_no || '?' ELSE CAST(seniority_no AS VARCHAR) END AS text FROM observation_in) x WHERE text IS NOT NULL""",
    "geta_marks": "SELECT label_id, CAST(length(coalesce(name_raw, '')) - length(replace(coalesce(name_raw, ''), '〓', '')) AS INTEGER) AS geta, regexp_replace(replace(replace(regexp_replace(coalesce(name_raw, ''), '(?s)\\(.*?\\)|\\[.*?\\]', '', 'g'), '〔?〕', ''), '〓', ''), '[^\\x{3000}-\\x{9FFF}0-9A-Za-z]', '', 'g') AS stripped FROM (SELECT DISTINCT label_id, name_raw FROM cell_label) x",
    "lexicon_suggest_lev": """WITH l AS (SELECT p_name AS entry, min(p_partkey) AS ordinal FROM part GROUP BY p_name), r AS (SELECT DISTINCT substr(entry, 1, 3) || substr(entry, 5, 50) AS reading FROM l),
 m AS (SELECT reading, entry, ordinal, 1 - levenshtein(reading, entry) / CAST(greatest(length(reading), length(entry)) AS DOUBLE) AS score FROM r, l),
 k AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY score DESC, ordinal) AS place FROM m),
 t AS (SELECT reading, max(entry) FILTER (place = 1) AS best, max(score) FILTER (place = 1) AS b, max(score) FILTER (place = 2) AS u FROM k GROUP BY reading)
 SELECT reading, best, round(b, 4) AS best_score, round(b - coalesce(u, 0), 4) AS margin, CASE WHEN b >= 0.9 AND b - coalesce(u, 0) >= 0.15 THEN 'PROBABLE' WHEN b >= 0.6 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status FROM r LEFT JOIN t USING (reading)""",
    "agreement_status": _AGREE,
    "worst_agreement": f"SELECT cell_id, arg_max(status, CASE status WHEN 'disagree' THEN 3 WHEN 'variant_equal' THEN 2 WHEN 'agree' THEN 1 ELSE 0 END) AS worst FROM ({_AGREE}) a GROUP BY cell_id",
    "length_buckets": """SELECT CASE WHEN s >= 0.9 THEN '>=0.90' WHEN s >= 0.8 THEN '0.80-0.90' WHEN s >= 0.7 THEN '0.70-0.80' WHEN s >= 0.5 THEN '0.50-0.70' ELSE '<0.50' END AS bucket, count(*) AS n, round(avg(n_chars), 6) AS mean
 FROM (SELECT n_cues / (n_chars / 60.0) AS s, n_chars FROM documents WHERE n_chars > 0 AND n_cues >= 0) x GROUP BY 1""",
    "holdout_split": f"SELECT obs_id, academy_id, use_flag FROM ({_HOLD}) h",
    "split_coverage": f"SELECT as_of_date, count(*) FILTER (use_flag = 'train') AS train, count(*) FILTER (use_flag = 'holdout') AS holdout, count(*) FILTER (use_flag = 'holdout') = 0 AS uncovered FROM ({_HOLD}) h GROUP BY as_of_date",
}

for _query in (machine_readings, text_line_filter,):
    QUERIES[_query.__name__] = _query
SQL |= {
    "text_line_filter": """SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) >= 6) AS counted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) x WHERE NOT regexp_matches(line, '-->|^[0-9]+\\r?$|^\\r?$') GROUP BY doc_id""",
}
SQL["machine_readings"] = f"SELECT reading, 'lexicon' AS engine, reading AS value, coalesce(best_score, 0.0) AS confidence FROM ({SQL['lexicon_suggest_lev']}) s"
