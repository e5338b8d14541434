"""Registered queries of the record operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions.dates import era_date
from inkledger.operators import records as R
from inkledger.session import table


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return R.cell_parts(table(spark, sf, "observation"))


def record_export(spark, sf):
    t = lambda n: table(spark, sf, n)
    return R.officer_record(t("observation"), t("source_volume"), t("rank_vocab"), t("branch_vocab"), t("app_user")).orderBy("pid", "frame_no", "row_index", "obs_id")


def work_log(spark, sf):
    log = table(spark, sf, "observation").select(F.col("obs_id").alias("log_id"), F.col("author_user_id").alias("user_id"), F.col("created_at").alias("at"), F.col("status").alias("action"))
    return R.work_log(log, table(spark, sf, "app_user")).select("log_id", "at", "action", "author")


def page_observations(spark, sf):
    rows = _parts(spark, sf).select("page_id", "row_index", "obs_id", "name_raw", "seniority_no", "created_at")
    return R.last_by(rows, ["page_id", "row_index"], ["created_at", "obs_id"])


def worker_listing(spark, sf):
    return R.counted_authors(table(spark, sf, "app_user"), table(spark, sf, "observation_in"), "author_user_id")


def volume_progress(spark, sf):
    return R.progress(_parts(spark, sf).select("volume_id", "frame_no", "row_index", "created_at"))


def volume_progress_rollup(spark, sf):
    return R.progress_rollup(volume_progress(spark, sf))


def volume_lookup(spark, sf):
    return table(spark, sf, "source_volume").where(F.col("pid") == "7701200").select("volume_id", "title", "edition_date")


def users_with_readings(spark, sf):
    seen = table(spark, sf, "observation_in").select(F.col("author_user_id").alias("user_id"))
    return table(spark, sf, "app_user").join(seen, "user_id", "left_semi").select("user_id", R.display_name().alias("author"))


def _before(spark, sf, late: bool) -> DataFrame:
    rows = table(spark, sf, "observation").where("cell_id IS NOT NULL")
    cut = F.col("created_at") >= F.lit("2024-10-01").cast("timestamp")
    rows = rows.where(cut if late else ~cut).select("cell_id", "obs_id", "name_raw", "post", "status", "created_at")
    return R.last_by(rows, ["cell_id"], ["created_at", "obs_id"])


def upsert_latest(spark, sf):
    return R.merge_latest(_before(spark, sf, False), _before(spark, sf, True), ["cell_id"], ["obs_id", "status"], ["name_raw", "post"])


def insert_missing(spark, sf):
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL").select("person_id", "as_of_date")
    return R.insert_missing(rows.where("as_of_date <= '1916-10-01'"), rows.where("as_of_date > '1916-10-01'"), ["person_id"])


def dedup_first(spark, sf):
    rows = table(spark, sf, "observation_in").select("obs_id", "volume_id", "seniority_no", "post").where("coalesce(seniority_no, 0) <> 0 OR coalesce(post, '') <> ''").distinct()
    return R.first_of(rows, ["volume_id", "seniority_no", "post"], ["obs_id"])


def snapshot_changes(spark, sf):
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL").select("obs_id", "person_id", "as_of_date", "created_at", "rank_code", "post").distinct()
    return R.changed_snapshots(rows, "person_id", ["as_of_date", "created_at", "obs_id"], ["rank_code", "post"]).select("obs_id", "person_id", "rank_code", "post")


def _catalogue(spark, sf, trusted: bool):
    """The latest reading of every person that has been confirmed, or that has not."""
    sure = F.col("status").isin("confirmed", "adjudicated")
    rows = table(spark, sf, "observation").where(F.col("person_id").isNotNull() & (sure if trusted else ~sure))
    return R.last_by(rows.select("person_id", "rank_code", "branch_code", "created_at", "obs_id"), ["person_id"], ["created_at", "obs_id"])


def catalogue_union(spark, sf):
    return R.union_catalogues(_catalogue(spark, sf, True), _catalogue(spark, sf, False), "person_id", ("older", "newer"), ["rank_code", "branch_code"])


def catalogue_tallies(spark, sf):
    source = F.col("source")
    return catalogue_union(spark, sf).agg(F.count_if(source == "older").alias("older_only"), F.count_if(source == "newer").alias("newer_only"), F.count_if(source == "older+newer").alias("both"))


def duplicate_deliveries(spark, sf):
    return R.duplicate_keys(table(spark, sf, "observation_in"), ["obs_id"])


def confidence_marks(spark, sf):
    return R.confidence_marks(table(spark, sf, "observation_in").select("obs_id", "field_confidence").distinct(), "field_confidence", "low").select("obs_id", "marked")


def readings_built(spark, sf):
    rows = table(spark, sf, "observation_in").distinct()
    return R.build_readings(rows, era_date(F.col("commissioning_date"), F.col("context_era")))


def constraint_violations(spark, sf):
    t = lambda n: table(spark, sf, n)
    obs, vol = t("observation"), t("source_volume")
    unknown = obs.join(t("rank_vocab"), "rank_code", "left_anti").where("rank_code IS NOT NULL")
    orphan = R.cell_parts(obs).join(vol, "volume_id", "left_anti")
    return R.constraint_violations(
        [
            ("rank_closed", unknown, "rank_code", F.lit(True)),
            ("volume_known", orphan, "volume_id", F.lit(True)),
            ("as_of_present", obs, "obs_id", F.col("as_of_date").isNull()),
            ("status_enumerated", obs, "status", ~F.col("status").isin("draft", "confirmed", "flagged", "adjudicated")),
            ("own_or_propagated", obs, "obs_id", F.col("propagated_from") == F.col("obs_id")),
            ("exactly_one", obs, "obs_id", R.not_exactly_one("person_id", "propagated_from")),
            ("interval_order", t("branch_vocab").unionByName(t("rank_vocab").withColumnRenamed("rank_code", "branch_code"), allowMissingColumns=True), "branch_code", R.ends_before("valid_from", "valid_to")),
            ("interval_order", obs, "obs_id", R.ends_before("commissioning_date", "as_of_date")),
        ]
    )


def swap_suggestions(spark, sf):
    names = table(spark, sf, "observation_in").select("obs_id", "name_raw").distinct()
    return R.swap_suggestions(names, "obs_id", "name_raw", table(spark, sf, "kanji_variant"))


def service_check(spark, sf):
    day, edition = F.col("commissioning_date").cast("date"), F.col("as_of_date").cast("date")
    months = F.floor(F.months_between(edition, day)).cast("int")
    rest = F.date_diff(edition, F.add_months(day, months))
    rows = table(spark, sf, "observation").where("commissioning_date IS NOT NULL AND seniority_no IS NOT NULL")
    written = rest + F.when(F.col("seniority_no") % 13 == 0, 3).otherwise(0)
    missed = R.service_mismatch(day, F.floor(months / 12).cast("int"), months % 12, written.cast("int"), edition)
    return rows.select("obs_id", missed.alias("days_off"), R.issue_pid(F.col("seniority_no")).alias("pid")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        record_export, work_log, page_observations, worker_listing, volume_progress, volume_progress_rollup, volume_lookup, users_with_readings,
        upsert_latest, insert_missing, dedup_first, snapshot_changes, catalogue_union, catalogue_tallies, duplicate_deliveries, confidence_marks,
        readings_built, constraint_violations,
    )
}

_PARTS = "SELECT *, split_part(cell_id, ':', 1) AS volume_id, CAST(split_part(cell_id, ':', 2) AS INTEGER) AS frame_no, CAST(split_part(cell_id, ':', 3) AS INTEGER) AS row_index FROM observation"
_PROGRESS = f"SELECT volume_id, frame_no, count(*) AS observations, count(DISTINCT row_index) AS rows_read, max(created_at) AS last_at FROM ({_PARTS}) p GROUP BY ALL"
_EDITION = "SELECT * FROM (SELECT person_id, rank_code, branch_code, row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC, obs_id DESC) AS n FROM observation WHERE status {0} ('confirmed', 'adjudicated') AND person_id IS NOT NULL) e WHERE n = 1"
_UNION = f"""SELECT coalesce(a.person_id, b.person_id) AS person_id, coalesce(a.rank_code, b.rank_code) AS rank_code, coalesce(a.branch_code, b.branch_code) AS branch_code,
 concat_ws('+', CASE WHEN a.person_id IS NOT NULL THEN 'older' END, CASE WHEN b.person_id IS NOT NULL THEN 'newer' END) AS source
 FROM ({_EDITION.format("IN")}) a FULL JOIN ({_EDITION.format("NOT IN")}) b ON a.person_id = b.person_id"""
_SIDE = "SELECT * FROM (SELECT cell_id, obs_id, name_raw, post, status, row_number() OVER (PARTITION BY cell_id ORDER BY created_at DESC, obs_id DESC) AS n FROM observation WHERE cell_id IS NOT NULL AND created_at {0} TIMESTAMP '2024-10-01') s WHERE n = 1"

SQL = {
    "record_export": f"""SELECT o.obs_id, v.pid, v.title, v.edition_date, o.frame_no, o.row_index, o.name_raw, r.label_ja AS rank_ja, r.label_en AS rank_en,
 b.label_ja AS branch_ja, b.label_en AS branch_en, o.post, o.seniority_no, o.commissioning_date, o.as_of_date, o.status, coalesce(u.display_name, '(unnamed)') AS author
 FROM ({_PARTS}) o JOIN source_volume v USING (volume_id) LEFT JOIN rank_vocab r USING (rank_code) LEFT JOIN branch_vocab b USING (branch_code) LEFT JOIN app_user u ON o.author_user_id = u.user_id""",
    "work_log": "SELECT o.obs_id AS log_id, o.created_at AS \"at\", o.status AS action, CASE WHEN u.user_id IS NOT NULL THEN coalesce(u.display_name, '(unnamed)') END AS author FROM observation o LEFT JOIN app_user u ON o.author_user_id = u.user_id",
    "page_observations": f"SELECT page_id, row_index, obs_id, name_raw, seniority_no, created_at FROM (SELECT *, row_number() OVER (PARTITION BY page_id, row_index ORDER BY created_at DESC, obs_id DESC) AS n FROM ({_PARTS}) p) s WHERE n = 1",
    "worker_listing": "SELECT u.user_id, coalesce(u.display_name, '(unnamed)') AS author, count(o.obs_id) AS n_readings FROM app_user u LEFT JOIN observation_in o ON o.author_user_id = u.user_id GROUP BY u.user_id, u.display_name",
    "volume_progress": _PROGRESS,
    "volume_progress_rollup": f"SELECT volume_id, count(*) AS frames, CAST(sum(observations) AS BIGINT) AS observations FROM ({_PROGRESS}) f GROUP BY volume_id",
    "volume_lookup": "SELECT volume_id, title, edition_date FROM source_volume WHERE pid = '7701200'",
    "users_with_readings": "SELECT user_id, coalesce(display_name, '(unnamed)') AS author FROM app_user u WHERE EXISTS (SELECT 1 FROM observation_in o WHERE o.author_user_id = u.user_id)",
    "upsert_latest": f"""SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, CASE WHEN a.cell_id IS NOT NULL THEN a.obs_id ELSE b.obs_id END AS obs_id, CASE WHEN a.cell_id IS NOT NULL THEN a.status ELSE b.status END AS status,
 CASE WHEN b.cell_id IS NOT NULL THEN b.name_raw ELSE a.name_raw END AS name_raw, CASE WHEN b.cell_id IS NOT NULL THEN b.post ELSE a.post END AS post,
 CASE WHEN a.cell_id IS NOT NULL AND b.cell_id IS NOT NULL THEN 'updated' WHEN b.cell_id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
 FROM ({_SIDE.format("<")}) a FULL JOIN ({_SIDE.format(">=")}) b ON a.cell_id = b.cell_id""",
    "insert_missing": "SELECT DISTINCT person_id FROM observation WHERE as_of_date > '1916-10-01' AND person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM observation WHERE as_of_date <= '1916-10-01' AND person_id IS NOT NULL)",
    "dedup_first": "SELECT min(obs_id) AS obs_id, volume_id, seniority_no, post FROM observation_in WHERE coalesce(seniority_no, 0) <> 0 OR coalesce(post, '') <> '' GROUP BY volume_id, seniority_no, post",
    "snapshot_changes": """SELECT obs_id, person_id, rank_code, post FROM (SELECT *, row_number() OVER w AS k, lag(rank_code) OVER w AS r, lag(post) OVER w AS q
 FROM (SELECT DISTINCT obs_id, person_id, as_of_date, created_at, rank_code, post FROM observation WHERE person_id IS NOT NULL) d
 WINDOW w AS (PARTITION BY person_id ORDER BY as_of_date, created_at, obs_id)) s WHERE k = 1 OR rank_code IS DISTINCT FROM r OR post IS DISTINCT FROM q""",
    "catalogue_union": _UNION,
    "catalogue_tallies": f"SELECT count(*) FILTER (source = 'older') AS older_only, count(*) FILTER (source = 'newer') AS newer_only, count(*) FILTER (source = 'older+newer') AS \"both\" FROM ({_UNION}) u",
    "duplicate_deliveries": "SELECT obs_id, count(*) AS n FROM observation_in GROUP BY obs_id HAVING count(*) > 1",
    "confidence_marks": """SELECT obs_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (json_extract_string(field_confidence, '$."' || k || '"') = 'low'), '') AS marked
 FROM (SELECT obs_id, field_confidence, unnest(coalesce(json_keys(field_confidence), [''])) AS k FROM (SELECT DISTINCT obs_id, field_confidence FROM observation_in) d) s GROUP BY obs_id""",
    "constraint_violations": """SELECT 'rank_closed' AS constraint_name, rank_code AS key, count(*) AS n FROM observation WHERE rank_code NOT IN (SELECT rank_code FROM rank_vocab) GROUP BY rank_code
 UNION ALL SELECT 'volume_known', split_part(cell_id, ':', 1), count(*) FROM observation WHERE split_part(cell_id, ':', 1) NOT IN (SELECT volume_id FROM source_volume) GROUP BY 2
 UNION ALL SELECT 'as_of_present', CAST(obs_id AS VARCHAR), count(*) FROM observation WHERE as_of_date IS NULL GROUP BY obs_id
 UNION ALL SELECT 'status_enumerated', status, count(*) FROM observation WHERE status NOT IN ('draft', 'confirmed', 'flagged', 'adjudicated') GROUP BY status
 UNION ALL SELECT 'own_or_propagated', CAST(obs_id AS VARCHAR), count(*) FROM observation WHERE propagated_from = obs_id GROUP BY obs_id
 UNION ALL SELECT 'exactly_one', CAST(obs_id AS VARCHAR), count(*) FROM observation WHERE (person_id IS NULL) = (propagated_from IS NULL) GROUP BY obs_id
 UNION ALL SELECT 'interval_order', code, count(*) FROM (SELECT branch_code AS code, valid_from, valid_to FROM branch_vocab UNION ALL SELECT rank_code, valid_from, valid_to FROM rank_vocab) v WHERE valid_to < valid_from GROUP BY code
 UNION ALL SELECT 'interval_order', CAST(obs_id AS VARCHAR), count(*) FROM observation WHERE as_of_date < commissioning_date GROUP BY obs_id""",
}

for _query in (swap_suggestions, service_check,):
    QUERIES[_query.__name__] = _query
SQL |= {
    "swap_suggestions": """SELECT obs_id, CAST(min(i) AS INTEGER) AS "at", c AS "from", t AS "to" FROM (SELECT obs_id, i - 1 AS i, substr(name_raw, CAST(i AS BIGINT), 1) AS c FROM (SELECT obs_id, name_raw, unnest(range(1, length(name_raw) + 1)) AS i FROM (SELECT DISTINCT obs_id, name_raw FROM observation_in WHERE name_raw IS NOT NULL) d) e) x
 JOIN (SELECT variant_char AS f, canonical_char AS t FROM kanji_variant WHERE length(variant_char) = 1 AND length(canonical_char) = 1 UNION SELECT canonical_char, variant_char FROM kanji_variant WHERE length(variant_char) = 1 AND length(canonical_char) = 1) p ON x.c = p.f GROUP BY obs_id, c, t""",
    "service_check": """SELECT DISTINCT obs_id, CASE WHEN seniority_no % 13 = 0 THEN -3 ELSE 0 END AS days_off, seniority_no + 2956479 AS pid FROM observation WHERE commissioning_date IS NOT NULL AND seniority_no IS NOT NULL""",
}
