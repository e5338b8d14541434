"""Registered queries of entries, page work and field binning with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.functions import readings as T
from inkledger.functions.dates import era_date
from inkledger.operators import entries as E
from inkledger.operators import geometry as G
from inkledger.operators import harvest as H
from inkledger.operators import matching as M
from inkledger.operators import planned as P
from inkledger.operators import records as R
from inkledger.operators import sequences as S
from inkledger.operators import vocabularies as V
from inkledger.plans.vocabularies import validate_all
from inkledger.session import table


def _known(spark, sf):
    """Pages and cells that a confirmed reading has registered."""
    rows = R.cell_parts(table(spark, sf, "observation").where("status = 'confirmed'").select("page_id", "cell_id"))
    dated = table(spark, sf, "source_volume").select("volume_id", F.when(F.col("coverage_notes").isNotNull(), F.col("edition_date")).alias("edition_date"))
    pages = rows.select("volume_id", "frame_no", "page_id").distinct().join(dated, "volume_id")
    return pages, rows.select("page_id", "row_index", "cell_id").distinct()


def rejects(spark, sf):
    entries = R.cell_parts(table(spark, sf, "observation").select("obs_id", "cell_id").distinct()).drop("cell_id")
    return E.guarded(entries, *_known(spark, sf)).where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first"))


def _drafts(spark, sf):
    entries = table(spark, sf, "observation_in").distinct()
    dated = table(spark, sf, "source_volume").select("volume_id", "edition_date")
    page = F.concat_ws(":", "volume_id", F.col("frame_no").cast("string"))
    pages = entries.select("volume_id", "frame_no", page.alias("page_id")).distinct().join(dated, "volume_id")
    cells = entries.select(page.alias("page_id"), "row_index", F.concat_ws(":", page, F.col("row_index").cast("string")).alias("cell_id")).distinct()
    accepted = E.guarded(entries, pages, cells).where("reject_reason IS NULL")
    return E.created(accepted, era_date(F.col("commissioning_date"), F.col("context_era")))


def drafts_created(spark, sf):
    marks = F.map_filter("confidence", lambda k, v: ~k.isin("commissioning_date", "notes"))
    return _drafts(spark, sf).select("obs_id", "cell_id", "as_of_date", "status", F.col("confidence").getItem("notes").alias("notes"), F.size(marks).cast("bigint").alias("marks"))


def creation_log(spark, sf):
    return E.creation_log(_drafts(spark, sf)).groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"), F.max("obs_id").alias("last"))


def page_resolve(spark, sf):
    pages = R.cell_parts(table(spark, sf, "observation").select("page_id", "cell_id")).select("page_id", "volume_id", "frame_no").distinct()
    return E.resolved_pages(pages, table(spark, sf, "source_volume"))


def page_listing(spark, sf):
    obs = table(spark, sf, "observation").select("obs_id", "page_id", "cell_id", "name_raw", "status", "author_user_id").distinct()
    cells = R.cell_parts(obs.select("cell_id").where("cell_id IS NOT NULL").distinct()).where("row_index IS NOT NULL")
    return E.page_listing(obs, cells, table(spark, sf, "app_user")).select("page_id", "row_index", "obs_id", "name_raw", "status", "author").orderBy("page_id", "row_index", "obs_id")


def field_update(spark, sf):
    return E.with_value(table(spark, sf, "source_volume").select("volume_id", "title"), "volume_id", F.lit("vol-s01"), "title", F.lit("調査団列次名簿（訂正）"))


def edition_backfill(spark, sf):
    """Volumes whose title names their date in the era's form, every second one without a date of its own."""
    vol = table(spark, sf, "source_volume")
    day = F.col("edition_date").cast("date")
    taisho = F.concat(F.lit("大正"), (F.year(day) - 1911).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日調"))
    rows = vol.select("volume_id", F.when(F.col("coverage_notes").isNotNull(), F.col("edition_date")).alias("present"), F.concat(F.col("title"), F.lit(" "), F.when(day >= "1912-07-30", taisho).otherwise(F.lit("調"))).alias("title"))
    rows = rows.withColumn("found", T.era_in_title("title")).withColumn("d", era_date(F.col("found")))
    return rows.groupBy(E.backfill_state(F.col("present"), F.col("found"), F.col("d.value")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def worklist_order(spark, sf):
    return E.by_year(table(spark, sf, "source_volume").select(F.substring("edition_date", 1, 4).alias("year"), "pid", "volume_id"), "year", "pid")


def expected_seniority(spark, sf):
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL").select("as_of_date", "person_id", "seniority_no", "created_at", "obs_id")
    last = R.last_by(rows, ["as_of_date", "person_id"], ["created_at", "obs_id"])
    return E.expected_order(last, ["as_of_date"], "seniority_no", "person_id").select("as_of_date", "person_id", "expected")


def variants_json(spark, sf):
    one = lambda name, code: table(spark, sf, name).select(F.col(code).alias("code"), E.variants_json(F.col("variants")).alias("variants"))
    return one("rank_vocab", "rank_code").unionByName(one("branch_vocab", "branch_code"))


def portable_types(spark, sf):
    rows = table(spark, sf, "officers").distinct().select("officer_id", "dates", (F.col("cohort") > 20).alias("late"), F.make_date(F.col("cohort") + 1893, F.lit(5), F.lit(1)).alias("day"), (F.col("seniority") / 4).cast("decimal(12,2)").alias("quarter"))
    return E.portable(rows)


def extra_issues(spark, sf):
    title = F.concat(F.lit("官報 "), F.col("o_orderdate").cast("date").cast("string"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" 号外")).when(F.col("o_orderpriority") == "2-HIGH", F.lit(" 號外二")).otherwise(F.lit("")))
    rows = table(spark, sf, "orders").select("o_orderstatus", H.extra_issue(title).alias("extra"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("issues"), F.count_if("extra").alias("extra"))


def frame_contents(spark, sf):
    rows = R.cell_parts(table(spark, sf, "observation").select("cell_id", "rank_code", "status"))
    contents = rows.where("status = 'adjudicated' AND rank_code IS NOT NULL").select("volume_id", "frame_no", "rank_code").distinct()
    marked = H.annotated_frames(rows.select("volume_id", "frame_no").distinct(), contents, ["volume_id", "frame_no"], "rank_code")
    return marked.select("volume_id", "frame_no", F.array_join("labels", ";").alias("labels"))


def _page_texts(spark, sf):
    """What the first and the last reader of each row wrote, as pages of two engines."""
    rows = table(spark, sf, "observation_in").where("name_raw IS NOT NULL").select("volume_id", "frame_no", "row_index", "obs_id", "name_raw").distinct()
    own = rows.groupBy("volume_id", "frame_no", "row_index").agg(F.min_by("name_raw", "obs_id").alias("a"), F.max_by("name_raw", "obs_id").alias("b"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", c))), lambda s: s[c]), "")
    pages = own.groupBy("volume_id", "frame_no").agg(joined("a").alias("a"), joined("b").alias("b"))
    return pages.select("volume_id", "frame_no", F.col("a").alias("text")), pages.where("b <> a OR frame_no > 1").select("volume_id", "frame_no", F.col("b").alias("text"))


def page_likeness(spark, sf):
    return M.page_agreement(*_page_texts(spark, sf), "volume_id", "frame_no")


def page_agreement(spark, sf):
    return M.agreement_summary(page_likeness(spark, sf), "volume_id", "frame_no")


def _boxes(spark, sf):
    """Printed officers as the boxes of their column, in order of line."""
    rows = table(spark, sf, "officers").distinct()
    box = lambda line, text, place, width: F.struct(F.lit(line).alias("line"), text.alias("text"), F.lit(place).alias("place"), F.lit(width).alias("width"))
    number = lambda c: F.col(c).cast("string")
    listed = F.transform(F.coalesce("dates", F.array().cast("array<string>")), lambda d, i: F.struct((F.lit(20) + i).alias("line"), d.alias("text"), F.lit(0.3).alias("place"), F.lit(10.0).alias("width")))
    others = F.transform("other", lambda d, i: F.struct((F.lit(60) + i).alias("line"), d.alias("text"), F.lit(0.5).alias("place"), F.lit(10.0).alias("width")))
    fixed = F.array(box(1, F.col("post"), 0.1, 10.0), box(2, number("seniority"), 0.4, 10.0), box(3, F.col("name"), 0.75, 14.0), box(4, F.col("reading"), 0.76, 6.0), box(5, F.col("birth"), 0.9, 10.0), box(6, F.col("honors"), 0.7, 10.0), box(7, number("cohort"), 0.95, 10.0), box(8, number("frame_no"), 0.45, 10.0))
    return rows.select("officer_id", F.explode(F.concat(fixed, listed, others)).alias("b")).select("officer_id", "b.*").where("text IS NOT NULL")


def column_fields(spark, sf):
    # The text of a box is trimmed of every kind of white space before it is judged.
    boxes = _boxes(spark, sf).withColumn("text", F.regexp_replace("text", "(?U)^\\s+|\\s+$", ""))
    rows = M.fields_of_columns(boxes, "officer_id")
    return rows.select("officer_id", "seniority", "cohort", "name", "reading", "post", F.array_join("dates", ";").alias("dates"), "birth", "honours", F.size("other").cast("bigint").alias("others"))


def engine_disagreement(spark, sf):
    from inkledger.plans.texts import worst_agreement

    rows = worst_agreement(spark, sf).select("cell_id", F.lit(None).cast("string").alias("page_id"), F.col("worst").alias("status"))
    return V.engine_disagreement(rows, "status").select("cell_id", "code", "detail")


def next_after(spark, sf):
    rows = R.cell_parts(table(spark, sf, "observation").select("cell_id")).select("volume_id", "frame_no").distinct()
    current = rows.select("volume_id", F.col("frame_no").alias("at")).unionByName(rows.groupBy("volume_id").agg((F.max("frame_no") + 3).alias("at")))
    return S.next_after(rows, current, ["volume_id"], "frame_no")


def page_labels(spark, sf):
    frames = R.cell_parts(table(spark, sf, "observation").select("cell_id")).select("volume_id", "frame_no").distinct()
    numbers = table(spark, sf, "source_volume").select("volume_id", F.regexp_extract("volume_id", "([0-9]+)$", 1).cast("int").alias("k"))
    model = numbers.where("k % 3 <> 2").select("volume_id", F.when(F.col("k") % 2 == 0, 2).otherwise(1).alias("slope"), (F.col("k") % 5 - 4).alias("offset"))
    return S.page_labels(frames, model, ["volume_id"], "frame_no")


def column_totals(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("page"), F.pmod("vec_id", F.lit(4)).alias("frame"), F.round(F.col("embedding")[0].cast("double") * 1000).alias("x"), "vec_id")
    clusters = S.gap_clusters(rows, ["page", "frame"], "x", "vec_id", 6.0, 5)
    return S.cluster_totals(clusters.withColumn("n", F.col("cluster")), "page", "frame")


def largest_regions(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 50).alias("h"))
    return G.largest_regions(rows, "p_brand", "p_partkey")


def review_tasks(spark, sf):
    open_tasks = table(spark, sf, "observation").where("status = 'flagged'").select("cell_id").distinct()
    return E.tasks_of(validate_all(spark, sf), open_tasks)


def inserted_count(spark, sf):
    from inkledger.plans.records import insert_missing

    return insert_missing(spark, sf).agg(F.count(F.lit(1)).alias("inserted"))


def text_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sha256("text").alias("digest"))


def event_scores(spark, sf):
    """Commissions that drafts and flagged readings show against those that others do."""
    rows = table(spark, sf, "observation").where("person_id IS NOT NULL AND commissioning_date IS NOT NULL")
    trusted = F.col("status").isin("confirmed", "adjudicated")
    return P.event_scores(rows.where(~trusted), rows.where(trusted), ["person_id", "commissioning_date"])


def worklist_coverage(spark, sf):
    rows = R.cell_parts(table(spark, sf, "observation").select("page_id", "cell_id", "status"))
    return P.coverage(rows.where("status = 'confirmed'"), rows, ["page_id"], "volume_id")


def reader_agreement(spark, sf):
    """Share of pairs of labels of a cell that are equal, by field."""
    rows = table(spark, sf, "cell_label").distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("name_raw", "seniority_no", "commissioning_date")]))
    counted = rows.select("cell_id", pairs.alias("v")).where("v.value IS NOT NULL").groupBy("cell_id", "v.field", "v.value").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.groupBy("cell_id", "field").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    return cells.groupBy("field").agg(F.round(F.sum("same") / F.sum(F.col("m") * (F.col("m") - 1)), 6).alias("agreement"))


_QUERIES = (
    rejects, drafts_created, creation_log, page_resolve, page_listing, field_update, edition_backfill, worklist_order, expected_seniority, variants_json, portable_types,
    extra_issues, frame_contents, page_likeness, page_agreement, column_fields, engine_disagreement, next_after, page_labels, column_totals, largest_regions, review_tasks,
    inserted_count, text_hashes, event_scores, worklist_coverage, reader_agreement,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_CELL = "split_part(cell_id, ':', 1) AS volume_id, CAST(split_part(cell_id, ':', 2) AS INTEGER) AS frame_no, CAST(split_part(cell_id, ':', 3) AS INTEGER) AS row_index"
_PAGES = f"SELECT DISTINCT o.page_id, o.volume_id, o.frame_no, CASE WHEN v.coverage_notes IS NOT NULL THEN v.edition_date END AS edition_date FROM (SELECT page_id, {_CELL} FROM observation WHERE status = 'confirmed') o JOIN source_volume v USING (volume_id)"
_LABELS = "SELECT cell_id, f, x, count(*) AS n FROM (SELECT cell_id, 'name_raw' AS f, name_raw AS x FROM l UNION ALL SELECT cell_id, 'seniority_no', CAST(seniority_no AS VARCHAR) FROM l UNION ALL SELECT cell_id, 'commissioning_date', commissioning_date FROM l) s WHERE x IS NOT NULL GROUP BY ALL"
_TRIM = r"regexp_replace({0}, '^[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_BOXES = """SELECT officer_id, 1 AS line, post AS text, 0.1 AS place, 10.0 AS width FROM d UNION ALL SELECT officer_id, 2, CAST(seniority AS VARCHAR), 0.4, 10.0 FROM d UNION ALL SELECT officer_id, 3, name, 0.75, 14.0 FROM d
 UNION ALL SELECT officer_id, 4, reading, 0.76, 6.0 FROM d UNION ALL SELECT officer_id, 5, birth, 0.9, 10.0 FROM d UNION ALL SELECT officer_id, 6, honors, 0.7, 10.0 FROM d UNION ALL SELECT officer_id, 7, CAST(cohort AS VARCHAR), 0.95, 10.0 FROM d
 UNION ALL SELECT officer_id, 8, CAST(frame_no AS VARCHAR), 0.45, 10.0 FROM d UNION ALL SELECT officer_id, 19 + generate_subscripts(dates, 1), unnest(dates), 0.3, 10.0 FROM d UNION ALL SELECT officer_id, 59 + generate_subscripts(other, 1), unnest(other), 0.5, 10.0 FROM d"""

SQL = {
    "rejects": f"""WITH p AS ({_PAGES}), c AS (SELECT DISTINCT page_id, {_CELL} FROM observation WHERE status = 'confirmed')
SELECT reason AS reject_reason, count(*) AS n, min(obs_id) AS first FROM (SELECT e.obs_id, CASE WHEN p.page_id IS NULL THEN 'page is not registered' WHEN p.edition_date IS NULL THEN 'volume has no edition date' WHEN c.page_id IS NULL THEN 'officer has no roster cell' END AS reason
 FROM (SELECT DISTINCT obs_id, {_CELL} FROM observation) e LEFT JOIN p USING (volume_id, frame_no) LEFT JOIN c ON c.page_id = p.page_id AND c.row_index = e.row_index) x WHERE reason IS NOT NULL GROUP BY 1""",
    "drafts_created": """SELECT e.obs_id, volume_id || ':' || frame_no || ':' || row_index AS cell_id, edition_date AS as_of_date, 'draft' AS status, nullif(trim(coalesce(e.notes, ''), ' '), '') AS notes,
 CAST(len(list_filter(json_keys(field_confidence), lambda k: k NOT IN ('commissioning_date', 'notes'))) AS BIGINT) AS marks FROM (SELECT DISTINCT * FROM observation_in) e JOIN source_volume v USING (volume_id) WHERE edition_date IS NOT NULL""",
    "creation_log": "SELECT author_user_id AS user_id, 'create_observation' AS action, count(*) AS n, max(obs_id) AS last FROM (SELECT DISTINCT * FROM observation_in) e JOIN source_volume v USING (volume_id) WHERE edition_date IS NOT NULL GROUP BY ALL",
    "page_resolve": f"SELECT v.pid, o.frame_no, o.page_id, v.volume_id, v.title, v.edition_date FROM (SELECT DISTINCT page_id, volume_id, frame_no FROM (SELECT page_id, {_CELL} FROM observation) x) o JOIN source_volume v USING (volume_id)",
    "page_listing": f"SELECT page_id, row_index, obs_id, name_raw, status, coalesce(u.display_name, '(unnamed)') AS author FROM (SELECT DISTINCT obs_id, page_id, cell_id, name_raw, status, author_user_id, {_CELL} FROM observation) o LEFT JOIN app_user u ON u.user_id = o.author_user_id WHERE row_index IS NOT NULL",
    "field_update": "SELECT volume_id, CASE WHEN volume_id = 'vol-s01' THEN '調査団列次名簿（訂正）' ELSE title END AS title FROM source_volume",
    "edition_backfill": """SELECT CASE WHEN coverage_notes IS NOT NULL AND trim(edition_date, ' ') <> '' THEN 'already set' WHEN edition_date < '1912-07-30' THEN 'no date' WHEN edition_date > '1926-12-25' THEN 'refused' ELSE 'would write' END AS state, count(*) AS n FROM source_volume GROUP BY 1""",
    "worklist_order": "SELECT substr(edition_date, 1, 4) AS year, pid, volume_id FROM source_volume ORDER BY 1, 2",
    "expected_seniority": "SELECT as_of_date, person_id, CAST(row_number() OVER (PARTITION BY as_of_date ORDER BY seniority_no NULLS LAST, person_id) AS INTEGER) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, person_id ORDER BY created_at DESC, obs_id DESC) AS k FROM observation WHERE person_id IS NOT NULL) q WHERE k = 1",
    "variants_json": "".join(
        f"{' UNION ALL ' if i else ''}SELECT {n}_code AS code, CAST(to_json(list_filter(list_transform(string_split(coalesce(variants, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS VARCHAR) AS variants FROM {n}_vocab" for i, n in enumerate(("rank", "branch"))
    ),
    "portable_types": "SELECT officer_id, CAST(to_json(dates) AS VARCHAR) AS dates, CAST(cohort > 20 AS INTEGER) AS late, strftime(make_date(cohort + 1893, 5, 1), '%Y-%m-%d') AS day, CAST(CAST(seniority / 4 AS DECIMAL(12, 2)) AS DOUBLE) AS quarter FROM (SELECT DISTINCT * FROM officers) o",
    "extra_issues": "SELECT o_orderstatus, count(*) AS issues, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS extra FROM orders GROUP BY 1",
    "frame_contents": f"""WITH o AS (SELECT {_CELL}, rank_code, status FROM observation) SELECT f.volume_id, f.frame_no, coalesce(labels, '') AS labels FROM (SELECT DISTINCT volume_id, frame_no FROM o) f
 LEFT JOIN (SELECT volume_id, frame_no, string_agg(DISTINCT rank_code, ';' ORDER BY rank_code) AS labels FROM o WHERE status = 'adjudicated' AND rank_code IS NOT NULL GROUP BY ALL) l ON l.volume_id = f.volume_id AND l.frame_no IS NOT DISTINCT FROM f.frame_no""",
    "column_fields": f"""WITH d AS (SELECT DISTINCT * FROM officers), b AS (SELECT officer_id, line, {_TRIM.format("text")} AS whole, CAST(place AS DOUBLE) AS place, CAST(width AS DOUBLE) AS width FROM ({_BOXES}) x WHERE text IS NOT NULL),
 t AS (SELECT *, replace(whole, ' ', '') AS t, try_cast(translate(replace(whole, ' ', ''), '０１２３４５６７８９', '0123456789') AS INTEGER) AS n, median(width) OVER (PARTITION BY officer_id) AS m FROM b),
 k AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^\\p{{Nd}}{{1,4}}$') THEN CASE WHEN place > 0.8 AND n < 60 THEN 'cohort' WHEN place > 0.3 AND place < 0.55 THEN 'seniority' ELSE 'other' END
  WHEN regexp_matches(t, '^[明大昭]') THEN CASE WHEN place > 0.6 THEN 'birth' ELSE 'date' END WHEN regexp_matches(t, '^[ァ-ヶー・]+$') AND place > 0.55 THEN 'reading'
  WHEN regexp_matches(t, '[从正勲功旭瑞]') AND place > 0.55 AND place < 0.82 AND length(t) <= 8 THEN 'honours' WHEN regexp_matches(t, '[長附官員部隊課級校]') AND place < 0.72 THEN 'post'
  WHEN place > 0.6 AND width >= 1.35 * (CASE WHEN m = 0 THEN 1 ELSE m END) AND NOT starts_with(t, '同') AND NOT regexp_matches(t, '[、。\\p{{Nd}}]') THEN 'name' ELSE 'other' END AS kind FROM t),
 f AS (SELECT *, CASE WHEN kind = 'seniority' AND line > min(line) FILTER (kind = 'seniority') OVER (PARTITION BY officer_id) THEN 'other' ELSE kind END AS fin FROM k WHERE kind IS NOT NULL)
 SELECT officer_id, max(n) FILTER (fin = 'seniority') AS seniority, arg_max(n, line) FILTER (fin = 'cohort') AS cohort, nullif(string_agg(whole, '' ORDER BY place, line) FILTER (fin = 'name'), '') AS name, string_agg(t, '' ORDER BY line) FILTER (fin = 'reading') AS reading,
 string_agg(t, '' ORDER BY line) FILTER (fin = 'post') AS post, coalesce(string_agg(t, ';' ORDER BY line) FILTER (fin = 'date'), '') AS dates, string_agg(t, '' ORDER BY line) FILTER (fin = 'birth') AS birth, string_agg(t, '' ORDER BY line) FILTER (fin = 'honours') AS honours,
 count(*) FILTER (fin = 'other') AS others FROM f GROUP BY officer_id""",
    "next_after": f"""WITH r AS (SELECT DISTINCT volume_id, frame_no FROM (SELECT {_CELL} FROM observation) x), c AS (SELECT volume_id, frame_no AS "at" FROM r UNION ALL SELECT volume_id, max(frame_no) + 3 FROM r GROUP BY 1)
 SELECT c.volume_id, c."at", min(n.v) AS next_unread FROM c JOIN (SELECT volume_id, frame_no + 1 AS v FROM r UNION SELECT volume_id, "at" + 1 FROM c) n ON n.volume_id = c.volume_id AND n.v > c."at" AND NOT EXISTS (SELECT 1 FROM r WHERE r.volume_id = n.volume_id AND r.frame_no = n.v) GROUP BY ALL""",
    "page_labels": f"""SELECT f.volume_id, f.frame_no, CASE WHEN k IS NULL OR k % 3 = 2 THEN 'printed page unknown' WHEN s * frame_no + o < 1 THEN 'front matter' WHEN s = 2 THEN 'pages ' || (s * frame_no + o - 1) || '-' || (s * frame_no + o) ELSE 'page ' || (s * frame_no + o) END AS label
 FROM (SELECT DISTINCT volume_id, frame_no FROM (SELECT {_CELL} FROM observation) x) f LEFT JOIN (SELECT volume_id, k, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS s, k % 5 - 4 AS o FROM (SELECT volume_id, CAST(regexp_extract(volume_id, '([0-9]+)$', 1) AS INTEGER) AS k FROM source_volume) y) v USING (volume_id)""",
    "column_totals": """WITH e AS (SELECT label AS page, vec_id % 4 AS frame, round(CAST(embedding[1] AS DOUBLE) * 1000) AS x, vec_id FROM embeddings), g AS (SELECT *, x - lag(x) OVER (PARTITION BY page, frame ORDER BY x, vec_id) AS s, count(*) OVER (PARTITION BY page, frame) AS m FROM e)
 SELECT page, count(*) AS frames, CAST(sum(n) AS BIGINT) AS columns, round_even(avg(n), 1) AS mean FROM (SELECT page, frame, 1 + count(*) FILTER (s > 6) AS n FROM g WHERE m >= 5 GROUP BY ALL) t GROUP BY page""",
    "largest_regions": "SELECT p_brand, arg_min(p_partkey, {'a': -CAST(p_size * (p_partkey % 50) AS DOUBLE), 'k': p_partkey}) AS p_partkey, CAST(max(p_size * (p_partkey % 50)) AS DOUBLE) AS area FROM part GROUP BY p_brand",
    "inserted_count": "SELECT count(*) AS inserted FROM (SELECT DISTINCT person_id FROM observation WHERE person_id IS NOT NULL AND as_of_date > '1916-10-01' EXCEPT SELECT person_id FROM observation WHERE as_of_date <= '1916-10-01') x",
    "text_hashes": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "event_scores": """WITH e AS (SELECT DISTINCT person_id, commissioning_date, status IN ('confirmed', 'adjudicated') AS t FROM observation WHERE person_id IS NOT NULL AND commissioning_date IS NOT NULL AND status IS NOT NULL),
 n AS (SELECT count(*) FILTER (f) AS found, count(*) FILTER (g) AS "true", count(*) FILTER (f AND g) AS "both" FROM (SELECT person_id, commissioning_date, bool_or(NOT t) AS f, bool_or(t) AS g FROM e GROUP BY ALL) x)
 SELECT *, round("both" / CAST(nullif(found, 0) AS DOUBLE), 6) AS precision, round("both" / CAST(nullif("true", 0) AS DOUBLE), 6) AS recall FROM n""",
    "worklist_coverage": f"""SELECT volume_id, count(*) AS items, count(*) FILTER (r) AS done, round(count(*) FILTER (r) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT page_id, volume_id, bool_or(status = 'confirmed') AS r FROM (SELECT page_id, status, {_CELL} FROM observation) x GROUP BY ALL) y GROUP BY volume_id""",
    "reader_agreement": f"WITH l AS (SELECT DISTINCT * FROM cell_label) SELECT f AS field, round(sum(same) / CAST(sum(m * (m - 1)) AS DOUBLE), 6) AS agreement FROM (SELECT cell_id, f, sum(n) AS m, sum(n * (n - 1)) AS same FROM ({_LABELS}) c GROUP BY ALL) t GROUP BY f",
}
