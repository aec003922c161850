"""One query per operator over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelight.functions import fold as names
from treelight.functions.extract import extract_text
from treelight.operators import content, paths, replay
from treelight.plans import search
from treelight.sources import usn, volumes
from treelight.sources.volumes import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Entries without derived columns, and their paths, as DuckDB common table expressions. Ids of the D and P directories
#: are hashes in Spark; the oracle needs names and paths only.
_FILES = r"""
d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source FROM documents),
e AS (
  SELECT 'C' AS drive, 0 AS slot, 'C:' AS name, 'C:\' AS path, true AS is_dir, '' AS parent
  UNION ALL SELECT 'C', 100 + r_regionkey, r_name, 'C:\' || r_name, true, 'C:' FROM region
  UNION ALL SELECT 'C', 1000 + n_nationkey, n_name, 'C:\' || r_name || '\' || n_name, true, '' FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'C', 1000000 + c_custkey, c_name, 'C:\' || r_name || '\' || n_name || '\' || c_name, true, ''
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'C', 1000000000 + o_orderkey, 'order_' || o_orderkey || '.' || lower(o_orderstatus),
      'C:\' || r_name || '\' || n_name || '\' || c_name || '\order_' || o_orderkey || '.' || lower(o_orderstatus), false, ''
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'D', 0, 'D:', 'D:\', true, ''
  UNION ALL SELECT DISTINCT 'D', NULL::BIGINT, lang, 'D:\' || lang, true, '' FROM d
  UNION ALL SELECT DISTINCT 'D', NULL::BIGINT, source, 'D:\' || lang || '\' || source, true, '' FROM d
  UNION ALL SELECT 'D', 4398046511104 + doc_id, 'doc_' || lpad(doc_id::VARCHAR, 7, '0') || '.txt', 'D:\' || lang || '\' || source || '\doc_' || lpad(doc_id::VARCHAR, 7, '0') || '.txt', false, '' FROM d
  UNION ALL SELECT 'P', 0, 'P:', 'P:\', true, ''
  UNION ALL SELECT DISTINCT 'P', NULL::BIGINT, regexp_extract(url, '^[a-z]+://([^/#?]*)', 1), 'P:\' || regexp_extract(url, '^[a-z]+://([^/#?]*)', 1), true, '' FROM pages
  UNION ALL SELECT 'P', 2199023255552 + page_id, 'page_' || page_id || '.html', 'P:\' || regexp_extract(url, '^[a-z]+://([^/#?]*)', 1) || '\page_' || page_id || '.html', false, '' FROM pages
  UNION ALL SELECT 'Q', 0, 'Q:', 'Q:\', true, ''
  UNION ALL SELECT 'Q', 100 + p_partkey, p_name, 'Q:\' || p_name, false, '' FROM part
  UNION ALL SELECT 'Q', 1000000000 + s_suppkey, s_name, 'Q:\' || s_name, false, '' FROM supplier
)"""


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _search(name: str, q: str, where: str, options: search.Options | None = None) -> None:
    """All hits of a query, as drive, name, is_dir; where is the same condition in DuckDB over e."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, p = volumes.stored(spark, sf_dir)
        return search.matched(e, p, q, options).select("drive", "name", "is_dir")

    _query(name, f"WITH {_FILES} SELECT drive, name, is_dir FROM e WHERE {where}")(run)


_search("substr_ascii", "Widget", "contains(lower(name), 'widget')")
_search("multi_term_and", "order .f 99", "contains(lower(name), 'order') AND contains(lower(name), '.f') AND contains(lower(name), '99')")
_search("wildcard_suffix", "*.TXT", "lower(name) LIKE '%.txt'")
_search("wildcard_prefix", "doc_00001*", r"lower(name) LIKE 'doc!_00001%' ESCAPE '!'")
_search("wildcard_infix", "order_*1*.o", r"lower(name) LIKE 'order!_%1%.o' ESCAPE '!'")
_search("wildcard_qmark", "doc_00000?5.txt", r"lower(name) LIKE 'doc!_00000_5.txt' ESCAPE '!'")
_search("drive_filter", "c: *.p", "drive = 'C' AND lower(name) LIKE '%.p'")
_search("drive_multi", "Q: P: 7", "drive IN ('Q', 'P') AND contains(name, '7')")
_search("match_all_with_root", "", "true")
_search("path_term", r"asia\ 1.f", r"contains(lower(path), 'asia\') AND contains(lower(name), '1.f')")
_search("match_path_flag", "europe order", "contains(lower(path), 'europe') AND contains(lower(path), 'order')", search.Options(match_path=True))
_search("path_wildcard_anchored", r"D:\fr\*\doc_*7.txt", r"lower(path) LIKE 'd:\fr\%\doc!_%7.txt' ESCAPE '!'")
_search("name_and_path", r"order_* africa\ c:", r"lower(name) LIKE 'order!_%' ESCAPE '!' AND contains(lower(path), 'africa\') AND drive = 'C'")


@_query("extension_of", f"WITH {_FILES} SELECT drive, name, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE '' END AS ext FROM e WHERE NOT is_dir")
def extension_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.stored(spark, sf_dir)[0].where("not is_dir").select("drive", "name", names.extension(F.col("name")).alias("ext"))


@_query("ext_histogram", f"WITH {_FILES} SELECT drive, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE '' END AS ext, count(*)::BIGINT AS n FROM e WHERE NOT is_dir GROUP BY ALL")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.stored(spark, sf_dir)[0].where("not is_dir").groupBy("drive", "ext").agg(F.count(F.lit(1)).alias("n"))


@_query("find_offset", "SELECT p_partkey, CASE WHEN position('a' IN lower(p_name)) > 0 THEN strlen(substr(p_name, 1, position('a' IN lower(p_name))::INT - 1)) END::BIGINT AS at FROM part")
def find_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.find(F.col("p_name"), "A").alias("at"))


@_query("under_dir", f"WITH {_FILES} SELECT name, path FROM e WHERE starts_with(lower(path), 'c:\\asia\\nation_2\\')")
def under_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = volumes.stored(spark, sf_dir)
    rows = paths.with_paths(e, p)
    return rows.where(names.under_dir(F.col("path"), r"c:\Asia\Nation_2")).select("name", "path")


@_query("highlight", "SELECT p_partkey, regexp_replace(p_name, '(small|bolt)', '<mark>\\1</mark>', 'gi') AS marked FROM part")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.highlight(F.col("p_name"), "small* content:bolt").alias("marked"))


@_query("path_of_tree", f"WITH {_FILES} SELECT drive, name, path FROM e")
def path_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_paths(*volumes.stored(spark, sf_dir)).select("drive", "name", "path")


@_query("subtree_delete", f"WITH {_FILES} SELECT drive, name FROM e WHERE NOT (drive = 'C' AND (path = 'C:\\ASIA' OR starts_with(path, 'C:\\ASIA\\')))")
def subtree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when a directory goes with all below it."""
    e, p = volumes.stored(spark, sf_dir)
    asia = table(spark, sf_dir, "region").where("r_name = 'ASIA'").first()
    gone = paths.subtree(e, p, "C", 100 + asia["r_regionkey"] if asia else -1)
    return e.join(gone.select("drive", "frn"), ["drive", "frn"], "left_anti").select("drive", "name")


_NO_ASIA = "drive = 'C' AND starts_with(path, 'C:\\ASIA\\')"


def _without_asia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.stored(spark, sf_dir)[0].where("not (drive = 'C' and name = 'ASIA' and slot < 1000)")


@_query("orphan_reachability", f"WITH {_FILES} SELECT drive, name FROM e WHERE NOT ({_NO_ASIA}) AND path <> 'C:\\ASIA'")
def orphan_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one directory's row missing: what hangs from a root."""
    e = _without_asia(spark, sf_dir)
    return paths.with_paths(e, paths.dir_paths(e)).select("drive", "name")


@_query("orphan_dropped", f"WITH {_FILES} SELECT drive, name FROM e WHERE {_NO_ASIA}")
def orphan_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _without_asia(spark, sf_dir)
    return paths.orphans(e, paths.dir_paths(e)).select("drive", "name")


def _page(name: str, q: str, options: search.Options, where: str, order: str) -> None:
    @_query(name, f"WITH {_FILES} SELECT drive, name, path, is_dir FROM e WHERE {where} ORDER BY {order} LIMIT {options.limit} OFFSET {options.offset}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.page(*volumes.stored(spark, sf_dir), q, options).select("drive", "name", "path", "is_dir")


_page("page_index_order", "c: order", search.Options(limit=50), "drive = 'C' AND contains(lower(name), 'order')", "drive, slot")
_page("page_sort_name", "c: d: 7", search.Options(limit=40, sort="name"), "drive IN ('C', 'D') AND contains(name, '7')", "name, drive, slot")
_page("page_sort_path", "c: *.f", search.Options(limit=30, sort="path"), "drive = 'C' AND lower(name) LIKE '%.f'", "path, drive, slot")
_page("page_offset", "doc", search.Options(limit=25, offset=75, sort="name"), "contains(lower(name), 'doc')", "name, drive, slot")


@_query("total_and_nondir", f"WITH {_FILES} SELECT count(*)::BIGINT AS total_matched, count(*) FILTER (NOT is_dir)::BIGINT AS non_dir_matched FROM e WHERE contains(lower(name), '1')")
def total_and_nondir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(volumes.stored(spark, sf_dir)[0], None, "1")


@_query("substr_unicode", "SELECT doc_id FROM documents WHERE contains(lower(text), 'éelle')")
def substr_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(names.matches(names.fold(F.col("text")), "ÉELLE")).select("doc_id")


NEEDLES = ["the", "ing"]
_HAS = "contains(lower(text), 'the') AND contains(lower(text), 'ing')"
_COUNT = "least(10000, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3)::INT"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@_query("content_match_and", f"SELECT doc_id FROM documents WHERE {_HAS}")
def content_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.scan_text(_docs(spark, sf_dir), NEEDLES).where("status = 'match'").select("doc_id")


@_query("content_count", f"SELECT doc_id, {_COUNT} AS content_matches FROM documents WHERE {_HAS}")
def content_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.scan_text(_docs(spark, sf_dir), NEEDLES).where("status = 'match'").select("doc_id", "content_matches")


@_query("content_first_hit", f"SELECT doc_id, CASE WHEN {_HAS} THEN least(position('the' IN lower(text)), position('ing' IN lower(text))) ELSE 0 END::INT AS hit FROM documents")
def content_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", content.first_hit(names.fold(F.col("text")), NEEDLES).alias("hit"))


_WS = "'[\\s\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


def _trimmed(text: str) -> str:
    return f"trim(regexp_replace({text}, {_WS}, ' ', 'g'))"


@_query(
    "content_snippet",
    f"""WITH h AS (SELECT doc_id, text, position('idiot' IN lower(text))::INT - 1 AS h FROM documents WHERE contains(lower(text), 'idiot')),
    b AS (SELECT *, greatest(0, strlen(left(text, h)) - 64) AS low, least(strlen(text), strlen(left(text, h)) + 64) AS high FROM h),
    m AS (SELECT doc_id, text, list_max(list_filter(range(greatest(0, h - 64), h + 1), lambda c: strlen(left(text, c::INT)) <= low)) AS a,
          list_min(list_filter(range(h, least(length(text), h + 64) + 1), lambda c: strlen(left(text, c::INT)) >= high)) AS z FROM b)
    SELECT doc_id, CASE WHEN {_trimmed('left(text, a::INT)')} <> '' THEN '…' ELSE '' END || {_trimmed('substr(text, a::INT + 1, (z - a)::INT)')}
      || CASE WHEN {_trimmed('substr(text, z::INT + 1)')} <> '' THEN '…' ELSE '' END AS snippet FROM m""",
)
def content_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes decide in both: DuckDB looks for the characters that hold the first and the last one."""
    return content.scan_text(_docs(spark, sf_dir), ["idiot"]).where("status = 'match'").select("doc_id", "snippet")


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matched(volumes.stored(spark, sf_dir, "D")[0], None, "5")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = content.candidates(_doc_files(spark, sf_dir))
    d = _docs(spark, sf_dir).withColumn("slot", F.col("doc_id") + volumes.DOC_BASE)
    return content.scan_text(window.select("drive", "slot", "name").join(d.select("slot", "text"), "slot", "left"), NEEDLES)


#: Directories that match come first in index order and take places in the window.
_WINDOW = f"""{_FILES}, c AS (SELECT name, is_dir, slot FROM e WHERE drive = 'D' AND contains(name, '5')),
w AS (SELECT slot - 4398046511104 AS doc_id FROM c WHERE NOT is_dir ORDER BY slot LIMIT (SELECT greatest(0, {content.MOST_CANDIDATES} - count(*)) FROM c WHERE is_dir)),
s AS (SELECT documents.* FROM w JOIN documents USING (doc_id))"""


@_query("content_window_truncated", f"WITH {_WINDOW} SELECT (SELECT count(*) FROM c WHERE NOT is_dir) > (SELECT count(*) FROM w) AS truncated")
def content_window_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_files(spark, sf_dir)
    counted = rows.where("not is_dir").select(F.lit(1).alias("matched"), F.lit(0).alias("in_window")).union(content.candidates(rows).select(F.lit(0), F.lit(1)))
    return counted.agg((F.coalesce(F.sum("matched") > F.sum("in_window"), F.lit(False))).alias("truncated"))


@_query("content_paging", f"WITH {_WINDOW} SELECT 'doc_' || lpad(doc_id::VARCHAR, 7, '0') || '.txt' AS name, {_COUNT} AS content_matches FROM s WHERE {_HAS} ORDER BY doc_id LIMIT 20 OFFSET 10")
def content_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_page(_scanned(spark, sf_dir), 20, 10).select("name", "content_matches")


@_query(
    "content_status_counts",
    f"WITH {_WINDOW} SELECT count(text)::BIGINT AS scanned, 0::BIGINT AS skipped_size, 0::BIGINT AS skipped_binary, count(*) FILTER (text IS NULL)::BIGINT AS errors, count(*) FILTER ({_HAS})::BIGINT AS total_matched FROM s",
)
def content_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.scan_info(_scanned(spark, sf_dir))


_OP = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'rename_old' WHEN 'click' THEN 'rename_new' WHEN 'purchase' THEN 'delete' END"


@_query("event_classify", f"SELECT event_id AS usn, {_OP} AS op, 100 + user_id AS frn FROM events WHERE {_OP} IS NOT NULL")
def event_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.journal(spark, sf_dir).select("usn", "op", "frn")


@_query("event_breakdown", f"SELECT CASE WHEN {_OP} LIKE 'rename%' THEN 'rename' ELSE {_OP} END AS kind, count(*)::BIGINT AS n FROM events WHERE {_OP} IS NOT NULL GROUP BY 1")
def event_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.startswith("op", F.lit("rename")), F.lit("rename")).otherwise(F.col("op"))
    return volumes.journal(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as undecoded ids and reasons: the upper 16 bits of an id are its sequence number."""
    return table(spark, sf_dir, "events").select(
        "event_id", ((F.col("user_id") % 1000) + F.shiftleft(F.col("event_id") % 7, 48)).alias("raw"), (F.col("event_id") * 257 % 16384).alias("reason")
    )


@_query("frn_mask", "SELECT event_id, user_id % 1000 AS frn FROM events")
def frn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", F.col("raw").bitwiseAND(usn.FRN_MASK).alias("frn"))


@_query("metafile_filter", "SELECT event_id FROM events WHERE user_id % 1000 >= 24")
def metafile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(F.col("raw").bitwiseAND(usn.FRN_MASK) >= usn.FIRST_USER_FRN).select("event_id")


@_query(
    "reason_precedence",
    "SELECT event_id, CASE WHEN (event_id * 257 % 16384) & 8192 <> 0 THEN 'rename_new' WHEN (event_id * 257 % 16384) & 4096 <> 0 THEN 'rename_old' WHEN (event_id * 257 % 16384) & 256 <> 0 THEN 'create' WHEN (event_id * 257 % 16384) & 512 <> 0 THEN 'delete' END AS op FROM events",
)
def reason_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", usn.operation(F.col("reason")).alias("op"))


#: Every directory of J hangs from the root and holds only its own four users, so groups of five users are independent: a recursive
#: step reads the next event of each group. State by position: alive, names, born (the event that gave the slot), armed renames.
#: What waits for a directory is tried once, at the end of the batch, after all slots of the events themselves.
_REPLAY = f"""WITH RECURSIVE ev AS (
  SELECT event_id AS usn, user_id // 5 AS g, (user_id % 5 + 1)::INT AS k, {_OP} AS op, 'user_' || user_id || '_' || event_id AS name,
         row_number() OVER (PARTITION BY user_id // 5 ORDER BY event_id) AS i
  FROM events WHERE {_OP} IS NOT NULL
), s AS (
  SELECT DISTINCT g, 0::BIGINT AS i, 0::BIGINT AS usn, false AS new, [false, false, false, false, false] AS alive, ['', '', '', '', ''] AS names,
         [0, 0, 0, 0, 0]::BIGINT[] AS born, [false, false, false, false, false] AS armed, []::STRUCT(k INT, name VARCHAR, usn BIGINT)[] AS waits FROM ev
  UNION ALL
  SELECT g, i, usn, act = 'insert' AND NOT alive[k],
         list_transform([1, 2, 3, 4, 5], lambda j: CASE WHEN act = 'delete' AND (k = 1 OR j = k) THEN false WHEN act = 'insert' AND j = k THEN true ELSE alive[j] END),
         list_transform([1, 2, 3, 4, 5], lambda j: CASE WHEN act IN ('insert', 'rename') AND j = k THEN name ELSE names[j] END),
         list_transform([1, 2, 3, 4, 5], lambda j: CASE WHEN act = 'insert' AND j = k AND NOT alive[k] THEN usn ELSE born[j] END),
         list_transform([1, 2, 3, 4, 5], lambda j: CASE WHEN j <> k OR op = 'create' THEN armed[j] ELSE op = 'rename_old' END),
         CASE WHEN act = 'wait' THEN list_append(waits, {{'k': k, 'name': name, 'usn': usn}}) WHEN act = 'delete' THEN list_filter(waits, lambda w: w.k <> k) ELSE waits END
  FROM (
    SELECT s.g, ev.i, ev.usn, ev.k, ev.op, ev.name, s.alive, s.names, s.born, s.armed, s.waits,
           CASE WHEN op = 'delete' THEN 'delete' WHEN op = 'rename_old' THEN 'none' WHEN op = 'rename_new' AND armed[k] THEN CASE WHEN alive[k] THEN 'rename' ELSE 'none' END
                WHEN k = 1 OR alive[1] THEN 'insert' ELSE 'wait' END AS act
    FROM s JOIN ev ON ev.g = s.g AND ev.i = s.i + 1
  )
), slots AS (SELECT usn, row_number() OVER (ORDER BY usn) AS slot FROM s WHERE new),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
w AS (SELECT f.g, w.k, max_by(w.name, w.usn) AS name, min(w.usn) AS usn, bool_and(f.alive[w.k]) AS was FROM f, unnest(f.waits) AS u(w) WHERE f.alive[1] GROUP BY f.g, w.k),
late AS (SELECT g, k, name, (SELECT count(*) FROM slots) + row_number() OVER (ORDER BY usn) AS slot FROM w WHERE NOT was),
n AS (SELECT g, k, names[k] AS name, born[k] AS usn FROM f, (SELECT unnest([1, 2, 3, 4, 5])::INT AS k) WHERE alive[k]),
l AS (
  SELECT n.g, n.k, coalesce(w.name, n.name) AS name, slots.slot FROM n JOIN slots USING (usn) LEFT JOIN w ON w.g = n.g AND w.k = n.k
  UNION ALL SELECT g, k, name, slot FROM late
)
SELECT 'J' AS drive, slot::BIGINT AS slot, (99 + 5 * g + k)::BIGINT AS frn, CASE WHEN k = 1 THEN 5 ELSE 100 + 5 * g END::BIGINT AS parent_frn, name, k = 1 AS is_dir FROM l
UNION ALL SELECT 'J', 0, 5, NULL, 'J:', true"""


@_query("replay_live_set", _REPLAY)
def replay_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(volumes.journal(spark, sf_dir), drives=("J",))


@_query("usn_decode")
def usn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows packed into record buffers by the executors, then decoded and classified."""
    reason = F.expr(f"case op when 'create' then {usn.REASON_CREATE} when 'delete' then {usn.REASON_DELETE} when 'rename_old' then {usn.REASON_RENAME_OLD} else {usn.REASON_RENAME_NEW} end")
    rows = volumes.journal(spark, sf_dir).select("usn", "frn", "parent_frn", "name", reason.alias("reason"), F.when(F.col("is_dir"), usn.ATTRIBUTE_DIRECTORY).otherwise(0).alias("attributes"))

    def pack(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"buffer": [b"".join(usn.pack(r.frn, r.parent_frn, r.usn, r.reason, r.attributes, r.name) for r in b.itertuples())]})

    return usn.events(usn.decode(rows.mapInPandas(pack, "buffer binary")))


ORACLES["usn_decode"] = f"""SELECT event_id AS usn, {_OP} AS op, 100 + user_id AS frn, CASE WHEN user_id % 5 = 0 THEN 5 ELSE 100 + user_id - user_id % 5 END AS parent_frn,
  'user_' || user_id || '_' || event_id AS name, user_id % 5 = 0 AS is_dir FROM events WHERE {_OP} IS NOT NULL"""

@_query("office_extract", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'error' ELSE 'text' END AS status, nullif(text, '') AS text FROM documents")
def office_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document put into an office container by the executors, and taken out again; a container without text is broken."""

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        for b in batches:
            out = []
            for text in b["text"]:
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    z.writestr("word/document.xml", f"<w:document><w:p>{escape(text or '')}</w:p></w:document>")
                out.append(f.getvalue())
            b["content"] = out
            yield b[["doc_id", "content"]]

    packed = _docs(spark, sf_dir).mapInPandas(pack, "doc_id long, content binary")
    return packed.select("doc_id", extract_text(F.col("content"), F.lit("docx")).alias("got")).select("doc_id", "got.*")


@_query("utf16_decode", "SELECT doc_id, CASE WHEN text IS NULL THEN 'error' ELSE 'text' END AS status, text FROM documents")
def utf16_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids as UTF-16 little-endian, odd ones as big-endian, with byte-order marks."""
    text = F.col("text")
    data = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
    return _docs(spark, sf_dir).select("doc_id", extract_text(data, F.lit("txt")).alias("got")).select("doc_id", "got.*")


_DELETED = "slot % 7 = 3"


def _with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.stored(spark, sf_dir)[0].withColumn("deleted", F.expr(f"not is_dir and {_DELETED}"))


_T = f"t AS (SELECT *, NOT is_dir AND {_DELETED} AS deleted FROM e)"


@_query(
    "volume_status",
    f"""WITH {_FILES}, {_T} SELECT drive, count(*) FILTER (NOT deleted)::BIGINT AS files, count(*) FILTER (is_dir AND NOT deleted)::BIGINT AS dirs, count(*) FILTER (deleted)::BIGINT AS deleted,
    (sum(strlen(name)) + 28 * count(*) + 24 * count(*) FILTER (NOT deleted) + 64 * count(*) FILTER (is_dir))::BIGINT AS memory,
    count(*) FILTER (deleted) > 1024 AND count(*) FILTER (deleted) * 20 > count(*) AS needs_rebuild FROM t GROUP BY drive""",
)
def volume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.volume_status(_with_tombstones(spark, sf_dir))


@_query("compaction", f"WITH {_FILES}, {_T} SELECT drive, name, CASE WHEN NOT is_dir OR drive IN ('C', 'Q') THEN row_number() OVER (PARTITION BY drive ORDER BY NOT is_dir, slot) - 1 END::BIGINT AS slot FROM t WHERE NOT deleted")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of D and P come first there, in the order of their hashed ids, which DuckDB doesn't know: their slots are left out."""
    known = ~F.col("is_dir") | F.col("drive").isin("C", "Q")
    return paths.compact(_with_tombstones(spark, sf_dir)).select("drive", "name", F.when(known, F.col("slot")).alias("slot"))


@_query("validate_report", f"WITH {_FILES} SELECT drive, 0::BIGINT AS roots, 0::BIGINT AS root_keys, 0::BIGINT AS names, CASE WHEN drive = 'C' THEN (SELECT count(*) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA') ELSE 0 END::BIGINT AS parents, 0::BIGINT AS keys FROM e GROUP BY drive")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.validate(_without_asia(spark, sf_dir))


@_query("phase_filter", f"WITH {_FILES} SELECT drive, name FROM e WHERE drive IN ('C', 'P') AND contains(name, '3')")
def phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = spark.sql("select * from values ('C', 'ready'), ('D', 'building'), ('P', 'ready'), ('Q', 'failed') as v(drive, phase)")
    return search.matched(volumes.stored(spark, sf_dir)[0], None, "3", volumes=phases).select("drive", "name")


@_query(
    "validate_violations",
    f"""WITH {_FILES}, b AS (
      SELECT drive, CASE WHEN slot % 10 = 3 AND NOT is_dir THEN NULL ELSE name END AS name, slot, is_dir, path FROM e WHERE drive IN ('C', 'Q') AND NOT (drive = 'Q' AND slot = 0)
      UNION ALL SELECT drive, name, slot, is_dir, path FROM e WHERE drive = 'C' AND slot % 100 = 7 AND NOT is_dir
      UNION ALL SELECT 'C', 'C:', 0, true, 'C:'
    )
    SELECT drive, 1::BIGINT AS roots, 1::BIGINT AS root_keys, count(*) FILTER (name IS NULL)::BIGINT AS names,
      CASE drive WHEN 'C' THEN 0 ELSE count(*) END::BIGINT AS parents, (count(*) - count(DISTINCT slot))::BIGINT AS keys FROM b GROUP BY drive
    UNION ALL SELECT 'Z', 1, 1, 0, 0, 0""",
)
def validate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C with its root and some files twice, Q without its root, names missing in both, Z without any entry."""
    e = volumes.stored(spark, sf_dir)[0].where("drive in ('C', 'Q')")
    broken = e.where("not (drive = 'Q' and slot = 0)").withColumn("name", F.expr("case when slot % 10 = 3 and not is_dir then null else name end"))
    broken = broken.unionByName(e.where("drive = 'C' and slot % 100 = 7 and not is_dir")).unionByName(e.where("drive = 'C' and slot = 0"))
    return paths.validate(broken, ["Z"])


_RAW_FRN, _RAW_REASON, _RAW_MAJOR = "user_id % 1000", "event_id * 257 % 16384", "CASE WHEN event_id % 11 = 0 THEN 3 ELSE 2 END"


@_query(
    "scan_counts",
    f"""SELECT count(*)::BIGINT AS records, count(*) FILTER ({_RAW_MAJOR} = 2 AND {_RAW_FRN} >= 24 AND (({_RAW_REASON}) & {usn.REASON_CREATE | usn.REASON_DELETE | usn.REASON_RENAME_OLD | usn.REASON_RENAME_NEW}) <> 0)::BIGINT AS events,
    count(*) FILTER ({_RAW_MAJOR} <> 2)::BIGINT AS other_versions FROM events""",
)
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records, some of another version, some of metafiles, some without a reason that counts."""
    rows = table(spark, sf_dir, "events").selectExpr(f"{_RAW_FRN} as frn", "event_id", f"{_RAW_REASON} as reason", f"{_RAW_MAJOR} as major")

    def pack(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"buffer": [b"".join(usn.pack(r.frn, 5, r.event_id, r.reason, 0, "文件", r.major) for r in b.itertuples())]})

    return usn.scan_counts(usn.decode(rows.mapInPandas(pack, "buffer binary")))


@_query("wildcard_unicode", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%éelle_é%'")
def wildcard_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(names.matches(names.fold(F.col("text")), "*ÉELLE?É*")).select("doc_id")


@_query("plain_path", f"WITH {_FILES} SELECT path FROM e WHERE drive <> 'P' UNION ALL SELECT '\\\\' || path FROM e WHERE drive = 'P'")
def plain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths.with_paths(*volumes.stored(spark, sf_dir))
    verbatim = F.concat(F.when(F.col("drive") == "P", F.lit("\\\\?\\UNC\\")).otherwise(F.lit("\\\\?\\")), "path")
    return rows.select(names.plain_path(verbatim).alias("path"))


_CAP = 3000


@_query(
    "content_size_filter",
    f"""SELECT count(*) FILTER (strlen(text) <= {_CAP})::BIGINT AS scanned, count(*) FILTER (strlen(text) > {_CAP})::BIGINT AS skipped_size, 0::BIGINT AS skipped_binary,
    count(*) FILTER (text IS NULL)::BIGINT AS errors, count(*) FILTER (strlen(text) <= {_CAP} AND {_HAS})::BIGINT AS total_matched FROM documents""",
)
def content_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files with a limit of size: each has one status."""
    status = F.when(F.col("text").isNull(), "error").when(F.octet_length("text") > _CAP, "skipped_size").otherwise("text")
    return content.scan_info(content.scan_text(_docs(spark, sf_dir).withColumn("status", status), NEEDLES))


@_query("content_query", f"WITH {_FILES} SELECT e.name, least(10000, (length(lower(text)) - length(replace(lower(text), 'idiot', ''))) // 5)::INT AS content_matches FROM e JOIN documents ON slot = 4398046511104 + doc_id WHERE drive = 'D' AND e.name LIKE '%7.txt' AND contains(lower(text), 'idiot')")
def content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query as it's typed: the content term decides among the files that the name term leaves."""
    q = search.parse("*7.txt d: Content:IDIOT")
    hits = search.matched(volumes.stored(spark, sf_dir)[0], None, q).where("not is_dir")
    texts = _docs(spark, sf_dir).select((F.col("doc_id") + volumes.DOC_BASE).alias("slot"), "text")
    return content.scan_text(hits.join(texts, "slot"), q.content_terms).where("status = 'match'").select("name", "content_matches")


@_query("page_clamped", f"WITH {_FILES} SELECT drive, name, path, is_dir FROM e WHERE drive = 'C' AND contains(lower(name), 'order') ORDER BY slot LIMIT {search.MOST_LIMIT}")
def page_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(*volumes.stored(spark, sf_dir), "c: order", search.Options(limit=search.MOST_LIMIT + 4000)).select("drive", "name", "path", "is_dir")


@_query("rename_pairing", f"""WITH r AS (SELECT event_id, user_id, {_OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE {_OP} IS NOT NULL AND {_OP} <> 'create')
  SELECT n.event_id AS usn, coalesce(o.op = 'rename_old', false) AS paired FROM r AS n LEFT JOIN r AS o ON o.user_id = n.user_id AND o.i = n.i - 1 WHERE n.op = 'rename_new'""")
def rename_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a new name follows an old one of the same id, with neither a deletion nor another new name between them."""
    return replay.paired_renames(volumes.journal(spark, sf_dir)).select("usn", "paired")
