"""The library's own queries by name, each with equivalent SQL for the same tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathgrove.functions import modes
from pathgrove.operators import diff as d, export, intervals, merkle, name_index, search as s, stats, tree as t
from pathgrove.plans import dealing
from pathgrove.plans.options import search_condition
from pathgrove.sources import derived, snapshot as store
from pathgrove.sources.shared import materialise, shared_dir

NOW = dt.datetime(2024, 3, 31, 12, 0, 0)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The derived snapshots as SQL.
V1 = """
files AS (SELECT doc_id AS idx, source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size,
  420::BIGINT AS mode, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INTEGER) AS mtime FROM documents),
dirs AS (SELECT -1 - ('0x' || substr(sha1(path), 1, 12))::BIGINT AS idx, path, 4096::BIGINT AS size, 2147484141::BIGINT AS mode, TIMESTAMP '2024-01-01 00:00:00' AS mtime
  FROM (SELECT DISTINCT unnest(['.', source, source || '/' || lang]) AS path FROM documents)),
e AS (SELECT idx, sha1(path) AS id, path, size::BIGINT AS size, mode, mtime FROM (SELECT * FROM files UNION ALL SELECT * FROM dirs)),
h AS (SELECT doc_id AS idx, sha256(text) AS hash FROM documents),
eh AS (SELECT e.*, h.hash FROM e JOIN h USING (idx) WHERE h.hash IS NOT NULL)"""
#: The same while the digests of texts of over 5,000 characters are still pending.
V1P = V1.replace("sha256(text) AS", "CASE WHEN n_chars <= 5000 THEN sha256(text) END AS")
V1B = (
    V1
    + """,
kinds AS (SELECT *, CASE WHEN idx < 0 THEN 9 ELSE idx % 10 END AS k FROM e),
moved AS (SELECT idx, CASE WHEN k = 1 THEN regexp_replace(path, '([^/]+)$', 'moved-\\1') ELSE path END AS path, CASE WHEN k = 3 THEN size + 1 ELSE size END AS size,
  CASE WHEN k = 2 THEN 493 ELSE mode END::BIGINT AS mode, CASE WHEN k = 4 THEN mtime + to_hours(1) ELSE mtime END AS mtime FROM kinds WHERE k <> 0),
e2 AS (SELECT idx, sha1(path) AS id, path, size, mode, mtime FROM moved),
h2 AS (SELECT idx, CASE WHEN idx % 10 = 5 AND hash IS NOT NULL THEN sha256(hash) ELSE hash END AS hash FROM h WHERE idx % 10 <> 0),
j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.id, b.id) AS id, coalesce(a.size, b.size) AS size, coalesce(a.mode, b.mode) >= 2147483648 AS is_dir,
  a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b, (CASE WHEN a.mode <> b.mode THEN 2 ELSE 0 END + CASE WHEN a.size <> b.size THEN 4 ELSE 0 END
  + CASE WHEN a.mtime <> b.mtime THEN 8 ELSE 0 END) AS c0, CASE WHEN ha.hash <> hb.hash AND a.mode < 2147483648 THEN 16 ELSE 0 END AS cx
  FROM e a FULL JOIN e2 b ON a.id = b.id LEFT JOIN h ha ON ha.idx = a.idx LEFT JOIN h2 hb ON hb.idx = b.idx),
dp AS (SELECT CASE WHEN NOT in_b THEN 'left' WHEN NOT in_a THEN 'right' WHEN c0 <> 0 THEN 'changed' ELSE 'nothing' END AS type, id, path, is_dir,
  (CASE WHEN in_a AND in_b THEN c0 ELSE 0 END)::INTEGER AS changed, size FROM j),
dh AS (SELECT CASE WHEN NOT in_b THEN 'left' WHEN NOT in_a THEN 'right' WHEN c0 + cx <> 0 THEN 'changed' ELSE 'nothing' END AS type, id, path, is_dir,
  (CASE WHEN in_a AND in_b THEN c0 + cx ELSE 0 END)::INTEGER AS changed, size FROM j)"""
)
V2 = """
ev AS (SELECT DISTINCT user_id::VARCHAR AS u, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events),
b AS (SELECT 'live' AS top, * FROM ev UNION ALL SELECT 'backup', * FROM ev WHERE user_id % 3 = 0),
s4 AS (SELECT DISTINCT top, u, day, event_type AS name, sha1(event_type) AS sig FROM b),
s3 AS (SELECT top, u, day, sha1(list_reduce(list(unhex(sig) ORDER BY name), lambda a, b: a || b) || encode(day)) AS sig FROM s4 GROUP BY top, u, day),
s2 AS (SELECT top, u, sha1(list_reduce(list(unhex(sig) ORDER BY day), lambda a, b: a || b) || encode(u)) AS sig FROM s3 GROUP BY top, u),
s1 AS (SELECT top, sha1(list_reduce(list(unhex(sig) ORDER BY u), lambda a, b: a || b) || encode(top)) AS sig FROM s2 GROUP BY top),
allsig AS (SELECT top || '/' || u || '/' || day || '/' || name AS path, sig AS signature, false AS is_dir FROM s4 UNION ALL SELECT top || '/' || u || '/' || day, sig, true FROM s3
  UNION ALL SELECT top || '/' || u, sig, true FROM s2 UNION ALL SELECT top, sig, true FROM s1)"""
V3 = """
p AS (SELECT page_id AS idx, regexp_replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/+$', '') AS path FROM pages)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _searches() -> None:
    """One query for every kind of predicate."""

    def add(name: str, condition, where: str, hashed: bool = False):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return s.search(derived.documents_snapshot(spark, sf_dir), condition(), hashed).select("id", "path", "size")

        run.__name__ = name
        query(f"WITH {V1} SELECT id, path, size FROM {'eh' if hashed else 'e'} WHERE {where}")(run)

    add("search_regex", lambda: s.regex(r"src1\d?/en/[0-9]+5\.txt$"), r"regexp_matches(path, 'src1\d?/en/[0-9]+5\.txt$')")
    add("search_iregex", lambda: s.regex(r"SRC[[:digit:]]/(DE|FR)/", True), "regexp_matches(path, '(?i)SRC[[:digit:]]/(DE|FR)/')")
    add("search_name", lambda: s.glob("1?[0-4]*.txt"), r"regexp_matches(path, '(^|/)1[^/][0-4][^/]*\.txt$')")
    add("search_iname", lambda: s.glob("*7.TXT", True, True), r"path LIKE '%7.txt'")
    add("search_path", lambda: s.glob("src*/e?/*.txt", False), r"regexp_matches(path, '^src[^/]*/e[^/]/[^/]*\.txt$')")
    add("search_ipath", lambda: s.glob("SRC1*/EN/*", False, True), r"regexp_matches(path, '^src1[^/]*/en/[^/]*$')")
    add("search_type_file", lambda: s.type_of("df"), "mode < 2147483648")
    add("search_type_dir", lambda: s.type_of("d"), "mode >= 2147483648")
    add("search_size_eq", lambda: s.size("4096"), "size = 4096")
    add("search_size_gt", lambda: s.size("+2k"), "size > 2000")
    add("search_size_lt", lambda: s.size("-1k"), "size < 1000")
    add("search_before", lambda: s.before("2024-01-20", NOW), "mtime < TIMESTAMP '2024-01-20'")
    add("search_before_relative", lambda: s.before("2M", NOW), "mtime < TIMESTAMP '2024-01-31 12:00:00'")
    add("search_after", lambda: s.after("2024-01-20T06:00:00", NOW), "mtime > TIMESTAMP '2024-01-20 06:00:00'")
    add("search_hash_prefix", lambda: s.hash_prefix("A"), "starts_with(hash, 'a')", True)
    add("search_id_prefix", lambda: s.id_prefix("0F"), "starts_with(id, '0f')")
    add("search_type_mask", lambda: s.type_mask(modes.DIR | modes.SYMLINK), "mode >= 2147483648")
    add("search_func", lambda: s.func(lambda rows: rows["size"] % 7 == 3), "size % 7 = 3")
    add("search_and", lambda: search_condition(iname=["*.TXT"], size=["+1k"], type=["f"], now=NOW)[0], "path LIKE '%.txt' AND size > 1000 AND mode < 2147483648")
    add("search_or", lambda: s.regex("/de/") | s.size("+8k"), "path LIKE '%/de/%' OR size > 8000")
    add("search_not", lambda: ~s.regex("/en(/|$)") & ~s.never(), "NOT regexp_matches(path, '/en(/|$)')")
    add("search_no_options", lambda: search_condition()[0], "false")


_searches()


def _v1(spark, sf_dir):
    return derived.documents_snapshot(spark, sf_dir)


def _pair(spark, sf_dir):
    return _v1(spark, sf_dir), derived.documents_later(spark, sf_dir)


@query(f"WITH {V1} SELECT id, path, size FROM e WHERE path = '.' OR (mode >= 2147483648 AND regexp_matches(path, 'src1') OR mode < 2147483648 AND path LIKE '%src1%')")
def scan_filter_include_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.kept_by_filters(_v1(spark, sf_dir).entries, include_dirs=["src1"]).select("id", "path", "size")


@query(f"WITH {V1} SELECT id, path, size FROM e WHERE NOT (mode < 2147483648 AND regexp_matches(path, '[02468]\\.txt$')) AND path NOT LIKE 'src3/%' AND path <> 'src3'")
def scan_filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.kept_by_filters(_v1(spark, sf_dir).entries, exclude_files=[r"[02468]\.txt$"], exclude_dirs=["^src3$"]).select("id", "path", "size")


FULL = "CASE WHEN path = '.' THEN '/data/docs' ELSE '/data/docs/' || path END"


@query(f"WITH {V1} SELECT path FROM e")
def list_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.listing(_v1(spark, sf_dir))


@query(f"WITH {V1} SELECT id, size, {FULL} AS path, mode, mtime FROM e")
def list_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.listing(_v1(spark, sf_dir), full=True)


@query(f"WITH {V1} SELECT id, size, {FULL} AS path, mode, mtime, hash FROM eh")
def list_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.listing(_v1(spark, sf_dir), with_hash=True)


@query(f"""WITH {V1} SELECT id AS "Id", size AS "Size", CASE WHEN mode >= 2147483648 THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS "Mode",
  strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS "ModTime", mode >= 2147483648 AS "IsDir", coalesce(hash, '') AS "Hash (sha256)", {FULL} AS "Path" FROM e LEFT JOIN h USING (idx)""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(_v1(spark, sf_dir))


@query(f"WITH {V1} SELECT size::VARCHAR || ',' || hash || ',./' || path AS value FROM eh")
def export_hashdeep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.hashdeep_rows(_v1(spark, sf_dir))


@query(f"""WITH {V1} SELECT '{{"id":"' || id || '","path":"' || {FULL} || '","size":' || size || ',"mode":' || mode || ',"modeStr":"'
  || CASE WHEN mode >= 2147483648 THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END || '","modTime":"' || strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') || '","isDir":' || (mode >= 2147483648)
  || CASE WHEN hash IS NULL THEN '' ELSE ',"hash":"' || hash || '"' END || '}}' AS value FROM e LEFT JOIN h USING (idx)""")
def export_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_rows(_v1(spark, sf_dir))


MODE = "CASE WHEN mode >= 2147483648 THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END"


@query(f"""WITH {V1} SELECT 'Id,Size,Mode,ModTime,IsDir,Hash (sha256),Path' AS value UNION ALL
  SELECT id || ',' || size || ',' || {MODE} || ',' || strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') || ',' || (mode >= 2147483648) || ',' || coalesce(hash, '') || ',' || path FROM e LEFT JOIN h USING (idx)""")
def export_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one CSV file that many tasks have written."""
    target = f"{shared_dir(spark).removeprefix('file://')}/export-{uuid.uuid4().hex}.csv"
    export.write_file(export.csv_lines(_v1(spark, sf_dir)), target)
    return spark.read.text(f"file://{target}")


@query(f"""WITH {V1} SELECT '{{' || id || '}}, ' || hash || ', ' || size || ', "' || {FULL} || '", ' || {MODE} || ', ' || strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') AS line
  FROM eh WHERE regexp_matches(path, '^src1/') AND size > 2000""")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found entries as they are printed."""
    snapshot = _v1(spark, sf_dir)
    return s.found_lines(s.search(snapshot, s.regex("^src1/") & s.size("+2k"), with_hash=True), snapshot.root).select("line")


@query(f"WITH {V1} SELECT id, path, size FROM e WHERE regexp_matches(path, '(^|/)[^/]+17\\.txt$')")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by base name through the index of names, which is built first."""
    index = name_index.build(_v1(spark, sf_dir).entries, f"{shared_dir(spark)}/names-{uuid.uuid4().hex}")
    return name_index.find(index, "?*17.TXT", insensitive=True).select("id", "path", "size")


@query(f"WITH {V1} SELECT id, path, size FROM e WHERE regexp_matches(path, '(^|/)src1/[^/]+/[0-9]*[37]17\\.txt$') OR regexp_matches(path, '/8[0-9]17\\.txt$')")
def search_indexed_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by regular expression through the index of names, which is built first."""
    index = name_index.build(_v1(spark, sf_dir).entries, f"{shared_dir(spark)}/names-{uuid.uuid4().hex}")
    return name_index.find_regex(index, r"(^|/)SRC1/[^/]+/[0-9]*(317|717)\.TXT$|/8[0-9]17\.txt$", insensitive=True).select("id", "path", "size")


@query(f"""WITH {V1} SELECT count(*) FILTER (mode >= 2147483648) AS dir_count, count(*) FILTER (mode < 2147483648) AS file_count,
  coalesce(sum(size) FILTER (mode < 2147483648), 0)::BIGINT AS total_size, coalesce(max(size) FILTER (mode < 2147483648), 0)::BIGINT AS max_size,
  (sum(size) FILTER (mode < 2147483648) // count(*) FILTER (mode < 2147483648))::BIGINT AS avg_size FROM e""")
def stats_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_stats(_v1(spark, sf_dir).entries)


@query(f"""WITH {V1}, g AS (SELECT count(*) AS n, sum(size) AS b, arg_max(size, idx) AS one FROM eh GROUP BY hash HAVING count(*) > 1)
  SELECT (SELECT count(hash) FROM h) AS hashed, (SELECT count(*) - count(hash) FROM h) AS pending, coalesce(sum(n), 0)::BIGINT AS dup_files,
  coalesce(sum(b), 0)::BIGINT AS dup_bytes, coalesce(sum(b - one), 0)::BIGINT AS savable_bytes FROM g""")
def stats_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hash_stats(_v1(spark, sf_dir))


DUPES = f"""WITH {V1}, g AS (SELECT hash, max(size) AS largest, (row_number() OVER (ORDER BY hash) - 1)::BIGINT AS grp FROM eh GROUP BY hash HAVING count(*) > 1),
  rows AS (SELECT grp, (row_number() OVER (PARTITION BY eh.hash ORDER BY idx) - 1)::BIGINT AS ord, eh.hash, idx, path, size FROM eh JOIN g ON g.hash = eh.hash WHERE largest > 0)"""


@query(f"{DUPES} SELECT * FROM rows")
def dupes_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicate_files(_v1(spark, sf_dir))


@query(f"{DUPES} SELECT grp, hash, count(*) AS files, sum(size)::BIGINT AS bytes FROM rows GROUP BY grp, hash")
def dupes_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicate_totals(stats.duplicate_files(_v1(spark, sf_dir)))


@query(f"WITH {V1B} SELECT * FROM dp")
def diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.diff(*_pair(spark, sf_dir), use_hashes=False)


@query(f"WITH {V1B} SELECT * FROM dp WHERE type = 'left'")
def diff_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.filtered(d.diff(*_pair(spark, sf_dir), use_hashes=False), include=["-"])


@query(f"WITH {V1B} SELECT * FROM dp WHERE type = 'right'")
def diff_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.filtered(d.diff(*_pair(spark, sf_dir), use_hashes=False), include=["+"])


@query(f"WITH {V1B} SELECT * FROM dp WHERE type = 'changed'")
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.filtered(d.diff(*_pair(spark, sf_dir), use_hashes=False), include=["~"])


@query(f"WITH {V1B} SELECT * FROM dh")
def diff_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.diff(*_pair(spark, sf_dir))


@query(f"WITH {V1B} SELECT * FROM dh WHERE NOT is_dir AND type <> 'nothing' AND (type = 'left' OR changed & 20 <> 0) AND changed & 8 = 0")
def diff_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.filtered(d.diff(*_pair(spark, sf_dir)), include=["f-", "fs", "fx"], exclude=["l"])


@query(f"""WITH {V1B} SELECT CASE WHEN is_dir THEN 'd' ELSE 'f' END || CASE type WHEN 'left' THEN '----' WHEN 'right' THEN '++++' ELSE
  CASE WHEN changed & 2 <> 0 THEN 'm' ELSE '~' END || CASE WHEN changed & 4 <> 0 THEN 's' ELSE '~' END || CASE WHEN changed & 8 <> 0 THEN 'l' ELSE '~' END
  || CASE WHEN changed & 16 <> 0 THEN 'x' ELSE '~' END END AS code, path FROM dh WHERE type <> 'nothing'""")
def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.report(d.diff(*_pair(spark, sf_dir)))


@query(f"""WITH {V1B} SELECT count(*) FILTER (type = 'left' AND NOT is_dir) AS left_files, count(*) FILTER (type = 'left' AND is_dir) AS left_dirs,
  count(*) FILTER (type = 'right' AND NOT is_dir) AS right_files, count(*) FILTER (type = 'right' AND is_dir) AS right_dirs, count(*) FILTER (type = 'changed') AS changed,
  count(*) FILTER (type = 'nothing') AS not_changed, count(*) FILTER (changed & 2 <> 0) AS mode_changed, count(*) FILTER (changed & 4 <> 0) AS size_changed,
  count(*) FILTER (changed & 8 <> 0) AS mtime_changed, count(*) FILTER (changed & 16 <> 0) AS hash_changed FROM dh""")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.stats(d.diff(*_pair(spark, sf_dir)))


@query(f"WITH {V1B} SELECT type, id, path, changed, size FROM dp WHERE NOT is_dir AND (type = 'left' OR changed & 4 <> 0)")
def tosync_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.to_sync(*_pair(spark, sf_dir))


@query(f"""WITH {V1B}, m AS (SELECT hash, min(idx) AS idx FROM h WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM h2 WHERE hash IS NOT NULL) GROUP BY hash)
  SELECT m.hash, m.idx, e.id, e.path, e.size FROM m JOIN e USING (idx)""")
def tosync_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.to_sync_by_content(*_pair(spark, sf_dir))


@query(f"WITH {V1B} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM dp WHERE NOT is_dir AND (type = 'left' OR changed & 4 <> 0)")
def tosync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.sync_totals(d.to_sync(*_pair(spark, sf_dir)))


@query(f"WITH {V1B} SELECT type, id, path, changed, size FROM dh WHERE NOT is_dir AND (type = 'left' OR changed & 20 <> 0)")
def tosync_paths_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.to_sync(*_pair(spark, sf_dir), use_hashes=True)


@query(f"WITH {V1} SELECT hash, min(idx) AS idx FROM h WHERE hash IS NOT NULL GROUP BY hash")
def content_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.content_index(_v1(spark, sf_dir))


@query(f"WITH {V1} SELECT * FROM e WHERE id = sha1('src1/en')")
def entry_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v1(spark, sf_dir).by_id(hashlib.sha1(b"src1/en").hexdigest()).select("idx", "id", "path", "size", "mode", "mtime")


@query(f"WITH {V1} SELECT * FROM e WHERE idx = 42")
def entry_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v1(spark, sf_dir).by_index(42).select("idx", "id", "path", "size", "mode", "mtime")


@query(f"WITH {V1P} SELECT e.idx, e.path, e.size FROM e JOIN h USING (idx) WHERE h.hash IS NULL")
def pending_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pending(derived.documents_snapshot(spark, sf_dir, largest=5000)).select("idx", "path", "size")


@query(f"WITH {V1P} SELECT count(*) AS todo, coalesce(sum(e.size), 0)::BIGINT AS todo_bytes FROM e JOIN h USING (idx) WHERE h.hash IS NULL")
def pending_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pending_totals(derived.documents_snapshot(spark, sf_dir, largest=5000))


def _stored(snapshot, name: str):
    """Where the snapshot was stored for a query."""
    path = f"{shared_dir(snapshot.entries.sparkSession)}/{name}-{uuid.uuid4().hex}"
    store.write(snapshot, path)
    return path


@query(f"WITH {V1P.replace('5000', '9000')} SELECT e.idx, e.path, e.size FROM e JOIN h USING (idx) WHERE h.hash IS NULL")
def pending_after_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to digest of a stored snapshot whose run ended after two rounds of its log."""
    path = _stored(derived.documents_snapshot(spark, sf_dir, largest=5000), "rounds")
    log, todo = store.current(spark, path)["log_table"], store.read(spark, path).pending().select("idx", "id", "size")
    known = todo.join(_v1(spark, sf_dir).hashes, "idx")
    for low, high in ((5000, 7000), (7000, 9000)):
        store.append_digests(known.where((F.col("size") > low) & (F.col("size") <= high)), path, log)
    return store.read(spark, path).pending().select("idx", "path", "size")


@query(f"""WITH {V1}, c AS (SELECT idx, id, size + 65536 AS cost FROM e WHERE mode < 2147483648),
  small AS (SELECT idx, ((sum(cost) OVER (ORDER BY id) - cost) // 1000000)::BIGINT AS task, cost FROM c WHERE cost < 1000000),
  large AS (SELECT idx, ((SELECT coalesce((sum(cost) + 999999) // 1000000, 0) FROM small) + row_number() OVER (ORDER BY id) - 1)::BIGINT AS task, cost FROM c WHERE cost >= 1000000)
  SELECT idx, task, cost FROM small UNION ALL SELECT idx, task, cost FROM large""")
def digest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dealt to tasks of a million bytes."""
    files = _v1(spark, sf_dir).entries.where(modes.is_file(F.col("mode")))
    return dealing.deal(files, share=1_000_000)[0].select("idx", "task", "cost")


@query(f"WITH {V1B} SELECT * FROM dh")
def diff_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two stored snapshots, bucket by bucket."""
    return d.diff(*[store.read(spark, _stored(x, "side")) for x in _pair(spark, sf_dir)])


@query(f"WITH {V1} SELECT e.idx, e.id, path, size, hash FROM e LEFT JOIN h USING (idx) WHERE id = sha1('src1/en') OR e.idx = 42")
def entry_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of a stored snapshot, by id and by index, with digests."""
    stored = store.read(spark, _stored(_v1(spark, sf_dir), "points"))
    found = [store.Snapshot(rows, stored.hashes).with_any_hash() for rows in (stored.by_id(hashlib.sha1(b"src1/en").hexdigest()), stored.by_index(42))]
    return found[0].unionByName(found[1]).select("idx", "id", "path", "size", "hash")


@query(f"WITH {V1B} SELECT e2.idx, h.hash FROM e2 LEFT JOIN e ON e.id = e2.id LEFT JOIN h ON h.idx = e.idx WHERE e2.mode < 2147483648")
def update_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, later = _pair(spark, sf_dir)
    return stats.carry_hashes(later.entries, before).drop("id")


@query(f"""WITH {V1B} SELECT e2.idx, CASE WHEN e.size = e2.size AND e.mtime = e2.mtime THEN h.hash END AS hash
  FROM e2 LEFT JOIN e ON e.id = e2.id LEFT JOIN h ON h.idx = e.idx WHERE e2.mode < 2147483648""")
def update_carry_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, later = _pair(spark, sf_dir)
    return stats.carry_hashes(later.entries, before, strict=True).drop("id")


NODES = f"""WITH {V3}, leaf AS (SELECT DISTINCT string_split(path, '/') AS parts FROM p), n AS (SELECT DISTINCT parts[1:k] AS parts FROM leaf, generate_series(1, 8) g(k) WHERE k <= len(parts)),
  nodes AS (SELECT array_to_string(n.parts, '/') AS path, CASE WHEN len(n.parts) > 1 THEN array_to_string(n.parts[1:len(n.parts) - 1], '/') ELSE '.' END AS parent,
  n.parts[len(n.parts)] AS name, len(n.parts)::INTEGER AS depth, leaf.parts IS NULL AS implied FROM n LEFT JOIN leaf ON leaf.parts = n.parts)"""


def _page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.nodes(derived.pages_entries(spark, sf_dir)).select("path", "parent", "name", "depth", "implied")


@query(f"{NODES} SELECT * FROM nodes")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_tree(spark, sf_dir)


@query(f"{NODES} SELECT * FROM nodes WHERE depth <= 2")
def tree_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.limited(_page_tree(spark, sf_dir), 2)


@query(f"{NODES} SELECT * FROM nodes WHERE path = 'blog.ththan.example.net/en' OR starts_with(path, 'blog.ththan.example.net/en/')")
def tree_subpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = intervals.labelled(derived.pages_entries(spark, sf_dir)).select("path", "parent", "name", "depth", "implied", "pre", "last")
    return t.within(tree, "/blog.ththan.example.net/en/", must_exist=False).drop("pre", "last")


@query(f"WITH {V2} SELECT 1 + count(*) FILTER (is_dir) AS directories, count(*) FILTER (NOT is_dir) AS files FROM allsig")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.counts(t.nodes(derived.events_tree(spark, sf_dir)))


@query(f"WITH {V1} SELECT 1 + count(*) AS directories, 0::BIGINT AS files FROM e WHERE mode >= 2147483648 AND path <> '.'")
def tree_dirs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.counts(t.nodes(_v1(spark, sf_dir).entries, only_dirs=True))


@query(f"""{NODES}, o AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS pre FROM nodes)
  SELECT a.path, a.pre, max(b.pre) AS last FROM o a JOIN o b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.path, a.pre""")
def tree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the nodes in the traversal by names, and of the last node below each."""
    return intervals.labelled(derived.pages_entries(spark, sf_dir)).select("path", "pre", "last")


@query(f"""{NODES}, m AS (SELECT *, name = max(name) OVER (PARTITION BY parent) AS last FROM nodes WHERE depth <= 2)
  SELECT CASE WHEN a.depth < 2 THEN '' WHEN b.last THEN '    ' ELSE '│   ' END || CASE WHEN a.last THEN '└── ' ELSE '├── ' END || a.name AS line
  FROM m a LEFT JOIN m b ON a.depth = 2 AND b.depth = 1 AND b.path = a.parent WHERE NOT starts_with(a.path, '.') AND NOT contains(a.path, '/.')""")
def tree_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.lines(t.limited(intervals.labelled(derived.pages_entries(spark, sf_dir)), 2)).select("line")


@query(f"WITH {V2} SELECT * FROM allsig")
def merkle_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.signatures(intervals.labelled(derived.events_tree(spark, sf_dir))).select("path", "signature", "is_dir")


@query(f"WITH {V2} SELECT * FROM allsig")
def merkle_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the tree from those of an earlier one, which lacked some users and had others twice."""
    tree = materialise(derived.events_tree(spark, sf_dir).select("idx", "path", "mode"), "tree")
    user = F.get(F.split("path", "/"), F.lit(1)).cast("int")
    twice = tree.where(user % 50 == 9).withColumn("path", F.regexp_replace("path", "^(live|backup)/", "$1/copy-"))
    earlier = merkle.signatures(intervals.labelled(tree.where(user.isNull() | (user % 50 != 7)).unionByName(twice)))
    added, removed = merkle.changes(earlier, t.nodes(tree))
    return merkle.refreshed(earlier, merkle.refresh(earlier, added, removed), removed).select("path", "signature", "is_dir")


@query(f"""WITH {V2}, dirs AS (SELECT path, signature, string_split(path, '/') AS parts FROM allsig WHERE is_dir),
  keys AS (SELECT path, signature, parts, rank() OVER (PARTITION BY signature ORDER BY parts[1] DESC, parts[2] DESC NULLS FIRST, parts[3] DESC NULLS FIRST) = 1 AS first FROM dirs),
  open AS (SELECT k.path, k.signature FROM keys k WHERE NOT EXISTS (SELECT 1 FROM keys a WHERE NOT a.first AND starts_with(k.path, a.path || '/')))
  SELECT signature, path FROM open WHERE signature IN (SELECT signature FROM open GROUP BY signature HAVING count(*) > 1)""")
def dupes_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.duplicate_subtrees(merkle.signatures(intervals.labelled(derived.events_tree(spark, sf_dir))))


@query(f"""WITH {V2}, dirs AS (SELECT path, signature, string_split(path, '/') AS parts FROM allsig WHERE is_dir),
  keys AS (SELECT path, signature, parts, rank() OVER (PARTITION BY signature ORDER BY parts[1] DESC, parts[2] DESC NULLS FIRST, parts[3] DESC NULLS FIRST) = 1 AS first FROM dirs),
  open AS (SELECT k.path, k.signature FROM keys k WHERE NOT EXISTS (SELECT 1 FROM keys a WHERE NOT a.first AND starts_with(k.path, a.path || '/'))),
  groups AS (SELECT signature, count(*) AS n FROM open GROUP BY signature HAVING count(*) > 1)
  SELECT signature, 0 AS part, 'Signature: ' || signature AS line FROM groups UNION ALL SELECT signature, 1, '  ' || path FROM open JOIN groups USING (signature) UNION ALL SELECT signature, 3, '' FROM groups""")
def dupes_subtrees_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report on duplicate subtrees."""
    return merkle.duplicate_lines(merkle.signatures(intervals.labelled(derived.events_tree(spark, sf_dir)))).select("signature", "part", "line")


#: CRC-32 over the bytes of a text: the table of its 256 steps, then a step per byte.
CRC = """
steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS s FROM range(256) r(i)),
texts AS (SELECT hex(encode(concat_ws(chr(31), idx, id, path, size, mode, strftime(mtime, '%Y-%m-%d %H:%M:%S')))) AS x FROM e),
crcs AS (SELECT xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1]))) AS crc FROM texts, steps)"""


@query(f"""WITH {V1}, {CRC}, c AS (SELECT 'entries_count' AS "check", count(*)::VARCHAR AS actual FROM e UNION ALL SELECT 'file_count', count(*)::VARCHAR FROM e WHERE mode < 2147483648
  UNION ALL SELECT 'checksum', sum(crc)::VARCHAR FROM crcs)
  SELECT "check", actual AS expected, actual, true AS ok FROM c
  UNION ALL SELECT 'wrong_ids', '0', n::VARCHAR, n = 0 FROM (SELECT count(*) AS n FROM e WHERE id <> sha1(path))
  UNION ALL SELECT 'unmatched_slots', '0', n::VARCHAR, n = 0 FROM (SELECT count(*) AS n FROM (SELECT idx FROM e WHERE mode < 2147483648) f FULL JOIN h ON h.idx = f.idx WHERE h.idx IS NULL OR f.idx IS NULL)""")
def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = _v1(spark, sf_dir)
    return stats.check(snapshot, store.describe(snapshot))


@query(f"""WITH {V1}, hit AS (SELECT substr(id, 1, 3) AS r FROM e WHERE idx = 42), lost AS (SELECT substr(id, 1, 3) AS r FROM e WHERE path = 'src1/en'),
  n AS (SELECT substr(id, 1, 3) AS r, count(*) AS n, count(*) FILTER (path = 'src1/en') AS gone FROM e GROUP BY ALL)
  SELECT 'entries' AS part, r AS range, n AS expected_rows, n - gone AS actual_rows FROM n WHERE r IN (SELECT r FROM hit UNION SELECT r FROM lost)""")
def damaged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ids in which a snapshot differs from its checksums: one row was changed, and one is gone."""
    whole = _v1(spark, sf_dir).entries
    changed = whole.where("path <> 'src1/en'").withColumn("size", F.when(F.col("idx") == 42, F.col("size") + 1).otherwise(F.col("size")))
    return store.damaged_ranges(store.range_sums(whole, None), changed, None)


@query(f"""WITH {V1P}, g AS (SELECT count(*) AS n, sum(size) AS b, arg_max(size, idx) AS one FROM eh GROUP BY hash HAVING count(*) > 1),
  f AS (SELECT count(*) FILTER (mode >= 2147483648) AS dir_count, count(*) FILTER (mode < 2147483648) AS file_count, coalesce(sum(size) FILTER (mode < 2147483648), 0)::BIGINT AS total_size,
  coalesce(max(size) FILTER (mode < 2147483648), 0)::BIGINT AS max_size, (sum(size) FILTER (mode < 2147483648) // count(*) FILTER (mode < 2147483648))::BIGINT AS avg_size FROM e)
  SELECT f.*, (SELECT count(hash) FROM h) AS hashed, (SELECT count(*) - count(hash) FROM h) AS pending, coalesce(sum(n), 0)::BIGINT AS dup_files,
  coalesce(sum(b), 0)::BIGINT AS dup_bytes, coalesce(sum(b - one), 0)::BIGINT AS savable_bytes FROM f, g GROUP BY ALL""")
def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = derived.documents_snapshot(spark, sf_dir, largest=5000)
    return stats.file_stats(snapshot.entries).crossJoin(F.broadcast(stats.hash_stats(snapshot)))  # one row by one row
