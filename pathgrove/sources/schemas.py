"""The tables of a snapshot. Nothing is inferred: every reader gives its schema."""

META = "version INT, root STRING, tool STRING, os STRING, arch STRING, created_at TIMESTAMP, features INT, hash_algo STRING, entries_count BIGINT, file_count BIGINT, checksum DECIMAL(38,0), revision INT, entries_table STRING, hashes_table STRING, log_table STRING, buckets INT, sums_table STRING"
ENTRIES = "idx BIGINT, id STRING, path STRING, size BIGINT, mode BIGINT, mtime TIMESTAMP, mtime_ns SMALLINT, tz_min SMALLINT"
HASHES = "idx BIGINT, id STRING, hash STRING"
SUMS = "part STRING, range STRING, rows BIGINT, files BIGINT, checksum DECIMAL(38,0)"
#: Fixed value: the feature bit of a snapshot that has content digests.
FEATURE_HASHES = 2
