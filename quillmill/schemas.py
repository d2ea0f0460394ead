"""Schemas of the library's tables, as DDL text; readers never infer them."""

FILES = "id long, path string, name string, size long, hash string, file_type string, content string, is_supported boolean, created_at timestamp, updated_at timestamp"
FOLDERS = "id long, path string, name string, last_scan_at timestamp, last_full_scan_at timestamp, file_count long, total_size long, schedule_enabled boolean, schedule_day string, schedule_time string"
QUERY_LOG = "id long, query string, searched_at timestamp"
SAVED_QUERIES = "id long, name string, query string, created_at timestamp"
TAGS = "id long, name string, color string, created_at timestamp"
FILE_TAGS = "file_path string, tag_id long, created_at timestamp"
SKIP_RULES = "name string, type string, pattern string, enabled boolean"
CHANGES = "event string, path string, old_path string, volume string, ts timestamp, is_dir boolean"
#: As change events stand on the wire, one JSON object a line.
CHANGE_LINES = "type string, event string, path string, volume string, timestamp long, oldPath string, isDirectory boolean"
JOURNAL = "file_id long, parent_id long, usn long, filetime long, reason long, attributes long, file_name string"
POSTINGS = "term string, doc_id long, field string, tf int, positions array<int>, lead boolean"
#: As they are written: by parts of the alphabet, in folders.
POSTINGS_IN_PARTS = POSTINGS + ", part int"
VOCABULARY = "term string, n_docs long, n_occurrences long"
DOC_STATS = "doc_id long, n_tokens long"
