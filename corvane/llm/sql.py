"""SQL for the queries of this package that SQL can state over whole tables: near-duplicates by counting shared
shingles, boundaries by measuring stretches, and arrivals by their definition."""

from __future__ import annotations

_TOKEN = "[a-z0-9ß-öø-ÿ]+|[぀-ヿ一-鿿]"

_P1 = f"""
WITH c AS (SELECT chunk_id AS id, regexp_extract_all(lower(text), '{_TOKEN}') AS t FROM parsed_chunks WHERE text IS NOT NULL),
s AS (SELECT DISTINCT id, array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT id, t, unnest(range(1, len(t) - 2)) AS i FROM c WHERE len(t) >= 20)),
f AS (SELECT asset_id, arg_min(asset_title, log_seq) FILTER (asset_title IS NOT NULL) AS any_title, min(log_seq) AS id FROM asset_index_log WHERE NOT deleted GROUP BY asset_id),
l AS (SELECT f.id, trim(regexp_replace(lower(a.asset_title), '[^a-z0-9ß-öø-ÿ぀-ヿ一-鿿]+', ' ', 'g')) AS t FROM f JOIN asset_index_log a ON a.log_seq = f.id WHERE a.asset_title IS NOT NULL),
u AS (SELECT DISTINCT id, substring(t, i, 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM l WHERE length(t) >= 3)),
k AS (SELECT 'chunk' AS kind, 6e-1 AS least, id, g FROM s UNION ALL SELECT 'title', 7e-1, id, g FROM u),
n AS (SELECT kind, id, count(*) AS n FROM k GROUP BY kind, id),
p AS (SELECT a.kind, a.least, a.id AS id_1, b.id AS id_2, count(*) AS shared FROM k a JOIN k b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.kind, id_1, id_2 FROM p JOIN n x ON x.kind = p.kind AND x.id = id_1 JOIN n y ON y.kind = p.kind AND y.id = id_2 WHERE shared >= least * (x.n + y.n - shared) - 1e-9"""

_W = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{001C}-\\x{001F}]"


def _longest(text: str, cut: str) -> str:
    """The length of the longest stretch, without white space at its ends."""
    return f"coalesce(list_max(list_transform(regexp_split_to_array({text}, '{cut}'), lambda x: length(regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')))), 0)"


_MARKED = f"regexp_replace(regexp_replace(text, '([。！？])', '\\1' || chr(1), 'g'), '([.!?])({_W})', '\\1' || chr(1) || '\\2', 'g')"
_P2 = f"""
WITH t AS (SELECT 'chunk' AS kind, chunk_id AS rec_id, text FROM parsed_chunks UNION ALL SELECT 'block', block_id, text FROM ir_blocks),
o AS (SELECT t.*, max_chars FROM t JOIN split_limits USING (kind) WHERE length(text) > max_chars)
SELECT kind, rec_id, CASE WHEN {_longest("text", "(?:\\r\\n|\\n|\\r)[ \\t]*(?:\\r\\n|\\n|\\r)")} <= max_chars THEN 'paragraph'
  WHEN {_longest(_MARKED, "[\\x01\\n\\r]")} <= max_chars THEN 'sentence'
  WHEN {_longest(_MARKED, "\\x01|" + _W)} <= max_chars THEN 'word' ELSE 'none' END AS boundary FROM o"""

_SUFFIX = "(?:[\\s_.\\-]+[0-9a-f]{8}|[\\s_.\\-]*\\((?:副本|コピー|copy|kopie|copie|copia|\\d{1,3})(?:\\s*\\d{1,3})?\\)|[\\s_.\\-]*(?:副本|コピー)|[\\s_.\\-]+(?:copy|kopie|copie|copia)(?:[\\s_.\\-]*\\d{1,3})?|[\\s_.\\-]+\\d{1,2})+$"


def _key(text: str, path: bool) -> str:
    if path:
        text = f"regexp_replace(coalesce(try(url_decode(regexp_replace({text}, '\\+', '%2B', 'g'))), {text}), '^.*[/\\\\]', '')"
    text = f"translate(lower(trim({text})), '（）　－＿．', '() -_.')"
    ext = f"regexp_extract({text}, '(\\.[a-z0-9]{{1,5}})$', 1)" if path else "''"
    stem = f"regexp_replace({text}, '\\.[a-z0-9]{{1,5}}$', '')" if path else text
    stem = f"regexp_replace(regexp_replace({stem}, '^(?:copy of |kopie von |copie de |copia de )', ''), '{_SUFFIX}', '')"
    return f"nullif(trim(regexp_replace({stem}, '[\\s_.\\-]+', ' ', 'g')), '') || {ext}"


_P4 = f"""
WITH a AS (SELECT log_seq AS s, asset_id, nullif(regexp_replace(lower(trim(sha256)), '^sha-?256[:=\\-]\\s*|[\\s:\\-]', '', 'g'), '') AS sha, {_key('asset_id', False)} AS key FROM asset_index_log WHERE NOT deleted),
x AS (SELECT asset_id, log_seq AS t FROM asset_index_log WHERE deleted),
m AS (SELECT r.s, max((q.sha = r.sha)::INT) AS same, max((q.key = r.key)::INT) AS alike FROM a r JOIN a q ON q.s < r.s AND (q.sha = r.sha OR q.key = r.key) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.asset_id = q.asset_id AND x.t > q.s AND x.t < r.s) GROUP BY r.s),
f AS (SELECT task_id, min(task_seq) AS task_seq FROM task_records GROUP BY task_id),
u AS (SELECT task_seq, generate_subscripts(uploaded_files, 1) - 1 AS ix, unnest(uploaded_files) AS file FROM task_records JOIN f USING (task_id, task_seq) WHERE origin_task_id IS NULL),
v AS (SELECT task_seq, ix, file, coalesce({_key('file', True)}, file) AS key FROM u WHERE file <> ''),
w AS (SELECT *, min(task_seq * 1000000 + ix) OVER (PARTITION BY file) AS same, min(task_seq * 1000000 + ix) OVER (PARTITION BY key) AS alike FROM v)
SELECT 'asset' AS kind, s AS rec_id, 0::INT AS item_ix, CASE WHEN same = 1 THEN 'exact' ELSE 'near' END AS how FROM m
UNION ALL SELECT 'task', task_seq, ix::INT, CASE WHEN same < task_seq * 1000000 + ix THEN 'exact' ELSE 'near' END FROM w WHERE alike < task_seq * 1000000 + ix"""

SQL: dict[str, str] = {"p1_found": _P1, "p2_found": _P2, "p4_found": _P4}
