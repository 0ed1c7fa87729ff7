"""Layout records made from the test tables by integer arithmetic, as common table expressions for Spark and for the oracle."""

from __future__ import annotations

#: Per dialect: rows of lines, words of a text, blocks of an HTML page.
SPLIT = {
    "spark": {
        "lines": "SELECT doc_id, n, line FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (n, line) FROM documents)",
        "words": "SELECT DISTINCT doc_id, word FROM (SELECT doc_id, explode(regexp_extract_all(lower(text), r'[\\p{L}\\p{N}]{3,}', 0)) AS word FROM documents)",
        "cut_blocks": "SELECT page_id, posexplode(filter(split(regexp_replace(regexp_replace(html, r'(?i)</?(?:ul|ol|div|body|html|h[1-6]/|p/|li/|head|title|article|section|table|tr|td)[^>]*>|</(?:h[1-6]|p|li)>', '\\u0001'), r'(?i)<(h[1-6]|p|li)(?: [^>]*)?>', '\\u0001$1\\u0002'), '\\u0001'), t -> t RLIKE r'^(?:h[1-6]|p|li)\\x02')) AS (i, raw) FROM pages",
        "line_words": "SELECT doc_id, page, n, x + i * 12 AS x0, y AS y0, x + i * 12 + 10 AS x1, y + h AS y1, i, word FROM (SELECT doc_id, page, n, x, y, h, posexplode(split(trim(text), ' ')) AS (i, word) FROM layout) WHERE word <> ''",
        "page_words": "SELECT DISTINCT page_id, word FROM (SELECT page_id, explode(regexp_extract_all(lower(regexp_replace(regexp_replace(html, r'(?s)<(script|style)[^>]*>.*?</(script|style)>', ' '), r'<[^>]*>', ' ')), r'[\\p{L}\\p{N}]{3,}', 0)) AS word FROM pages)",
        "block_words": "SELECT DISTINCT page_id, word FROM (SELECT page_id, explode(regexp_extract_all(lower(text), r'[\\p{L}\\p{N}]{3,}', 0)) AS word FROM html_blocks)",
        "strip": "trim(regexp_replace(regexp_replace(regexp_replace(raw, r'^[a-z0-9]+\\x02', ''), r'<[^>]*>', ''), r'\\s+', ' '))",
    },
    "duck": {
        "lines": "SELECT doc_id, (n - 1)::INT AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)",
        "words": "SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}')) AS word FROM documents)",
        "cut_blocks": "SELECT page_id, (i - 1)::INT AS i, raw FROM (SELECT page_id, unnest(cut) AS raw, generate_subscripts(cut, 1) AS i FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(html, '(?i)</?(?:ul|ol|div|body|html|h[1-6]/|p/|li/|head|title|article|section|table|tr|td)[^>]*>|</(?:h[1-6]|p|li)>', chr(1), 'g'), '(?i)<(h[1-6]|p|li)(?: [^>]*)?>', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda t: regexp_matches(t, '^(?:h[1-6]|p|li)\\x02')) AS cut FROM pages))",
        "line_words": "SELECT doc_id, page, n, x + i * 12 AS x0, y AS y0, x + i * 12 + 10 AS x1, y + h AS y1, i, word FROM (SELECT doc_id, page, n, x, y, h, unnest(string_split(trim(text), ' ')) AS word, (generate_subscripts(string_split(trim(text), ' '), 1) - 1)::INT AS i FROM layout) WHERE word <> ''",
        "page_words": "SELECT DISTINCT page_id, word FROM (SELECT page_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')), '[\\p{L}\\p{N}]{3,}')) AS word FROM pages)",
        "block_words": "SELECT DISTINCT page_id, word FROM (SELECT page_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}')) AS word FROM html_blocks)",
        "strip": "trim(regexp_replace(regexp_replace(regexp_replace(raw, '^[a-z0-9]+\\x02', ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))",
    },
}

#: (name, text, what it builds on); {key} is taken from SPLIT.
PARTS = [
    ("raw_lines", "{lines}", []),
    ("markdown_lines", """SELECT doc_id, n, CASE (doc_id + n * 5) % 23 WHEN 0 THEN concat('## ', line) WHEN 1 THEN concat('- ', line) WHEN 2 THEN concat('  - ', line) WHEN 3 THEN concat('     1. ', line) WHEN 4 THEN ''
        WHEN 5 THEN '```py' WHEN 20 THEN CASE WHEN doc_id % 5 = 0 THEN '````' ELSE '```' END WHEN 14 THEN '~~~' WHEN 19 THEN '~~~~' WHEN 6 THEN concat('| ', line, ' | b |') WHEN 11 THEN '| --- | :--- |' WHEN 16 THEN concat('x | ', line)
        WHEN 12 THEN concat('    ', line) WHEN 13 THEN concat('10) ', line) WHEN 17 THEN '  ' WHEN 18 THEN '![picture](a.png)' ELSE line END AS line FROM raw_lines""", ["raw_lines"]),
    ("placed", """SELECT *, doc_id % 3 = 0 AND doc_id % 4 <> 0 AND (doc_id + b) % 5 = 0 AND b < 1000 AS celled, (doc_id + b) % 17 = 0 AND b < 1000 AS wide, doc_id % 4 = 0 AS two FROM
        (SELECT doc_id, CAST(floor(n / 40) AS INT) AS page, n, CAST(n % 40 AS INT) AS k, CASE WHEN doc_id % 3 = 0 THEN CAST(floor((n % 40) / 2) AS INT) ELSE CAST(n % 40 AS INT) END AS b, line FROM raw_lines
        UNION ALL SELECT doc_id, 0, CAST(1000000 + j AS INT), CAST(40 + j AS INT), CAST(1000 + j AS INT), concat('Item ', CAST(j AS STRING)) FROM documents CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS js WHERE doc_id % 8 = 5) AS l""", ["raw_lines"]),
    ("layout", """SELECT doc_id, page, n, b AS block,
        CASE WHEN celled AND k % 2 = 1 THEN 300 WHEN (two OR b >= 1000) AND NOT wide AND b % 2 = 1 THEN 330 ELSE 72 END AS x,
        60 + (CASE WHEN celled AND k % 2 = 1 THEN k - 1 ELSE k END) * 16 + CAST(floor(k / 8) AS INT) * 24 + CASE WHEN doc_id % 5 = 1 AND k >= 20 THEN 70 ELSE 0 END AS y,
        CASE WHEN celled THEN 150 WHEN wide THEN 460 WHEN two THEN 220 ELSE 400 END AS w, 12 AS h,
        CASE WHEN n = 0 THEN 18 WHEN (doc_id * 7 + b * 13) % 11 = 0 THEN 14 ELSE 11 END AS size,
        CASE WHEN (doc_id + b) % 5 = 0 THEN CASE WHEN n % 2 = 0 THEN 16 ELSE 0 END ELSE 0 END + CASE WHEN (doc_id + b) % 7 = 0 THEN 2 ELSE 0 END AS flags,
        CASE WHEN (doc_id + b) % 5 = 0 THEN 'Plain-Bold' WHEN (doc_id + b) % 6 = 1 THEN 'Plain-Oblique' ELSE 'Plain' END AS font,
        CASE WHEN doc_id % 5 = 1 AND k = 20 THEN concat('Figure ', CAST(n AS STRING), '. ', line)
             WHEN (doc_id + n) % 9 = 1 THEN concat(CASE n % 4 WHEN 0 THEN '• ' WHEN 1 THEN '- ' WHEN 2 THEN '* ' ELSE '  ‣ ' END, line)
             WHEN (doc_id + n) % 9 = 2 THEN concat(CAST(n AS STRING), CASE WHEN n % 2 = 0 THEN '. ' ELSE ') ' END, line)
             WHEN (doc_id + n) % 23 = 3 THEN concat(CASE WHEN n % 2 = 0 THEN 'Figure ' ELSE 'fig.' END, CAST(n AS STRING), ' ', line)
             WHEN doc_id % 8 = 3 AND n % 3 = 1 THEN concat('Revenue 1,316,892 ', CAST(n AS STRING), '.5 12% ', line)
             ELSE line END AS text
        FROM (SELECT * FROM placed UNION ALL SELECT doc_id, page, n + 2000000, k + 20, b + 2000, '  ', false, wide, two FROM placed WHERE (doc_id + n) % 13 = 5) AS both_kinds""", ["placed"]),
    ("page_box", "SELECT DISTINCT doc_id, page, 612 AS width, 860 AS height FROM layout", ["layout"]),
    ("images", "SELECT doc_id, page, 0 AS i, 100 AS x, 60 + CAST(doc_id * 13 % 400 AS INT) AS y, 200 AS w, 120 AS h FROM page_box WHERE doc_id % 6 = 1", ["page_box"]),
    ("all_blocks", """SELECT doc_id, page, block AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(size) AS size, count(*) AS n_lines,
        count(CASE WHEN trim(text) <> '' THEN 1 END) AS n_full, trim(agg[trim(text); ' '; n]!) AS text FROM layout GROUP BY doc_id, page, block""", ["layout"]),
    ("blocks", "SELECT doc_id, page, n, x, y, w, h, size, n_lines, text FROM all_blocks WHERE n_full > 0", ["all_blocks"]),
    ("body", """SELECT doc_id, page, max_by(size, (weight, 0 - first_n)) AS body FROM
        (SELECT doc_id, page, size, sum(length(text)) AS weight, min(n) AS first_n FROM layout GROUP BY doc_id, page, size) AS s GROUP BY doc_id, page""", ["layout"]),
    ("levels", """SELECT doc_id, page, size, CAST(least(4, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY size DESC)) AS INT) AS level FROM
        (SELECT DISTINCT l.doc_id, l.page, l.size FROM layout AS l JOIN body AS o ON l.doc_id = o.doc_id AND l.page = o.page WHERE l.size * 100 >= o.body * 115) AS s""", ["layout", "body"]),
    ("drawings", """SELECT doc_id, page, d, CASE d WHEN 3 THEN 40 WHEN 4 THEN 72 WHEN 5 THEN CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 64 END WHEN 6 THEN 30 ELSE 60 + 8 * d END AS x,
        CASE d WHEN 3 THEN 40 WHEN 4 THEN 100 WHEN 5 THEN CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 61 + CAST(doc_id * 31 % 500 AS INT) END WHEN 6 THEN 30 ELSE 60 + CAST((doc_id * 31 + d * 97) % 500 AS INT) END AS y,
        CASE d WHEN 3 THEN 532 WHEN 4 THEN 400 WHEN 5 THEN CASE WHEN doc_id % 7 = 0 THEN 612 ELSE 100 END WHEN 6 THEN 552 ELSE 300 END AS w,
        CASE d WHEN 3 THEN 780 WHEN 4 THEN 1 WHEN 5 THEN CASE WHEN doc_id % 7 = 0 THEN 860 ELSE 30 END WHEN 6 THEN 800 ELSE 40 END AS h,
        CASE WHEN d IN (3, 4, 6) THEN NULL WHEN d = 5 AND doc_id % 7 = 0 THEN '#FFFFFF' WHEN (doc_id + d) % 3 = 0 THEN '#3C78D8' WHEN (doc_id + d) % 3 = 1 THEN '#F9CB9C' ELSE '#111111' END AS fill,
        CASE d WHEN 1 THEN '#000000' WHEN 3 THEN '#808080' WHEN 4 THEN '#1F4E79' WHEN 6 THEN '#000000' END AS stroke, CAST(CASE d WHEN 3 THEN 2.0 WHEN 4 THEN 0.5 WHEN 1 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS width
        FROM (SELECT doc_id, page, CAST(k AS INT) AS d FROM page_box CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS ks) AS p
        WHERE doc_id % 9 <> 8 AND (d <> 3 OR doc_id % 5 = 0) AND (d <> 6 OR doc_id % 10 = 0)""", ["page_box"]),
    ("fills", "SELECT d.doc_id, d.page, d.d AS f, d.x, d.y, d.w, d.h, d.fill FROM drawings AS d JOIN page_box AS p ON d.doc_id = p.doc_id AND d.page = p.page WHERE d.fill IS NOT NULL AND NOT (d.w >= p.width - 2 AND d.h >= p.height - 2)", ["drawings", "page_box"]),
    ("borders", """SELECT doc_id, page, stroke AS color, width, n, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first_d) AS INT) AS place FROM
        (SELECT doc_id, page, stroke, width, count(*) AS n, min(d) AS first_d FROM drawings WHERE stroke IS NOT NULL GROUP BY doc_id, page, stroke, width) AS s""", ["drawings"]),
    ("frames", """SELECT doc_id, page, max_by(d, (w * h, 0 - d)) AS d, max_by(stroke, (w * h, 0 - d)) AS color, max_by(width, (w * h, 0 - d)) AS width FROM
        (SELECT d.* FROM drawings AS d JOIN page_box AS p ON d.doc_id = p.doc_id AND d.page = p.page WHERE d.stroke IS NOT NULL AND d.w * 100 >= 60 * p.width AND d.w < p.width - 1 AND d.h * 100 >= 60 * p.height AND d.h < p.height - 1) AS c GROUP BY doc_id, page""", ["drawings", "page_box"]),
    ("words", "{line_words}", ["layout"]),
    ("fill_text", """SELECT f.doc_id, f.page, f.f, f.fill, coalesce(t.text, '') AS text FROM fills AS f LEFT JOIN (SELECT f.doc_id, f.page, f.f, substr(trim(agg[w.word; ' '; w.n, w.i]!), 1, 60) AS text FROM fills AS f JOIN words AS w
        ON f.doc_id = w.doc_id AND f.page = w.page AND w.x0 >= f.x - 1 AND w.x1 <= f.x + f.w + 1 AND w.y0 >= f.y - 1 AND w.y1 <= f.y + f.h + 1 GROUP BY f.doc_id, f.page, f.f) AS t ON f.doc_id = t.doc_id AND f.page = t.page AND f.f = t.f""", ["fills", "words"]),
    ("multi_pages", """SELECT doc_id, page, count(*) >= 6 AND count(CASE WHEN x + w / 2 < 286 THEN 1 END) >= 3 AND count(CASE WHEN x + w / 2 > 326 THEN 1 END) >= 3
        AND count(CASE WHEN x + w / 2 < 286 THEN 1 END) * 4 > count(*) AND count(CASE WHEN x + w / 2 > 326 THEN 1 END) * 4 > count(*) AS multi FROM all_blocks GROUP BY doc_id, page""", ["all_blocks"]),
    ("short_columns", "SELECT doc_id, page, b, count(*) AS n FROM (SELECT doc_id, page, CAST(floor(x / 5.0 + 0.5) AS INT) * 5 AS b FROM layout WHERE cnt[text;'[^\\s]+']! BETWEEN 1 AND 4) AS s GROUP BY doc_id, page, b", ["layout"]),
    ("numeric_lines", "SELECT doc_id, page, n, cnt[text;'-?[0-9,]*[.]?[0-9]+%?']! >= 2 AND like[text;'([$]?-?[0-9,]*[.]?[0-9]+%?)(\\s+[$]?-?[0-9,]*[.]?[0-9]+%?)+']! AS is_numeric FROM layout", ["layout"]),
    ("tabular_pages", """SELECT p.doc_id, p.page, coalesce(a.tabular, false) AS by_geometry, coalesce(b.n, 0) >= 3 AS by_content FROM page_box AS p
        LEFT JOIN (SELECT doc_id, page, sum(n) >= 8 AND count(CASE WHEN n >= 3 THEN 1 END) >= 2 AS tabular FROM short_columns GROUP BY doc_id, page) AS a ON p.doc_id = a.doc_id AND p.page = a.page
        LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM numeric_lines WHERE is_numeric GROUP BY doc_id, page) AS b ON p.doc_id = b.doc_id AND p.page = b.page""", ["page_box", "short_columns", "numeric_lines"]),
    ("llm_modes", "SELECT 'auto' AS llm UNION ALL SELECT 'all' UNION ALL SELECT 'none'", []),
    ("routes", """SELECT s.doc_id, s.page, c.llm, CAST(s.chars AS BIGINT) AS chars,
        CASE WHEN c.llm = 'all' OR c.llm = 'auto' AND s.chars < 90 THEN 'llm' ELSE 'text' END AS mode,
        CASE WHEN c.llm = 'all' THEN 'forced (all)' WHEN c.llm = 'none' THEN 'forced (none)' WHEN s.chars < 90 THEN 'scanned' WHEN m.multi THEN 'multi-column' WHEN t.by_geometry OR t.by_content THEN 'tabular' ELSE 'clean' END AS reason
        FROM (SELECT doc_id, page, sum(length(text)) AS chars FROM layout GROUP BY doc_id, page) AS s JOIN multi_pages AS m ON s.doc_id = m.doc_id AND s.page = m.page
        JOIN tabular_pages AS t ON s.doc_id = t.doc_id AND s.page = t.page CROSS JOIN llm_modes AS c""", ["layout", "multi_pages", "tabular_pages", "llm_modes"]),
    ("cells", """SELECT l_orderkey AS t, CAST(l_linenumber AS INT) AS r, CAST(c AS INT) AS c, 40 + c * 90 AS x,
        40 + c * 90 + CASE WHEN (l_orderkey + l_linenumber + c) % 7 = 0 THEN 150 ELSE 60 END AS x_end,
        CASE WHEN l_linenumber = 1 THEN 'Head' WHEN c = 0 THEN l_returnflag WHEN c = 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN c = 2 THEN concat(CAST(CAST(l_discount * 100 AS INT) AS STRING), '%') ELSE CASE WHEN l_partkey % 5 = 0 THEN l_linestatus ELSE concat('$', CAST(l_suppkey AS STRING)) END END AS text,
        (l_partkey + c) % 2 = 0 AS bold, (l_suppkey + c) % 3 = 0 AS italic
        FROM lineitem CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS cs
        WHERE (c < 3 OR l_linenumber % 2 = 1) AND NOT (c = 2 AND (l_orderkey + l_linenumber) % 5 = 0)""", []),
    ("cell_bands", """SELECT t, band, min(x) AS x0, max(x) AS x1 FROM (SELECT t, x, CAST(sum(brk) OVER (PARTITION BY t ORDER BY x) AS INT) AS band FROM
        (SELECT t, x, CASE WHEN x - lag(x) OVER (PARTITION BY t ORDER BY x) > 25 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT t, x FROM cells) AS d) AS g) AS k GROUP BY t, band""", ["cells"]),
    ("banded_cells", """SELECT c.t, c.r, c.c, c.x_end, b.band, min(b.band) OVER (PARTITION BY c.t, c.r ORDER BY b.band RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_band
        FROM cells AS c JOIN cell_bands AS b ON c.t = b.t AND c.x >= b.x0 AND c.x <= b.x1""", ["cells", "cell_bands"]),
    ("attempts", """SELECT user_id AS doc_id, CAST(event_id % 20 AS INT) AS page, event_id AS attempt, CASE event_type WHEN 'click' THEN 'json' WHEN 'view' THEN 'json_escalated' WHEN 'purchase' THEN 'code_text' ELSE 'code_image' END AS rung,
        CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS rank, event_id % 3 = 0 AS ok, CAST(400 + event_id % 120 AS INT) AS code, CASE WHEN event_id % 7 = 0 THEN 'tool_use_failed' WHEN event_id % 31 = 5 THEN 'Cancel: stopped' ELSE 'status' END AS message FROM events""", []),
    ("page_state", """SELECT doc_id, page, CASE WHEN bool_or(ok) THEN 'completed' WHEN count(*) > 2 THEN 'failed' ELSE 'pending' END AS status, count(*) AS tries,
        min(CASE WHEN ok THEN rank END) AS rung, CAST(sum(attempt % 50) AS BIGINT) AS chars FROM attempts GROUP BY doc_id, page""", ["attempts"]),
    ("html_raw", "{cut_blocks}", []),
    ("html_blocks", """SELECT page_id, i, CASE WHEN raw LIKE 'h%' THEN 'heading' WHEN raw LIKE 'li%' THEN 'list' ELSE 'paragraph' END AS type, CASE WHEN raw LIKE 'h%' THEN CAST(substr(raw, 2, 1) AS INT) END AS level, {strip} AS text FROM html_raw""", ["html_raw"]),
    ("doc_words", "{words}", []),
    ("page_words", "{page_words}", []),
    ("block_words", "{block_words}", ["html_blocks"]),
    ("running", """SELECT doc_id AS page, k, CASE WHEN doc_id % 11 = 0 AND k = 0 THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN doc_id % 13 = 0 AND k = 2 THEN 'page_footer' ELSE 'text' END AS label,
        CASE WHEN k = 0 THEN 840 WHEN k = 3 THEN 400 ELSE 20 END AS cy, 860 AS page_h, CASE WHEN k = 0 THEN concat(CASE WHEN doc_id % 2 = 0 THEN 'REPORT  ' ELSE 'Report ' END, CAST(doc_id % 7 AS STRING)) WHEN k = 1 THEN
        CASE doc_id % 4 WHEN 0 THEN CAST(doc_id + 530 AS STRING) WHEN 1 THEN concat('Page ', CAST(doc_id + 530 AS STRING)) WHEN 2 THEN concat(CAST(doc_id + 530 AS STRING), ' of 9999') ELSE concat(CAST(doc_id AS STRING), '/20') END ELSE concat('Only on ', text) END AS raw
        FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS ks""", []),
    ("margin_lines", """SELECT page, k, layer, label, cy, raw, layer = 'furniture' OR label IN ('page_header', 'page_footer') AS furniture,
        CASE WHEN cy * 100 > 88 * page_h THEN 'header' WHEN cy * 100 < 12 * page_h THEN 'footer' WHEN label = 'page_header' THEN 'header' WHEN label = 'page_footer' THEN 'footer' END AS band,
        trim(rx[rx[lower(raw);'[0-9]+';'#']!;'\\s+';' ']!) AS norm FROM running WHERE trim(raw) <> ''""", ["running"]),
    ("running_groups", "SELECT band, norm, count(*) AS pages, min_by(raw, page) AS first_raw, min(page) AS first_page FROM (SELECT band, norm, page, min(raw) AS raw FROM margin_lines WHERE band IS NOT NULL GROUP BY band, norm, page) AS one GROUP BY band, norm HAVING count(*) >= 2", ["margin_lines"]),
]


def prefix(needs: list[str], dialect: str, given: tuple[str, ...] = ()) -> str:
    """WITH clause of the parts needed, and of what those build on; the parts given are there already."""
    known = {name: (text, on) for name, text, on in PARTS}
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted and name not in given:
            wanted.add(name)
            for x in known[name][1]:
                add(x)

    for name in needs:
        add(name)
    parts = []
    for name, text, _ in PARTS:
        if name in wanted:
            for key, value in SPLIT[dialect].items():
                text = text.replace("{" + key + "}", value)
            parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def translated(sql: str, dialect: str) -> str:
    """The few spellings in which the dialects differ: STRING, agg[value; separator; order]!, rx[text; pattern; by]!, like[text; pattern]!, cnt and each (matches)."""
    import re

    def agg(m: re.Match) -> str:
        v, sep, order = (x.strip() for x in m[1].rsplit(";", 2))
        return f"listagg({v}, {sep}) WITHIN GROUP (ORDER BY {order})" if dialect == "spark" else f"string_agg({v}, {sep} ORDER BY {order})"

    def rx(m: re.Match) -> str:
        v, p, by = (x.strip() for x in m[1].rsplit(";", 2))
        return f"regexp_replace({v}, r{p}, {by})" if dialect == "spark" else f"regexp_replace({v}, {p}, {by}, 'g')"

    def like(m: re.Match) -> str:
        v, p = (x.strip() for x in m[1].rsplit(";", 1))
        return f"({v} RLIKE r{p})" if dialect == "spark" else f"regexp_matches({v}, {p})"

    def cnt(m: re.Match) -> str:
        v, p = (x.strip() for x in m[1].rsplit(";", 1))
        return f"size(regexp_extract_all({v}, r{p}, 0))" if dialect == "spark" else f"len(regexp_extract_all({v}, {p}))"

    def each(m: re.Match) -> str:
        v, p = (x.strip() for x in m[1].rsplit(";", 1))
        return f"explode(regexp_extract_all({v}, r{p}, 0))" if dialect == "spark" else f"unnest(regexp_extract_all({v}, {p}))"

    for name, f in (("agg", agg), ("rx", rx), ("rx", rx), ("rx", rx), ("like", like), ("cnt", cnt), ("each", each)):
        sql = re.sub(rf"\b{name}\[((?:[^\[\]]|\[[^\[\]]*\])*?)\]!", f, sql)
    return sql if dialect == "spark" else re.sub(r"\bAS STRING\)", "AS VARCHAR)", sql)
