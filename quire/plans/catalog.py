"""The operators as queries: (name, fixture parts, SQL). One text serves Spark and the oracle; hand-worked rows test the rules themselves."""

from __future__ import annotations

#: A bulleted and a numbered line, a numeric cell.
BULLET, NUMBERED = r"'^\s*[•·▪◦‣*-]\s+'", r"'^\s*[0-9]+[.)]\s+'"
NUMERIC = "'^-?[$]?[0-9,]*[.]?[0-9]+%?$'"

OPS: list[tuple[str, list[str], str]] = [
    ("slice_route_coverage", ["html_blocks", "page_words", "block_words"], """,
        w AS (SELECT page_id, count(*) AS n FROM page_words GROUP BY page_id),
        h AS (SELECT p.page_id, count(*) AS hits FROM page_words AS p JOIN block_words AS b ON p.page_id = b.page_id AND p.word = b.word GROUP BY p.page_id),
        c AS (SELECT page_id, sum(length(text)) AS chars, count(*) AS blocks FROM html_blocks GROUP BY page_id)
        SELECT c.page_id, CAST(c.chars AS BIGINT) AS chars, CASE WHEN c.chars < 90 THEN 'scanned' ELSE 'text' END AS mode, coalesce(w.n, 0) AS words, coalesce(h.hits, 0) AS hits,
        coalesce(h.hits, 0) * 10 >= coalesce(w.n, 0) * 6 AS ok FROM c LEFT JOIN w ON c.page_id = w.page_id LEFT JOIN h ON c.page_id = h.page_id"""),
    ("S2_page_text", ["documents"], "SELECT doc_id, text, length(text) AS chars FROM documents"),
    ("S6_page_size", ["page_box"], r"SELECT doc_id, page, width, height FROM page_box"),
    ("S7_spans", ["layout"], "SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS place, text, size, x, y FROM layout WHERE trim(text) <> ''"),
    ("S9_drawings", ["drawings"], r"SELECT doc_id, page, d, CASE WHEN h <= 3 OR w <= 3 THEN 'line' ELSE 'rect' END AS kind, coalesce(stroke, fill) AS color, width, x, y, x + w AS x1, y + h AS y1 FROM drawings WHERE coalesce(stroke, fill) IS NOT NULL AND coalesce(stroke, fill) <> '#FFFFFF'"),
    ("S17_markdown_lines", ["raw_lines"], "SELECT doc_id, n, CASE WHEN like[line;'^#{1,6} ']! THEN 'heading' WHEN like[line;'^ *[-*+] ']! THEN 'bullet' WHEN like[line;'^ *[0-9]+[.] ']! THEN 'number' WHEN like[line;'[|]']! THEN 'table' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM raw_lines"),
    ("S20_html_blocks", ["html_blocks"], "SELECT page_id, i, type, text FROM html_blocks"),
    ("K3_markdown", ["html_blocks"], r""", b AS (SELECT *, CASE WHEN type = coalesce(lag(type) OVER (PARTITION BY page_id ORDER BY i), '') AND type = 'list' THEN chr(10) ELSE concat(chr(10), chr(10)) END AS gap, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM html_blocks WHERE text <> '')
        SELECT page_id, agg[concat(CASE WHEN k = 1 THEN '' ELSE gap END, CASE type WHEN 'heading' THEN concat(repeat('#', least(6, level)), ' ', text) WHEN 'list' THEN concat('- ', text) ELSE text END); ''; i]! AS markdown FROM b GROUP BY page_id"""),
    ("K4_html", ["html_blocks"], r""", b AS (SELECT *, coalesce(lag(type) OVER (PARTITION BY page_id ORDER BY i), '') AS before, coalesce(lead(type) OVER (PARTITION BY page_id ORDER BY i), '') AS after, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM html_blocks WHERE text <> '')
        SELECT page_id, agg[CASE type WHEN 'heading' THEN concat('<h', CAST(level AS STRING), '>', esc, '</h', CAST(level AS STRING), '>') WHEN 'list' THEN concat(CASE WHEN before <> 'list' THEN '<ul>' ELSE '' END, '<li>', esc, '</li>', CASE WHEN after <> 'list' THEN '</ul>' ELSE '' END) ELSE concat('<p>', esc, '</p>') END; ''; i]! AS html FROM b GROUP BY page_id"""),
    ("K12_summary", ["page_box", "blocks", "images", "fills"], r""", b AS (SELECT doc_id, page, count(*) AS n, sum(length(text)) AS chars FROM blocks GROUP BY doc_id, page), i AS (SELECT doc_id, page, count(*) AS n FROM images GROUP BY doc_id, page), f AS (SELECT doc_id, page, count(*) AS n FROM fills GROUP BY doc_id, page)
        SELECT p.doc_id, count(*) AS pages, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS blocks, CAST(sum(coalesce(b.chars, 0)) AS BIGINT) AS chars, CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS images, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS fills
        FROM page_box AS p LEFT JOIN b ON p.doc_id = b.doc_id AND p.page = b.page LEFT JOIN i ON p.doc_id = i.doc_id AND p.page = i.page LEFT JOIN f ON p.doc_id = f.doc_id AND p.page = f.page GROUP BY p.doc_id"""),
    ("K13_text_prompt", ["layout", "all_blocks", "body", "page_box", "fill_text", "fills", "borders"], r""", l AS (SELECT l.doc_id, l.page, CAST(floor(b.y / 4.0 + 0.5) AS INT) AS band, b.x AS bx, l.block, l.n, concat('  x=', rpad(CAST(l.x AS STRING), 5, ' '), ' y=', rpad(CAST(l.y AS STRING), 5, ' '), ' | ', rx[l.text;'\s+$';'']!,
        CASE WHEN l.size * 100 >= o.body * 115 THEN concat(' [HEADING ~', CAST(l.size AS STRING), 'pt]') WHEN l.flags >= 16 OR lower(l.font) LIKE '%bold%' OR lower(l.font) LIKE '%black%' OR lower(l.font) LIKE '%heavy%' THEN ' [bold]' ELSE '' END) AS line
        FROM layout AS l JOIN all_blocks AS b ON l.doc_id = b.doc_id AND l.page = b.page AND l.block = b.n JOIN body AS o ON l.doc_id = o.doc_id AND l.page = o.page WHERE trim(l.text) <> ''),
        t AS (SELECT doc_id, page, agg[line; chr(10); band, bx, block, n]! AS lines FROM l GROUP BY doc_id, page),
        c AS (SELECT f.doc_id, f.page, agg[concat('  ', f.fill, '  at x=', rpad(CAST(f.x AS STRING), 4, ' '), ' y=', rpad(CAST(f.y AS STRING), 4, ' '), ' w=', rpad(CAST(f.w AS STRING), 4, ' '), ' h=', rpad(CAST(f.h AS STRING), 3, ' '), '  behind: "', t.text, '"'); chr(10); f.f]! AS fills FROM fills AS f JOIN fill_text AS t ON f.doc_id = t.doc_id AND f.page = t.page AND f.f = t.f GROUP BY f.doc_id, f.page),
        r AS (SELECT doc_id, page, agg[concat(color, ' ', CAST(CAST(width AS DECIMAL(5, 1)) AS STRING), 'pt (x', CAST(n AS STRING), ')'); ', '; place]! AS borders FROM borders GROUP BY doc_id, page)
        SELECT p.doc_id, p.page, concat('PAGE ', CAST(p.width AS STRING), 'x', CAST(p.height AS STRING), ' pt (body text ~', CAST(o.body AS STRING), '.0pt). Reading order:', CASE WHEN t.lines IS NULL THEN '' ELSE concat(chr(10), t.lines) END,
        CASE WHEN c.fills IS NULL THEN '' ELSE concat(chr(10), chr(10), 'FILLS', chr(10), c.fills) END, CASE WHEN r.borders IS NULL THEN '' ELSE concat(chr(10), 'BORDERS ', r.borders) END) AS prompt
        FROM page_box AS p JOIN body AS o ON p.doc_id = o.doc_id AND p.page = o.page LEFT JOIN t ON p.doc_id = t.doc_id AND p.page = t.page LEFT JOIN c ON p.doc_id = c.doc_id AND p.page = c.page LEFT JOIN r ON p.doc_id = r.doc_id AND p.page = r.page"""),
    ("F1_nonblank", ["layout"], "SELECT doc_id, n, trim(text) <> '' AS has_text FROM layout"),
    ("F2_route", ["routes"], r"SELECT doc_id, page, llm, chars, mode, reason FROM routes"),
    ("F3_multi_column", ["multi_pages"], r"SELECT doc_id, page, multi FROM multi_pages"),
    ("F4_tabular_geometry", ["tabular_pages"], r"SELECT doc_id, page, by_geometry AS tabular FROM tabular_pages"),
    ("F5_tabular_content", ["numeric_lines"], r"SELECT doc_id, page, count(CASE WHEN is_numeric THEN 1 END) AS numeric_lines, count(CASE WHEN is_numeric THEN 1 END) >= 3 AS tabular FROM numeric_lines GROUP BY doc_id, page"),
    ("F6_reroute", ["routes", "fills", "frames"], r""", v AS (SELECT doc_id, page, bool_or(has_fill) AS has_fill, bool_or(has_frame) AS has_frame FROM (SELECT doc_id, page, true AS has_fill, false AS has_frame FROM fills UNION ALL SELECT doc_id, page, false, true FROM frames) AS u GROUP BY doc_id, page)
        SELECT r.doc_id, r.page, r.llm, r.mode AS before, CASE WHEN r.mode = 'text' AND r.llm = 'auto' AND (coalesce(v.has_fill, false) OR coalesce(v.has_frame, false)) THEN 'llm' ELSE r.mode END AS mode,
        CASE WHEN r.mode = 'text' AND r.llm = 'auto' AND (coalesce(v.has_fill, false) OR coalesce(v.has_frame, false)) THEN concat('vector fills/frame present (', r.reason, ')') ELSE r.reason END AS reason FROM routes AS r LEFT JOIN v ON r.doc_id = v.doc_id AND r.page = v.page"""),
    ("F8_spanning", ["blocks", "page_box"], r"SELECT b.doc_id, b.page, b.n, b.w * 100 > 62 * p.width OR (b.x * 100 < 45 * p.width AND (b.x + b.w) * 100 > 55 * p.width) AS spanning FROM blocks AS b JOIN page_box AS p ON b.doc_id = p.doc_id AND b.page = p.page"),
    ("F9_margin_band", ["running"], r"SELECT page, k, CASE WHEN cy * 100 > 88 * page_h THEN 'header' WHEN cy * 100 < 12 * page_h THEN 'footer' END AS band FROM running"),
    ("F10_furniture", ["running"], r"SELECT page, k, layer = 'furniture' OR label IN ('page_header', 'page_footer') AS furniture FROM running"),
    ("F11_page_number", ["running"], r"SELECT page, k, like[raw;'^[0-9]+$']! OR like[lower(raw);'^[0-9]+\s+of\s+[0-9]+$']! OR like[lower(raw);'^page\s+[0-9]+(\s+of\s+[0-9]+)?$']! AS is_number FROM running"),
    ("F12_stray_marks", ["layout"], r"SELECT doc_id, page, n FROM layout WHERE trim(text) <> '' AND NOT (length(trim(text)) <= 2 AND w < 10)"),
    ("F13_numeric_cell", ["cells"], f"SELECT t, r, c, like[text;{NUMERIC}]! AS is_numeric FROM cells"),
    ("F14_list_line", ["layout"], rf"SELECT doc_id, page, n, like[text;{BULLET}]! AS bullet, like[text;{NUMBERED}]! AS numbered, CASE WHEN like[text;{BULLET}]! THEN trim(rx[text;'^\s*[•·▪◦‣*-]\s+';'']!) WHEN like[text;{NUMBERED}]! THEN trim(rx[text;'^\s*[0-9]+[.)]\s+';'']!) END AS item FROM layout"),
    ("F15_caption", ["blocks"], r"SELECT doc_id, page, n, like[lower(text);'^(fig[.]?|figure)\s*[0-9]+']! AS caption FROM blocks"),
    ("F16_background", ["drawings", "page_box"], r"SELECT d.doc_id, d.page, d.d, d.w >= p.width - 2 AND d.h >= p.height - 2 AS background FROM drawings AS d JOIN page_box AS p ON d.doc_id = p.doc_id AND d.page = p.page WHERE d.fill IS NOT NULL"),
    ("F17_frame_candidate", ["drawings", "page_box"], r"SELECT d.doc_id, d.page, d.d, d.w * 100 >= 60 * p.width AND d.w < p.width - 1 AND d.h * 100 >= 60 * p.height AND d.h < p.height - 1 AS frame FROM drawings AS d JOIN page_box AS p ON d.doc_id = p.doc_id AND d.page = p.page WHERE d.stroke IS NOT NULL"),
    ("F18_has_text", ["layout"], "SELECT doc_id, page, count(CASE WHEN trim(text) <> '' THEN 1 END) > 0 AS has_text FROM layout GROUP BY doc_id, page"),
    ("F19_pending", ["page_state"], "SELECT doc_id, page, status FROM page_state WHERE status <> 'completed'"),
    ("F23_full_width", ["blocks"], """, o AS (SELECT doc_id, page, n, w, row_number() OVER (PARTITION BY doc_id, page ORDER BY w, n) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS c FROM blocks), m AS (SELECT doc_id, page, max(CASE WHEN i = floor(c / 2) THEN w END) AS m FROM o GROUP BY doc_id, page)
        SELECT b.doc_id, b.page, b.n, b.w * 10 >= m.m * 16 AS is_full FROM blocks AS b JOIN m ON b.doc_id = m.doc_id AND b.page = m.page"""),
    ("F24_injected", ["page_box", "fills", "borders", "frames"], r""", f AS (SELECT doc_id, page, count(*) AS n, agg[fill; ','; f]! AS fills FROM fills GROUP BY doc_id, page)
        SELECT p.doc_id, p.page, coalesce(f.n, 0) AS n_fills, f.fills, b.color AS border_color, b.width AS border_width, r.color AS frame_color, r.width AS frame_width FROM page_box AS p LEFT JOIN f ON p.doc_id = f.doc_id AND p.page = f.page LEFT JOIN borders AS b ON p.doc_id = b.doc_id AND p.page = b.page AND b.place = 1 LEFT JOIN frames AS r ON p.doc_id = r.doc_id AND p.page = r.page"""),
    ("F25_prompt_tag", ["layout", "body"], r"SELECT l.doc_id, l.page, l.n, CASE WHEN l.size * 100 >= o.body * 115 THEN concat(' [HEADING ~', CAST(l.size AS STRING), 'pt]') WHEN l.flags >= 16 OR lower(l.font) LIKE '%bold%' OR lower(l.font) LIKE '%black%' OR lower(l.font) LIKE '%heavy%' THEN ' [bold]' ELSE '' END AS tag FROM layout AS l JOIN body AS o ON l.doc_id = o.doc_id AND l.page = o.page WHERE trim(l.text) <> ''"),
    ("F27_frame_wanted", ["page_box", "frames", "borders", "multi_pages"], r"SELECT p.doc_id, p.page, p.doc_id % 16 = 0 AS asked, p.doc_id % 16 = 0 OR r.d IS NOT NULL OR (m.multi AND b.color IS NOT NULL) AS frame_wanted FROM page_box AS p JOIN multi_pages AS m ON p.doc_id = m.doc_id AND p.page = m.page LEFT JOIN frames AS r ON p.doc_id = r.doc_id AND p.page = r.page LEFT JOIN borders AS b ON p.doc_id = b.doc_id AND p.page = b.page AND b.place = 1"),
    ("F28_classify", ["layout", "blocks", "levels"], rf""", l AS (SELECT doc_id, page, block, count(CASE WHEN like[text;{BULLET}]! OR like[text;{NUMBERED}]! THEN 1 END) AS items, max_by(CASE WHEN like[text;{NUMBERED}]! THEN 1 ELSE 0 END, 0 - n) AS ordered FROM layout GROUP BY doc_id, page, block),
        c AS (SELECT b.doc_id, b.page, b.n, b.y, b.x, b.text, v.level, l.ordered, CASE WHEN v.level IS NOT NULL AND b.n_lines <= 2 AND length(b.text) <= 120 THEN 'heading' WHEN l.items > 0 AND l.items >= b.n_lines - 1 THEN 'list' ELSE 'paragraph' END AS type
        FROM blocks AS b JOIN l ON b.doc_id = l.doc_id AND b.page = l.page AND b.n = l.block LEFT JOIN levels AS v ON b.doc_id = v.doc_id AND b.page = v.page AND b.size = v.size) SELECT doc_id, page, n, type, CASE WHEN type = 'heading' THEN level END AS level, CASE WHEN type = 'list' THEN ordered = 1 END AS ordered FROM c"""),
    ("J4_nearest_band", ["blocks"], r""", g AS (SELECT doc_id, page, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) > 40 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT doc_id, page, x FROM blocks) AS d),
        k AS (SELECT doc_id, page, x, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY x) AS INT) AS band FROM g), bands AS (SELECT doc_id, page, band, min(x) AS x0, max(x) AS x1 FROM k GROUP BY doc_id, page, band), near AS (SELECT b.doc_id, b.page, b.n, s.band, row_number() OVER (PARTITION BY b.doc_id, b.page, b.n ORDER BY abs(b.x - s.x0), s.band) AS k FROM blocks AS b JOIN bands AS s ON b.doc_id = s.doc_id AND b.page = s.page) SELECT doc_id, page, n, band FROM near WHERE k = 1"""),
    ("J5_figure_gaps", ["blocks", "images"], r", s AS (SELECT doc_id, page, n, text, y, lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS above FROM blocks), c AS (SELECT doc_id, page, n, greatest(coalesce(above, 0), y - 500) AS top, y AS bottom FROM s WHERE like[lower(text);'^(fig[.]?|figure)\s*[0-9]+']! AND y - greatest(coalesce(above, 0), y - 500) >= 60) SELECT c.doc_id, c.page, c.n FROM c LEFT ANTI JOIN images AS i ON c.doc_id = i.doc_id AND c.page = i.page AND c.top < i.y + i.h AND i.y < c.bottom"),
    ("J6_match_fill", ["blocks", "fill_text"], r""", bw AS (SELECT DISTINCT doc_id, page, n, word FROM (SELECT doc_id, page, n, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM blocks) AS q), fw AS (SELECT DISTINCT doc_id, page, f, word FROM (SELECT doc_id, page, f, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM fill_text WHERE fill IS NOT NULL) AS q),
        bn AS (SELECT doc_id, page, n, count(*) AS c FROM bw GROUP BY doc_id, page, n), fn AS (SELECT doc_id, page, f, count(*) AS c FROM fw GROUP BY doc_id, page, f),
        sh AS (SELECT b.doc_id, b.page, b.n, f.f, count(*) AS shared FROM bw AS b JOIN fw AS f ON b.doc_id = f.doc_id AND b.page = f.page AND b.word = f.word GROUP BY b.doc_id, b.page, b.n, f.f),
        sc AS (SELECT sh.doc_id, sh.page, sh.n, sh.f, shared + CASE WHEN shared = least(bn.c, fn.c) THEN 1 ELSE 0 END AS score FROM sh JOIN bn ON sh.doc_id = bn.doc_id AND sh.page = bn.page AND sh.n = bn.n JOIN fn ON sh.doc_id = fn.doc_id AND sh.page = fn.page AND sh.f = fn.f),
        best AS (SELECT doc_id, page, n, f, score, row_number() OVER (PARTITION BY doc_id, page, n ORDER BY score DESC, f) AS k FROM sc WHERE score >= 2) SELECT doc_id, page, n, f, score FROM sc WHERE score >= 2"""),
    ("J7_missing_fills", ["fills", "frames", "blocks", "fill_text"], r""", bw AS (SELECT DISTINCT doc_id, page, n, word FROM (SELECT doc_id, page, n, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM blocks) AS q), fw AS (SELECT DISTINCT doc_id, page, f, word FROM (SELECT doc_id, page, f, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM fill_text WHERE fill IS NOT NULL) AS q),
        bn AS (SELECT doc_id, page, n, count(*) AS c FROM bw GROUP BY doc_id, page, n), fn AS (SELECT doc_id, page, f, count(*) AS c FROM fw GROUP BY doc_id, page, f),
        sh AS (SELECT b.doc_id, b.page, b.n, f.f, count(*) AS shared FROM bw AS b JOIN fw AS f ON b.doc_id = f.doc_id AND b.page = f.page AND b.word = f.word GROUP BY b.doc_id, b.page, b.n, f.f),
        sc AS (SELECT sh.doc_id, sh.page, sh.n, sh.f, shared + CASE WHEN shared = least(bn.c, fn.c) THEN 1 ELSE 0 END AS score FROM sh JOIN bn ON sh.doc_id = bn.doc_id AND sh.page = bn.page AND sh.n = bn.n JOIN fn ON sh.doc_id = fn.doc_id AND sh.page = fn.page AND sh.f = fn.f),
        best AS (SELECT doc_id, page, n, f, score, row_number() OVER (PARTITION BY doc_id, page, n ORDER BY score DESC, f) AS k FROM sc WHERE score >= 2), want AS (SELECT DISTINCT doc_id, page, upper(replace(fill, '#', '')) AS fill FROM fills UNION SELECT doc_id, page, upper(replace(color, '#', '')) FROM frames),
        got AS (SELECT DISTINCT b.doc_id, b.page, upper(replace(t.fill, '#', '')) AS fill FROM best AS b JOIN fill_text AS t ON b.doc_id = t.doc_id AND b.page = t.page AND b.f = t.f WHERE b.k = 1) SELECT w.doc_id, w.page, w.fill FROM want AS w LEFT ANTI JOIN got AS g ON w.doc_id = g.doc_id AND w.page = g.page AND w.fill = g.fill"""),
    ("J8_coverage", ["page_words", "block_words"], r", h AS (SELECT p.page_id, count(b.word) AS hits, count(*) AS n FROM page_words AS p LEFT JOIN block_words AS b ON p.page_id = b.page_id AND p.word = b.word GROUP BY p.page_id) SELECT p.page_id, coalesce(h.hits, 0) AS hits, coalesce(h.n, 0) AS n, coalesce(h.hits * 10 >= h.n * 6, true) AS ok FROM pages AS p LEFT JOIN h ON p.page_id = h.page_id"),
    ("J9_unreferenced", ["images", "blocks"], r", a AS (SELECT doc_id, page, concat('img_', CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS STRING), '.png') AS asset FROM images), r AS (SELECT doc_id, page, 'img_1.png' AS asset FROM blocks WHERE n = 0 AND doc_id % 12 = 1) SELECT a.doc_id, a.page, a.asset FROM a LEFT ANTI JOIN r ON a.doc_id = r.doc_id AND a.page = r.page AND a.asset = r.asset"),
    ("J10_document_model", ["page_state", "attempts"], r", m AS (SELECT doc_id, page, min(attempt) AS manifest FROM attempts WHERE ok GROUP BY doc_id, page) SELECT s.doc_id, s.page, s.status, m.manifest, m.manifest IS NULL AS missing, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.page) AS place FROM page_state AS s LEFT JOIN m ON s.doc_id = m.doc_id AND s.page = m.page"),
    ("J11_hints", ["page_state", "fills", "frames", "images"], r""", gate AS (SELECT doc_id, page, status, rung FROM page_state WHERE status <> 'completed'),
        c AS (SELECT doc_id, page, upper(replace(fill, '#', '')) AS hex FROM fills UNION SELECT doc_id, page, upper(replace(color, '#', '')) FROM frames)
        SELECT DISTINCT c.doc_id, c.page, concat('injected fill #', c.hex, ' missing from output') AS hint FROM c JOIN gate AS g ON c.doc_id = g.doc_id WHERE c.hex = '111111'
        UNION ALL SELECT i.doc_id, i.page, concat('page has ', CAST(count(*) AS STRING), ' extracted image(s)') FROM images AS i LEFT SEMI JOIN gate AS g ON i.doc_id = g.doc_id GROUP BY i.doc_id, i.page
        UNION ALL SELECT doc_id, page, 'word coverage low overall' FROM gate WHERE coalesce(rung, 0) <> 1
        UNION ALL SELECT DISTINCT doc_id, 0, 'table overflow' FROM gate WHERE status = 'failed'"""),
    ("J12_picture_page", ["images", "page_box"], r"SELECT p.doc_id, p.page, i.i AS picture, concat('fig_', CAST(row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY i.i) AS STRING), '.png') AS file FROM page_box AS p JOIN images AS i ON p.doc_id = i.doc_id AND p.page = i.page"),
    ("J13_deref", ["layout", "images"], r""", r AS (SELECT doc_id, page, concat('#/texts/', CAST(n AS STRING)) AS ref FROM layout UNION ALL SELECT doc_id, page, concat('#/pictures/', CAST(i AS STRING)) FROM images UNION ALL SELECT doc_id, page, '#/tables/99' FROM images),
        s AS (SELECT doc_id, page, ref, rx[rx[ref;'^#/';'']!;'/.*$';'']! AS kind, CAST(rx[ref;'^.*/';'']! AS INT) AS idx FROM r), nodes AS (SELECT doc_id, page, 'texts' AS kind, n AS idx, text FROM layout UNION ALL SELECT doc_id, page, 'pictures', i, '' FROM images)
        SELECT s.doc_id, s.page, s.ref, s.kind, s.idx, n.text FROM s JOIN nodes AS n ON s.doc_id = n.doc_id AND s.page = n.page AND s.kind = n.kind AND s.idx = n.idx"""),
    ("J16_covered", ["banded_cells", "cell_bands"], "SELECT s.t, s.r, s.c, b.band AS k, s.next_band IS NOT NULL AND s.next_band <= b.band AS blocked FROM banded_cells AS s JOIN cell_bands AS b ON b.t = s.t AND b.band > s.band AND b.x0 + 4 < s.x_end"),
    ("J17_nested_columns", ["cells"], r""", s AS (SELECT t, r, CAST(sum(CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) AS INT) AS m, count(*) AS c FROM cells GROUP BY t, r), d AS (SELECT DISTINCT t, m, c FROM s), o AS (SELECT t, m, lag(m) OVER (PARTITION BY t ORDER BY c, m) AS below FROM d)
        SELECT t, bool_and(below IS NULL OR (m & below) = below) AS nested FROM o GROUP BY t"""),
    ("J18_remove_running", ["margin_lines", "running_groups"], r"SELECT r.page, r.k FROM margin_lines AS r LEFT ANTI JOIN running_groups AS g ON r.band = g.band AND r.norm = g.norm WHERE NOT (r.furniture AND r.band IS NOT NULL)"),
    ("A1_page_stats", ["layout", "images", "all_blocks"], r""", l AS (SELECT doc_id, page, sum(length(text)) AS chars, count(size) AS sized FROM layout GROUP BY doc_id, page), b AS (SELECT doc_id, page, count(*) AS n FROM all_blocks GROUP BY doc_id, page), i AS (SELECT doc_id, page, count(*) AS n FROM images GROUP BY doc_id, page)
        SELECT l.doc_id, l.page, CAST(l.chars AS BIGINT) AS chars, b.n + coalesce(i.n, 0) AS blocks, coalesce(i.n, 0) AS images, l.sized AS sizes FROM l JOIN b ON l.doc_id = b.doc_id AND l.page = b.page LEFT JOIN i ON l.doc_id = i.doc_id AND l.page = i.page"""),
    ("A2_body_size", ["body"], "SELECT doc_id, page, body FROM body"),
    ("A3_block_size", ["layout"], r", s AS (SELECT doc_id, page, block, size, sum(length(text)) AS wt, min(n) AS first_n FROM layout GROUP BY doc_id, page, block, size) SELECT doc_id, page, block, max_by(size, (wt, 0 - first_n)) AS size FROM s GROUP BY doc_id, page, block"),
    ("A4_heading_levels", ["levels"], "SELECT doc_id, page, size, level FROM levels"),
    ("A5_upper_median", ["blocks"], ", o AS (SELECT doc_id, page, length(text) AS v, row_number() OVER (PARTITION BY doc_id, page ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS c FROM blocks) SELECT doc_id, page, v AS median FROM o WHERE i = floor(c / 2)"),
    ("A6_border_histogram", ["borders"], r"SELECT doc_id, page, color, width, n, place FROM borders"),
    ("A7_band_population", ["blocks"], r""", g AS (SELECT doc_id, page, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) > 40 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT doc_id, page, x FROM blocks) AS d),
        k AS (SELECT doc_id, page, x, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY x) AS INT) AS band FROM g), bands AS (SELECT doc_id, page, band, min(x) AS x0, max(x) AS x1 FROM k GROUP BY doc_id, page, band) SELECT s.doc_id, s.page, s.band, count(*) AS n FROM bands AS s JOIN blocks AS b ON b.doc_id = s.doc_id AND b.page = s.page AND b.x BETWEEN s.x0 - 1 AND s.x1 + 1 GROUP BY s.doc_id, s.page, s.band HAVING count(*) >= 3"""),
    ("A8_running_elements", ["running_groups"], r"SELECT band, norm, pages, first_raw FROM running_groups"),
    ("A10_numeric_columns", ["cells"], f"SELECT t, c, bool_and(like[text;{NUMERIC}]!) AS is_numeric FROM cells WHERE r > 1 AND text <> '' GROUP BY t, c"),
    ("A12_word_counts", ["raw_lines"], "SELECT doc_id, CAST(sum(CASE WHEN trim(line) = '' THEN 0 ELSE length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 END) AS BIGINT) AS words FROM raw_lines GROUP BY doc_id"),
    ("A13_distinct_words", ["page_words"], "SELECT word, count(*) AS pages FROM page_words GROUP BY word"),
    ("A14_session", ["page_state"], "SELECT status, count(*) AS pages, CAST(sum(tries) AS BIGINT) AS tries, count(CASE WHEN rung > 1 THEN 1 END) AS escalated FROM page_state GROUP BY status"),
    ("A15_type_counts", ["html_blocks"], "SELECT type, count(*) AS n FROM html_blocks GROUP BY type"),
    ("A16_ragged", ["cells"], ", s AS (SELECT t, r, count(*) AS width FROM cells GROUP BY t, r) SELECT t, count(CASE WHEN width < m THEN 1 END) AS ragged FROM (SELECT t, r, width, max(width) OVER (PARTITION BY t) AS m FROM s) AS q GROUP BY t"),
    ("A17_cell_text", ["layout"], r", s AS (SELECT *, flags >= 16 OR lower(font) LIKE '%bold%' AS is_bold, flags % 4 >= 2 OR lower(font) LIKE '%italic%' OR lower(font) LIKE '%oblique%' AS is_italic FROM layout WHERE trim(text) <> '') SELECT doc_id, page, block, CAST(floor(x / 8.0 + 0.5) * 8 AS INT) AS key, agg[trim(text); ' '; y, n]! AS text, bool_and(is_bold) AS bold, bool_or(is_italic) AS italic, max(x + w) AS x_end FROM s GROUP BY doc_id, page, block, CAST(floor(x / 8.0 + 0.5) * 8 AS INT)"),
    ("A18_bbox_union", ["blocks"], "SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM blocks GROUP BY doc_id, page"),
    ("A19_dominant_font", ["layout"], r", d AS (SELECT doc_id, page, block, max_by(n, (length(trim(text)), size, 0 - n)) AS n FROM layout GROUP BY doc_id, page, block) SELECT d.doc_id, d.page, d.block, l.font, l.size, l.flags >= 16 OR lower(l.font) LIKE '%bold%' OR lower(l.font) LIKE '%black%' OR lower(l.font) LIKE '%heavy%' AS bold, l.flags % 4 >= 2 OR lower(l.font) LIKE '%italic%' OR lower(l.font) LIKE '%oblique%' AS italic FROM d JOIN layout AS l ON d.doc_id = l.doc_id AND d.n = l.n"),
    ("A20_verdict", ["page_state", "images", "fills"], r""", checks AS (SELECT doc_id, 'pages completed' AS name, bool_and(status = 'completed') AS ok FROM page_state GROUP BY doc_id UNION ALL SELECT doc_id, 'fills present', count(CASE WHEN fill = '#111111' THEN 1 END) = 0 FROM fills GROUP BY doc_id UNION ALL SELECT doc_id, 'images embedded', count(*) <= 2 FROM images GROUP BY doc_id)
        SELECT doc_id, bool_and(ok) AS ok, count(*) AS checks, count(CASE WHEN NOT ok THEN 1 END) AS failed FROM checks GROUP BY doc_id"""),
    ("A21_summary", ["layout", "fills"], r""", t AS (SELECT s.doc_id, s.page, s.n FROM layout AS s LEFT SEMI JOIN fills AS t ON t.doc_id = s.doc_id AND t.page = s.page AND s.x * 2 + s.w BETWEEN t.x * 2 AND (t.x + t.w) * 2 AND s.y * 2 + s.h BETWEEN t.y * 2 AND (t.y + t.h) * 2 WHERE trim(s.text) <> ''), a AS (SELECT doc_id, count(CASE WHEN trim(text) <> '' THEN 1 END) AS spans, count(DISTINCT page) AS pages FROM layout GROUP BY doc_id),
        b AS (SELECT doc_id, count(*) AS in_table FROM t GROUP BY doc_id), f AS (SELECT doc_id, count(*) AS tables FROM fills GROUP BY doc_id), n AS (SELECT a.doc_id, count(DISTINCT a.page * 100 + a.f) AS nested FROM fills AS a JOIN fills AS b ON a.doc_id = b.doc_id AND a.page = b.page AND a.f <> b.f AND b.x <= a.x + 2 AND b.y <= a.y + 2 AND b.x + b.w >= a.x + a.w - 2 AND b.y + b.h >= a.y + a.h - 2 GROUP BY a.doc_id)
        SELECT a.doc_id, a.pages, a.spans, coalesce(b.in_table, 0) AS in_table, coalesce(f.tables, 0) AS tables, coalesce(n.nested, 0) AS nested FROM a LEFT JOIN b ON a.doc_id = b.doc_id LEFT JOIN f ON a.doc_id = f.doc_id LEFT JOIN n ON a.doc_id = n.doc_id"""),
    ("A22_images_embedded", ["page_box", "images", "blocks"], r", e AS (SELECT doc_id, count(*) AS n FROM images GROUP BY doc_id), m AS (SELECT i.doc_id, count(*) AS n FROM images AS i JOIN page_box AS p ON i.doc_id = p.doc_id AND i.page = p.page WHERE i.page = 0 GROUP BY i.doc_id) SELECT d.doc_id, coalesce(m.n, 0) AS media, coalesce(e.n, 0) AS expected, coalesce(m.n, 0) >= coalesce(e.n, 0) AS ok FROM (SELECT DISTINCT doc_id FROM page_box) AS d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"),
    ("A23_page_counts", ["layout", "blocks"], ", a AS (SELECT doc_id, count(DISTINCT page) AS n FROM layout GROUP BY doc_id), b AS (SELECT doc_id, count(DISTINCT page) AS n FROM blocks GROUP BY doc_id) SELECT a.doc_id, a.n AS original, coalesce(b.n, 0) AS rendered, a.n = coalesce(b.n, 0) AS same FROM a LEFT JOIN b ON a.doc_id = b.doc_id"),
    ("W1_gap_clusters", ["blocks"], r""", g AS (SELECT doc_id, page, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) > 40 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT doc_id, page, x FROM blocks) AS d),
        k AS (SELECT doc_id, page, x, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY x) AS INT) AS band FROM g), bands AS (SELECT doc_id, page, band, min(x) AS x0, max(x) AS x1 FROM k GROUP BY doc_id, page, band) SELECT s.doc_id, s.page, s.band, s.x0, s.x1, count(*) AS n FROM bands AS s JOIN blocks AS b ON b.doc_id = s.doc_id AND b.page = s.page AND b.x BETWEEN s.x0 AND s.x1 GROUP BY s.doc_id, s.page, s.band, s.x0, s.x1"""),
    ("W3_segments", ["blocks"], r""", o AS (SELECT doc_id, page, n, w, row_number() OVER (PARTITION BY doc_id, page ORDER BY w, n) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS c FROM blocks), m AS (SELECT doc_id, page, max(CASE WHEN i = floor(c / 2) THEN w END) AS m FROM o GROUP BY doc_id, page), k AS (SELECT b.doc_id, b.page, b.n, b.x, b.y, CASE WHEN b.w * 10 >= m.m * 16 THEN 'full' ELSE 'columns' END AS kind FROM blocks AS b JOIN m ON b.doc_id = m.doc_id AND b.page = m.page), r AS (SELECT *, CASE WHEN kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id, page ORDER BY y, x, n), kind) THEN 1 ELSE 0 END AS brk FROM k), s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS INT) AS seg FROM r)
        SELECT doc_id, page, seg, kind, count(*) AS blocks, min(y) AS y FROM s GROUP BY doc_id, page, seg, kind"""),
    ("W5_column_span", ["banded_cells", "cell_bands"], "SELECT s.t, s.r, s.c, 1 + count(b.band) AS span FROM banded_cells AS s LEFT JOIN cell_bands AS b ON b.t = s.t AND b.band > s.band AND (s.next_band IS NULL OR b.band < s.next_band) AND b.x0 + 4 < s.x_end GROUP BY s.t, s.r, s.c"),
    ("W6_row_assembly", ["cells"], r""", l AS (SELECT t, r, c, CAST(floor(x / 8.0 + 0.5) * 8 AS INT) AS key, row_number() OVER (PARTITION BY t ORDER BY r, c) AS i FROM cells), f AS (SELECT t, min_by(key, i) AS leftmost FROM l GROUP BY t),
        s AS (SELECT l.t, l.i, l.key = f.leftmost AS is_left, lag(l.key = f.leftmost) OVER (PARTITION BY l.t ORDER BY l.i) AS was_left FROM l JOIN f ON l.t = f.t),
        b AS (SELECT t, i, CASE WHEN is_left AND was_left IS NOT NULL AND NOT was_left AND sum(CASE WHEN is_left THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS brk FROM s)
        SELECT t, i, CAST(sum(brk) OVER (PARTITION BY t ORDER BY i) AS INT) AS row_id FROM b"""),
    ("W7_relative_widths", ["cell_bands"], "SELECT t, band, coalesce(lead(x0) OVER (PARTITION BY t ORDER BY band) - x0, greatest(x1 - x0 + 60, 60)) AS width FROM cell_bands"),
    ("W8_list_coalescing", ["layout", "blocks", "levels"], rf""", l AS (SELECT doc_id, page, block, count(CASE WHEN like[text;{BULLET}]! OR like[text;{NUMBERED}]! THEN 1 END) AS items, max_by(CASE WHEN like[text;{NUMBERED}]! THEN 1 ELSE 0 END, 0 - n) AS ordered FROM layout GROUP BY doc_id, page, block),
        c AS (SELECT b.doc_id, b.page, b.n, b.y, b.x, b.text, v.level, l.ordered, CASE WHEN v.level IS NOT NULL AND b.n_lines <= 2 AND length(b.text) <= 120 THEN 'heading' WHEN l.items > 0 AND l.items >= b.n_lines - 1 THEN 'list' ELSE 'paragraph' END AS type
        FROM blocks AS b JOIN l ON b.doc_id = l.doc_id AND b.page = l.page AND b.n = l.block LEFT JOIN levels AS v ON b.doc_id = v.doc_id AND b.page = v.page AND b.size = v.size), b AS (SELECT *, CASE WHEN type = 'list' AND lag(type) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) = 'list' AND ordered = lag(ordered) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) THEN 0 ELSE 1 END AS brk FROM c), s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS INT) AS g FROM b),
        i AS (SELECT s.doc_id, s.page, s.g, s.type, s.ordered, s.y, s.x, s.n AS bn, l.n, trim(rx[rx[l.text;'^\s*[•·▪◦‣*-]\s+';'']!;'^\s*[0-9]+[.)]\s+';'']!) AS item FROM s JOIN layout AS l ON s.doc_id = l.doc_id AND s.page = l.page AND s.n = l.block WHERE s.type = 'list')
        SELECT doc_id, page, g, min(ordered) = 1 AS ordered, count(*) AS items, agg[item; '|'; y, x, bn, n]! AS text FROM i WHERE item <> '' GROUP BY doc_id, page, g"""),
    ("W9_break_mark", ["layout", "fills", "all_blocks"], r""", t AS (SELECT DISTINCT b.doc_id, b.page, b.n FROM all_blocks AS b JOIN fills AS t ON t.doc_id = b.doc_id AND t.page = b.page AND b.x * 2 + b.w BETWEEN t.x * 2 AND (t.x + t.w) * 2 AND b.y * 2 + b.h BETWEEN t.y * 2 AND (t.y + t.h) * 2),
        s AS (SELECT b.doc_id, b.page, b.n, b.y, b.x, t.n IS NOT NULL AS consumed FROM all_blocks AS b LEFT JOIN t ON b.doc_id = t.doc_id AND b.page = t.page AND b.n = t.n WHERE b.n_full > 0 OR t.n IS NOT NULL) SELECT doc_id, page, n, consumed, coalesce(lag(consumed) OVER (PARTITION BY doc_id, page ORDER BY y, x, n), false) AND NOT consumed AS break_before FROM s"""),
    ("W10_figure_gaps", ["blocks", "images", "page_box"], r", s AS (SELECT doc_id, page, n, text, y, lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS above FROM blocks), c AS (SELECT doc_id, page, n, greatest(coalesce(above, 0), y - 500) AS top, y AS bottom FROM s WHERE like[lower(text);'^(fig[.]?|figure)\s*[0-9]+']! AND y - greatest(coalesce(above, 0), y - 500) >= 60), k AS (SELECT * FROM c LEFT ANTI JOIN images AS i ON c.doc_id = i.doc_id AND c.page = i.page AND c.top < i.y + i.h AND i.y < c.bottom) SELECT k.doc_id, k.page, k.n, 72 AS x, k.top AS y, p.width - 144 AS w, k.bottom - k.top AS h, concat('fig_', CAST(row_number() OVER (PARTITION BY k.doc_id, k.page ORDER BY k.bottom, k.n) AS STRING), '.png') AS asset FROM k JOIN page_box AS p ON k.doc_id = p.doc_id AND k.page = p.page"),
    ("W11_xy_cut", ["blocks", "page_box"], r""", s AS (SELECT b.doc_id, b.page, b.n, b.y, CASE WHEN b.w * 100 > 62 * p.width OR (b.x * 100 < 45 * p.width AND (b.x + b.w) * 100 > 55 * p.width) THEN 1 ELSE 0 END AS sp, CASE WHEN b.x * 2 + b.w < p.width THEN 'L' ELSE 'R' END AS side, b.x * 2 + b.w AS cx FROM blocks AS b JOIN page_box AS p ON b.doc_id = p.doc_id AND b.page = p.page)
        SELECT doc_id, page, n, sp = 1 AS spanning, CAST(sum(sp) OVER (PARTITION BY doc_id, page ORDER BY y, cx, n) AS INT) AS band, CASE WHEN sp = 0 THEN side END AS side FROM s"""),
    ("W12_page_attach", ["layout"], r", s AS (SELECT doc_id, n, CASE WHEN trim(text) <> '' THEN page + 1 END AS p FROM layout) SELECT doc_id, n, coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page_no FROM s"),
    ("W13_page_ordinal", ["page_state"], "SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS INT) AS ordinal FROM page_state"),
    ("W14_first_style", ["attempts"], r"SELECT doc_id, min_by(rung, (page, attempt)) AS style, min_by(code, (page, attempt)) AS start FROM attempts WHERE ok GROUP BY doc_id"),
    ("W15_page_breaks", ["blocks"], r", s AS (SELECT doc_id, page, n, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, n) AS k, min(page) OVER (PARTITION BY doc_id) AS first_page FROM blocks) SELECT doc_id, page, n, CASE WHEN k = 1 AND page > first_page THEN 'NEXT_PAGE' ELSE 'CONTINUOUS' END AS type FROM s"),
    ("W18_exact_widths", ["cells"], ", s AS (SELECT DISTINCT t, c FROM cells), q AS (SELECT t, c, count(*) OVER (PARTITION BY t) AS k, row_number() OVER (PARTITION BY t ORDER BY c) AS i FROM s) SELECT t, c, CAST(CASE WHEN i = k THEN 9360 - floor(9360 / k) * (k - 1) ELSE floor(9360 / k) END AS INT) AS width FROM q"),
    ("W19_asset_numbers", ["images"], r"SELECT doc_id, page, i, concat('img_', CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS STRING), '.png') AS asset FROM images"),
    ("W20_column_order", ["blocks"], r""", g AS (SELECT doc_id, page, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) > 40 THEN 1 ELSE 0 END AS brk FROM (SELECT DISTINCT doc_id, page, x FROM blocks) AS d),
        k AS (SELECT doc_id, page, x, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY x) AS INT) AS band FROM g), bands AS (SELECT doc_id, page, band, min(x) AS x0, max(x) AS x1 FROM k GROUP BY doc_id, page, band), near AS (SELECT b.doc_id, b.page, b.n, b.y, s.band, row_number() OVER (PARTITION BY b.doc_id, b.page, b.n ORDER BY abs(b.x - s.x0), s.band) AS k FROM blocks AS b JOIN bands AS s ON b.doc_id = s.doc_id AND b.page = s.page) SELECT doc_id, page, n, band, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, y, n) AS place FROM near WHERE k = 1"""),
    ("W21_numbering", ["html_blocks"], "SELECT page_id, i, concat(CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS STRING), '. ', text) AS numbered, concat('• ', text) AS bulleted FROM html_blocks WHERE type = 'list'"),
    ("O1_reading_order", ["blocks"], ", s AS (SELECT doc_id, page, n, x, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, n) > 4 THEN 1 ELSE 0 END AS brk FROM blocks), g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY y, n) AS isl FROM s) SELECT doc_id, page, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY isl, x, n) AS place FROM g"),
    ("O2_bottom_up_order", ["blocks"], "SELECT doc_id, page, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, n) AS place FROM blocks"),
    ("O3_largest_frame", ["frames"], r"SELECT doc_id, page, d, color, width FROM frames"),
    ("O5_first_issues", ["page_state"], ", s AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM page_state WHERE status <> 'completed') SELECT doc_id, page FROM s WHERE i <= 3"),
    ("O6_merge_segments", ["blocks", "fills"], ", u AS (SELECT doc_id, page, y, 1 AS kind, n AS idx FROM blocks UNION ALL SELECT doc_id, page, y, 2, f FROM fills) SELECT doc_id, page, kind, idx, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, kind, idx) AS place FROM u"),
    ("O7_page_order", ["page_state"], "SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS place FROM page_state"),
    ("E1_union", ["blocks", "fills"], "SELECT doc_id, page, y FROM blocks UNION ALL SELECT doc_id, page, y FROM fills"),
    ("E2_intersect", ["page_words", "block_words"], "SELECT page_id, word FROM page_words INTERSECT SELECT page_id, word FROM block_words"),
    ("E3_except", ["page_words", "block_words"], "SELECT page_id, word FROM page_words EXCEPT SELECT page_id, word FROM block_words"),
    ("E4_subset", ["page_words", "block_words"], "SELECT p.page_id, count(b.word) = count(*) AS contained FROM page_words AS p LEFT JOIN block_words AS b ON p.page_id = b.page_id AND p.word = b.word GROUP BY p.page_id"),
    ("E5_distinct", ["fills"], "SELECT DISTINCT doc_id, fill FROM fills"),
    ("X1_significant_words", ["doc_words"], "SELECT doc_id, count(*) AS words FROM doc_words GROUP BY doc_id"),
    ("X2_norm", ["raw_lines"], "SELECT doc_id, n, trim(rx[rx[lower(line);'[0-9]+';'#']!;'\\s+';' ']!) AS norm FROM raw_lines"),
    ("X5_escape", ["raw_lines"], "SELECT doc_id, n, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM raw_lines"),
    ("X7_row_split", ["raw_lines"], "SELECT doc_id, n, length(line) - length(replace(line, '|', '')) AS bars, like[line;'^[ |:-]+$']! AS separator FROM raw_lines"),
    ("X12_pad", ["layout"], "SELECT doc_id, page, n, lpad(CAST(n AS STRING), 4, '0') AS padded FROM layout"),
    ("X13_flatten", ["html_blocks"], "SELECT page_id, agg[text; ' '; i]! AS text FROM html_blocks GROUP BY page_id"),
    ("X15_norm_hex", ["fills"], r"SELECT doc_id, page, f, lpad(substr(upper(rx[fill;'^#';'']!), 1, 6), 6, '0') AS hex, lpad(substr(upper(rx[substr(fill, 1, 4);'^#';'']!), 1, 6), 6, '0') AS short_hex FROM fills"),
    ("X16_contrast", ["drawings"], r", c AS (SELECT doc_id, page, d, lpad(hex(CAST((doc_id * 7919 + d * 104729) % 16777216 AS BIGINT)), 6, '0') AS h FROM drawings) SELECT doc_id, page, d, h, CASE WHEN 299 * ((instr('0123456789ABCDEF', substr(h, 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2, 1)) - 1) + 587 * ((instr('0123456789ABCDEF', substr(h, 3, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 4, 1)) - 1) + 114 * ((instr('0123456789ABCDEF', substr(h, 5, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 6, 1)) - 1) < 550 * 255 THEN 'FFFFFF' ELSE '1A1A1A' END AS text_color FROM c"),
    ("X17_border_size", ["drawings"], r"SELECT doc_id, page, d, width, CAST(greatest(2, floor(CASE WHEN width IS NULL OR width = 0 THEN 1 ELSE width END * 8 + 0.5)) AS INT) AS size FROM drawings WHERE stroke IS NOT NULL"),
    ("X18_tokens", ["documents"], "SELECT doc_id, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS tokens FROM documents"),
    ("X21_image_fit", ["fills"], "SELECT doc_id, page, f, CASE WHEN w > 250 THEN 250 ELSE w END AS w, CAST(CASE WHEN w > 250 THEN floor(h * 250.0 / w + 0.5) ELSE h END AS INT) AS h FROM fills"),
    ("X22_bucket", ["layout"], "SELECT doc_id, n, CAST(floor(x / 8.0 + 0.5) * 8 AS INT) AS b8, CAST(floor(x / 5.0 + 0.5) * 5 AS INT) AS b5 FROM layout"),
    ("X23_dpi", ["layout"], "SELECT doc_id, n, CAST(greatest(72, least(200, floor(1400 * 72 / w))) AS INT) AS dpi FROM layout"),
    ("X24_flags", ["layout"], r"SELECT doc_id, page, n, (flags & 16) > 0 OR lower(font) LIKE '%bold%' OR lower(font) LIKE '%black%' OR lower(font) LIKE '%heavy%' AS bold, (flags & 2) > 0 OR lower(font) LIKE '%italic%' OR lower(font) LIKE '%oblique%' AS italic, (flags & 16) > 0 OR font LIKE '%Bold%' AS span_bold FROM layout"),
    ("T3_resume", ["layout", "page_state"], ", p AS (SELECT DISTINCT doc_id, page FROM layout) SELECT p.doc_id, p.page FROM p LEFT ANTI JOIN page_state AS s ON p.doc_id = s.doc_id AND p.page = s.page AND s.status = 'completed'"),
    ("T4_ladder", ["attempts"], r", o AS (SELECT doc_id, page, rung, rank, attempt, ok, row_number() OVER (PARTITION BY doc_id, page, rung ORDER BY attempt) AS k FROM attempts), a AS (SELECT * FROM o WHERE k <= CASE WHEN rung = 'json' THEN 2 ELSE 1 END) SELECT doc_id, page, min_by(rung, (rank, attempt)) AS rung, min(rank) > 1 AS escalated FROM a WHERE ok GROUP BY doc_id, page"),
    ("T7_image_floor", ["attempts"], "SELECT doc_id, page, coalesce(min_by(CASE WHEN ok THEN rung END, CASE WHEN ok THEN (rank, attempt) END), 'image') AS rung FROM attempts GROUP BY doc_id, page"),
    ("T9_candidates", ["attempts"], "SELECT doc_id, min_by(rung, (rank, attempt)) AS chosen FROM attempts WHERE ok GROUP BY doc_id"),
    ("T10_retry_class", ["attempts"], r"SELECT attempt, code, message, CASE WHEN message LIKE 'Cancel%' OR message LIKE 'AbortError%' THEN 'fatal' WHEN message LIKE '%tool_use_failed%' THEN 'retry' WHEN code IN (400, 401, 402, 403, 404, 405, 406, 407, 409) THEN 'fatal' ELSE 'retry' END AS class FROM attempts"),
    ("T11_render_fallback", ["page_state", "blocks"], r"SELECT s.doc_id, s.page, CASE WHEN s.rung IS NOT NULL AND s.status = 'completed' THEN 'layout' ELSE 'plain paragraphs' END AS rendered, count(b.n) AS paragraphs, s.rung IS NULL OR s.status <> 'completed' AS warned FROM page_state AS s LEFT JOIN blocks AS b ON b.doc_id = s.doc_id AND b.page = s.page GROUP BY s.doc_id, s.page, s.rung, s.status"),
    ("F20_asset_name", ["images"], r", a AS (SELECT doc_id, page, concat('assets/page_', lpad(CAST(page + 1 AS STRING), 4, '0'), '/img_', CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS STRING), '.png') AS path FROM images) SELECT doc_id, page, path, rx[path;'^.*/';'']! AS name FROM a"),
    ("O4_best_fill", ["blocks", "fill_text"], r""", bw AS (SELECT DISTINCT doc_id, page, n, word FROM (SELECT doc_id, page, n, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM blocks) AS q), fw AS (SELECT DISTINCT doc_id, page, f, word FROM (SELECT doc_id, page, f, each[lower(text);'[\p{L}\p{N}]{3,}']! AS word FROM fill_text WHERE fill IS NOT NULL) AS q),
        bn AS (SELECT doc_id, page, n, count(*) AS c FROM bw GROUP BY doc_id, page, n), fn AS (SELECT doc_id, page, f, count(*) AS c FROM fw GROUP BY doc_id, page, f),
        sh AS (SELECT b.doc_id, b.page, b.n, f.f, count(*) AS shared FROM bw AS b JOIN fw AS f ON b.doc_id = f.doc_id AND b.page = f.page AND b.word = f.word GROUP BY b.doc_id, b.page, b.n, f.f),
        sc AS (SELECT sh.doc_id, sh.page, sh.n, sh.f, shared + CASE WHEN shared = least(bn.c, fn.c) THEN 1 ELSE 0 END AS score FROM sh JOIN bn ON sh.doc_id = bn.doc_id AND sh.page = bn.page AND sh.n = bn.n JOIN fn ON sh.doc_id = fn.doc_id AND sh.page = fn.page AND sh.f = fn.f),
        best AS (SELECT doc_id, page, n, f, score, row_number() OVER (PARTITION BY doc_id, page, n ORDER BY score DESC, f) AS k FROM sc WHERE score >= 2) SELECT b.doc_id, b.page, b.n, b.f, upper(replace(t.fill, '#', '')) AS fill FROM best AS b JOIN fill_text AS t ON b.doc_id = t.doc_id AND b.page = t.page AND b.f = t.f WHERE b.k = 1"""),
    ("X6_json_slice", ["events"], r""", s AS (SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN concat('```json', chr(10)) ELSE 'Result: ' END, props, CASE WHEN event_id % 2 = 0 THEN concat(chr(10), '```') ELSE ' end' END) AS raw FROM events WHERE props IS NOT NULL), f AS (SELECT event_id, trim(rx[rx[raw;'^```[a-zA-Z]*\s*';'']!;'```\s*$';'']!) AS raw FROM s)
        SELECT event_id, CASE WHEN instr(raw, '{') > 0 AND length(raw) - instr(reverse(raw), '}') + 1 > instr(raw, '{') THEN substr(raw, instr(raw, '{'), length(raw) - instr(reverse(raw), '}') + 2 - instr(raw, '{')) END AS layout FROM f"""),
    ("X10_caption_label", ["blocks"], r"SELECT doc_id, page, n, regexp_extract(text, '^((?:Figure|Table|Fig[.]) *[0-9]+)[.:]? *', 1) AS label, trim(rx[text;'^(Figure|Table|Fig[.]) *[0-9]+[.:]? *';'']!) AS caption FROM blocks WHERE like[text;'^(Figure|Table|Fig[.]) *[0-9]+']!"),
    ("X14_rgb_hex", ["drawings"], r", c AS (SELECT doc_id, page, d, CAST((doc_id * 37 + d * 91) % 256 AS INT) AS r, CAST((doc_id * 53 + d * 17) % 256 AS INT) AS g, CAST((doc_id * 11 + d * 201) % 256 AS INT) AS b FROM drawings) SELECT doc_id, page, d, concat('#', lpad(hex(CAST(r * 65536 + g * 256 + b AS BIGINT)), 6, '0')) AS hex, concat('#', lower(lpad(hex(CAST(r * 65536 + g * 256 + b AS BIGINT)), 6, '0'))) AS hex_of_int FROM c"),
]
